import hashlib
import random
import re

from quire.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(n * 2 - 9 * (n > 4) if i % 2 else n for i, n in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def brute(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append(f"{kind}:{m.start()}:{m.end()}")
    return found


def test_base_spans_match_plain_patterns(spark, tables):
    rng = random.Random(8)
    pieces = ["a@b.c", "@", "x.y", "_", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+", " ", "-", "é", "\n", "7", "(", "mail me", "💡"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 14))) for _ in range(1500)] + ["a@b.co " * 1000, "1" * 20_000, "a" * 50_000, "12 " * 20_000, None]
    d = tables(documents=("doc_id long, text string", list(enumerate(texts))))
    for r in pii.query(spark, d).collect():
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(w.startswith(k) for w in want) for k in PLAIN]
        assert set(want) <= set(r["spans"].split(",")) | {""}


def test_added_kinds_need_a_checksum_or_context(spark, tables):
    texts = ["pay to DE89 3704 0044 0532 0130 00 now", "pay to DE88 3704 0044 0532 0130 00 now", "my ssn is 123-45-6789", "part 123-45-6789"]
    got = {r["doc_id"]: r["spans"] for r in pii.query(spark, tables(documents=("doc_id long, text string", list(enumerate(texts))))).collect()}
    assert got == {0: "iban:7:34", 1: "", 2: "ssn:10:21", 3: ""}


ADDED = {
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 70, "iban bank account konto compte cuenta", "serial part order model"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 40, "ssn social security", "order serial isbn"),
    "aba": (r"(?<![0-9.-])[0-9]{9}(?![0-9.-])", 40, "aba routing transit rtn", "order serial isbn invoice"),
    "nhs": (r"(?<![0-9.-])[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{4}(?![0-9.-])", 40, "nhs patient hospital", "order serial isbn phone tel"),
}


def holds(kind, value):
    d = [int(c) for c in value if c.isdigit()]
    bare = value.replace(" ", "")
    if kind == "iban":
        return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    if kind == "ssn":
        a, b, c = value.split("-")
        return a not in ("000", "666") and a[0] != "9" and b != "00" and c != "0000"
    if kind == "aba":
        return any(d) and sum(x * w for x, w in zip(d, [3, 7, 1] * 3)) % 10 == 0
    return any(d) and (11 - sum(x * w for x, w in zip(d, range(10, 1, -1))) % 11) % 11 == d[9]


def added(text):
    out = []
    for kind, (pattern, base, up, down) in ADDED.items():
        hits = list(re.finditer(pattern, text or ""))
        for i, m in enumerate(hits):
            left = max(hits[i - 1].end() if i else 0, m.start() - pii.AROUND)
            right = min(hits[i + 1].start() if i + 1 < len(hits) else len(text), m.end() + pii.AROUND)
            near = (text[left : m.start()] + " " + text[m.end() : right]).lower()
            said = lambda words, near=near: any(re.search(rf"(?<![a-z]){w}", near) for w in words.split())
            score = base + 30 * said(up) - 20 * said(down)
            if holds(kind, m[0]) and score >= 60:
                out.append((f"{kind}:{m.start()}:{m.end()}", score))
    return out


def test_added_kinds_like_a_plain_version(spark, tables):
    rng = random.Random(4)
    pieces = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "GB83WEST12345698765432", "123-45-6789", "666-45-6789", "123-00-6789", "021000021", "021000022", "943 476 5919", "9434765919", "943-476-5918", "000000000"]
    words = ["bank", "IBAN", "order", "serial", "my ssn", "social", "routing", "ABA", "NHS", "patient", "tel", "xbank", "é", "\n", ",", "x" * 60]
    texts = [" ".join(rng.choice(pieces if rng.random() < 0.4 else words) for _ in range(rng.randrange(1, 9))) for _ in range(800)] + [None, "", "GB82WEST12345698765432", "serial GB82WEST12345698765432", "routing 021000021 " * 300]
    found = 0
    for r in pii.query(spark, tables(documents=("doc_id long, text string", list(enumerate(texts))))).collect():
        spans = [x for x in r["spans"].split(",") if x]
        got = [(x, int(n)) for x, n in zip(spans, [n for n in r["scores"].split(",") if n], strict=True) if x.split(":")[0] in ADDED]
        assert got == added(texts[r["doc_id"]]), texts[r["doc_id"]]
        found += len(got)
    assert found > 300 and not added("serial GB82WEST12345698765432") and added("GB82WEST12345698765432")
