import random
import re
from collections import Counter, defaultdict

from quire.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, c long, term string, p long, v long, item string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, min_docs=3, ranks=200):
    df, groups, langs = defaultdict(Counter), {}, set()
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        df[lang or ""].update(set(terms))
        groups.setdefault((lang or "", source or ""), Counter()).update(terms)
    out = []
    f = lambda p, q: (p - q) ** 2 // q
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, n in df[lang].items() if n >= min_docs)
        own = {s: {t: c[t] for t in kept} for (g, s), c in groups.items() if g == lang}
        own[None] = {t: sum(x[t] for x in own.values()) for t in kept}
        p = {s: {t: 1 + 10**9 * (x[t] + 1) // (sum(x.values()) + len(kept)) for t in kept} for s, x in own.items()}
        for s in own:
            if s is None:
                continue
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in own if o is not None and o != s]
            terms = [(t, f(p[s][t], p[None][t])) for t in kept if own[s][t] and p[s][t] > p[None][t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def made(n):
    rng = random.Random(n)
    vocab = [f"{a}{b}" for a in ("wort", "Élan", "é", "Ab", "z", "İx") for b in "abcdefghijklmnopqrstuvwxyz"]
    rows = [(" ".join(rng.choice(vocab) if rng.random() < 0.7 else "the" for _ in range(rng.randrange(30))) + ", 12 don't", rng.choice(["en", "en", "de", None, ""]), rng.choice("abcde") if rng.random() < 0.9 else None) for _ in range(n)]
    return rows + [(None, "en", "empty"), ("", "xx", "a"), ("once", "xx", "b"), (None, None, None), ("the " * 20_000, "en", "a")] + rows[:3] * 2


def test_like_a_plain_audit(spark):
    for n, ranks in ((0, 200), (150, 200), (150, 4)):
        rows = made(n)
        docs = spark.createDataFrame([(i, *r, 1, "t", 2, 3, "x") for i, r in enumerate(rows)], SCHEMA).repartition(3)
        got = divergence.audit(docs, ranks=ranks).select("lang", "source", "part", "item", "value", "rank").collect()
        assert sorted(map(tuple, got)) == plain(rows, ranks=ranks)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    c, n, v = 10**17 + 3, 7 * 10**17 + 11, 123_456_789
    row = spark.range(1).select(divergence.share(*[F.lit(x).cast("long") for x in (c, n, v)]).alias("p"), divergence.divergence(F.lit(10**9 + 1).cast("long"), F.lit(1).cast("long")).alias("f")).first()
    assert row["p"] == 1 + 10**9 * (c + 1) // (n + v) and row["f"] == 10**18
