import hashlib
import random

import pytest

from quire.llm import mixing


def share_out(sizes):
    """Targets by resharing what is over the caps, round after round."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        out = fixed | {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if out[s] > 2 * sizes[s]]
        if not over:
            return out
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_targets_and_taken_words(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(["w"] * rng.randrange(0, 400)), rng.choice(["b", "a", "é", "z", None, "Big", "Big", "Big"])) for i in range(3000)] + [(9000, None, "a"), (9001, "x y", "only")]
    out = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    sizes = {}
    for _, text, s in docs:
        sizes[s] = sizes.get(s, 0) + len((text or "").split())
    want = share_out(sizes)
    taken = {}
    for r in out:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    for s, t in taken.items():
        gap = want[s] - t
        assert gap >= -1e-6
        # near: within a thousandth, or no document fits into what is left
        whole = want[s] // sizes[s]
        assert gap <= want[s] / 1000 or all(r["size"] > gap for r in out if r["source"] == s and r["copies"] == whole and r["size"]), (s, t, want[s])


def test_inclusion_is_as_planned_and_reruns_agree(spark):
    docs = spark.createDataFrame([(i, "a b c d", "x" if i % 4 else "y") for i in range(4000)], "doc_id long, text string, source string")
    a, b = ({r["doc_id"]: r["copies"] for r in mixing.mix(docs.repartition(n)).collect()} for n in (1, 7))
    assert a == b
    other = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, seed="other").collect()}
    assert other != a and sum(other.values()) == sum(a.values())


def by_hand(docs, goals, seed=mixing.SEED):
    """Copies of each document by ranking one source after another, document by document."""
    out = {}
    size = {i: len((t or "").split()) for i, t, _ in docs}
    for source, target in goals.items():
        ids = [i for i, t, s in docs if s == source]
        total = sum(size[i] for i in ids)
        whole = int(target // total) if total else 0
        due = target - whole * total
        strata = {}
        for i in ids:
            strata[len(str(size[i]))] = strata.get(len(str(size[i])), 0) + size[i]
        p, left, open_ = {}, due, dict(strata)
        while open_:
            level = left / sum(d * w for d, w in open_.items()) if sum(open_.values()) else 0.0
            full = [d for d in open_ if level * d > 1]
            if not full:
                p |= {d: level * d for d in open_}
                break
            for d in full:
                p[d] = 1.0
                left -= open_.pop(d)
        taken = {i for i in ids if due > 0 and size[i] and p[len(str(size[i]))] >= 1}
        gap = due - sum(size[i] for i in taken)
        odds = {}
        for i in ids:
            q = p[len(str(size[i]))]
            if size[i] and 0 < q < 1:
                u = (int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                odds[i] = (u / (1 - u)) / (q / (1 - q))
        for _ in range(2):
            room = gap
            for i in sorted((i for i in odds if i not in taken and size[i] <= room), key=lambda i: (odds[i], i)):
                if size[i] > gap:
                    break
                taken.add(i)
                gap -= size[i]
        fits = [i for i in odds if i not in taken and size[i] <= gap]
        if fits:
            taken.add(min(fits, key=lambda i: (-size[i], odds[i], i)))
        out |= {i: whole + (i in taken) if size[i] else 0 for i in ids}
    return out


@pytest.mark.parametrize("slice_rows", [3, 2000])
def test_same_as_document_by_document(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    rng = random.Random(11)
    docs = [(i, " ".join(["w"] * int(10 ** rng.uniform(0, 3.2))), rng.choice(["a", "b", "c", "d", None, "z", "z", "z"])) for i in range(900)] + [(901, None, "a"), (902, "", "empty"), (903, "one", "single")]
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    got = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert got == by_hand(docs, share_out(sizes))


def test_inclusion_differs_by_document(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(["w"] * rng.choice([5, 50, 500])), "x" if i % 3 else f"y{i % 9}") for i in range(6000)], "doc_id long, text string, source string")
    out = mixing.mix(docs).filter("source = 'x'").collect()
    more = {}
    for r in out:
        more.setdefault(r["size"], []).append(r["copies"] - min(x["copies"] for x in out))
    share = {n: sum(v) / len(v) for n, v in more.items()}
    assert 1.6 < share[50] / share[5] < 2.4 and 1.2 < share[500] / share[50] < 1.8  # as the digits: 1, 2, 3


def test_whole_documents_keep_their_columns(spark):
    schema = "doc_id long, text string, source string, size string, gap int, row array<int>, copies long, key string, digits int, p double"
    rows = [(i, "w " * (i % 50), "s" if i % 2 else None, "own", i, [i], 7, "k", 1, 0.5) for i in range(200)] + [(5, "same row", "s", None, None, None, None, None, None, None)] * 3 + [(None, None, "s", "x", 1, [1], 1, "k", 1, 0.5)]
    docs = spark.createDataFrame(rows, schema)
    got = mixing.mixed_documents(docs)
    assert got.schema == docs.schema
    key = lambda r: repr(tuple(r))
    copies = {}
    for r in mixing.mix(docs).collect():
        copies.setdefault((r["doc_id"], r["size"]), []).append(r["copies"])
    assert all(len(set(v)) == 1 for v in copies.values())  # rows alike are taken alike
    want = sorted(key(r) for r in docs.collect() for _ in range(copies[(r["doc_id"], len((r["text"] or "").split()))][0]))
    assert sorted(map(key, got.collect())) == want
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
