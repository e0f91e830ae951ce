import hashlib
import random
import zlib

import pytest

from quire.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, place long, level int, path string, up int"
MORE = ("x", 1, 2, "p", 3)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, text, lang, source, n):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def climb(digests, fanout):
    """The root, and for each leaf its siblings level by level as (before, after)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for leaf_no, p in enumerate(at):
            run, k = runs[p // fanout], p % fanout
            paths[leaf_no].append((run[:k], run[k + 1 :]))
        at, level = [p // fanout for p in at], [H(*r) for r in runs]
    return level[0], paths


def plain(rows, fanout=2):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))):
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([leaf(*r) for r in groups[g]], fanout) for g in order}
    root, upper = climb([trees[g][0] for g in order], fanout)
    out = []
    for g, top in zip(order, upper, strict=True):
        for r, own in zip(groups[g], trees[g][1], strict=True):
            i, text, lang, source, n = r
            bad = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
            digest, path = leaf(i, text, lang, source, n + 1 if bad else n), own + top
            for before, after in path:
                digest = H(*before, digest, *after)
            out.append((i, leaf(*r), trees[g][0], root, H(*[x for b, a in path for x in b + a]), digest, digest == root))
    return sorted(out, key=str)


def rows(n):
    rng = random.Random(n)
    made = [(i * 3, f"text {rng.random()} é", rng.choice(["en", "en", "en", "de", "é", ""]), rng.choice(["a", "b", None]), rng.choice([5, 7, None])) for i in range(n)]
    return made + [(None, None, None, None, None), (None, "", "en", "", 0), (4, "x" * 200_000, None, "s", 9), (4, "x", "alone", "s", 9)] + made[:2] * 2


@pytest.mark.parametrize("n", [0, 1, 6, 61])
def test_like_a_plain_tree(spark, n):
    docs = spark.createDataFrame([(*r, *MORE) for r in rows(n)], SCHEMA).repartition(3)
    got = merkle.proofs(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows(n))


@pytest.mark.parametrize("given", [[], [(7, "one", "en", "s", 3)], [(i, "t", "en", "s", 1) for i in range(5)]])
def test_no_row_one_row_one_group(spark, given):
    got = merkle.proofs(spark.createDataFrame([(*r, *MORE) for r in given], SCHEMA))
    assert sorted(map(tuple, got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str) == (plain(given) if given else [])


def test_other_fanouts(spark):
    given = rows(40)
    found = merkle.manifest(spark.createDataFrame([(*r, *MORE) for r in given], SCHEMA), fanout=3).collect()
    want = {r[1]: r[3] for r in plain(given, 3)}
    assert len(found) == len(given) and {r["leaf"]: r["root"] for r in found} == want
    for r in found:
        digest = r["leaf"]
        for x in r["path"]:
            s = x["siblings"].hex()
            digest = H(s[: 64 * x["before"]], digest, s[64 * x["before"] :])
        assert digest == r["root"]
