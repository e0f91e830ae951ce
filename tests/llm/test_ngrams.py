import itertools
import random

import numpy as np

from quire.llm import ngrams


def sets(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_links_like_all_pairs(spark):
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(3000)]
    docs = []
    for g in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randrange(3, 150))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            docs.append((len(docs), " ".join(own)))
    big = [rng.choice(vocab) for _ in range(200)]
    for i in range(700):  # more than a block
        own = list(big)
        own[rng.randrange(200)] = f"x{i}"
        docs.append((len(docs), " ".join(own)))
    docs += [(len(docs), None), (len(docs) + 1, " "), (len(docs) + 2, "One"), (len(docs) + 3, "one")]
    got = {r["doc_id"]: r for r in ngrams.ngram_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    s = {i: sets(t) for i, t in docs}
    ids, want = list(s), {i: 0 for i in s}
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b]):
                want[a] += 1
                want[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    found = sum(r["n_links"] for r in got.values())
    assert all(got[i]["n_links"] <= want[i] for i in ids) and found >= 0.99 * sum(want.values())
    assert sum(got[i]["component_id"] == find(i) for i in ids) >= 0.99 * len(ids)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_bands_are_done_at_the_depth_that_their_recall_needs():
    done = ngrams.band_depths(ngrams.JACCARD, ngrams.RECALL)
    assert done[-1] == ngrams.DEEP and set(done) == {5, 6, 7, 8} and done == sorted(done)
    for equal, depth in enumerate(done):
        assert ngrams.found_chance(max(0.8, equal / 128), depth) >= ngrams.RECALL
    assert {d for k, d in enumerate(done) if k / 128 <= 0.9} == {5}  # a pair at the threshold is not taken for a near copy


def test_the_walk_gives_each_pair_of_a_subtree_once_where_its_prefixes_part():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 2, (90, 128)).astype(np.uint8)
    s[:, : 8 * ngrams.TREES : 8] = 1
    t = np.repeat([0, 3, 7], 30)
    side = np.concatenate([np.zeros(60, int), np.resize([1, 2], 30)])
    bounds = np.array([0, 30, 60, 90])
    got = {}
    for a, b, depth in ngrams._walker(1)(bounds, side, s, t):
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            assert (min(i, j), max(i, j)) not in got
            got[min(i, j), max(i, j)] = depth
    want = {}
    for g in range(3):
        for i, j in itertools.combinations(range(30 * g, 30 * g + 30), 2):
            if side[i] == 0 or side[i] != side[j]:
                same = s.reshape(90, 16, 8)[i, t[i]] == s.reshape(90, 16, 8)[j, t[j]]
                want[i, j] = 8 if same.all() else int(same.argmin())
    assert got == want


def test_near_copies_are_harvested_from_long_prefixes_only():
    keep = ngrams._keeper(ngrams.JACCARD, ngrams.RECALL)
    base = np.arange(128, dtype=np.uint8)
    near, far = base.copy(), base.copy()
    near[[3, 60]] += 100  # two labels differ: trees 0 and 7
    far[np.arange(0, 128, 5)] += 100  # 102 of 128 are equal, in runs of four at most
    s, t = np.stack([base, near, far]), np.array([1, 1, 1])
    at = lambda i, depth: bool(keep(s, t, np.array([0]), np.array([i]), depth)[0])
    assert at(1, 8) and not at(1, 7) and not at(2, 8)
    t[:] = 2
    assert not at(1, 8)  # tree 1 has it already


def test_chunks_do_not_change_shingles():
    texts = [b"a b c d e f", b"", b"One two", b"x " * 50]
    (_, first), (hashes, bounds) = ngrams.shingles(texts)
    for i, t in enumerate(texts):
        _, (own, ends) = ngrams.shingles([t])
        assert own[: ends[1]].tolist() == hashes[bounds[i] : bounds[i + 1]].tolist()
    assert first.tolist() == [0, 6, 6, 8, 58]


def test_near_copies_without_an_id(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    near = [*words[:60], "changed", *words[61:]]
    rows = [(None, " ".join(words)), (7, " ".join(near)), (9, " ".join(words)), (None, "alone here"), (3, None)]
    out = ngrams.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((str(r["doc_id"]), r["n_links"], r["component_id"], r["kept"]) for r in out)
    assert got == [("3", 0, 3, True), ("7", 2, 7, True), ("9", 2, 7, False), ("None", 0, None, True), ("None", 2, 7, False)]
    only = ngrams.ngram_join(spark.createDataFrame([(None, " ".join(words)), (None, " ".join(near)), (1, "x")], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_links"], r["component_id"], r["kept"]) for r in only) == [("1", 0, 1, True), ("None", 1, None, True), ("None", 1, None, True)]
