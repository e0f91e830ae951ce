import math

import numpy as np
from quire.llm import vectors


def test_recall_and_links_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 32))
    near = base[:60].repeat(6, 0) + 0.06 * rng.standard_normal((360, 32))
    edge = base[60:120] + 0.42 * rng.standard_normal((60, 32))  # about the threshold
    x = np.concatenate([base, near, edge, np.tile(base[0], (700, 1)) * (1 + 0.01 * rng.standard_normal((700, 32)))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = (y @ y.T >= 0.9).sum(1) - 1
    links = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (links <= want).all() and links.sum() >= 0.97 * want.sum()
    assert got[300]["component_id"] == got[301]["component_id"] and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_plan_follows_size_and_threshold():
    k1, t1, w = vectors.plan(1000)
    k2, t2, _ = vectors.plan(1_000_000)
    assert k2 > k1 and t2 > t1 and math.isclose(w, 4 * math.sqrt(0.2))
    assert 1 - (1 - vectors.collision(4.0) ** k1) ** t1 >= vectors.RECALL


def test_vectors_that_cannot_be_compared(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("inf"), 1.0]), (5, [1.0, 1.0]), (6, [2.0, 2.0]), (7, [1e-30, 1e-30]), (8, [1.0, -1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (0, 4), 5: (2, 5), 6: (2, 5), 7: (2, 5), 8: (0, 8)}


def test_lengths_are_compared_among_themselves(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.99, 0.01, 0.0]), (3, [1.0, 0.0]), (4, [2.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0]), (7, [5.0]), (8, [-5.0]), (9, []), (10, None), (11, [0.0, 0.0]), (12, [1.0, float("nan")]), (13, [1.0, 0.0, 0.0, 0.0])]
    out = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out}
    want = {i: (0, i) for i in range(1, 14)} | {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 6: (1, 6), 7: (1, 6)}
    assert got == want
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_copies_of_a_vector_are_one_class(spark):
    """6,000 copies, in two scales that have one unit vector, cost no more than one: all pairs would be 18 million cosines in every table."""
    rng = np.random.default_rng(5)
    one, near = rng.standard_normal(16), rng.standard_normal(16)
    near = one + 0.1 * near
    rows = [(i, (one * (2 if i % 2 else 1)).tolist()) for i in range(10, 6010)] + [(3, near.tolist()), (9000, near.tolist()), (5, (-one).tolist())]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()}
    assert got[5] == (0, 5, True) and got[3] == (6001, 3, True) and got[9000] == (6001, 3, False)
    assert {got[i] for i in range(10, 6010)} == {(6001, 3, False)}
