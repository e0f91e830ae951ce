"""Labels of the tree, running sums and ranks, beside plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import ranks, sections, telemetry, trees

SCHEMA = "id string, parent_id string, title string, byte_start long, seq int"


def plain(rows):
    """id: (root, depth, enter, leave)."""
    up = {i: p if p in {r[0] for r in rows} and p != i else None for i, p, *_ in rows}
    for i in list(up):  # loops end at their smallest id
        seen, x = [], i
        while x is not None and x not in seen:
            seen.append(x)
            x = up[x]
        if x is not None:
            up[min(seen[seen.index(x) :])] = None
    kids = {}
    for i, _, _, at, seq in sorted(rows, key=lambda r: (r[3], r[4], r[0])):
        kids.setdefault(up[i], []).append(i)
    out = {}
    for root in kids.get(None, []):
        at, todo = 0, [(root, 0, False)]
        while todo:
            x, depth, done = todo.pop()
            if done:
                out[x][3] = at - 1
                continue
            out[x] = [root, depth, at, None]
            at += 1
            todo.append((x, depth, True))
            todo += [(k, depth + 1, False) for k in reversed(kids.get(x, []))]
    return {i: tuple(v) for i, v in out.items()}


def trees_of(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(160):
        p = "" if i < 3 else f"s{rng.randrange(max(0, i - rng.choice([3, 40])), i):03d}"
        rows.append((f"s{i:03d}", rng.choice([p] * 9 + [None, "gone"]), f"t{i}", rng.randrange(4), rng.randrange(3)))
    return rows + [("self", "self", "x", 0, 0), ("la", "lb", "x", 0, 0), ("lb", "lc", "x", 1, 0), ("lc", "la", "x", 1, 0), ("ld", "lb", "x", 0, 0), ("le", "ld", "x", 0, 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_labels_of_forests_with_loops(spark, seed):
    rows = trees_of(seed)
    got = {r["id"]: (r["root"], r["depth"], r["enter"], r["leave"]) for r in trees.labels(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == plain(rows)


def test_a_chain_of_5000_levels(spark):
    n = 5000
    rows = [(f"s{i}", f"s{i - 1}" if i else "", f"t{i}", i, 0) for i in range(n)]
    s = spark.createDataFrame(rows, SCHEMA).cache()
    labelled = trees.labels(s).cache()
    assert labelled.filter("root = 's0' AND depth = enter AND leave = 4999 AND id = concat('s', depth)").count() == n
    assert sections.descendants(s, "s10", labels=labelled).agg(F.count("*"), F.max("depth")).first() == (n - 11, n - 11)
    assert sections.descendants(s, "s10", 7, labels=labelled).count() == 7
    path = sections.section_path(s, "s4999", labels=labelled)
    assert [(r["depth"], r["id"]) for r in path.orderBy("depth").collect()] == [(i, f"s{n - 1 - i}") for i in range(n)]
    assert sections.section_path(s, "none", labels=labelled).count() == 0


def test_no_sections(spark):
    assert trees.labels(spark.createDataFrame([], SCHEMA)).count() == 0


def test_running_sums_of_a_group_that_lies_in_many_slices(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), i, rng.choice([None, 1, 2, 5])) for i in range(5000)]
    got = {(r["g"], r["at"]): (r["sum"], r["all"]) for r in ranks.running(spark.createDataFrame(rows, "g string, at int, v int").repartition(5), ["g"], ["at"], F.col("v"), "sum", "all").collect()}
    sums = {}
    for g, at, v in rows:
        sums[g] = sums.get(g, 0) + (v or 0)
        assert got[g, at][0] == sums[g]
    assert all(got[g, at][1] == sums[g] for g, at, _ in rows) and len(got) == 5000
    assert ranks.running(spark.createDataFrame([], "g string, at int, v int"), ["g"], ["at"], F.col("v"), "sum").count() == 0


def test_ranks_with_ties_and_nulls(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 10 else "b", rng.choice([1.5, 2.5, None, rng.random()]), 1) for i in range(3000)] + [("none", None, 0)]
    got = {r["tool"]: r for r in telemetry.latency_stats(spark.createDataFrame(rows, "tool string, duration_ms double, ok int").repartition(4)).collect()}
    for tool in ("hot", "b"):
        known = sorted(v for t, v, _ in rows if t == tool and v is not None)
        for name, p in (("p50_ms", 0.5), ("p95_ms", 0.95)):
            assert got[tool][name] == round(known[round(p * (len(known) - 1))], 3)
        assert got[tool]["calls"] == sum(t == tool for t, *_ in rows)
    assert got["none"]["p50_ms"] is None and got["none"]["error_rate"] == 1.0
