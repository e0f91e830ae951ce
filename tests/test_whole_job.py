"""Queries and operators that must not leave out a part of their input."""

import random

from pyspark.sql import functions as F

from quire import queries
from quire.operators import search, sections
from quire.plans import relations

SF = "/root/testdata/sf0.001"


def test_fusion_ranks_more_rows_than_any_cut(spark):
    """1,500 hits: a row at the top of one list may stand far down the other, and its share there counts."""
    rng = random.Random(3)
    rows = [(f"d{i:04}", "t", "", " ".join(["needle"] * rng.randrange(1, 9) + ["hay"] * rng.randrange(1, 200)), [rng.random(), rng.random()]) for i in range(1500)]
    s = spark.createDataFrame(rows, "id string, title string, summary string, content string, embedding array<double>").withColumn("ancestors", F.lit(""))
    lexical = search.bm25_scores(search.index.terms(s), "needle").collect()
    semantic = search.semantic_scores(s, [1.0, 0.2]).collect()
    assert len(lexical) == len(semantic) == 1500
    for weight in (0.5, 0.2):
        want, seen = {}, {}
        for at, (scored, w) in enumerate(((lexical, 1 - weight), (semantic, weight))):
            for rank, (_, i) in enumerate(sorted((-round(r["score"], 9 if at == 0 else 15), r["id"]) for r in scored), 1):
                want[i] = want.get(i, 0) + w / (60 + rank)
                seen.setdefault(i, (at, rank))
        best = sorted(want, key=lambda i: (-want[i], seen[i]))[:10]
        got = search.hybrid_search(s, s, "needle", [1.0, 0.2], weight).collect()
        assert [(r["id"], r["score"]) for r in got] == [(i, round(want[i], 8)) for i in best]


def test_neighbours_on_the_whole_tree(spark):
    """Every region, nation, customer and order beside loops over lists."""
    s = relations.tree(spark, SF).select("id", "parent_id", "seq").collect()
    kids, parent = {}, {r["id"]: r["parent_id"] for r in s}
    for r in sorted(s, key=lambda r: (r["seq"], r["id"])):
        kids.setdefault(r["parent_id"], []).append(r["id"])
    want = {}
    for i, p in parent.items():
        near = [(p, "parent")] if p else []
        near += [(c, "child") for c in kids.get(i, [])[:10]]
        if p:
            near += [(x, "sibling") for x in [x for x in kids[p] if x != i][:10]]
            uncles = kids[parent[p]] if parent[p] else []
            near += [(c, "cousin") for u in uncles if u != p for c in kids.get(u, [])[:10]]
        for other, kind in near:
            want.setdefault((i, other), kind)
    got = sections.structural_neighbors(relations.tree(spark, SF), cousins=True).collect()
    assert len(got) == len(want) and {(r["source"], r["id"]): r["kind"] for r in got} == want
    assert any(r["source"].startswith("o") and r["kind"] == "cousin" for r in got)


def test_excerpt_whose_cut_falls_behind_a_line_break(spark):
    """The 60 bytes end with a line break, one or two: only that one goes, not the line before it."""
    long = "x" * 50
    rows = [("a", f"{long}\nline four\nmore"), ("b", f"{long}12345678\n\nmore"), ("c", f"{long}\nline 4\r\nmore")]
    got = {r["id"]: r["excerpt"] for r in sections.excerpts(spark.createDataFrame(rows, "id string, content string"), None, 60 + 1).collect()}
    assert got["a"] == f"{long}\nline four"
    got |= {r["id"]: r["excerpt"] for r in sections.excerpts(spark.createDataFrame(rows[1:], "id string, content string"), None, 60).collect()}
    assert got["b"] == f"{long}12345678\n"
    assert got["c"] == f"{long}\nline 4\r"


def test_counts_of_relatives_are_not_made_of_pairs(spark):
    """A random forest, with parents that are not there: the counts are those of the listing, and two thousand uncles a section take no time."""
    rng = random.Random(5)
    rows = [(f"n{i}", "" if i < 3 or rng.random() < 0.02 else f"n{rng.randrange(i)}" if i % 40 else "lost", rng.randrange(5)) for i in range(600)]
    s = spark.createDataFrame(rows, "id string, parent_id string, seq int")
    for most in (1, 3, 10):
        listed = sections.structural_neighbors(s, most, cousins=True).groupBy("source", "kind").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
        want = {tuple(r) for r in listed.select("source", "kind", "n", "first_id", "last_id").collect()}
        got = [tuple(r) for r in sections.relative_counts(s, most).select("source", "kind", "n", "first_id", "last_id").collect()]
        assert len(got) == len(want) and set(got) == want
    wide = spark.range(2000).selectExpr("concat('f', id) AS id", "'top' AS parent_id", "id AS seq").unionByName(spark.range(20000).selectExpr("concat('c', id) AS id", "concat('f', id % 2000) AS parent_id", "id AS seq"))
    wide = wide.unionByName(spark.createDataFrame([("top", "", 0)], "id string, parent_id string, seq long"))
    assert sections.relative_counts(wide).filter("kind = 'cousin'").agg(F.count("*"), F.min("n"), F.max("n")).first() == (20000, 19990, 19990)


def test_excerpts_of_every_document(spark):
    def cut(said):
        raw = said.encode()
        if len(raw) <= 60:
            return said, False
        safe = raw[:60].decode(errors="ignore")
        line = safe.rpartition("\n")[0]
        return (line if "\n" in safe and len(line) * 2 > len(safe) else safe), True

    docs = relations.documents(spark, SF).select("id", "content").collect()
    got = queries.QUERIES["section_excerpts"](spark, SF).collect()
    assert len(got) == len(docs) and {r["id"]: (r["excerpt"], r["truncated"]) for r in got} == {r["id"]: cut(r["content"]) for r in docs}
    assert any(len(r["excerpt"].encode()) < 60 for r in got if r["truncated"])


def test_every_item_is_asked_and_whole_passages_decide(spark):
    s = relations.documents(spark, SF).drop("tags")
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("item_id AS query", "text")
    items, docs = asked.collect(), s.select("id", "content").collect()
    holds = {(i["query"], r["id"]) for i in items for r in docs if i["text"] in r["content"]}
    assert {(r["query"], r["id"]) for r in search.holders(s, asked).collect()} == holds
    ranked = search.lexical_search_each(s, asked).orderBy("query", "rank").collect()
    assert {r["query"] for r in ranked} == {i["query"] for i in items}
    for i in items[::13]:
        one = search.lexical_search(s, i["text"]).collect()
        assert [(r["id"], r["score"]) for r in ranked if r["query"] == i["query"]] == [(r["id"], r["score"]) for r in one]
    assert queries.QUERIES["retrieval_metrics"](spark, SF).first()["n_queries"] == len({q for q, _ in holds})


def test_a_shared_opening_is_not_a_whole_passage(spark):
    head = "one opening that is longer than forty characters "
    s = spark.createDataFrame([("a", head + "and ends like this, then more"), ("b", head + "but ends in another way"), ("c", "xone two"), ("d", None)], "id string, content string")
    asked = spark.createDataFrame([(1, head + "and ends like this"), (2, "one"), (3, "one two"), (4, " one opening ")], "query long, text string")
    assert {(r["query"], r["id"]) for r in search.holders(s, asked).collect()} == {(1, "a"), (2, "a"), (2, "b"), (2, "c"), (3, "c")}
