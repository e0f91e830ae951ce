"""The search over stored blocks of postings, beside the whole scores."""

import pytest
from pyspark.sql import functions as F

from quire import queries
from quire.operators import search
from quire.plans import relations as R
from quire.sources import store as search_store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def searcher(spark):
    return queries.searcher(spark, SF)


def asked(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    return texts + [" ".join(t.split()[:n]) for n in (1, 2, 4) for t in texts[:8]] + ["the the of", "en", "src3 the", "", "zzzz qqqq"]


def test_the_best_are_those_of_the_whole_scores(spark, searcher):
    """Every benchmark item, and short queries where blocks are skipped."""
    skipped = 0
    for query in asked(spark):
        got = [(r["id"], r["score"]) for r in searcher.best(query, 10).collect()]
        skipped += searcher.last["blocks"] - searcher.last["blocks_read"]
        whole = searcher.scores(query).select("id", F.round("score", 6).alias("score")).collect()
        assert got == sorted(((r["id"], r["score"]) for r in whole), key=lambda x: (-x[1], x[0]))[:10], query
    assert skipped > 0


def test_whole_scores_are_those_of_a_search_without_an_index(spark, searcher):
    sections = R.documents(spark, SF)
    for query in asked(spark)[:3] + ["the of src3"]:
        want = [(r["id"], r["title"], r["doc_path"], r["score"]) for r in search.lexical_search(sections, query).collect()]
        assert [tuple(r) for r in searcher.search(query).collect()] == want


def test_blocks_that_cannot_matter_are_skipped(searcher):
    one = search.Searcher.__new__(search.Searcher)
    one.levels = {"a": [(80, 5), (40, 20), (3, 1000)], "b": [(8, 5), (2, 500)]}
    one.highest = one.lowest = 1.0
    assert one.needed({"a": 2.0}, 10) == {"a": 40}
    assert one.needed({"a": 2.0, "b": 0.1}, 10) == {"a": 40, "b": 2}  # sections of a's blocks may have any posting of b
    assert one.needed({"a": 2.0, "b": 0.1}, 10, bonus=10.0) == {"a": 3, "b": 2}
    assert one.needed({"a": 2.0, "new": 1.0}, 10) == {"a": 3, "new": 0}
    assert one.needed({"a": 2.0, "new": 1.0}, 10, least=60.0) == {"new": 0}  # a term whose blocks are not known is read whole
    one.highest, one.lowest = 1.25, 0.5  # the means have drifted
    assert one.needed({"a": 2.0}, 10) == {"a": 40} and one.needed({"a": 2.0}, 10, least=12.0) == {"a": 40}
    assert one.needed({"a": 2.0}, 10, least=13.0) == {"a": 80}


def _words(spark, rows):
    s = spark.createDataFrame(rows, "id string, title string, content string").withColumns({"summary": F.lit(""), "ancestors": F.lit(""), "tags": F.array(F.lit("red")), "doc_path": F.expr("split(id, '::')[1]")})
    return s


def test_f6_terms_beyond_the_commonest_count_in_all_their_sections(spark, tmp_path):
    import math

    many = " ".join(f"w{i:04}" for i in range(6000))
    s = _words(spark, [(f"r::d{i}::t#1", "", many if i < 3 else "w0000 w0001") for i in range(8)])
    store = queries.Store(spark, str(tmp_path))
    store.save_side("sections", "r", s)
    queries.pipeline.save_search(store, "r", s)
    got = [(r["id"], r["score"]) for r in search.Searcher(store, "r").best("w5999", 10).collect()]
    part = 2.2 / (1 + 1.2 * (0.25 + 0.75 * 6000 / ((3 * 6000 + 5 * 2) / 8)))
    assert got == [(f"r::d{i}::t#1", pytest.approx(math.log((8 - 3 + 0.5) / (3 + 0.5) + 1) * part, abs=2e-6)) for i in range(3)]


def test_f3_an_index_in_parts_with_short_keys_finds_the_same(spark, tmp_path, monkeypatch):
    s = _words(spark, [(f"r::d{i:02}::a-long-slug-{i}#1", f"title {i % 5}", " ".join(f"w{j}" for j in range(i % 7, i % 11 + 9))) for i in range(60)])
    one, two = queries.Store(spark, str(tmp_path / "one")), queries.Store(spark, str(tmp_path / "two"))
    one.save_side("sections", "r", s)
    queries.pipeline.save_search(one, "r", s)
    monkeypatch.setattr(queries.pipeline, "MANY_TERMS", 1)
    for module in (queries.pipeline, search_store):
        monkeypatch.setattr(module, "PARTS", 2)
    s = s.withColumn("key", F.expr("regexp_extract(id, '^.*::', 0)"))
    two.save_side("sections", "r", s.select("key", "id", "title", "doc_path"))
    queries.pipeline.save_search(two, "r", s)
    left, right = (x.load("postings", "r").drop("id", "repo", "bucket").orderBy("term", "level", "dl2", "tf2", "tf0").collect() for x in (one, two))
    assert sorted(map(str, left)) == sorted(map(str, right)) and len(left) > 500
    assert {r["id"] for r in two.load("postings", "r").select("id").collect()} == {f"r::d{i:02}::" for i in range(60)}
    for query in ("w8 w14 title", "w15 red", "nothing"):
        found = [[tuple(r) for r in search.Searcher(x, "r").search(query).collect()] for x in (one, two)]
        assert found[0] == found[1] and (found[0] or query == "nothing")


def test_f3_the_index_of_documents_holds_no_texts(searcher):
    assert set(searcher.schemas["sections"].names) == {"key", "id", "title", "doc_path", "repo"}
    assert searcher.store.load("postings").filter("length(id) > 30").count() == 0
