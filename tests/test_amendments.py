"""Derived tables under random edits, beside tables made anew."""

import random

from pyspark.sql import functions as F

from quire.operators import search
from quire.plans import index, pipeline
from quire.sources.store import Store

SCHEMA = "repo string, doc_path string, id string, title string, summary string, content string, level int, parent_id string, seq int, byte_start long, byte_end long, tags array<string>, references array<string>, file_hash string"
WORDS = [f"word{i}" for i in range(60)] + ["the", "of"]


def document(rng, path):
    rows = []
    for k in range(rng.randrange(1, 4)):
        title = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 4)))
        said = " ".join(rng.choice(WORDS[: rng.choice([5, 62])]) for _ in range(rng.randrange(5, 40)))
        rows.append(("a/b", path, f"a/b::{path}::part/s{k}#1", title, title, said, 1, "", k, 100 * k, 100 * k + 90, rng.sample(["Red", "blue", "green"], rng.randrange(3)), [f"d{rng.randrange(30)}.md#x"], str(rng.random())))
    return rows


def tables(store):
    """What is derived, whichever way it was written."""
    out = {n: sorted(map(str, store.load(n, "a/b").drop("repo", "bucket", "level").collect())) for n in ("postings", "tags", "links")}
    out["df"] = sorted(map(tuple, store.load("term_counts", "a/b").groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0").collect()))
    blocks = store.load("level_counts", "a/b").groupBy("term").agg(F.sum("n").alias("n")).filter("n <> 0").collect()
    out["sizes"] = sorted(map(tuple, blocks))
    stats = store.load("corpus_stats", "a/b").first()
    out["stats"] = [round(stats[c], 9) for c in ("n_sections", "sum_title", "sum_content", "avg_title", "avg_summary", "avg_content")]
    return out


def size_of(store, name):
    p = store._pointer(name, "a/b")
    fs, _ = store._open(store.path)
    where = lambda b, v: store._open(f"{store._folder(name, 'a/b')}/{v}/bucket={b}")[1]
    return [sum(fs.getContentSummary(where(b, vs[i])).getLength() for b, vs in p["buckets"].items() if len(vs) > i) for i in (0, 1)]


def test_random_edits_give_the_tables_of_a_whole_build(spark, tmp_path, monkeypatch):
    # what only whole builds make is not looked at here
    monkeypatch.setattr(pipeline.similarity, "near_duplicate_clusters", lambda rows: rows.select("id").limit(0))
    monkeypatch.setattr(pipeline, "adjacency", lambda rows: rows.select(F.col("id").alias("source")).limit(0))
    monkeypatch.setattr("quire.sources.store.MOST_AMENDED", 3)
    rng = random.Random(11)
    docs = {f"d{i}.md": document(rng, f"d{i}.md") for i in range(30)}
    frame = lambda d: spark.createDataFrame([r for rows in d.values() for r in rows], SCHEMA)
    store = Store(spark, str(tmp_path / "index"))
    store.save(frame(docs))
    pipeline.derive(store, "a/b")
    whole_runs, whole = [], pipeline.save_search
    monkeypatch.setattr(pipeline, "save_search", lambda *a: whole_runs.append(a) or whole(*a))
    for step in range(4):
        changed = {p: document(rng, p) for p in rng.sample(sorted(docs), 2)} | {f"n{step}.md": document(rng, f"n{step}.md")}
        gone = rng.sample([p for p in sorted(docs) if p not in changed], 1)
        docs = {p: r for p, r in (docs | changed).items() if p not in gone}
        pipeline.replace_documents(store, "a/b", frame(changed), spark.createDataFrame([(p,) for p in gone], "doc_path string"))
        if step == 0:
            first, second = size_of(store, "postings")
            assert 0 < second < first
    assert not whole_runs and store._pointer("postings", "a/b")["amended"] == 1  # written whole at the third
    anew = Store(spark, str(tmp_path / "anew"))
    anew.save(frame(docs))
    pipeline.derive(anew, "a/b")
    assert tables(store) == tables(anew)
    one, two = search.Searcher(store, "a/b"), search.Searcher(anew, "a/b")
    for query in ("word1 word2", "the", "word7 of blue", "word40 word41 word42 red"):
        best = [(r["id"], r["score"]) for r in one.best(query, 5).collect()]
        assert best == [(r["id"], r["score"]) for r in two.best(query, 5).collect()]
        stored = one.scores(query).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(5)
        assert best == [(r["id"], r["score"]) for r in stored.collect()]


def test_an_edit_after_a_failed_one_makes_all_tables_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pipeline.similarity, "near_duplicate_clusters", lambda rows: rows.select("id").limit(0))
    monkeypatch.setattr(pipeline, "adjacency", lambda rows: rows.select(F.col("id").alias("source")).limit(0))
    rng = random.Random(3)
    frame = lambda p: spark.createDataFrame(document(rng, p), SCHEMA)
    none = spark.createDataFrame([], "doc_path string")
    store = Store(spark, str(tmp_path / "index"))
    store.save(frame("d1.md"))
    pipeline.derive(store, "a/b")
    store.save_incremental("a/b", frame("d2.md"), none)  # and what is derived was never written
    assert not store.is_derived("a/b")
    pipeline.replace_documents(store, "a/b", frame("d3.md"), none)
    ids = {r["id"].split("::")[1] for r in store.load("postings", "a/b").select("id").distinct().collect()}
    assert ids == {"d1.md", "d2.md", "d3.md"} and store.is_derived("a/b")
    assert store.load("corpus_stats", "a/b").first()["n_sections"] == store.load("sections", "a/b").count()


def test_terms_are_counted_once_for_each_section(spark):
    termed = spark.createDataFrame([("x", ["a", "a"], ["a"], ["b", "a"], ["c"]), ("y", [], [], ["a"], [])], "id string, title array<string>, summary array<string>, content array<string>, ancestors array<string>")
    posted = index.blocked_postings(termed, {f: 2.0 for f in index.FIELDS})
    got = {(r["term"], r["id"]): (r["tf0"], r["dl0"], r["tf1"], r["tf2"], r["tf3"], r["own"]) for r in posted.collect()}
    assert got[("a", "x")] == (2, 2, 1, 1, 0, True) and got[("c", "x")] == (0, None, 0, 0, 1, False) and len(got) == 4
    assert {r["term"]: r["df"] for r in index.term_counts(posted).collect()} == {"a": 2, "b": 1}
