"""Operators on small tables made by hand, beside plain Python."""

import os
import posixpath
import random
import re

import fixtures
import pytest
from pyspark.sql import functions as F

from quire.functions import paths, text, vectors
from quire.operators import components, context, health, links, mining, search, sections, telemetry
from quire.plans import index, pipeline
from quire.sources import documents
from quire.sources.store import Store


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_tokenize(spark):
    said = "See [the Docs](http://x.y/z) at https://api.example.com/v2/users?x=1#f `getHTTPResponse` ```hidden code``` the a I café snake_case"
    assert one(spark, text.tokenize, said) == ["see", "docs", "api", "example", "com", "v2", "users", "get", "http", "response", "caf", "snake", "case"]
    assert one(spark, text.tokenize, None) == []


@pytest.mark.parametrize("path", ["a/b/../c", "./a//b/", "../x", "a/../../b", "", "a", "/a/../..", "a/./b"])
def test_normpath(spark, path):
    assert one(spark, paths.normpath, path) == posixpath.normpath(path)


def test_slugify_like_the_readers(spark):
    from quire.sources.outline import slugify

    for title in ("Café! Über_alles", "  A -- b  ", "!!", "x__y"):
        assert one(spark, text.slugify, title) == slugify(title)


def test_cosine_of_zero_and_unlike_lengths(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0], [1.0, 2.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<float>, b array<float>")
    assert [round(r[0], 9) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 1.0]


def test_excerpts_keep_characters_whole(spark):
    s = spark.createDataFrame([("a", "é" * 400), ("b", "short"), ("c", "one line\n" * 100), ("d", "😀" * 200)], "id string, content string")
    out = {r["id"]: r for r in sections.excerpts(s, ["a", "b", "c", "d"], 101).collect()}
    assert out["a"]["excerpt"] == "é" * 50 and out["a"]["truncated"]
    assert out["b"]["excerpt"] == "short" and not out["b"]["truncated"]
    assert out["c"]["excerpt"] == "\n".join(["one line"] * 11)
    assert out["d"]["excerpt"] == "😀" * 25


def test_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges for n in e if e[0] != e[1] or n in got}


def test_filters_before_and_after_the_limit(spark):
    s = fixtures.sections(spark)
    after = search.search_sections(s, "install the tool", max_results=3, role="api").count()
    before = search.search_sections(s, "install the tool", max_results=3, filter_mode="pre", path_glob="guide/*").collect()
    assert after <= 3 and len(before) == 3 and all(r["doc_path"].startswith("guide/") for r in before)


def test_search_without_terms_and_on_an_empty_table(spark):
    s = fixtures.sections(spark)
    assert search.lexical_search(s, "the of").count() == 0
    assert search.lexical_search(s.limit(0), "install").count() == 0


def test_fusion_prefers_rows_in_both_lists(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "id string, rank int")
    assert [r["id"] for r in search.fuse([(a, 0.5), (b, 0.5)]).collect()] == ["y", "x", "z"]


def test_code_is_compressed_inside_fences_only():
    said = "# keep\n\n```python\n# gone\n\nx = 1  # stays\n```\n# keep\n"
    assert mining.compress_code(said) == "# keep\n\n```python\nx = 1  # stays\n```\n# keep\n"


def test_rst_glossary(spark):
    s = spark.createDataFrame([("s1", "d", 0, ".. glossary::\n   Term\n      Its meaning\n      goes on\n   Other\n      More\n")], "id string, doc_path string, seq int, content string")
    assert [(r["term"], r["definition"]) for r in mining.glossary(s).orderBy("term").collect()] == [("Other", "More"), ("Term", "Its meaning goes on")]


def test_roles_come_from_titles_ancestors_and_text(spark):
    s = fixtures.sections(spark)
    got = {r["title"]: (r["role"], r["role_source"]) for r in s.filter("doc_path LIKE 'guide/%' AND level > 0").collect()}
    assert got["Errors"] == ("troubleshooting", "heading") and got["Usage"] == ("example", "heading") and got["Run it"] == ("example", "ancestor")
    assert got["Steps"] == ("concept", "default")


def test_percentiles_are_nearest_rank(spark):
    calls = spark.createDataFrame([("t", float(i), 1) for i in range(1, 7)], "tool string, duration_ms double, ok int")
    assert telemetry.latency_stats(calls).first()["p50_ms"] == 3.0  # round(0.5 * 5) is 2, halves to even


def test_stale_pages(spark):
    pages = spark.createDataFrame([("p.md", "---\ntitle: x\nsources:\n  - a.py\n  - b.py\n  - c.py\n---\n", {"a.py": "1", "b.py": "1"})], "doc_path string, content string, source_hashes map<string,string>")
    now = spark.createDataFrame([("a.py", "1"), ("b.py", "2"), ("c.py", "3")], "doc_path string, file_hash string")
    assert {(r["source"], r["state"]) for r in health.stale_pages(pages, now).collect()} == {("b.py", "modified"), ("c.py", "untracked")}


def test_delete_is_safe_without_links(spark):
    s = fixtures.sections(spark)
    lonely = s.filter("doc_path = 'faq.md' AND level = 1").first()["id"]
    assert links.delete_safe(s, index.links(s), lonely).first()["verdict"] == "safe_to_delete"


def _write(folder, files):
    for path, said in files.items():
        os.makedirs(os.path.dirname(folder / path), exist_ok=True)
        (folder / path).write_text(said)


def test_folder_is_indexed_and_kept_current(spark, tmp_path):
    src = tmp_path / "src"
    _write(src, fixtures.FILES | {"node_modules/x.md": "# no", "my.secret.md": "# no", "pic.png": "no", "big.md": "x" * 600_000})
    store = Store(spark, str(tmp_path / "index"))
    assert pipeline.index_folder(spark, str(src), "acme/docs", store) == {"new": len(fixtures.FILES)}
    first = {r["doc_path"] for r in store.load("sections", "acme/docs").select("doc_path").distinct().collect()}
    assert first == set(fixtures.FILES)
    assert pipeline.index_folder(spark, str(src), "acme/docs", store) == {"same": len(fixtures.FILES)}
    (src / "faq.md").unlink()
    (src / "changelog.md").write_text("# Changed\n\nNew words\n")
    (src / "new.rst").write_text("New\n===\n")
    changes = pipeline.index_folder(spark, str(src), "acme/docs", store)
    assert changes == {"same": len(fixtures.FILES) - 2, "deleted": 1, "changed": 1, "new": 1}
    spark.catalog.clearCache()
    rows = Store(spark, str(tmp_path / "index")).load("sections", "acme/docs").collect()
    assert {r["doc_path"] for r in rows} == set(fixtures.FILES) - {"faq.md"} | {"new.rst"}
    assert [r["title"] for r in rows if r["doc_path"] == "changelog.md" and r["level"] == 1] == ["Changed"]
    assert store.load("glossary", "acme/docs").count() == 2 and store.load("postings", "acme/docs").filter("term = 'changed'").count() > 0
    assert store.resolve("docs") == "acme/docs" and store.resolve("other") == "local/other"
    store.define_group("all", ["acme/docs", "local/x"])
    assert store.groups().count() == 2
    store.delete("acme/docs")
    assert store.repos().count() == 0


def test_scope_leaves_other_documents_alone(spark, tmp_path):
    src = tmp_path / "src"
    _write(src, fixtures.FILES)
    store = Store(spark, str(tmp_path / "index"))
    pipeline.index_folder(spark, str(src), "a/b", store)
    (src / "guide/01-install.md").write_text("# Other\n")
    assert pipeline.index_folder(spark, str(src), "a/b", store, scope=("guide",)) == {"changed": 1, "same": 2}
    assert {r[0] for r in store.load("sections", "a/b").select("doc_path").distinct().collect()} == set(fixtures.FILES)


def test_one_file_in_the_repo_that_holds_it(spark, tmp_path):
    outer, inner = tmp_path / "src", tmp_path / "src" / "deep"
    _write(outer, {"a.md": "# A\n", "deep/b.md": "# B\n"})
    store = Store(spark, str(tmp_path / "index"))
    pipeline.index_folder(spark, str(outer), "x/outer", store)
    pipeline.index_folder(spark, str(inner), "x/inner", store)
    (inner / "b.md").write_text("# Changed\n")
    (outer / "a.md").write_text("# Too\n")
    assert pipeline.index_file(spark, str(inner / "b.md"), store) == {"changed": 1}
    titles = lambda repo: {r["title"] for r in store.load("sections", repo).filter("level = 1").collect()}
    assert (titles("x/inner"), titles("x/outer")) == ({"Changed"}, {"A", "B"})
    assert pipeline.index_file(spark, str(outer / "a.md"), store) == {"changed": 1} and titles("x/outer") == {"Too", "B"}
    with pytest.raises(LookupError):
        pipeline.index_file(spark, str(tmp_path / "other.md"), store)


def test_tuned_weights_are_kept(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    events = spark.createDataFrame([("a", 0.9 if i % 2 else 0.4, i % 2) for i in range(60)] + [("b", 0.2 if i % 2 else 0.8, i % 2) for i in range(60)] + [("c", 0.5, 1)], "repo string, confidence double, semantic_used int")
    for times, want in ((1, {"a": 0.55, "b": 0.45}), (2, {"a": 0.6, "b": 0.4})):
        out = {r["repo"]: (r["status"], r["weight"]) for r in pipeline.tune(store, events).collect()}
        assert store.weights() == want, times
    assert out["c"] == ("insufficient_events", 0.5)


def test_stream_of_documents_equals_a_batch(spark, tmp_path):
    from quire.streaming.incremental import index_stream

    arriving, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "index"))
    first = [(p, t.encode(), False) for p, t in fixtures.FILES.items()]
    spark.createDataFrame(first, "doc_path string, raw binary, deleted boolean").write.parquet(arriving)
    for more in (None, [("faq.md", None, True), ("z.md", b"# Z\n", False)]):
        if more:
            spark.createDataFrame(more, "doc_path string, raw binary, deleted boolean").write.mode("append").parquet(arriving)
        index_stream(spark, arriving, "s/t", store, str(tmp_path / "check")).awaitTermination()
    got = {r["id"] for r in Store(spark, store.path).load("sections", "s/t").collect()}
    want = {r["id"] for p, t in (fixtures.FILES | {"z.md": "# Z\n"}).items() if p != "faq.md" for r in documents.split_document(t, p, "s/t")}
    assert got == want


def test_readers_see_one_version_whole(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "index"))
    rows = lambda n, text_: spark.createDataFrame([("007", f"d{i}", f"d{i}#1", text_) for i in range(n)], "repo string, doc_path string, id string, content string")
    store.save(rows(40, "old"))
    before = store.load("sections", "007")

    def fails(*_):
        raise OSError("the writer is lost")

    with monkeypatch.context() as m:  # after the new files, before the swap
        m.setattr(Store, "_swap", fails)
        for write in (lambda: store.save(rows(7, "new")), lambda: store.save_incremental("007", rows(5, "new"), rows(9, "x").select("doc_path"))):
            with pytest.raises(OSError, match="lost"):
                write()
    assert {(r["doc_path"], r["content"], r["repo"]) for r in store.load("sections", "007").collect()} == {(f"d{i}", "old", "007") for i in range(40)}
    files = lambda: set((tmp_path / "index" / "sections" / "007").rglob("part-*.parquet"))
    lost = files() - {p for p in files() if str(p.parent).removeprefix("/") in {u.removeprefix("file:///").rpartition("/")[0] for u in before.inputFiles()}}
    store.save_incremental("007", rows(5, "new"), rows(9, "x").select("doc_path"))
    now = {r["doc_path"]: r["content"] for r in store.load("sections").collect()}
    assert now == {f"d{i}": "new" if i < 5 else "old" for i in range(40) if i < 5 or i >= 9}
    assert before.count() == 40  # a reader that had begun
    store.save(rows(3, "last"))
    store.save(rows(3, "last"))
    assert len(files() - lost) <= 6 and store.load("sections", "007").count() == 3
    assert store.load("sections", "007", keys=["d1"]).filter("doc_path = 'd1'").count() == 1
    store.save_side("links", "007", spark.createDataFrame([("a", "b")], "source_doc string, resolved string"))
    store.delete("007")
    assert store.load("links", "007") is None and not store.exists("sections")


def test_the_latest_event_of_a_document_counts(spark, tmp_path):
    from datetime import datetime as t

    from quire.streaming.incremental import index_stream

    arriving, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "index"))
    rows = [("a.md", b"# Old\n", False, t(2024, 1, 1)), ("a.md", None, True, t(2024, 1, 2)), ("b.md", None, True, t(2024, 1, 1)), ("b.md", b"# New\n", False, t(2024, 1, 3)), ("c.md", b"# C\n", False, None), ("c.md", None, True, None)]
    spark.createDataFrame(rows, "doc_path string, raw binary, deleted boolean, at timestamp").repartition(3).write.parquet(arriving)
    index_stream(spark, arriving, "s/t", store, str(tmp_path / "check")).awaitTermination()
    got = {(r["doc_path"], r["title"]) for r in store.load("sections", "s/t").filter("level = 1").collect()}
    assert got == {("b.md", "New"), ("c.md", "C")}


def test_many_referrers_count_in_full(spark):
    """120 documents link to the target, and 90 to one of those: more than a listing shows."""
    target = "r::t.md::t#1"
    docs = [("t.md", [])] + [(f"a{i}.md", ["t.md"]) for i in range(120)] + [(f"b{i}.md", ["a7.md"]) for i in range(90)]
    rows = [("r", f"r::{d}::x#1" if d != "t.md" else target, d, "x", 1, i, refs, "") for i, (d, refs) in enumerate(docs)]
    s = spark.createDataFrame(rows, "repo string, id string, doc_path string, title string, level int, seq int, references array<string>, content string")
    found = index.links(s)
    edges = spark.createDataFrame([], "doc string, next string")
    out = links.delete_safe(s, found, target, edges=edges).first()
    assert (out["doc_backlinks"], out["transitive_backlinks"], out["verdict"]) == (120, 210, "backlinks_blocking")
    assert links.impact(found, "t.md").count() == 50 + 50 or links.impact(found, "t.md").filter("depth = 1").count() == 50


def test_ledgers(spark, tmp_path):
    store = Store(spark, str(tmp_path / "x"))
    for i in range(5):
        store.append("tool_calls", spark.createDataFrame([(float(i), "t")], "ts double, tool string"))
    store.trim("tool_calls", 2)
    assert sorted(r["ts"] for r in spark.read.parquet(store.at("tool_calls")).collect()) == [3.0, 4.0]
    store.append_json("replay", spark.createDataFrame([(1.0, "q")], "ts double, query string"))
    with open(os.path.join(store.at("replay"), "bad.json"), "w") as f:
        f.write("{broken\n")
    assert store.read_json("replay", "ts double, query string").filter("query IS NOT NULL").count() == 1


def test_embeddings_are_made_once_for_each_text(spark):
    s = fixtures.sections(spark)
    seen = []

    def embed(rows):
        seen.append(rows.count())
        return rows.select("content_hash", F.array(F.length("embed_text").cast("float")).alias("embedding"))

    made = pipeline.with_embeddings(s, None, embed)
    assert made.filter("embedding IS NULL").count() == 0 and seen == [s.select("content_hash").distinct().count()]
    again = pipeline.with_embeddings(s, made.select("content_hash", "embedding").dropDuplicates(["content_hash"]), embed)
    assert again.count() == s.count() and seen[-1] == 0


def test_fields_of_a_glob(spark):
    df = spark.createDataFrame([("a/b.md",), ("a/c/d.md",), ("x.rst",)], "p string")
    assert [r[0] for r in df.filter(paths.matches_glob(F.col("p"), "a/*.md")).orderBy("p").collect()] == ["a/b.md", "a/c/d.md"]
    assert re.match(paths.glob_regex("[!a]?.md"), "bc.md")


def test_a_links_parts_are_worked_out_once(spark):
    """Filters over links use what was worked out; they don't hold the path's normal form again."""
    rows = spark.createDataFrame([("r", "r::a/x.md::x#1", "t", "a/x.md", 0, ["../b/y.md", "z.md#k", "http://h/p", "../../../q/./w.md", "#k"])], "repo string, id string, title string, doc_path string, seq int, references array<string>")
    found = index.links(rows).filter("resolved IS NOT NULL AND resolved <> source_doc")
    assert sorted(r["resolved"] for r in found.collect()) == ["../../q/w.md", "a/z.md", "b/y.md"]
    assert not [x for x in str(found._jdf.queryExecution().optimizedPlan()).splitlines() if "Filter" in x and "aggregate(" in x]


def test_context_moves_no_texts_of_other_documents(spark):
    rows = [("r::a::x#1", "X", "a", "", 0, "one"), ("r::a::x/y#2", "Y", "a", "r::a::x#1", 1, "two"), ("r::a::x/z#2", "Z", "a", "r::a::x#1", 2, "three"), ("r::a::x/y/w#3", "W", "a", "r::a::x/y#2", 3, "four"), ("r::b::x#1", "B", "b", "", 0, "five")]
    s = spark.createDataFrame(rows, "id string, title string, doc_path string, parent_id string, seq int, content string").withColumns({"level": F.lit(1), "byte_start": F.col("seq"), "repo": F.lit("r")})
    got = context.context(s, "r::a::x/y#2", include_related=True)
    assert [tuple(r) for r in got.orderBy("ord").collect()] == [(1, "section", "r::a::x/y#2", "two"), (2, "ancestor", "r::a::x#1", "X"), (3, "child", "r::a::x/y/w#3", "four"), (4, "sibling", "r::a::x/z#2", "three")]
    assert all("content" not in line for line in str(got._jdf.queryExecution().optimizedPlan()).splitlines() if "Join" in line)
    assert "five" not in str(got.collect()) and context.context(s, "none").count() == 0


def test_postings_are_counted_in_their_rows(spark):
    """Nothing is exchanged where ids are unique; an id in two rows is still grouped."""
    rng = random.Random(4)
    draw = lambda n: [rng.choice("abcdefgh") for _ in range(rng.randrange(n))]
    rows = [(f"i{k}", draw(4), draw(3), draw(60), None if k % 5 == 0 else draw(3)) for k in range(700)]
    kinds = "id string, title array<string>, summary array<string>, content array<string>, ancestors array<string>"
    want = {(t, r[0], f, v.count(t), len(v)) for r in rows for f, v in zip(index.FIELDS, r[1:], strict=True) for t in v or ()}
    got = index.postings(spark.createDataFrame(rows, kinds))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    found = [tuple(r) for r in got.select("term", "id", "field", "tf", "dl").collect()]
    assert len(found) == len(want) and set(found) == want
    base = dict.fromkeys(index.FIELDS, 2.0)
    blocked = index.blocked_postings(spark.createDataFrame(rows, kinds), base)
    assert "Exchange" not in blocked._jdf.queryExecution().executedPlan().toString()
    said = {(r["term"], r["id"], f, r[f"tf{i}"], r[f"dl{i}"]) for r in blocked.collect() for i, f in enumerate(index.FIELDS) if r[f"tf{i}"]}
    assert said == want and all(r["dl2"] is None for r in blocked.collect() if not r["tf2"])
    twice = spark.createDataFrame([("x", ["a"], [], ["b"], []), ("x", ["a"], [], ["c"], [])], kinds)
    assert {(r["term"], r["field"], r["tf"]) for r in index.postings(twice).collect()} == {("a", "title", 2), ("b", "content", 1), ("c", "content", 1)}
