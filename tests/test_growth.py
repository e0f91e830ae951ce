"""What is written and moved grows with the input, not with the pairs in it."""

from pyspark.sql import functions as F

from quire.operators import context, links, similarity


def _written(monkeypatch, module, whose):
    """Rows of the tables that a module's ``cut`` writes, by label."""
    rows, cut = {}, module.cut

    def counted(df, label="t", compression=None):
        out = cut(df, label, compression)
        rows[label] = rows.get(label, 0) + out.count()
        return out

    for m in whose:
        monkeypatch.setattr(m, "cut", counted)
    return rows


def _alike(spark, n):
    s = spark.range(n).select(F.format_string("d::f%d/%03d.md::t#1", F.col("id") % 2, "id").alias("id"), F.format_string("f%d/%03d.md", F.col("id") % 2, "id").alias("doc_path"), F.when(F.col("id") % 3 == 0, "red green blue black").otherwise("red green blue black white").alias("title"), (F.col("id") + 5).alias("byte_end"))
    return s.withColumns({"summary": F.col("title"), "byte_start": F.lit(0).cast("long"), "seq": F.lit(0), "repo": F.lit("d"), "references": F.array().cast("array<string>")})


def test_f5_pairs_of_sections_with_like_titles_are_not_moved(spark):
    n = 60
    found = similarity.similar_sections(_alike(spark, n))
    assert found.count() == found.distinct().count() == n * (n - 1) // 2  # 0.8 or 1 for all
    assert {tuple(r) for r in found.groupBy("score").count().collect()} == {(1.0, 190 + 780), (0.8, 800)}
    found.collect()
    plan = found._jdf.queryExecution().toString()
    last = plan[plan.index("== Physical Plan ==") :].partition("Generate")[0]
    assert "Exchange" not in last and "Join" not in last  # pairs are made last


def test_f4_groups_of_like_titles_are_found_without_their_pairs(spark, monkeypatch):
    n = 60
    rows = _written(monkeypatch, similarity, (similarity, context))
    s = _alike(spark, n)
    empty = s.limit(0).select(F.col("id").alias("source_section_id"), F.col("doc_path").alias("source_doc"), "seq", F.lit("").alias("href"), F.lit(False).alias("is_external"), F.lit("").alias("file_part"), F.lit("").alias("resolved"))
    got = context.similar_clusters(s, empty).collect()
    mean = round((970 + 0.8 * 800) / 1770, 4)
    assert [tuple(r) for r in got] == [("d::f1/059.md::t#1", n, 1.0, mean, "near_duplicate")]
    assert sum(rows.values()) <= 3 * n


def _docs(spark, texts):
    return spark.createDataFrame([(p, 0, t) for p, t in texts], "doc_path string, seq int, content string")


def test_f9_the_next_of_numbered_documents_takes_no_task_for_a_folder(spark):
    s = _docs(spark, [(f"p/{i:02}-x.md", "text") for i in range(40)] + [("q/01.md", "next: [a](02.md)"), ("q/02.md", "t")])
    edges = links.tutorial_edges(s)
    assert {(r["doc"], r["next"]) for r in edges.collect() if r["strategy"] == "ordered_filename"} == {(f"p/{i:02}-x.md", f"p/{i + 1:02}-x.md") for i in range(39)} | {("q/01.md", "q/02.md")}
    assert {(r["doc"], r["next"]) for r in edges.collect() if r["strategy"] == "inline_link"} == {("q/01.md", "q/02.md")}
    assert "lead(" not in edges._jdf.queryExecution().optimizedPlan().toString()


def test_f10_f11_a_walk_from_one_document_does_not_move_all_links(spark):
    rows = [(f"d{i}.md", "s", 0, 0, "", f"d{i // 2}.md") for i in range(1, 400)]
    table = spark.createDataFrame(rows, "source_doc string, source_section_id string, seq int, ref_at int, anchor string, resolved string")
    from quire.operators import links as module

    plans, cut = [], module.cut
    module.cut = lambda df, *a: (plans.append(df._jdf.queryExecution().sparkPlan().toString()), cut(df, *a))[1]
    try:
        found = module.impact(table, "d1.md", most=None).collect()
    finally:
        module.cut = cut
    assert len(found) == 14
    first = [p for p in plans if "Window" in p][0]
    assert "= d1.md)" in first  # only links to the document are joined at all


def test_f20_f25_sections_are_read_without_roles_where_none_are_used(spark, monkeypatch):
    from quire import queries
    from quire.plans import pipeline, shop

    def never(rows):
        raise AssertionError("roles are not used")

    monkeypatch.setattr(shop, "_READ", {})
    monkeypatch.setattr(pipeline, "with_roles", never)
    for name in ("undocumented_symbols", "code_examples"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001") is not None


def test_f17_f18_shingles_that_are_not_frequent_stay_in_their_rows(spark, monkeypatch):
    monkeypatch.setattr(similarity, "FLAG_CHARS", (1024, 1024))
    rows = _written(monkeypatch, similarity, (similarity,))
    sets = spark.range(60).select(F.format_string("s%02d", "id").alias("id"), F.expr("array_sort(array_union(sequence(1L, 20L), array(1000 + id DIV 2, 2000 + id)))").alias("set"))
    got = {(r["a"], r["b"]): r["jaccard"] for r in similarity.near_duplicate_pairs(sets).collect()}
    assert len(got) == 30 and set(got.values()) == {21 / 23}
    assert rows["frequent"] == 20 and rows["flags"] == 1


def test_f20_f25_only_what_a_query_reads_leaves_the_reader(spark, monkeypatch):
    from quire import queries
    from quire.plans import shop
    from quire.sources import documents

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(shop, "_READ", {})
    rows = _written(monkeypatch, shop, (shop,))
    assert queries.QUERIES["code_examples"](spark, sf).count() == 10
    found = queries.QUERIES["undocumented_symbols"](spark, sf)
    assert found.count() > 0 and not rows  # the files as read are not written
    read = next(line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "MapInPandas" in line)
    assert "title" in read and "content" not in read and "code_blocks" not in read
    for made in (shop.files, shop.format_files):
        whole = documents.sections(made(spark, sf))
        for columns in (("title", "summary"), ("id", "references", "tags", "content_hash"), ("id", "code_blocks", "byte_end")):
            few = documents.sections(made(spark, sf), columns)
            assert few.columns == list(columns)
            assert sorted(map(str, few.collect())) == sorted(map(str, whole.select(*columns).collect()))


def test_f23_texts_are_taken_apart_once_and_sets_are_not_moved(spark, monkeypatch):
    from quire import queries
    from quire.operators import search

    rows = _written(monkeypatch, queries, (queries, search, similarity))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert queries.QUERIES["search_deduped"](spark, "/root/testdata/sf0.001").count() > 0
    assert set(rows) == {"terms", "keys"} and rows["terms"] == docs
    run = [f"w{i}" for i in range(10)]
    termed = spark.createDataFrame([("b", run * 2), ("a", run * 3), ("c", run), ("d", run[:9]), ("e", run[::-1]), ("f", run * 2)], "id string, content array<string>")
    assert {tuple(r) for r in similarity.equal_classes(termed).collect()} == {("a", "a"), ("b", "a"), ("f", "a"), ("c", "c"), ("e", "e")}


def test_f23_terms_of_texts_with_and_without_marks(spark):
    import re

    from quire.functions import text

    def terms(x):
        for pattern, to in ((r"(?s)```.*?```|~~~.*?~~~", " "), (r"!?\[([^\]]+)\]\([^)]*\)", r" \1 "), (r"""https?://([^\s)\]'"<>?#]*)[^\s)\]'"<>]*""", r" \1 "), (r"`([^`]+)`", r" \1 "), (r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")):
            x = re.sub(pattern, to, x)
        return [t for t in re.split("[^a-z0-9]+", x.lower()) if len(t) >= 2 and t not in text.STOP_WORDS]

    rng = __import__("random").Random(2)
    parts = ["aB", "ABc", "XMLHttp", "go2Go", "ABCd", "`", "```", "~~~", "[ab](", "](", "x)", "http://ab.cd/ef?gh", "https://", " ", "\n", "The", "É"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.tokenize(F.col("t")).alias("w")).collect()
    assert [r["w"] for r in got] == [terms(r["t"]) for r in got]


def test_f26_a_task_groups_no_more_when_the_table_grows(spark, monkeypatch):
    import re

    from quire.operators import search

    rows = [(f"d{i:03}", "title", "", "red green blue " * 20 + "red " * (i % 7)) for i in range(300)]
    s = spark.createDataFrame(rows, "id string, title string, summary string, content string").withColumn("ancestors", F.lit(""))
    asked = spark.createDataFrame([(1, "red"), (2, "blue green"), (3, "title")], "query long, text string")
    want = sorted(tuple(r) for r in search.lexical_search_each(s, asked).collect())
    monkeypatch.setattr(search, "TASK_GROUPS", 1000)
    tasks = {}
    for n in (100, 300):
        found = search.lexical_search_each(s.limit(n), asked)
        tasks[n] = int(re.search(r"RepartitionByExpression \[id#\d+\], (\d+)", found._jdf.queryExecution().optimizedPlan().toString())[1])
    assert tasks[100] >= 7 and tasks[300] >= 20
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) == 30


def test_f5_nearest_vectors_are_found_tile_by_tile(spark, monkeypatch):
    import random

    rng = random.Random(5)
    monkeypatch.setattr(similarity, "TILE", (7, 16))
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(40)]
    near = lambda: [x + rng.gauss(0, 1e-4) for x in rng.choice(base)]
    odd = [[0.0] * 6, [float("nan")] + [1.0] * 5, [float("inf")] + [0.0] * 5, [1e-30] * 6, [1e30, 0.0, 0.0, 0.0, 0.0, 1.0], [1.0, 2.0], []]
    rows = [(f"v{i}", rng.choice(base) if i % 3 == 0 else near() if i % 3 == 1 else [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)] + [(f"o{i}", x) for i, x in enumerate(odd * 2)]
    rows = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(3)
    for top, least in ((5, 0.2), (2, 0.9)):
        monkeypatch.setattr(similarity, "FEW_QUERIES", 10_000)
        want = sorted(map(str, similarity.semantic_neighbors(rows, rows, top, least).collect()))
        monkeypatch.setattr(similarity, "FEW_QUERIES", 16)
        assert sorted(map(str, similarity.semantic_neighbors(rows, rows, top, least).collect())) == want and len(want) > 500


def test_f5_copies_of_a_vector_are_met_once(monkeypatch):
    import pyarrow as pa

    rows = pa.table({"id": [f"v{i:04}" for i in range(2000)], "embedding": pa.array([[1.0, float(i % 4), 2.0] for i in range(2000)], pa.list_(pa.float32()))})
    found = similarity._nearest(5, 0.2)(rows, rows)
    assert found.num_rows <= 2000 * 4 * 6
    best = {}
    for x in found.to_pylist():
        best.setdefault(x["id"], []).append((-x["cosine"], x["other"]))
    assert all(v != x[1] for v, xs in best.items() for x in xs)
    own = lambda i: [f"v{k:04}" for k in range(i % 4, 2000, 4) if k != i][:5]
    assert all([x for _, x in sorted(best[f"v{i:04}"])[:5]] == own(i) for i in range(2000))


def test_f4_pairs_of_sections_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TASK_PAIRS", 100)
    monkeypatch.setattr(similarity, "CHUNK", 5)
    n = 60
    found = similarity.similar_sections(_alike(spark, n))
    assert found.count() == found.distinct().count() == n * (n - 1) // 2
    parts = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 10 and max(r["count"] for r in parts) < n * (n - 1) // 8
    assert found.rdd.getNumPartitions() == 28  # 20 * 20 + 40 * 40 + 20 * 40 pairs of members, 100 a task
