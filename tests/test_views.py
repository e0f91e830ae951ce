"""Views that put operators together, scans of folders, and what is kept beside an index."""

import json
import math
import os
import random

import fixtures
import pytest
from pyspark.sql import functions as F

from quire.functions import paths
from quire.operators import health, search, sections, similarity, telemetry
from quire.plans import index, pipeline
from quire.sources import documents, openapi
from quire.sources.store import Store


def _write(folder, files):
    for path, said in files.items():
        os.makedirs(os.path.dirname(folder / path), exist_ok=True)
        (folder / path).write_text(said)


@pytest.mark.parametrize(
    ("lines", "ignored", "kept"),
    [
        (["*.log", "!keep.log"], ["a.log", "d/b.log"], ["keep.log", "d/keep.log", "a.md"]),
        (["/build/", "docs/*.md"], ["build/x.md", "docs/a.md"], ["d/build/x.md", "docs/sub/a.md", "build"]),
        (["tmp/", "a?c.md", "[xy].md"], ["tmp/q.md", "d/tmp/e/q.md", "abc.md", "d/x.md"], ["tmp", "a/c.md", "z.md"]),
        (["**/gen/*.md", "end/**", "# note", "", "\\#odd.md", "sp ace.md  "], ["gen/a.md", "d/e/gen/a.md", "end/a/b.md", "#odd.md", "sp ace.md"], ["gen/d/a.md", "end", "note"]),
        (["node"], ["node", "node/x.md", "d/node/y.md"], ["nodes/x.md"]),
    ],
)
def test_ignore_rules(spark, lines, ignored, kept):
    df = spark.createDataFrame([(p,) for p in ignored + kept], "p string")
    got = {r["p"]: r["i"] for r in df.select("p", paths.ignored(F.col("p"), lines).alias("i")).collect()}
    assert [p for p in got if got[p]] == ignored


def test_scan_stays_in_its_folder(spark, tmp_path):
    src, other = tmp_path / "src", tmp_path / "other"
    _write(src, {"a.md": "# A", "b/c.md": "# C", "b/d.txt": "d", "drafts/e.md": "# E", "b/keep.md": "# K", ".gitignore": "drafts/\n*.txt\n"})
    _write(other, {"secret.md": "# S", "x/y.md": "# Y"})
    os.symlink(other / "secret.md", src / "link.md")
    os.symlink(src / "a.md", src / "inside.md")
    got = lambda **kw: {r["doc_path"]: bytes(r["raw"]).decode() for r in documents.scan(spark, str(src), "r", **kw).collect()}
    assert got() == {"a.md": "# A", "b/c.md": "# C", "b/keep.md": "# K", "inside.md": "# A"}
    assert set(got(follow_symlinks=True)) == {"a.md", "b/c.md", "b/keep.md", "inside.md", "link.md"}
    assert set(got(only=("b/", "./b/../b/c.md", "../other/secret.md", "/etc", "b"))) == {"b/c.md", "b/keep.md"}
    assert set(got(only=("../other",))) == set()
    _write(src, {"odd/[id].md": "# I", "odd/sp ace {x}.md": "# S", "odd/q?*.md": "# Q"})
    assert got(only=("odd",)) == {"odd/[id].md": "# I", "odd/sp ace {x}.md": "# S", "odd/q?*.md": "# Q"}
    os.utime(src / "b/c.md", (2_000_000_000, 2_000_000_000))
    assert set(got(max_files=1)) == {"b/c.md"} and set(got(max_files=1, sort_by="walk_order")) == {"a.md"}
    assert documents.inside(("x", "x/", "./x", "../y", "a/../../z", " ")) == ["x"]


def test_sections_by_id_with_checks(spark):
    rows = fixtures.sections(spark)
    steps = next(r["id"] for r in rows.collect() if r["title"] == "Steps")
    files = spark.createDataFrame([(p, t if p != "guide/01-install.md" else t.replace("installer", "INSTALLER")) for p, t in fixtures.FILES.items()], "doc_path string, content string")
    one = lambda **kw: sections.get_sections(rows, [steps], **kw).first()
    assert one(verify=True)["hash_verified"] is True
    assert one(verify=True, files=files)["hash_verified"] is False and "INSTALLER" in one(files=files)["content"]
    short = one(verify=True, compress_code=True)
    assert "# fetch it" not in short["content"] and "acme init" in short["content"] and short["hash_verified"] is False
    assert "2. Check the version" not in one(strip=["2. Check the version"])["content"]
    assert [r["found"] for r in sections.get_sections(rows, ["no", steps], verify=True).orderBy("ord").collect()] == [False, True]


def test_group_search_in_all_modes(spark):
    rng = random.Random(2)
    rows = [(f"r{i % 3}", f"r{i % 3}::d{i}::s#1", f"d{i}.md", f"title {i}", "", " ".join(rng.choice(["pump", "valve", "pipe", "tank", "gear"]) for _ in range(12)), "", rng.choice(["guide", "api"]), [rng.random(), rng.random()]) for i in range(60)]
    s = spark.createDataFrame(rows, "repo string, id string, doc_path string, title string, summary string, content string, parent_id string, role string, embedding array<double>")
    vector = [1.0, 0.3]

    def fused(lists, k=10):
        out = sorted(((round(1 / (60 + rank), 8), repo, i) for repo, ids in lists.items() for rank, i in enumerate(ids, 1)), key=lambda x: (-x[0], x[1], x[2]))
        return [(repo, i, score) for score, repo, i in out[:k]]

    def ranked(repo, weight=None, only=False):
        mine = s.filter(F.col("repo") == repo)
        lexical = [r["id"] for r in search.bm25_scores(index.terms(mine), "pump valve").withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "id").collect()]
        close = [r["id"] for r in search.semantic_scores(mine, vector).orderBy(F.desc("score"), "id").collect()]
        if weight is None:
            return lexical
        lists = [(close, 1.0)] if only else [(lexical, 1 - weight), (close, weight)]
        total, seen = {}, {}
        for n, (ids, w) in enumerate(lists):
            for rank, i in enumerate(ids, 1):
                total[i] = total.get(i, 0) + w / (60 + rank)
                seen.setdefault(i, (n, rank))
        return sorted(total, key=lambda i: (-total[i], seen[i], i))

    get = lambda **kw: [tuple(r) for r in search.group_search(s, "pump valve", 10, **kw).collect()]
    repos = ("r0", "r1", "r2")
    role = {r[1]: r[7] for r in rows}
    assert get() == fused({r: ranked(r)[:10] for r in repos})
    assert get(embedded=s, vector=vector, semantic_weight=0.3) == fused({r: ranked(r, 0.3)[:10] for r in repos})
    assert get(embedded=s, vector=vector, semantic_only=True) == fused({r: ranked(r, 1, True)[:10] for r in repos})
    assert get(roles=("api",)) == fused({r: [i for i in ranked(r)[:10] if role[i] == "api"] for r in repos})
    assert {role[i] for _, i, _ in get(filter_mode="pre", roles=("api",))} == {"api"}


def test_similar_sections_with_and_without_vectors(spark):
    rng = random.Random(7)
    words = ["pump", "valve", "pipe", "tank", "gear", "belt", "motor", "seal"]
    rows = []
    for i in range(70):
        at = rng.randrange(0, 400)
        rows.append((f"s{i:02}", f"{rng.choice('ab')}/d{i % 12}.md", " ".join(rng.sample(words, 3)), " ".join(rng.sample(words, 4)), at, at + rng.randrange(0, 300), [rng.gauss(1, 0.5), rng.gauss(1, 0.5)] if i % 5 else None))
    s = spark.createDataFrame(rows, "id string, doc_path string, title string, summary string, byte_start int, byte_end int, embedding array<double>")

    def brute(vectors, same):
        out = {}
        j = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
        for n, a in enumerate(rows):
            for b in rows[n + 1 :]:
                if a[5] <= a[4] or b[5] <= b[4]:
                    continue
                if a[1] == b[1] and (not same or min(a[5], b[5]) - max(a[4], b[4]) > 0.5 * min(a[5] - a[4], b[5] - b[4])):
                    continue
                title, body = j(a[2], b[2]), j(a[3], b[3])
                if max(title, body) < 0.1:
                    continue
                score = 0.7 * body + 0.3 * title
                if vectors and a[6] and b[6]:
                    score = 0.6 * sum(x * y for x, y in zip(a[6], b[6])) / math.hypot(*a[6]) / math.hypot(*b[6]) + 0.25 * body + 0.15 * title
                if round(score, 4) >= 0.7:
                    out[a[0], b[0]] = round(score, 4)
        return out

    for vectors in (False, True):
        for same in (False, True):
            got = {(r["a"], r["b"]): r["score"] for r in similarity.similar_sections(s, exclude_same_doc=not same, embedded=s if vectors else None).collect()}
            want = brute(vectors, same)
            assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-4 for k in want) and want


def test_neighbours_by_products_are_those_of_the_expression(spark, monkeypatch):
    """Copies, zero vectors, other lengths, nulls and near ties; all pairs are met in blocks, not in a nested loop of rows."""
    rng = random.Random(8)
    base = [[float(rng.randrange(-3, 4)) for _ in range(5)] for _ in range(60)]
    rows = [(i, rng.choice(base) if i % 7 else [0.0] * 5 if i % 2 else [rng.gauss(0, 1) for _ in range(4)]) for i in range(400)] + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0])]
    rows = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    for top, least in ((5, 0.6), (3, 0.0), (7, -1.0)):
        monkeypatch.setattr(similarity, "FEW_QUERIES", 10_000)
        want = sorted(map(tuple, similarity.semantic_neighbors(rows, rows, top, least).collect()))
        monkeypatch.setattr(similarity, "FEW_QUERIES", 16)
        met = similarity.semantic_neighbors(rows, rows, top, least)
        assert sorted(map(tuple, met.collect())) == want and len(want) > 1000
        assert not any(x in met._jdf.queryExecution().toString() for x in ("BroadcastNestedLoopJoin", "CartesianProduct"))


def test_neighbours_in_blocks_are_those_of_one_block(spark, monkeypatch):
    rng = random.Random(1)
    rows = spark.createDataFrame([(f"v{i:03}", [rng.gauss(0, 1) for _ in range(6)] if i % 9 else None) for i in range(120)], "id string, embedding array<double>")
    want = sorted(map(tuple, similarity.semantic_neighbors(rows, rows, 4, 0.3).collect()))
    monkeypatch.setattr(similarity, "BLOCK_FLOATS", 100)
    assert sorted(map(tuple, similarity.semantic_neighbors(rows, rows, 4, 0.3).collect())) == want and len(want) > 200
    tree = spark.createDataFrame([("r", "a", "", 0, [1.0, 0.0]), ("r", "b", "a", 1, [0.9, 0.1]), ("r", "c", "a", 2, [0.0, 1.0])], "repo string, id string, parent_id string, seq int, embedding array<double>")
    near = {(r["source"], r["id"], r["kind"]) for r in pipeline.adjacency(tree).collect()}
    assert {("a", "b", "child"), ("b", "c", "sibling"), ("a", "b", "semantic"), ("b", "a", "semantic")} <= near and ("a", "c", "semantic") not in near
    assert pipeline.adjacency(tree.drop("embedding")).filter("kind = 'semantic'").count() == 0


def test_canary_and_health(spark, tmp_path):
    embed = lambda shift: lambda rows: rows.select("content_hash", F.array(F.length("embed_text").cast("float"), F.lit(float(shift))).alias("embedding"))
    store = Store(spark, str(tmp_path / "index"))
    assert similarity.canary_drift(store.load("canary", "r"), spark, embed(1)).first()["has_canary"] is False
    store.save_side("canary", "r", similarity.capture_canary(spark, embed(1)))
    kept = store.load("canary", "r")
    same, moved = (similarity.canary_drift(kept, spark, embed(x)).first() for x in (1, 60))
    assert (same["n"], same["alarm"], moved["alarm"]) == (16, False, True)
    s = fixtures.sections(spark)
    s = s.withColumn("embedding", F.when(F.col("level") > 0, F.array(F.lit(1.0)))).withColumn("file_hash", F.lit("x"))
    files = spark.createDataFrame([(p, t, "x" if p != "faq.md" else "y") for p, t in fixtures.FILES.items() if p != "changelog.md"], "doc_path string, content string, file_hash string")
    row = health.doc_health(s, files, index.links(s), drift=similarity.canary_drift(kept, spark, embed(60))).first()
    assert row["doc_count"] == len(fixtures.FILES) and row["section_count"] == s.count() == sum(row["role_distribution"].values())
    assert row["edited_uncommitted"] > 0 and row["stale_index"] > 0 and row["broken_links"] >= 3 and row["embedded"] == s.filter("level > 0").count()
    axes = {r["axis"]: r["score"] for r in health.radar(health.radar_counts(health.doc_health(s, files, index.links(s), drift=similarity.canary_drift(kept, spark, embed(60))))).collect()}
    assert axes["drift_health"] == 0.0 and axes["role_coverage"] == 100.0 and axes["freshness"] < 100.0


def test_tree_of_contents_is_json(spark):
    rows = [("d", 'a"\\', "", 'T "quoted" \\ back', 1, 0, 0, 10, "s"), ("d", "b", 'a"\\', "B\n", 2, 1, 10, 20, None), ("d", "c", "gone", "C", 2, 2, 20, 30, "x"), ("d", "deep", "b", "D", 9, 3, 30, 40, "")]
    s = spark.createDataFrame(rows, "doc_path string, id string, parent_id string, title string, level int, seq int, byte_start int, byte_end int, summary string")
    tree = json.loads(sections.toc_tree(s, depth=3).first()["tree"])
    assert [n["id"] for n in tree] == ['a"\\', "c"] and tree[0]["title"] == 'T "quoted" \\ back' and tree[0]["level"] == 1
    assert tree[0]["children"] == [{"id": "b", "title": "B\n", "level": 2, "summary": None, "byte_start": 10, "byte_end": 20, "children": []}]
    assert sections.toc_tree(s, path_glob="other*").count() == 0


def test_what_is_kept_beside_an_index(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    assert store.load_side("glossary", "a/b", "term string").count() == 0
    store.save_side("glossary", "a/b", spark.createDataFrame([("t", "d")], "term string, definition string"))
    assert store.load_side("glossary", "a/b", "term string").count() == 1
    for part in (tmp_path / "index" / "glossary").rglob("part-*.parquet"):
        part.write_bytes(b"broken")
    for crc in (tmp_path / "index" / "glossary").rglob(".*.crc"):
        crc.unlink()
    assert store.load_side("glossary", "a/b", "term string").count() == 0
    assert (store.savings(), store.add_savings(10), store.add_savings(-3), store.add_savings(5), store.savings()) == (0, 10, 10, 15, 15)
    (tmp_path / "index" / "_savings.json").write_text("{broken")
    for crc in (tmp_path / "index").glob(".*.crc"):
        crc.unlink()
    assert store.savings() == 0 and store.add_savings(2) == 2
    calls = spark.createDataFrame([("s1", 1, 1000, 200), ("s1", 2, 100, 400), ("s2", 1, 4_000_000, 0), ("s1", 3, 80, 40)], "session string, ts int, raw_bytes long, sent_bytes long")
    assert [(r["tokens_saved"], r["total_tokens_saved"]) for r in telemetry.ledger(calls).filter("session = 's1'").orderBy("ts").collect()] == [(200, 200), (0, 200), (10, 210)]
    stats = {r["session"]: r for r in telemetry.session_stats(calls).collect()}
    assert stats["s2"]["cost_avoided_claude_opus"] == 15.0 and stats["s1"]["calls"] == 3


def test_a_specification_as_one_text():
    spec = {
        "openapi": "3.0.0", "info": {"title": "Pets", "version": 2, "description": "All of them."},
        "paths": {"/pets": {"get": {"tags": ["p", "q"], "summary": "All", "description": "All pets.", "parameters": [{"name": "n", "in": "query", "schema": {"type": "integer", "format": "int32"}, "description": "how many"}, {"name": "x", "in": "path", "required": True}], "responses": {"200": {"description": "ok"}}}, "post": {"requestBody": {"required": True, "content": {"application/json": {"schema": {"$ref": "#/c/Pet"}}}}}}},
        "components": {"schemas": {"Pet": {"description": "A pet.", "required": ["id"], "properties": {"id": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}, "description": "labels"}}}}},
    }
    assert openapi.to_markdown(json.dumps(spec)) == (
        "# Pets\n\nVersion: 2\n\nAll of them.\n\n\n## p\n\n### GET /pets — All\n\nAll pets.\n\n**Parameters:**\n- `n` (query, optional, integer(int32)) — how many\n- `x` (path, required)\n\n**Responses:**\n- `200` — ok"
        "\n\n\n## Operations\n\n### POST /pets\n\n**Request Body (required):**\n- `application/json` → `Pet`\n\n\n## Schemas\n\n### Pet\nA pet.\n\n**Properties:**\n- `id` *(required)* (`integer`)\n- `tags` (`array[string]`) — labels"
    )
    assert openapi.to_markdown("[1, 2]") == openapi.to_markdown("{}") == ""
