"""Each stage of the pipeline on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, number int, size string, score double, raw binary, lang_pred string, id long, h long, copies int, `a.b` int, codes array<int>"
MORE = ("k", 1, 2, "s", 0.1, b"r", "x", 7, 8, 9, 10, [11])


def rows():
    rng = random.Random(3)
    words = ["the", "house", "river", "stone", "and", "green"]
    said = lambda n: "\n".join(" ".join(rng.choice(words) + str(rng.randrange(500)) for _ in range(12)) for _ in range(n))
    made = [(i, said(3), "en", f"s{i % 3}", 0) for i in range(12)]
    made += [(20, made[0][1], "en", "s0", 0)] * 2 + [(None, said(2), None, None, None), (21, None, None, None, None), (22, "", "en", "s1", 0), (23, " \n\t", "en", "s1", 0), (24, said(4000), "en", "s2", 0), (25, "x" * 300_000, "en", "s2", 0), (0, "another text with the same id", "en", "s0", 0)]
    return [(*r, *MORE) for r in made]


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stage_keeps_to_its_columns(spark, name):
    stage = dict(cp.STAGES)[name]
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = stage(spark, docs, "")
    got = out.collect()
    empty = stage(spark, docs.limit(0), "")
    assert empty.count() == 0 and empty.columns == out.columns
    if name != cp.STAGES[-1][0]:
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        assert all(r[c] == v for r in got for c, v in zip(docs.columns[5:], (*MORE[:5], bytearray(MORE[5]), *MORE[6:]), strict=True))
    ids = [r["doc_id"] for r in got]
    if name == "language ID":
        assert {21, 22, 23} & set(ids) == set() and set(range(12)) <= set(ids) and ids.count(20) == 2 and None in ids
    elif name == "line dedup":
        assert len(got) == docs.count() and {r["text"] for r in got if r["doc_id"] == 20} == {""}
        assert [r["text"] for r in got if r["doc_id"] == 21] == [None]
    elif name == "n-gram Jaccard join":
        assert ids.count(20) == 0 and ids.count(0) == 2 and len({21, 22, 23} & set(ids)) == 1 and None in ids and {24, 25} <= set(ids)
    elif name == "mixing sources to target weights":
        assert not {21, 22, 23} & set(ids) and max(ids.count(i) for i in range(1, 12)) <= 2
    else:
        assert len(got) == docs.count() and {r["n_tokens"] for r in got if r["doc_id"] in (21, 22)} == {0}


def test_whole_run_leaves_no_tables_behind(spark, tables, monkeypatch):
    from quire import scratch

    written, kept = [], scratch.cut
    monkeypatch.setattr(scratch, "_WRITTEN", [written])
    docs = spark.createDataFrame([r[:5] for r in rows()], "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.run(spark, tables(documents=(docs.schema, docs.collect())))
    assert out.count() > 0 and kept is scratch.cut
    there = [p for p in written if scratch.read_small(spark, p + "/_SUCCESS") is not None]
    assert len(there) == 1 and out.inputFiles()[0].removeprefix("file://").startswith(there[0].removeprefix("file:"))
    assert F.col("doc_id") is not None
