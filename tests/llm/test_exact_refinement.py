import pytest

from quire.llm import exact

DOCS = [(1, "same text"), (2, "same  text"), (3, "other text"), (4, None), (5, " "), (6, "alone")]


def test_refinement_decides_which_rows_are_grouped(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = {r["doc_id"]: r for r in exact.exact_groups(docs, hash_all=True).collect()}
    assert {i: r["group_size"] for i, r in got.items()} == {1: 2, 2: 2, 3: 1, 4: 2, 5: 2, 6: 1}
    assert all(r["text_sha256"] for r in got.values())
    survivors = exact._survivor_filter
    monkeypatch.setattr(exact, "_survivor_filter", lambda groups: survivors(groups.limit(0)))
    assert {r["group_size"] for r in exact.exact_groups(docs, hash_all=True).collect()} == {1}  # nothing survives, so nothing is grouped


@pytest.mark.parametrize("hash_all", [True, False])
def test_the_digest_column_does_not_change_groups(spark, hash_all):
    docs = spark.createDataFrame(DOCS * 2, "doc_id long, text string")
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_groups(docs, hash_all=hash_all).collect())
    assert [x[1] for x in got] == [2, 2, 2, 2, 3, 3, 5, 5, 5, 5, 6, 6] and sum(x[3] for x in got) == 4
