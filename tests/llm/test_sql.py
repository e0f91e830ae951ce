"""The queries that SQL can express, on the smallest tables."""

import pytest

from compare import connect, spark_rows, sql_rows
from quire.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert spark_rows(registry.queries()[name](spark, SF)) == sql_rows(connect(SF), registry.oracle_sql()[name])


DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, h string, count int, id int, size int"
EMPTY = {
    "documents": (DOCS, []), "conversations": ("conv_id long, turn long, role string, text string", []), "pages": ("page_id long, url string, html string", []),
    "labels": ("doc_id long, quality int, toxic int", []), "embeddings": ("vec_id long, embedding array<float>, label int", []), "benchmark": ("item_id long, text string", []),
}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, tables, name):
    out = registry.queries()[name](spark, tables(**EMPTY)).collect()
    assert len(out) == (1 if name.startswith("op1_") else 0)


@pytest.mark.parametrize("name", sorted(n for n in registry.queries() if n.split("_")[0] not in ("op1", "op8", "op13")))
def test_nulls_ties_and_clashing_columns(spark, tables, name):
    x = ("a", "b", 1, 2, 3)
    rows = [(1, None, "en", "s", 0, *x), (2, "", None, None, None, *x), (None, "the words of a text that are here", None, "s", 3, *x), (3, "the words of a text that are here", "en", "t", 3, *x), (3, "the words of a text that are here", "en", "t", 3, *x), (4, " \t\n ", "fr", None, 1, *x), (5, "mot " * 30000, "fr", "t", 9, *x)]
    vectors = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [1.0, 2.0], 1), (6, [1.0, 2.0], 1), (7, [2.0, 4.001], None), (8, [1.0], 1), (None, [-1.0, -2.0], 1)]
    d = tables(**EMPTY | {"documents": (DOCS, rows), "embeddings": (EMPTY["embeddings"][0], vectors)})
    out = registry.queries()[name](spark, d).collect()
    assert len(out) == (len(vectors) if name.startswith("op10") else len(rows))
