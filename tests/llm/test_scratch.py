"""What queries leave in the shared folder: their result, and nothing that was written on the way."""

import os

import pytest

from quire.llm import registry
from quire.scratch import shared_dir

DOCS = [(i, f"some words of text {i} that go on for a while, under the MIT license", "en", f"s{i % 2}", 9) for i in range(6)]


@pytest.mark.parametrize("name", ["op3_ngram_join", "op8_url_filter", "op10_vector_dedup", "op11_merkle_manifest", "op12_license_scan", "op13_source_divergence"])
def test_only_the_result_is_left(spark, tables, name):
    d = tables(
        documents=("doc_id long, text string, lang string, source string, n_chars long", DOCS),
        pages=("page_id long, url string, html string", [(i, f"https://a{i % 3}.org/x/{i}", "") for i in range(20)]),
        labels=("doc_id long, quality int, toxic int", [(i, i % 2, 0) for i in range(20)]),
        embeddings=("vec_id long, embedding array<float>, label int", [(i, [1.0, 0.01 * i], 1) for i in range(5)]),
    )
    where = shared_dir(spark).removeprefix("file:") + "/quire"
    here = lambda: set(os.listdir(where)) if os.path.isdir(where) else set()
    before = here()
    out = registry.queries()[name](spark, d)
    assert out.count() > 0 and len(here() - before) <= 1
