"""Sidebars of settings files, and chains of tutorials through them."""

import json

from quire.operators import links
from quire.sources import sidebars

SITE = {"themeConfig": {"sidebar": ["/", "/install/", {"text": "Guide", "link": "/guide/start.md", "children": ["guide/two", {"items": ["/guide/deep/", {"path": "/guide/last"}]}, 7, None]}, ["/install/", "nowhere"], "[odd]"]}}
DOCS = ["README.md", "install/index.md", "guide/start.md", "guide/two.md", "guide/deep/README.md", "guide/last.md", "api.md", "[odd].md"]
ORDER = ["README.md", "install/index.md", "guide/start.md", "guide/two.md", "guide/deep/README.md", "guide/last.md", "[odd].md"]


def test_nested_settings_in_order(spark):
    settings = spark.createDataFrame([(".vuepress/config.json", json.dumps(SITE)), ("b/.vuepress/config.json", json.dumps({"sidebar": ["api", "/api.md"]})), ("c/.vuepress/config.json", "{not json"), ("d/.vuepress/config.json", json.dumps({"title": "x"}))], "doc_path string, text string")
    docs = spark.createDataFrame([(d,) for d in DOCS], "doc_path string")
    got = {}
    for r in sidebars.sidebars(settings, docs).orderBy("root", "at").collect():
        got.setdefault(r["root"], []).append(r["next"])
    assert got == {".vuepress/config.json": ORDER, "b/.vuepress/config.json": ["api.md"]}


def test_a_chain_through_a_sidebar(spark):
    settings = spark.createDataFrame([(".vuepress/config.json", json.dumps(SITE))], "doc_path string, text string")
    sections = spark.createDataFrame([(d, 0, f"# {d}") for d in DOCS], "doc_path string, seq int, content string")
    edges = links.tutorial_edges(sections, sidebars.sidebars(settings, sections))
    walk = links.tutorial_chain(edges, "guide/start.md").orderBy("step").collect()
    assert [r["doc"] for r in walk] == ORDER[2:]


def test_contents_lists_make_chains(spark):
    rows = [("index.rst", 0, ".. toctree::\n   :maxdepth: 2\n\n   intro\n   Usage <use/page>\n\nText"), ("intro.rst", 0, "x"), ("use/page.rst", 0, "y")]
    edges = links.tutorial_edges(spark.createDataFrame(rows, "doc_path string, seq int, content string"))
    assert {(r["doc"], r["next"]) for r in edges.filter("strategy = 'sphinx_toctree'").collect()} == {("index.rst", "intro.rst"), ("intro.rst", "use/page.rst")}
