"""Hand-made documents of every format, and the sections they must give."""

import json

import fixtures

from quire.sources import convert, documents, outline


def split(text, path="d/doc.md"):
    return [(r["title"], r["level"], r["id"].split("::")[-1], r["content"]) for r in documents.split_document(text, path, "r")]


def test_markdown_covers_the_document_without_overlap():
    text = "---\ntitle: x\n---\nintro é\n# A\nx\n## B\n```py\n# not one\n```\n# A\ny\nUnder\n=====\nz\n| a |\n---\n"
    rows = documents.split_document(text, "d/doc.md", "r")
    assert "".join(r["content"] for r in rows) == text
    assert [r["byte_start"] for r in rows[1:]] == [r["byte_end"] for r in rows[:-1]]
    assert [(r["title"], r["level"]) for r in rows] == [("doc", 0), ("A", 1), ("B", 2), ("A", 1), ("Under", 1)]
    assert [r["id"].split("::")[-1] for r in rows] == ["doc#0", "a#1", "a/b#2", "a-2#1", "under#1"]
    assert rows[2]["code_blocks"][0]["lang"] == "py" and rows[2]["code_blocks"][0]["content"] == "# not one\n"
    assert rows[2]["parent_id"] == rows[1]["id"] and rows[1]["children"] == [rows[2]["id"]] and rows[1]["parent_id"] == rows[0]["id"]


def test_empty_documents():
    assert split("") == [("doc", 0, "doc#0", "")]
    assert split("", "a.txt") == [("a", 0, "a#0", "")]
    assert split("", "a.json") == []
    assert split("{not json", "a.json") == []


def test_rst_levels_follow_first_use():
    text = "====\nTop\n====\n\nSub\n---\nx\n\nDeep\n~~~~\n\nSub2\n----\n"
    assert [(t, lv) for t, lv, *_ in split(text, "a.rst")] == [("a", 0), ("Top", 1), ("Sub", 2), ("Deep", 3), ("Sub2", 2)]


def test_asciidoc_and_text():
    assert [(t, lv) for t, lv, *_ in split("= T\nx\n== S ==\ny\n", "a.adoc")] == [("a", 0), ("T", 1), ("S", 2)]
    assert split("one\ntwo\n\n\none\n", "a.txt") == [("one", 1, "one#1", "one\ntwo\n"), ("one", 1, "one-2#1", "one\n")]


def test_html_headings_code_and_dropped_tags():
    made = convert.html("<title>T</title><nav>no</nav><h1>One</h1><p>a  b</p><pre>x = 1\n</pre><h2>Two</h2>see <code>y</code><script>z</script>")
    assert made == "T\n\n# One\n\n\na b\n\n```\nx = 1\n\n```\n\n## Two\nsee `y`".replace("\n\n\n", "\n\n")


def test_mdx_notebook_json_xml_godot():
    assert convert.mdx("---\na: b\n---\nimport X from 'x'\n<Note>\nkeep\n</Note>\n<Chart />\n") == "keep"
    book = {"metadata": {}, "cells": [{"cell_type": "markdown", "source": ["# H\n", "t"]}, {"cell_type": "code", "source": "1+1", "outputs": [{"output_type": "stream", "text": "2\n"}, {"data": {"image/png": "x"}}]}]}
    assert convert.notebook(json.dumps(book)) == "# H\nt\n\n```python\n1+1\n```\n\n**Output:**\n\n> 2\n\n_[image/png image; output preserved at index time]_"
    assert convert.json_tree('{"a": {"b": 1}, // note\n "c": [true, {"name": "n", "url": "http://x"}]}', "f.jsonc") == "# f.jsonc\n\n## a\n\n### b\n\n`1`\n\n## c\n- `true`\n\n### n\n\n#### name\n\nn\n\n#### url\n\nhttp://x"
    assert convert.xml("<r v='1'><a id='k'>t</a></r>", "x.xml") == "# x.xml\n\nRoot element: `r`\n\n## Attributes\n- `v`: 1\n\n## a (k)\n- `id`: k\n\nt"
    scene = '[gd_scene format=3]\n[node name="Root" type="Node2D"]\nx = 1\n[node name="Kid" parent="."]\n'
    assert [(t, lv) for t, lv, *_ in split(scene, "s.tscn")] == [("s", 0), ("s", 1), ("File Metadata", 2), ("Scene Tree", 2), ("Root (Node2D)", 3), ("Kid", 4)]


def test_openapi_sections_have_metadata():
    rows = {r["title"]: r for r in fixtures.rows() if r["doc_path"] == "petstore.json"}
    op = json.loads(rows["GET /pets"]["metadata"])["openapi_op"]
    assert op["operationId"] == "listPets" and op["responses"]["200"]["refs"] == ["Pet"]
    schema = json.loads(rows["Pet"]["metadata"])["openapi_schema"]
    assert schema["refs"] == ["Owner"] and schema["used_by_operations"] == ["listpets"]
    assert rows["POST /pets"]["parent_id"] == rows["pets"]["id"] and rows["Untagged"]["level"] == 2


def test_slugs_are_numbered_and_nested():
    s = outline.Slugs()
    assert [s.under("A b", 1), s.under("A b", 2), s.under("A b", 2), s.under("Café!", 1), s.under("a B", 1), s.under("!!", 1)] == ["a-b", "a-b/a-b", "a-b/a-b-2", "café", "a-b-2", "section"]
