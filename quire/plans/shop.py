"""A documentation repo made of the driver's tables: a Markdown file for each region, nation, supplier and part, and an API
description for each nation. The engine reads the files; the SQL says what must be found in them by how they are made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut, table

REPO = "shop"
_READ: dict[tuple[str, str], DataFrame] = {}


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def files(spark: SparkSession, d: str) -> DataFrame:
    """repo, doc_path, raw."""
    col = F.col
    region = table(spark, d, "region").select(
        _text("r/", col("r_regionkey"), ".md").alias("doc_path"),
        _text("# ", col("r_name"), "\n\nNations are listed here.\n\n## FAQ\n\nText.\n\n### More\n\nWhat?\n\n## Shipping\n\n1. Install it\n2. Run it\n3. Check it\n\n```sh\na\n```\n\n```sh\nb\n```\n").alias("text"),
    )
    key = col("n_nationkey")
    broken = F.when(key % 5 == 0, _text("\nSee [lost](../n/", key + 100, ".md) and [gone](#nowhere).\n")).otherwise("")
    nation = table(spark, d, "nation").select(
        _text("n/", key, ".md").alias("doc_path"),
        _text("# ", col("n_name"), "\n\nPart of [the region](../r/", col("n_regionkey"), ".md). #nation #r", col("n_regionkey"), "\n\n## Customs\n\n**Zone ", key, "** - the customs zone of nation ", key, ".\n", broken).alias("text"),
    )
    supp = col("s_suppkey")
    site = F.when(supp % 7 == 0, _text("\nSite https://example.com/s/", supp, "\n")).otherwise("")
    supplier = table(spark, d, "supplier").select(
        _text("s/", supp, ".md").alias("doc_path"),
        _text("# Supplier ", supp, "\n\nShips from [its nation](../n/", col("s_nationkey"), ".md#customs). #supplier\n\n## Usage\n\n```python\n# order\n\nsupplier_", supp, ".order()\n```\n", site).alias("text"),
    )
    sold = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").repartition("l_partkey").groupBy("l_partkey").agg(F.sort_array(F.array_distinct(F.collect_list("l_suppkey"))).alias("by"))  # as many as there are suppliers
    opens, ends = "- [supplier](../s/", ".md)\n"
    lines = F.when(F.size("by") > 0, _text(opens, F.array_join(F.col("by").cast("array<string>"), ends + opens), ends))
    part = table(spark, d, "part").join(sold, col("p_partkey") == col("l_partkey"), "left")
    part = part.select(_text("p/", col("p_partkey"), ".md").alias("doc_path"), _text("# ", col("p_name"), "\n\nSold by:\n\n", F.coalesce(lines, F.lit(""))).alias("text"))
    every = region.unionByName(nation).unionByName(supplier).unionByName(part)
    return every.select(F.lit(REPO).alias("repo"), "doc_path", F.col("text").cast("binary").alias("raw"))


def api_files(spark: SparkSession, d: str) -> DataFrame:
    """repo, doc_path, raw: the API descriptions."""
    col, key = F.col, F.col("n_nationkey")
    schema = lambda name: _text('{"$ref":"#/components/schemas/', name, '"}')
    this, new, area = _text("Nation", key), _text("New", key), _text("Region", col("n_regionkey"))
    api = table(spark, d, "nation").select(
        _text("api/", key, ".json").alias("doc_path"),
        _text(
            '{\n"openapi":"3.0.0","info":{"title":"API ', key, '","version":"1"},"paths":{"/nations/', key, '/customers":{"get":{"operationId":"list', key,
            '","tags":["nations"],"responses":{"200":{"description":"ok","content":{"application/json":{"schema":', schema(this),
            '}}}}},"post":{"requestBody":{"content":{"application/json":{"schema":', schema(new), '}}},"responses":{"201":{"description":"made"}}}}},"components":{"schemas":{"', this,
            '":{"type":"object","properties":{"region":', schema(area), '}},"', new, '":{"allOf":[', schema(this), ']},"', area, '":{"type":"object"}}}}',
        ).alias("text"),
    )
    return api.select(F.lit(REPO).alias("repo"), "doc_path", F.col("text").cast("binary").alias("raw"))


def _once(spark: SparkSession, name: str, make, label: str) -> DataFrame:
    """A table that is made and written once a session."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _READ:
        _READ[key] = cut(make(), label)
    return _READ[key]


def _bare(spark: SparkSession, d: str, made) -> DataFrame:
    """The files as the engine reads them, before roles are told: for queries that use none."""
    from ..sources import documents

    return _once(spark, f"{d} {made.__name__} bare", lambda: documents.sections(made(spark, d)), "shop")


def _read(spark: SparkSession, d: str, made) -> DataFrame:
    """The files as the engine reads them, with roles."""
    from .pipeline import with_roles

    return _once(spark, f"{d} {made.__name__}", lambda: with_roles(_bare(spark, d, made)), "shop")


def bare_sections(spark: SparkSession, d: str) -> DataFrame:
    return _bare(spark, d, files)


def some_columns(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Columns of these sections, for a query that reads them once: nothing else is read out of the files, and nothing is written."""
    from ..sources import documents

    made = _READ.get((spark.sparkContext.applicationId, f"{d} files bare"))
    return documents.sections(files(spark, d), columns) if made is None else made.select(*columns)


def links(spark: SparkSession, d: str) -> DataFrame:
    """The links of these sections, resolved once a session."""
    from . import index

    return _once(spark, f"{d} links", lambda: index.links(bare_sections(spark, d)), "links")


def sections(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, files)


def api_sections(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, api_files)


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """Names in code: a class for each nation, a variable for every third supplier, and functions that no document names."""
    supp = F.col("s_suppkey")
    nations = table(spark, d, "nation").select(_text("shop/n.py::nation_", F.col("n_nationkey"), "#class").alias("symbol"))
    some = table(spark, d, "supplier")
    return nations.unionByName(some.filter(supp % 3 == 0).select(_text("shop/s.py::supplier_", supp, "#variable").alias("symbol"))).unionByName(some.filter(supp % 4 == 1).select(_text("shop/x.py::zzz", supp, "#function").alias("symbol")))


_NL = "chr(10)"
#: Sections: doc_path, seq, level, title, id, parent_id, content, tags, role, role_source.
SECTIONS = f"""reg AS (SELECT r_regionkey AS k, r_name AS name, replace(replace(lower(r_name), '_', '-'), ' ', '-') AS slug, 'r/' || r_regionkey || '.md' AS doc FROM region),
nat AS (SELECT n_nationkey AS k, n_regionkey AS rk, n_name AS name, replace(replace(lower(n_name), '_', '-'), ' ', '-') AS slug, 'n/' || n_nationkey || '.md' AS doc FROM nation),
sup AS (SELECT s_suppkey AS k, s_nationkey AS nk, 'supplier-' || s_suppkey AS slug, 's/' || s_suppkey || '.md' AS doc FROM supplier),
sold AS (SELECT DISTINCT l_partkey AS pk, l_suppkey AS sk FROM lineitem),
par AS (SELECT p_partkey AS k, p_name AS name, replace(lower(p_name), ' ', '-') AS slug, 'p/' || p_partkey || '.md' AS doc,
  coalesce((SELECT string_agg('- [supplier](../s/' || sk || '.md)' || {_NL}, '' ORDER BY sk) FROM sold WHERE pk = p_partkey), '') AS lines FROM part),
s0 AS (
  SELECT doc, 0 AS seq, 0 AS level, CAST(k AS VARCHAR) AS title, CAST(k AS VARCHAR) AS slug, '' AS up, '' AS content, '' AS tags, 'concept' AS role, 'default' AS role_source FROM (SELECT doc, k FROM reg UNION ALL SELECT doc, k FROM nat UNION ALL SELECT doc, k FROM sup UNION ALL SELECT doc, k FROM par) z
  UNION ALL SELECT doc, 1, 1, name, slug, k || '#0', '# ' || name || {_NL} || {_NL} || 'Nations are listed here.' || {_NL} || {_NL}, '', 'concept', 'default' FROM reg
  UNION ALL SELECT doc, 2, 2, 'FAQ', slug || '/faq', slug || '#1', '## FAQ' || {_NL} || {_NL} || 'Text.' || {_NL} || {_NL}, '', 'faq', 'heading' FROM reg
  UNION ALL SELECT doc, 3, 3, 'More', slug || '/faq/more', slug || '/faq#2', '### More' || {_NL} || {_NL} || 'What?' || {_NL} || {_NL}, '', 'faq', 'ancestor' FROM reg
  UNION ALL SELECT doc, 4, 2, 'Shipping', slug || '/shipping', slug || '#1', '## Shipping' || {_NL} || {_NL} || '1. Install it' || {_NL} || '2. Run it' || {_NL} || '3. Check it' || {_NL} || {_NL} || '```sh' || {_NL} || 'a' || {_NL} || '```' || {_NL} || {_NL} || '```sh' || {_NL} || 'b' || {_NL} || '```' || {_NL}, '', 'tutorial', 'density' FROM reg
  UNION ALL SELECT doc, 1, 1, name, slug, k || '#0', '# ' || name || {_NL} || {_NL} || 'Part of [the region](../r/' || rk || '.md). #nation #r' || rk || {_NL} || {_NL}, 'nation,r' || rk, 'concept', 'default' FROM nat
  UNION ALL SELECT doc, 2, 2, 'Customs', slug || '/customs', slug || '#1', '## Customs' || {_NL} || {_NL} || '**Zone ' || k || '** - the customs zone of nation ' || k || '.' || {_NL} || CASE WHEN k % 5 = 0 THEN {_NL} || 'See [lost](../n/' || (k + 100) || '.md) and [gone](#nowhere).' || {_NL} ELSE '' END, '', 'concept', 'default' FROM nat
  UNION ALL SELECT doc, 1, 1, 'Supplier ' || k, slug, k || '#0', '# Supplier ' || k || {_NL} || {_NL} || 'Ships from [its nation](../n/' || nk || '.md#customs). #supplier' || {_NL} || {_NL}, 'supplier', 'concept', 'default' FROM sup
  UNION ALL SELECT doc, 2, 2, 'Usage', slug || '/usage', slug || '#1', '## Usage' || {_NL} || {_NL} || '```python' || {_NL} || '# order' || {_NL} || {_NL} || 'supplier_' || k || '.order()' || {_NL} || '```' || {_NL} || CASE WHEN k % 7 = 0 THEN {_NL} || 'Site https://example.com/s/' || k || {_NL} ELSE '' END, '', 'example', 'heading' FROM sup
  UNION ALL SELECT doc, 1, 1, name, slug, k || '#0', '# ' || name || {_NL} || {_NL} || 'Sold by:' || {_NL} || {_NL} || lines, '', 'concept', 'default' FROM par),
s AS (SELECT doc AS doc_path, seq, level, title, '{REPO}::' || doc || '::' || slug || '#' || level AS id, CASE WHEN up = '' THEN '' ELSE '{REPO}::' || doc || '::' || up END AS parent_id, content, tags, role, role_source FROM s0)"""
#: Links of these sections: source_section_id, source_section, source_doc, seq, ref_at, href, is_external, file_part, anchor, resolved.
LINKS = f"""{SECTIONS}, l0 AS (
  SELECT doc, 1 AS seq, 0 AS ref_at, '../r/' || rk || '.md' AS href, 0 AS is_external, '../r/' || rk || '.md' AS file_part, '' AS anchor, 'r/' || rk || '.md' AS resolved FROM nat
  UNION ALL SELECT doc, 2, 0, '../n/' || (k + 100) || '.md', 0, '../n/' || (k + 100) || '.md', '', 'n/' || (k + 100) || '.md' FROM nat WHERE k % 5 = 0
  UNION ALL SELECT doc, 2, 1, '#nowhere', 0, '', 'nowhere', NULL FROM nat WHERE k % 5 = 0
  UNION ALL SELECT doc, 1, 0, '../n/' || nk || '.md#customs', 0, '../n/' || nk || '.md', 'customs', 'n/' || nk || '.md' FROM sup
  UNION ALL SELECT doc, 2, 0, 'https://example.com/s/' || k, 1, 'https://example.com/s/' || k, '', NULL FROM sup WHERE k % 7 = 0
  UNION ALL SELECT 'p/' || pk || '.md', 1, row_number() OVER (PARTITION BY pk ORDER BY sk) - 1, '../s/' || sk || '.md', 0, '../s/' || sk || '.md', '', 's/' || sk || '.md' FROM sold WHERE pk IN (SELECT k FROM par)),
l AS (SELECT s.id AS source_section_id, s.title AS source_section, l0.doc AS source_doc, l0.seq, ref_at, href, is_external, file_part, anchor, resolved FROM l0 JOIN s ON s.doc_path = l0.doc AND s.seq = l0.seq)"""
SYMBOLS = """sy AS (SELECT 'shop/n.py::nation_' || n_nationkey || '#class' AS symbol, true AS documented, true AS known, NULL AS block FROM nation
  UNION ALL SELECT 'shop/s.py::supplier_' || s_suppkey || '#variable', false, true, 'shop::s/' || s_suppkey || '.md::supplier-' || s_suppkey || '/usage#2::code#0' FROM supplier WHERE s_suppkey % 3 = 0
  UNION ALL SELECT 'shop/x.py::zzz' || s_suppkey || '#function', false, false, NULL FROM supplier WHERE s_suppkey % 4 = 1)"""
#: Operations of the API descriptions: k, id, method, path, tag, ref.
OPERATIONS = """op AS (SELECT n_nationkey AS k, 'shop::api/' || n_nationkey || '.json::operations/nations/op-list' || n_nationkey || '#3' AS id, 'GET' AS method, '/nations/' || n_nationkey || '/customers' AS path, 'nations' AS tag, 'Nation' || n_nationkey AS ref FROM nation
  UNION ALL SELECT n_nationkey, 'shop::api/' || n_nationkey || '.json::operations/untagged/op-post-nations-' || n_nationkey || '-customers#3', 'POST', '/nations/' || n_nationkey || '/customers', 'untagged', 'New' || n_nationkey FROM nation)"""


def format_files(spark: SparkSession, d: str) -> DataFrame:
    """repo, doc_path, raw: a file for each nation in each other format that is read."""
    key, name = F.col("n_nationkey"), F.col("n_name")
    made = (
        ("m/", ".mdx", _text("---\ntitle: x\n---\nimport X from 'y'\n\n# ", name, '\n\n<Note>\nInside.\n</Note>\n\n## Part\n\nText <Card title="a" />done.\n')),
        ("t/", ".rst", _text(name, "\n====================\n\nIntro.\n\nPart\n----------\n\nText.\n")),
        ("a/", ".adoc", _text("= ", name, "\n\nIntro.\n\n== Part\n\nText.\n")),
        ("x/", ".txt", _text(name, " first\nmore\n\n\nSecond ", name, "\n")),
        ("h/", ".html", _text("<html><head><title>T</title><style>p {}</style></head><body><nav>menu</nav><h1>", name, "</h1><p>Intro &amp; more.</p><h2>Part</h2><ul><li>one</li><li>two</li></ul><pre><code>a  b</code></pre></body></html>")),
        ("b/", ".ipynb", _text('{"metadata":{"language_info":{"name":"python"}},"cells":[{"cell_type":"markdown","source":["# ', name, '\\n","\\n","Intro."]},{"cell_type":"code","source":["print(', key, ')"],"outputs":[{"output_type":"stream","text":["', key, '\\n"]}]}]}')),
        ("j/", ".jsonc", _text('{"name": "', name, '", // note\n "items": [{"name": "one", "v": 1}, "two"], "flag": true}')),
        ("w/", ".xml", _text('<root v="1"><item id="', name, '">text</item></root>')),
        ("g/", ".tscn", _text('[gd_scene format=3]\n\n[node name="', name, '" type="Node2D"]\nspeed = ', key, "\n")),
    )
    each = F.explode(F.array(*[F.struct(_text(folder, key, ending).alias("doc_path"), text.alias("text")) for folder, ending, text in made]))
    return table(spark, d, "nation").select(each.alias("f")).select(F.lit(REPO).alias("repo"), "f.doc_path", F.col("f.text").cast("binary").alias("raw"))


def format_sections(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, format_files)


def _expected() -> str:
    """Sections of these files: (folder, ending, seq, level, title, slug, parent's slug and level, content); {n} the name, {s} its slug, {k} the key."""
    rows = [
        ("m", ".mdx", 1, 1, "{n}", "{s}", "{k}#0", "# {n}\n\nInside.\n\n"), ("m", ".mdx", 2, 2, "Part", "{s}/part", "{s}#1", "## Part\n\nText done."),
        ("t", ".rst", 1, 1, "{n}", "{s}", "{k}#0", "{n}\n====================\n\nIntro.\n\n"), ("t", ".rst", 2, 2, "Part", "{s}/part", "{s}#1", "Part\n----------\n\nText.\n"),
        ("a", ".adoc", 1, 1, "{n}", "{s}", "{k}#0", "= {n}\n\nIntro.\n\n"), ("a", ".adoc", 2, 2, "Part", "{s}/part", "{s}#1", "== Part\n\nText.\n"),
        ("x", ".txt", 0, 1, "{n} first", "{s}-first", "", "{n} first\nmore\n"), ("x", ".txt", 1, 1, "Second {n}", "second-{s}", "", "Second {n}\n"),
        ("h", ".html", 0, 0, "{k}", "{k}", "", "T\n\n"), ("h", ".html", 1, 1, "{n}", "{s}", "{k}#0", "# {n}\n\nIntro & more.\n\n"), ("h", ".html", 2, 2, "Part", "{s}/part", "{s}#1", "## Part\n\none\n\ntwo\n\n```\na  b\n```"),
        ("b", ".ipynb", 1, 1, "{n}", "{s}", "{k}#0", "# {n}\n\nIntro.\n\n```python\nprint({k})\n```\n\n**Output:**\n\n> {k}"),
        ("j", ".jsonc", 1, 1, "{k}.jsonc", "{k}jsonc", "{k}#0", "# {k}.jsonc\n\n"), ("j", ".jsonc", 2, 2, "name", "{k}jsonc/name", "{k}jsonc#1", "## name\n\n{n}\n\n"), ("j", ".jsonc", 3, 2, "items", "{k}jsonc/items", "{k}jsonc#1", "## items\n\n"),
        ("j", ".jsonc", 4, 3, "one", "{k}jsonc/items/one", "{k}jsonc/items#2", "### one\n\n"), ("j", ".jsonc", 5, 4, "name", "{k}jsonc/items/one/name", "{k}jsonc/items/one#3", "#### name\n\none\n\n"),
        ("j", ".jsonc", 6, 4, "v", "{k}jsonc/items/one/v", "{k}jsonc/items/one#3", "#### v\n\n`1`\n- two\n\n"), ("j", ".jsonc", 7, 2, "flag", "{k}jsonc/flag", "{k}jsonc#1", "## flag\n\n`true`"),
        ("w", ".xml", 1, 1, "{k}.xml", "{k}xml", "{k}#0", "# {k}.xml\n\nRoot element: `root`\n\n"), ("w", ".xml", 2, 2, "Attributes", "{k}xml/attributes", "{k}xml#1", "## Attributes\n- `v`: 1\n\n"), ("w", ".xml", 3, 2, "item ({n})", "{k}xml/item-{s}", "{k}xml#1", "## item ({n})\n- `id`: {n}\n\ntext"),
        ("g", ".tscn", 1, 1, "{k}", "{k}", "{k}#0", "# {k}\n\nGodot scene file: `{k}.tscn`\n\n"), ("g", ".tscn", 2, 2, "File Metadata", "{k}/file-metadata", "{k}#1", "## File Metadata\n- `format`: 3\n\n"),
        ("g", ".tscn", 3, 2, "Scene Tree", "{k}/scene-tree", "{k}#1", "## Scene Tree\n\n"), ("g", ".tscn", 4, 3, "{n} (Node2D)", "{k}/scene-tree/{s}-node2d", "{k}/scene-tree#2", "### {n} (Node2D)\n- `speed = {k}`"),
    ]
    rows += [(folder, ending, 0, 0, "{k}", "{k}", "", "") for folder, ending in (("m", ".mdx"), ("t", ".rst"), ("a", ".adoc"), ("b", ".ipynb"), ("j", ".jsonc"), ("w", ".xml"), ("g", ".tscn"))]
    quoted = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


FORMATS = f"""x AS (SELECT * FROM (VALUES {_expected()}) AS v(folder, ending, seq, level, title, slug, up, content)),
nk AS (SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS n, replace(replace(lower(n_name), '_', '-'), ' ', '-') AS s FROM nation),
y AS (SELECT folder || '/' || k || ending AS doc, seq, level, replace(replace(title, '{{n}}', n), '{{k}}', k) AS title, replace(replace(slug, '{{s}}', s), '{{k}}', k) AS slug, replace(replace(up, '{{s}}', s), '{{k}}', k) AS up, replace(replace(content, '{{n}}', n), '{{k}}', k) AS content FROM x, nk),
s AS (SELECT doc AS doc_path, seq, level, title, '{REPO}::' || doc || '::' || slug || '#' || level AS id, CASE WHEN up = '' THEN '' ELSE '{REPO}::' || doc || '::' || up END AS parent_id, content FROM y)"""
