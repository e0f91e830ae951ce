"""The driver's tables as sections, calls, trees and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..scratch import table

STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


def documents(spark: SparkSession, d: str) -> DataFrame:
    """A section for each document: the source is the repo, the language stands in for a role, and both are tags."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "text")
    title = F.substring(F.trim(F.substring_index("text", "\n", 1)), 1, 80)
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    rows = docs.select("doc_id", F.col("source").alias("repo"), path.alias("doc_path"), title.alias("title"), F.col("text").alias("content"), F.col("lang").alias("role"), F.array("lang", "source").alias("tags"))
    rows = rows.withColumns({"id": F.concat("repo", F.lit("::"), "doc_path", F.lit("::"), text.slugify(F.col("title")), F.lit("#1")), "level": F.lit(1), "byte_start": F.lit(0).cast("long"), "byte_end": text.bytes_of(F.col("content")), "summary": F.col("title"), "seq": F.lit(0), "parent_id": F.lit("")})
    return rows


#: The same in SQL.
DOCUMENTS = r"""s AS (
  SELECT doc_id, source AS repo, source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS doc_path, lang AS role, text AS content, title, title AS summary,
    source || '::' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt::' || CASE WHEN slug = '' THEN 'section' ELSE slug END || '#1' AS id,
    octet_length(encode(text)) AS byte_end
  FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(title)), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') AS slug
    FROM (SELECT *, substr(trim(split_part(text, chr(10), 1)), 1, 80) AS title FROM documents) a) b
)"""


def tokens_sql(x: str) -> str:
    """The terms of a SQL expression."""
    for pattern, to in (
        (r"(?s)```.*?```|~~~.*?~~~", " "), (r"!?\[([^\]]+)\]\([^)]*\)", r" \1 "), (r"https?://([^\s)\]''\"<>?#]*)[^\s)\]''\"<>]*", r" \1 "), (r"`([^`]+)`", r" \1 "),
        (r"([a-z0-9])([A-Z])", r"\1 \2"), (r"([A-Z])([A-Z][a-z])", r"\1 \2"),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda t: length(t) >= 2 AND t NOT IN ({STOP}))"


TERMS = f"{DOCUMENTS}, t AS (SELECT id, repo, {tokens_sql('title')} AS title, {tokens_sql('summary')} AS summary, {tokens_sql('content')} AS content FROM s)"


def turns(spark: SparkSession, d: str) -> DataFrame:
    """A section for each turn of a conversation, in order, below its first turn."""
    c = table(spark, d, "conversations")
    path = F.concat(F.lit("c/"), F.col("conv_id").cast("string"))
    named = lambda t: F.concat(path, F.lit("::t"), t.cast("string"))
    return c.select(F.lit("chat").alias("repo"), path.alias("doc_path"), named(F.col("turn")).alias("id"), F.col("role").alias("title"), F.when(F.col("turn") == 0, 1).otherwise(2).alias("level"), F.when(F.col("turn") > 0, named(F.lit(0))).otherwise(F.lit("")).alias("parent_id"), F.col("turn").alias("seq"), F.col("turn").alias("byte_start"), (F.col("turn") + 1).alias("byte_end"), F.coalesce("text", F.lit("")).alias("content"))


TURNS = """s AS (SELECT 'chat' AS repo, 'c/' || conv_id AS doc_path, 'c/' || conv_id || '::t' || turn AS id, role AS title, CASE WHEN turn = 0 THEN 1 ELSE 2 END AS level,
  CASE WHEN turn > 0 THEN 'c/' || conv_id || '::t0' ELSE '' END AS parent_id, turn AS seq, turn AS byte_start FROM conversations)"""


def places(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers as a tree of sections."""
    return _tree(spark, d, 3)


def tree(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations, customers and orders as a tree of sections."""
    return _tree(spark, d, 4)


def _tree(spark: SparkSession, d: str, deep: int) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [
        table(spark, d, "region").select(key("r", "r_regionkey").alias("id"), F.lit("").alias("parent_id"), F.col("r_name").alias("title"), F.lit(0).alias("level"), F.col("r_regionkey").cast("long").alias("seq")),
        table(spark, d, "nation").select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent_id"), F.col("n_name").alias("title"), F.lit(1).alias("level"), F.col("n_nationkey").cast("long").alias("seq")),
        table(spark, d, "customer").select(key("c", "c_custkey").alias("id"), key("n", "c_nationkey").alias("parent_id"), F.col("c_name").alias("title"), F.lit(2).alias("level"), F.col("c_custkey").cast("long").alias("seq")),
        table(spark, d, "orders").select(key("o", "o_orderkey").alias("id"), key("c", "o_custkey").alias("parent_id"), F.col("o_orderpriority").alias("title"), F.lit(3).alias("level"), F.col("o_orderkey").cast("long").alias("seq")),
    ]
    out = parts[0]
    for p in parts[1:deep]:
        out = out.unionByName(p)
    return out.withColumns({"repo": F.lit("shop"), "doc_path": F.lit("shop"), "byte_start": F.col("seq")})


_PLACES = """  SELECT 'r' || r_regionkey AS id, '' AS parent_id, r_name AS title, 0 AS level, CAST(r_regionkey AS BIGINT) AS seq FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 1, CAST(n_nationkey AS BIGINT) FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, 2, CAST(c_custkey AS BIGINT) FROM customer"""
PLACES = f"s AS ({_PLACES})"
TREE = f"s AS ({_PLACES} UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_orderpriority, 3, CAST(o_orderkey AS BIGINT) FROM orders)"


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Events as calls of tools."""
    return table(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("tool"), F.col("value").alias("duration_ms"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("ok"), F.concat(F.lit("repo"), (F.col("user_id") % 7).cast("string")).alias("repo"), "user_id")


CALLS = "calls AS (SELECT event_id, ts, event_type AS tool, value AS duration_ms, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS ok, 'repo' || (user_id % 7) AS repo, user_id FROM events)"


def page_links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pages as sections, and the links of their raw HTML (readers drop the targets of links)."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*/?([^?#]*)", 1)
    pages = table(spark, d, "pages").select(F.lit("web").alias("repo"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), path.alias("doc_path"), F.lit("page").alias("title"), F.lit(1).alias("level"), F.col("page_id").alias("seq"), F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("references"), F.array().cast("array<string>").alias("tags"))
    from .index import links

    return pages, links(pages)


def files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files at index time, and as they are now: every seventh changed, every eleventh gone, every thirteenth new."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("doc_path"), F.col("text").alias("content"))
    old = docs.filter("doc_id % 13 <> 0")
    now = docs.filter("doc_id % 11 <> 0").withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit(" edited"))).otherwise(F.col("content")))
    hashed = lambda x: x.withColumn("file_hash", F.sha2("content", 256))
    return hashed(old), hashed(now)


FILES = """old AS (SELECT doc_id, 'd/' || doc_id AS doc_path, text AS content, sha256(text) AS file_hash FROM documents WHERE doc_id % 13 <> 0),
  now_ AS (SELECT doc_id, doc_path, content, sha256(content) AS file_hash FROM (SELECT doc_id, 'd/' || doc_id AS doc_path, CASE WHEN doc_id % 7 = 0 THEN text || ' edited' ELSE text END AS content FROM documents WHERE doc_id % 11 <> 0) n)"""
