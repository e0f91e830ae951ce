"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are the same after white space is deleted. The first pass keeps a narrow table (id,
lengths, a hash of the first normalised characters). Groups by length, then by length and prefix, shrink to those of
two rows or more; the second pass hashes the full text of their rows only. Which rows those are is tested against a
filter whose size follows the number of groups up to a bound (``FILTER_BITS``), so neither the text nor a growing table has to be moved to find
out; beyond the bound more rows than need be are hashed, and the result is the same.

Defined cases: a null text counts as empty; of equal texts the row with the most code points stays, then the smallest
doc_id (null last); of repeated rows with one doc_id a single one is ``kept``; an empty table gives no rows; columns
beyond doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import cut, discard, table

#: The white space that does not count.
SPACE = r"[\x20\x09-\x0D]+"
#: Characters of the prefix; the filter has 2 to the power of these bits, at least and at most (4 MB).
PREFIX_CHARS, FILTER_BITS = 128, (14, 25)


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def _position(bits) -> Column:
    return F.pmod(F.xxhash64("n_len", "p_hash"), bits)


def _survivor_filter(groups: DataFrame) -> DataFrame:
    """One row with the filter's 64-bit words: sixteen bits for each group, within bounds."""
    spark = groups.sparkSession
    bits = 1 << min(max(FILTER_BITS[0], (16 * groups.count()).bit_length()), FILTER_BITS[1])
    words = groups.select(_position(F.lit(bits)).alias("at")).groupBy((F.col("at") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    every = spark.range(bits // 64).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("bits"))
    full = words.union(every).groupBy("w").agg(F.max(F.when(F.col("bits") != 0, F.col("bits"))).alias("bits"))
    return full.select(F.struct("w", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("x")).agg(F.sort_array(F.collect_list("x"))["bits"].alias("words"))


def exact_groups(docs: DataFrame, hash_all: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; text_sha256 only where a row had to be hashed, or with ``hash_all`` everywhere. Groups are formed of survivors only in both cases."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    narrow = cut(base.select(normal(F.col("text")).alias("n")).select(F.char_length("n").alias("n_len"), F.xxhash64(F.substring("n", 1, PREFIX_CHARS)).alias("p_hash")), "probe")
    lengths = narrow.groupBy("n_len").count().filter("count > 1").select("n_len")
    # counted before the join: however many copies there are, a pair is a row of each task by then
    groups = narrow.groupBy("n_len", "p_hash").count().join(lengths, "n_len", "left_semi").filter("count > 1").select("n_len", "p_hash")
    groups = cut(groups, "groups")
    words = cut(_survivor_filter(groups), "filter").scalar()
    full = base.select("doc_id", F.char_length("text").alias("chars"), normal(F.col("text")).alias("n")).withColumns({"n_len": F.char_length("n"), "p_hash": F.xxhash64(F.substring("n", 1, PREFIX_CHARS))})
    full = full.withColumn("p", _position(F.size(words).cast("long") * 64)).withColumn("w", F.element_at(words, (F.col("p") / 64).cast("int") + 1)).withColumn("survives", F.expr("shiftright(w, cast(p % 64 as int)) & 1") == 1)
    digest = F.sha2("n", 256) if hash_all else F.when(F.col("survives"), F.sha2("n", 256))
    hashed = full.select("doc_id", "chars", "survives", digest.alias("text_sha256"), F.monotonically_increasing_id().alias("row"))
    hashed = cut(hashed, "hashed")  # rows that repeat an id are told apart by their number
    discard(narrow)
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("z"), "doc_id", "row"))
    groups = hashed.filter("survives").groupBy("text_sha256").agg(F.count("*").alias("group_size"), best.alias("best")).filter("group_size > 1")
    out = hashed.join(groups, "text_sha256", "left")
    single = F.col("best").isNull()
    return out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("best.row"))).alias("kept"),
        "text_sha256",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), hash_all=True)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents
), w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
