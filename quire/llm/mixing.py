"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share a budget of words; a target stops
at a cap, and what is left is shared again by weight. That ends where every uncapped source gets the same words per
weight, so one pass over the sources in order of cap per weight finds it.

Sampling: a document of a source with target T and size S gets the whole part of T / S as certain copies. One more copy
goes to a Pareto sample with unequal inclusion probabilities: p is in proportion to the number of digits of a
document's word count (a step for each power of ten, so long documents come up to five times as often as short ones),
stops at 1, and is scaled so that the words expected are those still due. Documents of a source rank by the odds of a
uniform number (from a hash of the id) over the odds of p, and the lowest ranks are taken while their words fit. The
gap that the first misfit leaves is filled in the same order by documents that fit into it, and what is left then goes
to the largest document that fits.

All this needs per source only a place in the rank order: ranks are counted in slices of equal width on the scale of log odds,
where no mix of probabilities puts more than a quarter of a source into a unit, then the rows of one slice are sorted.
The decision on a document follows from its own columns and the rules of its source, so no text moves between tasks.

Defined cases: a null text has size 0 and is never taken; sources without words have target 0; a null source is one
source; rows that repeat id and size share a rank, and are taken or left together; an empty table gives no rows; other columns are
ignored by ``mix`` and kept by ``mixed_documents``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import cut, discard, table

WEIGHTS, SHARE, MOST_COPIES, SEED = (5, 2, 1), 1.5, 2, "mix-1"
#: Rows of a source that one slice of its ranks should hold at most.
SLICE_ROWS = 2000


def words(text: Column) -> Column:
    """Number of maximal runs without the white space that counts."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """In (0, 1), from the first 48 bits of a digest."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(per: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, n_docs, target, from the first three; one row per source, so a single task handles them (their number, not the documents')."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", (F.col("source_size") * most).cast("double"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    rest = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    each = rest / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("level", F.when(F.col("cap") / F.col("weight") >= each, each))
    level = F.max("level").over(everything)  # past the first uncapped source it only falls
    return leveled.withColumn("fair", level).select("source", "source_size", "n_docs", F.when(F.col("fair").isNull() | (F.col("cap") <= F.col("fair") * F.col("weight")), F.col("cap")).otherwise(F.col("fair") * F.col("weight")).alias("target"))


def _digits(size: Column) -> Column:
    return F.length(size.cast("string"))


def _chances(sizes: DataFrame, weights, share, most) -> DataFrame:
    """For each source and number of digits: source_size, n_docs, target, whole copies, p of one more, and the words (gap) that are left for documents with p < 1."""
    strata = sizes.groupBy("source", _digits(F.col("size")).alias("digits")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    strata = cut(strata, "strata")
    goals = targets(strata.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n_docs")), weights, share, most).withColumnRenamed("source", "g_source")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = strata.join(goals, strata["source"].eqNullSafe(F.col("g_source"))).drop("g_source").withColumn("whole", F.floor(due))
    rows = rows.withColumn("due", F.col("target") - F.col("whole") * F.col("source_size"))
    own = W.partitionBy("source")
    before = own.orderBy(F.desc("digits")).rowsBetween(W.unboundedPreceding, -1)
    weight = (F.col("digits") * F.col("words")).cast("double")
    rest = F.col("due") - F.coalesce(F.sum("words").over(before), F.lit(0))
    among = F.sum(weight).over(own) - F.coalesce(F.sum(weight).over(before), F.lit(0.0))
    rows = rows.withColumns({"rest": rest, "among": among}).withColumn("each", F.when(F.col("among") > 0, F.col("rest") / F.col("among")))
    rows = rows.withColumn("level", F.max(F.when(F.lit(1.0) / F.col("digits") >= F.col("each"), F.col("each"))).over(own))
    full = F.col("level").isNull() | (F.col("level") * F.col("digits") >= 1.0)
    rows = rows.withColumn("p", F.when(full, F.lit(1.0)).otherwise(F.col("level") * F.col("digits")))
    certain = F.coalesce(F.sum(F.when(F.col("p") >= 1, F.col("words"))).over(own), F.lit(0))
    return rows.withColumn("gap", F.col("due") - certain).select("source", "digits", "source_size", "n_docs", "target", "whole", "p", "due", "gap")


def _ranked(rows: DataFrame, chances: DataFrame, seed: str) -> DataFrame:
    """Adds to rows with doc_id, source and size: the rules of their source, and for documents with 0 < p < 1 their key (place in the rank order) and slice."""
    c = chances.select(F.col("source").alias("r_source"), F.col("digits").alias("r_digits"), *[x for x in chances.columns if x not in ("source", "digits")])
    met = rows.join(c, rows["source"].eqNullSafe(F.col("r_source")) & (_digits(rows["size"]) == F.col("r_digits")), "left").drop("r_source", "r_digits")
    u = uniform(F.col("doc_id"), seed)
    odds = F.when((F.col("p") > 0) & (F.col("p") < 1) & (F.col("size") > 0), (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
    met = met.withColumn("odds", odds)
    return met.withColumns({
        "key": F.when(F.col("odds").isNotNull(), F.struct("odds", "doc_id", "size")),
        "slice": F.floor(F.ln("odds") * F.ceil(F.col("n_docs") / (4 * SLICE_ROWS))),
    })


def _place(fits: DataFrame) -> DataFrame:
    """Of rows (source, size, key, slice, gap): for each source the last slice and key in rank order up to which the words stay within the gap, and the rest of the gap."""
    bins = fits.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.max("gap").alias("gap"))
    bins = bins.withColumn("upto", F.sum("words").over(W.partitionBy("source").orderBy("slice")))
    over = F.when(F.col("upto") > F.col("gap"), F.struct("slice", (F.col("upto") - F.col("words")).alias("before")))
    edges = bins.groupBy("source").agg(F.max("gap").alias("gap"), F.max("upto").alias("total"), F.min(over).alias("edge"))
    e = edges.select(F.col("source").alias("e_source"), F.col("edge.slice").alias("e_slice"), F.col("edge.before").alias("before")).filter("e_slice IS NOT NULL")
    inside = fits.join(e, fits["source"].eqNullSafe(F.col("e_source")) & (F.col("slice") == F.col("e_slice")))
    inside = inside.withColumn("upto", F.sum("size").over(W.partitionBy("source", "slice").orderBy("key")) + F.col("before"))  # rows of one key count together
    last = inside.filter("upto <= gap").groupBy(F.col("source").alias("l_source")).agg(F.max("key").alias("key"), F.max("upto").alias("used"))
    out = edges.join(last, edges["source"].eqNullSafe(F.col("l_source")), "left")
    used = F.coalesce("used", "edge.before", "total")
    return out.select("source", F.col("edge.slice").alias("slice"), "key", (F.col("gap") - used).alias("rest"))


def _up_to(slice_: str, key: str) -> Column:
    """Whether a row stands up to a place: no slice means the end."""
    return F.col(slice_).isNull() | (F.col("slice") < F.col(slice_)) | F.coalesce((F.col("slice") == F.col(slice_)) & (F.col("key") <= F.col(key)), F.lit(False))


def _with(rows: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """Joins a source's place number n: has, slice, key, rest."""
    f = found.select(F.col("source").alias("f_source"), F.lit(True).alias(f"has{n}"), *[F.col(x).alias(f"{x}{n}") for x in found.columns if x != "source"])
    return rows.join(f, rows["source"].eqNullSafe(F.col("f_source")), "left").drop("f_source")


def _first() -> Column:
    return F.coalesce("has1", F.lit(False)) & (F.col("size") <= F.col("gap")) & _up_to("slice1", "key1")


def _second() -> Column:
    return F.coalesce("has2", F.lit(False)) & (F.col("size") <= F.col("rest1")) & _up_to("slice2", "key2")


class Rules:
    """What decides on documents, worked out from doc_id, source and size of all of them."""

    def __init__(self, sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: str = SEED):
        self.seed = seed
        self.chances = cut(_chances(sizes, weights, share, most), "chances")
        ranked = _ranked(sizes, self.chances, seed).filter("key IS NOT NULL AND gap > 0").select("source", "size", "key", "slice", "gap")
        self.one = cut(_place(ranked.filter("size <= gap")), "places")
        left = _with(ranked, self.one, 1).filter(~_first())
        self.two = cut(_place(left.filter("size <= rest1").withColumn("gap", F.col("rest1"))), "places")
        left = _with(left, self.two, 2).filter(~_second()).withColumn("rest", F.coalesce("rest2", "rest1", "gap"))
        fits = left.filter("size <= rest").withColumn("miss", F.col("rest") - F.col("size"))
        self.last = cut(fits.groupBy("source").agg(F.min(F.struct("miss", "key"))["key"].alias("key")), "nearest")

    def decide(self, rows: DataFrame) -> DataFrame:
        """rows (doc_id, source, size and others) with source_size, target and copies."""
        names = rows.columns
        met = _with(_with(_with(_ranked(rows, self.chances, self.seed), self.one, 1), self.two, 2), self.last, 3)
        more = (F.col("p") >= 1) & (F.col("due") > 0) | F.col("key").isNotNull() & (F.col("gap") > 0) & (_first() | _second() | F.coalesce(F.col("key") == F.col("key3"), F.lit(False)))
        copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce(more, F.lit(False)).cast("long")).otherwise(0).cast("long")
        return met.select(*names, "source_size", "target", copies.alias("copies"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (long) for every row."""
    sizes = cut(_sized(docs), "sizes")
    return Rules(sizes, **options).decide(sizes)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """All columns of ``docs``, each row as often as the mix takes it."""
    sizes = cut(_sized(docs), "sizes")
    rules = Rules(sizes, **options)
    discard(sizes)
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = rules.decide(rows).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = rf"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, CAST(2 * source_size AS DOUBLE) AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM per),
shares AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER w, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0)) AS each FROM ranked
  WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
least_ AS (SELECT max(each) AS level FROM shares WHERE cap / weight >= each),
goals AS (SELECT source, source_size, CASE WHEN level IS NULL OR cap <= level * weight THEN cap ELSE level * weight END AS target FROM shares, least_),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM goals),
strata AS (SELECT source, length(CAST(size AS VARCHAR)) AS digits, CAST(sum(size) AS DOUBLE) AS words FROM sizes GROUP BY 1, 2),
s1 AS (SELECT s.*, s.digits * s.words AS weight, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS due FROM strata s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
s2 AS (SELECT *, due - coalesce(sum(words) OVER b, 0) AS rest, sum(weight) OVER (PARTITION BY source) - coalesce(sum(weight) OVER b, 0) AS among FROM s1
  WINDOW b AS (PARTITION BY source ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, CASE WHEN among > 0 THEN rest / among END AS each FROM s2),
s4 AS (SELECT *, max(CASE WHEN 1.0::DOUBLE / digits >= each THEN each END) OVER (PARTITION BY source) AS level FROM s3),
s5 AS (SELECT *, CASE WHEN level IS NULL OR level * digits >= 1 THEN 1.0::DOUBLE ELSE level * digits END AS p FROM s4),
s6 AS (SELECT *, due - coalesce(sum(CASE WHEN p >= 1 THEN words END) OVER (PARTITION BY source), 0) AS gap FROM s5),
d AS (SELECT z.doc_id, z.source, z.size, s.source_size, s.target, s.whole, s.p, s.due, s.gap,
    (CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM sizes z JOIN s6 s ON z.source IS NOT DISTINCT FROM s.source AND length(CAST(z.size AS VARCHAR)) = s.digits),
ranks AS (SELECT doc_id, source, size, gap, (u / (1 - u)) / (p / (1 - p)) AS odds FROM d WHERE size > 0 AND p > 0 AND p < 1 AND gap > 0),
c1 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id, size) AS upto FROM ranks WHERE size <= gap),
t1 AS (SELECT doc_id, source, size FROM c1 WHERE upto <= gap),
left1 AS (SELECT r.*, r.gap - coalesce(u.used, 0) AS rest FROM ranks r LEFT JOIN (SELECT source, sum(size) AS used FROM t1 GROUP BY source) u ON r.source IS NOT DISTINCT FROM u.source
  WHERE NOT EXISTS (SELECT 1 FROM t1 WHERE t1.doc_id = r.doc_id)),
c2 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id, size) AS upto FROM left1 WHERE size <= rest),
t2 AS (SELECT doc_id, source, size FROM c2 WHERE upto <= rest),
left2 AS (SELECT r.* REPLACE (r.rest - coalesce(u.used, 0) AS rest) FROM left1 r LEFT JOIN (SELECT source, sum(size) AS used FROM t2 GROUP BY source) u ON r.source IS NOT DISTINCT FROM u.source
  WHERE NOT EXISTS (SELECT 1 FROM t2 WHERE t2.doc_id = r.doc_id)),
t3 AS (SELECT doc_id FROM left2 WHERE size <= rest QUALIFY row_number() OVER (PARTITION BY source ORDER BY size DESC, odds, doc_id) = 1),
taken AS (SELECT doc_id FROM t1 UNION ALL SELECT doc_id FROM t2 UNION ALL SELECT doc_id FROM t3)
SELECT d.doc_id, d.size, d.source_size, d.target,
  CAST(CASE WHEN d.size > 0 THEN d.size * (d.whole + CASE WHEN t.doc_id IS NOT NULL OR d.p >= 1 AND d.due > 0 THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken
FROM d LEFT JOIN taken t ON d.doc_id = t.doc_id
"""
