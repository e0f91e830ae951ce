"""Source divergence audit: how far the word use of each source of a language is from that of every other.

Words are counted by language and source, within tasks first, in counters of bounded size; a language keeps the words of at least ``MIN_DOCS`` of its documents. A pair of
sources starts at V times the divergence of two zero counts. What a word adds to that comes from its postings, the sources
that have it: where one of the two has it, the correction depends on nothing but its count there, so such words are
counted by group and count before they meet the other sources; where both have it, the word's postings meet each other.
Only corrections that are not zero are emitted, and they are summed before they are shuffled. A source's own words are
ranked by a window whose limit acts before the shuffle.

Arithmetic is exact: shares are whole numbers of a billionth. All of a group's shares are at most V + 10^9 together, so the
sum of their squares, and with it every sum here, fits into a long for V up to 2 * 10^9; counts go through decimals.

Defined cases: null text, language and source count as empty strings; a source without words has zero counts throughout; a
language that keeps no word gives pairs of value 0 and no terms; a language with one source has no pairs; repeated rows
count as often as they stand; an empty table gives no rows; columns beyond text, lang and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import bounded_batches, cut, settled, table

MIN_DOCS, RANKS, SCALE = 3, 200, 1_000_000_000
#: A task passes its counts on when it holds so many.
HELD = 500_000
#: Counts under this give a share in long arithmetic.
_SMALL = 9_000_000_000


def share(count: Column, total: Column, v: Column) -> Column:
    """p: one more than the whole billionths of a count among those of its group."""
    wide = ((count.cast("decimal(18,0)") + 1) * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(30,0)")
    exact = F.call_function("div", wide, (total + v).cast("decimal(20,0)"))
    return F.when(count < _SMALL, F.call_function("div", (count + 1) * SCALE, total + v)).otherwise(exact) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _counted(batches):
    """Counts of a task's texts: words are runs of ASCII letters, made small, and of bytes outside ASCII."""
    from collections import Counter, defaultdict

    import pyarrow as pa

    plain = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))
    names = ["lang", "source", "term", "c", "df"]
    counts, docs = defaultdict(Counter), defaultdict(Counter)

    def passed_on():
        for (lang, source), c in counts.items():
            terms, d = pa.array(c.keys(), pa.binary()).cast(pa.string()), docs[lang, source]
            same = [pa.array([x], pa.string()).take(pa.array([0] * len(c), pa.int32())) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*same, terms, pa.array(c.values(), pa.int64()), pa.array([d[t] for t in c], pa.int64())], names)
        counts.clear()
        docs.clear()

    for batch in batches:
        for lang, source, raw in zip(*(batch[k].to_pylist() for k in ("lang", "source", "raw")), strict=True):
            words = raw.translate(plain).split()
            counts[lang, source].update(words)
            docs[lang, source].update(set(words))
        if sum(map(len, counts.values())) > HELD:
            yield from passed_on()
    yield from passed_on()


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, c (occurrences), df (documents), in several rows."""
    bounded_batches(docs.sparkSession)
    return docs.select("lang", "source", F.col("text").cast("binary").alias("raw")).mapInArrow(_counted, "lang string, source string, term string, c long, df long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    base = docs.select(empty("lang"), empty("source"), empty("text"))
    # dealt by language and word once: a word's sources and its total are counted where it lies
    summed = counts(base).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("df").alias("df"))
    word = W.partitionBy("lang", "term")
    kept = summed.select("lang", "source", "term", "c", F.sum("c").over(word).alias("total"), F.sum("df").over(word).alias("docs"), (F.row_number().over(word.orderBy("source")) == 1).alias("first"))
    kept = cut(kept.filter(F.col("docs") >= min_docs).drop("docs"), "kept")
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("c").alias("lang_n"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    zero = F.lit(0).cast("long")
    groups = base.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("n", "v", "lang_n")], F.monotonically_increasing_id().alias("gid"))
    groups = cut(groups.withColumn("p0", F.when(F.col("v") > 0, share(zero, F.col("n"), F.col("v")))), "groups")  # a row for each language and source
    postings = kept.join(groups, ["lang", "source"]).select("lang", "term", "gid", "c", "total", "v", "lang_n", "p0", share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    postings = cut(postings, "postings")

    a, b = groups.select("lang", F.col("gid").alias("a"), F.col("p0").alias("a0"), "v", "source"), groups.select("lang", F.col("gid").alias("b"), F.col("p0").alias("b0"), F.col("source").alias("item"))
    pairs = a.join(b, "lang").filter("a <> b")
    start = pairs.select("a", "b", F.when(F.col("v") > 0, F.col("v") * divergence(F.col("a0"), F.col("b0"))).otherwise(zero).alias("x"))
    alike = postings.groupBy("lang", "gid", "p").agg(F.count("*").alias("k"))  # words of one count have one share
    one = pairs.join(alike.withColumnRenamed("gid", "a").drop("lang"), "a").select("a", "b", F.col("k") * (divergence(F.col("p"), F.col("b0")) - divergence(F.col("a0"), F.col("b0"))))
    other = pairs.join(alike.withColumnRenamed("gid", "b").drop("lang"), "b").select("a", "b", F.col("k") * (divergence(F.col("a0"), F.col("p")) - divergence(F.col("a0"), F.col("b0"))))
    left, right = (postings.select("lang", "term", F.col("gid").alias(x), F.col("p").alias(f"p{x}"), F.col("p0").alias(f"z{x}")) for x in "ab")

    def both(p, q, p0, q0):
        p, q, p0, q0 = map(F.col, (p, q, p0, q0))
        return divergence(p, q) - divergence(p, q0) - divergence(p0, q) + divergence(p0, q0)

    met = left.join(right, ["lang", "term"]).filter("a < b").select("a", "b", both("pa", "pb", "za", "zb").alias("ab"), both("pb", "pa", "zb", "za").alias("ba"))
    met = met.filter("ab <> 0 OR ba <> 0").groupBy("a", "b").agg(F.sum("ab").alias("ab"), F.sum("ba").alias("ba"))
    met = cut(met, "corrections")
    parts = start.union(one).union(other).union(met.select("a", "b", "ab")).union(met.select("b", "a", "ba"))
    values = parts.groupBy("a", "b").agg(F.sum("x").alias("value"))
    named = values.join(a.select("a", "lang", "source"), "a").join(b.select("b", "item"), "b").select("a", "lang", "source", F.lit("pair").alias("part"), "item", "value")
    best = lambda key: W.partitionBy(key).orderBy(F.desc("value"), "item")
    named = named.withColumn("rank", F.row_number().over(best("a"))).drop("a")

    q = share(F.col("total"), F.col("lang_n"), F.col("v"))
    own = postings.withColumn("q", q).filter("p > q").select("gid", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    own = own.withColumn("rank", F.row_number().over(best("gid"))).filter(F.col("rank") <= ranks)
    own = own.join(groups.select("gid", "lang", "source"), "gid").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return named.unionByName(own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, lambda: audit(table(spark, sf_dir, "documents")), "divergence")


ORACLE = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM base
), kept AS (
  SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), langs AS (
  SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang
), c AS (
  SELECT w.lang, w.source, w.term, count(*) AS c FROM words w JOIN kept USING (lang, term) GROUP BY ALL
), sizes AS (
  SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL
), groups AS (
  SELECT g.lang, g.source, coalesce(n, 0) AS n, v, lang_n FROM (SELECT DISTINCT lang, source FROM base) g LEFT JOIN sizes USING (lang, source) LEFT JOIN langs USING (lang)
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (g.n + g.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.total + 1)) // (g.lang_n + g.v)::HUGEINT AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), valued AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN valued v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
