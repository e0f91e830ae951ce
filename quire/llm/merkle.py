"""Merkle manifest of a dataset: a tree for each group, a tree over the groups' roots, and a proof for every row.

A row's leaf is the digest of its fields. Rows are numbered within their group by a range sort and the counts of its
partitions, so no task holds a group. A level is one window: partitioned by group and parent, its ordered whole frame
collects the children's digests, which are the parent's preimage and each child's siblings at once. The first child
of each run stands for the parent in the next level, so a level has a ``fanout``-th of the rows of the one below, and
all levels together cost about twice the first. The tree over the groups' roots is made the same way. Proofs go down
again: the root of a group starts with its path in the upper tree, and each level joins its nodes with their parents'
paths by group and parent, so rows of a large group are spread over all tasks.

Defined cases: a null field is ``-``, which no value looks like (values carry their length); a null doc_id comes first
in its group, and rows that repeat a doc_id stand in the order of their leaves; a group of one row has its leaf as its
root, and with one group its root is the root; an empty table gives no rows; columns beyond the fields are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import cut, settled, table

FIELDS, GROUP, FANOUT = ("doc_id", "source", "lang", "n_chars", "text"), "lang", 2
#: The walk down is written out after so many levels, so a lost executor costs no more than these.
STEP = 8
_HEX = 64


def digest_of(values: list[Column]) -> Column:
    """The digest of values in order, each with its length in bytes; a null is a dash."""
    strings = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in strings]), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with place (from 0) and n (their number) within ``g``, in the order given."""
    dealt = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    dealt = cut(dealt.withColumn("at", F.monotonically_increasing_id()), "sorted").withColumn("part", F.shiftright("at", 33))
    runs = dealt.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("c"))  # as many as partitions and groups together
    before = W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("g", "part", "first", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"), F.sum("c").over(W.partitionBy("g")).alias("n"))
    return dealt.join(runs, ["g", "part"]).select(*rows.columns, (F.col("at") - F.col("first") + F.col("before")).alias("place"), "n")


def up(n, fanout: int) -> Column:
    return F.ceil(F.col(n) / fanout).cast("long")


def grown(leaves: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level, and each group's root (g, digest, height). leaves: g, place, n, digest and columns to keep.

    A level's rows are its nodes that have a parent: g, place, n, up (the parent's place), up_digest, entry (before, siblings)."""
    keep = [c for c in leaves.columns if c not in ("g", "place", "n")]
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, roots, nodes = [], leaves.filter("n = 1").select("g", "digest", F.lit(0).alias("height")), leaves
    while most > 1:
        parent, at = F.floor(F.col("place") / fanout), (F.col("place") % fanout).cast("int")
        run = F.collect_list("digest").over(W.partitionBy("g", "up").orderBy("place").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        made = nodes.filter("n > 1").withColumn("up", parent).withColumn("run", run)
        siblings = F.unhex(F.concat(F.array_join(F.slice("run", F.lit(1), at), ""), F.array_join(F.slice("run", at + 2, F.lit(fanout)), "")))
        entry = F.struct(at.alias("before"), siblings.alias("siblings"))
        levels.append(cut(made.select("g", "place", "n", "up", F.sha2(F.array_join("run", ""), 256).alias("up_digest"), entry.alias("entry"), *(keep if not levels else ())), "level"))
        # a parent is taken from the first child of its run, once
        nodes = levels[-1].filter(F.col("place") % fanout == 0).select("g", F.col("up").alias("place"), up("n", fanout).alias("n"), F.col("up_digest").alias("digest"))
        roots = roots.unionByName(nodes.filter("n = 1").select("g", "digest", F.lit(len(levels)).alias("height")))
        most = -(-most // fanout)
    return levels, roots


def walked(leaves: DataFrame, levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The columns of the leaves with path (entries from the leaf on) and what ``ends`` (g, height, path and more) says of a group."""
    more = [c for c in ends.columns if c not in ("g", "height", "path")]
    keep = [c for c in leaves.columns if c not in ("g", "place", "n")]
    at = lambda k: ends.filter(F.col("height") == k)
    paths = at(len(levels)).select("g", F.lit(0).cast("long").alias("place"), "path", *more)
    for k in reversed(range(len(levels))):
        own = keep if k == 0 else []
        above = paths.withColumnRenamed("place", "up")
        paths = levels[k].select("g", "place", "up", "entry", *own).join(above, ["g", "up"]).select("g", "place", F.concat(F.array("entry"), "path").alias("path"), *more, *own)
        if k:
            paths = paths.unionByName(at(k).select("g", F.lit(0).cast("long").alias("place"), "path", *more))
            paths = cut(paths, "paths") if k % STEP == 0 else paths
    if not levels:
        paths = paths.limit(0).select(*paths.columns, *[F.lit(None).cast(leaves.schema[c].dataType).alias(c) for c in keep])
    single = leaves.filter("n = 1").join(at(0), "g").select("g", "place", "path", *more, *keep)
    return paths.unionByName(single)


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its path lead to."""

    def step(digest, x):
        siblings, edge = F.lower(F.hex(x["siblings"])), x["before"] * _HEX
        return F.sha2(F.concat(F.substring(siblings, F.lit(1), edge), digest, F.substring(siblings, edge + 1, F.length(siblings))), 256)

    return F.aggregate(path, leaf, step)


def proof(path: Column) -> Column:
    """All siblings of a path in order, as hex text."""
    return F.array_join(F.transform(path, lambda x: F.lower(F.hex(x["siblings"]))), "")


def manifest(docs: DataFrame, fields=FIELDS, group: str = GROUP, order: str = "doc_id", check: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, checked, subroot, root and path for every row. ``check``: another leaf of a row to be tested, or null."""
    checked = F.lit(None).cast("string") if check is None else check
    key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))  # the null group comes first
    leaves = docs.select(key.alias("g"), F.col(order).alias("doc_id"), digest_of([F.col(c) for c in fields]).alias("digest"), checked.alias("checked"))
    leaves = cut(numbered(leaves, ["doc_id", "digest", "checked"]), "leaves")
    levels, roots = grown(leaves, fanout)
    roots = cut(roots.select(F.lit("").alias("g"), F.col("g").alias("key"), "digest", F.col("height").alias("tall")), "roots")
    upper = cut(numbered(roots, ["key"]), "upper")
    top, root = grown(upper, fanout)
    root = cut(root, "root")
    empty = F.expr("cast(array() as array<struct<before: int, siblings: binary>>)")
    ends = walked(upper, top, root.select("g", "height", empty.alias("path"), F.col("digest").alias("root")))
    ends = cut(ends.select(F.col("key").alias("g"), F.col("tall").alias("height"), "path", F.col("digest").alias("subroot"), "root"), "ends")
    return walked(leaves, levels, ends).select("doc_id", F.col("digest").alias("leaf"), "checked", "subroot", "root", "path")


def tampered(docs: DataFrame) -> Column:
    """The leaf of a row whose n_chars is one more than it was, where 7 divides the checksum of its id."""
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, digest_of([more if c == "n_chars" else F.col(c) for c in FIELDS]))


def proofs(docs: DataFrame) -> DataFrame:
    found = manifest(docs, check=tampered(docs)).withColumn("folded_root", folded(F.col("path"), F.coalesce("checked", "leaf")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, lambda: proofs(table(spark, sf_dir, "documents")), "manifest")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS g,
    CASE WHEN doc_id IS NULL THEN '-' ELSE octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE octet_length(encode(source)) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE octet_length(encode(lang)) || ':' || lang END AS ahead,
    CASE WHEN n_chars IS NULL THEN '-' ELSE octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars END AS size, CASE WHEN n_chars IS NULL THEN '-' ELSE octet_length(encode((n_chars + 1)::VARCHAR)) || ':' || (n_chars + 1) END AS more,
    CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || text END AS body,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY g) AS n, sha256(ahead || size || body) AS leaf, CASE WHEN crc % 7 = 0 THEN sha256(ahead || more || body) END AS checked FROM d
), nodes AS (
  SELECT g, 0 AS level, place, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT g, any_value(level) + 1, place // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY g, place // 2
), subroots AS (
  SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper_nodes AS (
  SELECT 0 AS level, place, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, place // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY place)) FROM upper_nodes WHERE n > 1 GROUP BY place // 2
), climb AS (
  SELECT doc_id, g, leaf, 0 AS level, place, n, coalesce(checked, leaf) AS digest, '' AS siblings FROM leaves
  UNION ALL
  SELECT c.doc_id, c.g, c.leaf, c.level + 1, c.place // 2, (c.n + 1) // 2, sha256(CASE WHEN c.place % 2 = 1 THEN s.digest || c.digest ELSE c.digest || coalesce(s.digest, '') END), c.siblings || coalesce(s.digest, '')
  FROM climb c LEFT JOIN nodes s ON s.g = c.g AND s.level = c.level AND s.place = CASE WHEN c.place % 2 = 1 THEN c.place - 1 ELSE c.place + 1 END WHERE c.n > 1
), upper_climb AS (
  SELECT c.doc_id, c.leaf, r.subroot, 0 AS level, r.place, r.n, c.digest, c.siblings FROM climb c JOIN subroots r USING (g) WHERE c.n = 1
  UNION ALL
  SELECT c.doc_id, c.leaf, c.subroot, c.level + 1, c.place // 2, (c.n + 1) // 2, sha256(CASE WHEN c.place % 2 = 1 THEN s.digest || c.digest ELSE c.digest || coalesce(s.digest, '') END), c.siblings || coalesce(s.digest, '')
  FROM upper_climb c LEFT JOIN upper_nodes s ON s.level = c.level AND s.place = CASE WHEN c.place % 2 = 1 THEN c.place - 1 ELSE c.place + 1 END WHERE c.n > 1
)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, c.digest AS folded_root, c.digest = root AS verified FROM upper_climb c, (SELECT digest AS root FROM upper_nodes WHERE n = 1) WHERE n = 1
"""
