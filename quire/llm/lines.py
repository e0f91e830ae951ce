"""Line dedup: an exact set-similarity join of lines.

A line is the set of its tokens (runs without white space). A line goes when an earlier one (by doc_id, then place) has
a Jaccard similarity of ``NUM / DEN`` or more; it does not matter whether that one stays. Lines without tokens stay.

Copies of a line are the first to be settled, by two hashes. Of the other lines, one for each text goes on; which texts
are repeated is looked up in a table of flags, so that lines that are alone do not move. Then:

1. Tokens are ordered by rarity. Frequencies of all tokens are counted in a table of fixed size; any order that all
   lines share is exact, a good one only saves work.
2. Similar lines share a token in their prefixes. A semi-join over prefix tokens, under the length filter, the
   positional filter for a first common token, and a bound from 64 parity bits of each set, finds the lines that may
   have a partner. It gives at most a row for each prefix token, however many partners there are.
3. Those lines alone come back with all their tokens. Each looks for an earlier partner among the first lines of its
   prefix tokens' lists, ``PIVOTS`` at first, then more, at last all. Pairs are verified by their Jaccard similarity,
   and a line that is settled looks no further. So a group of near copies does not meet pair by pair.

Defined cases: null and empty texts have no lines to remove; rows that repeat doc_id and text are judged alike; a
null doc_id comes first; an empty table gives no rows; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .packed import FLAGS, flag, flags, numbers, packed
from .scratch import cut, discard, table

NUM, DEN = 4, 5
COUNT_BITS = 16
#: Characters of a table of flags: as many as give each line that is looked for some places of its own, within bounds.
FLAG_CHARS = (1 << 14, 1 << 22)
PIVOTS = (4,)


def _up(a: Column, b: int) -> Column:
    """a / b, rounded up."""
    return F.floor((a + (b - 1)) / b).cast("int")


def _least_overlap(n: Column, m: Column) -> Column:
    return _up((n + m) * NUM, NUM + DEN)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, r (hash of the text, for rows that share an id), line (place from 0), s; other white space as blanks."""
    odd = F.contains("text", F.lit("\t")) | F.contains("text", F.lit("\r")) | F.contains("text", F.lit("\v")) | F.contains("text", F.lit("\f"))
    text = F.when(odd, F.regexp_replace("text", r"[\x09\x0B-\x0D]", " ")).otherwise(F.col("text"))
    return docs.select("doc_id", F.xxhash64("text").alias("r"), text.alias("text")).select("doc_id", "r", F.posexplode(F.split("text", "\n")).alias("line", "s"))


def _hashes(s: Column) -> list[Column]:
    return [F.xxhash64(s).alias("h"), F.xxhash64(s, F.lit(1)).alias("h2")]


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - COUNT_BITS)


def frequencies(lines: DataFrame) -> Column:
    """The quantised counts of all tokens, by bucket."""
    tokens = lines.select(F.explode(F.split("s", " ")).alias("w")).filter("w <> ''").select(_bucket(F.xxhash64("w")).alias("place"))
    counts = tokens.groupBy("place").agg(F.count("*").alias("c"))
    return numbers(packed(counts.select("place", F.least(F.lit(94), F.floor(F.log2(F.col("c")) * 3) + 1).alias("value")), 1 << COUNT_BITS))


def _token_sets(lines: DataFrame) -> DataFrame:
    """Adds tokens (hashes, each once). Lines have at least one."""
    empty = lines.sparkSession.range(1).select(F.xxhash64(F.lit(""))).first()[0]
    return lines.withColumn("tokens", F.array_remove(F.array_distinct(F.transform(F.split("s", " "), lambda w: F.xxhash64(w))), F.lit(empty)))


def _parity(tokens: str, part: int | None = None) -> Column:
    """64 parity bits of a token set, of all tokens or of one half of them."""
    one = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    own = lambda h: one(h) if part is None else F.when(F.getbit(h, F.lit(12)) == part, one(h)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(own(h)))


def _prefixes(sets: DataFrame, counts: Column, id_: str, halves: bool = False) -> DataFrame:
    """A row for each prefix token: k, id, at (its place in the order), n, and parity bits (with ``halves`` twice as many).

    Each step is a projection whose columns the next one uses once, and the generator keeps empty arrays (there are none): a filter
    on a column or on the generator's input would be pushed down, and the arrays worked out again for it."""
    # the bucket is a function of the hash, so the rank and 56 of its bits tell tokens apart; never null, so that plain numbers are sorted
    rank = lambda h: F.coalesce(F.get(counts, _bucket(h).cast("int")), F.lit(0)).cast("long")
    ordered = F.sort_array(F.transform("tokens", lambda h: F.shiftleft(rank(h), 56).bitwiseOR(F.shiftrightunsigned(h, 8))))
    bits = {"bits": _parity("tokens", 0), "more": _parity("tokens", 1)} if halves else {"bits": _parity("tokens")}
    out = sets.select(F.col(id_).alias("id"), F.size("tokens").alias("n"), *[x.alias(k) for k, x in bits.items()], ordered.alias("ordered"))
    length = F.col("n") - _up(F.col("n") * NUM, DEN) + 1
    out = out.select("id", "n", *bits, F.slice("ordered", F.lit(1), length).alias("prefix"))
    return out.select("id", "n", *bits, F.posexplode_outer("prefix").alias("at", "k")).select("k", "id", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("at").cast("long")).alias("size"), *bits)


def _may(x: str, y: str, *bits: str) -> Column:
    """The filters for rows x and y that share a token: it can be the first they share, and the overlap can be enough."""
    n, m = (F.shiftright(F.col(f"{r}.size"), 32) for r in (x, y))
    at, other = (F.col(f"{r}.size").bitwiseAND(0xFFFFFFFF) for r in (x, y))
    need = _least_overlap(n, m)
    length = (m * DEN >= n * NUM) & (n * DEN >= m * NUM)
    place = F.least(n - at, m - other) >= need
    unlike = sum((F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in bits), F.lit(0))
    return length & place & (unlike <= n + m - need * 2)


def _suspects(lines: DataFrame, counts: Column) -> DataFrame:
    """id of lines that may have a partner of another text. lines: id, s, one row for each id. Both sides of the join share one exchange."""
    rows = _prefixes(_token_sets(lines), counts, "id")
    x, y = rows.alias("x"), rows.alias("y")
    near = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.id") != F.col("y.id")) & _may("x", "y", "bits"), "left_semi")
    return cut(near.select("id").distinct(), "suspects")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose id is not in ``gone``. A table of flags tells most of them, which do not move then; the others are looked up."""
    marked, places = _flagged(gone.select(F.xxhash64("id").alias("h")), "h")
    maybe = flag(marked, F.pmod(F.xxhash64("id"), F.lit(places)))
    return rows.filter(~maybe).unionByName(rows.filter(maybe).join(gone, "id", "left_anti"))


def _settle(sets: DataFrame, counts: Column) -> DataFrame:
    """id of lines with an earlier similar one. sets: id (in the order of the lines' first places), tokens."""
    rows = _prefixes(sets, counts, "id", halves=True)
    ranked = cut(rows.withColumn("rank", F.row_number().over(W.partitionBy("k").orderBy("id"))), "ranked")
    probes, gone, low = ranked.filter("rank > 1"), None, 0
    for high in (*PIVOTS, None):
        index = ranked.filter(f"rank > {low}" + (f" AND rank <= {high}" if high else ""))
        x, y = probes.alias("x"), index.alias("y")
        near = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("y.rank") < F.col("x.rank")) & _may("x", "y", "bits", "more"))
        # written, so that what was shuffled to find them is deleted before the sets are moved
        pairs = cut(near.select(F.col("x.id").alias("id"), F.col("y.id").alias("e")).distinct(), "pairs")
        # both sides read the sets by the same key, so they share one exchange
        mine, theirs = sets.select("id", "tokens").alias("m"), sets.select("id", "tokens").alias("t")
        met = pairs.alias("p").join(mine, F.col("p.id") == F.col("m.id")).join(theirs, F.col("p.e") == F.col("t.id"))
        enough = F.size(F.array_intersect("m.tokens", "t.tokens")) >= _least_overlap(F.size("m.tokens"), F.size("t.tokens"))
        found = cut(met.filter(enough).select("p.id").distinct(), "similar")
        discard(pairs)
        gone = found if gone is None else gone.unionByName(found)
        if high:
            probes, low = _without(ranked.filter(f"rank > {high}"), gone), high
    discard(ranked)
    return gone


def _flag_chars(rows: int) -> int:
    return min(max(FLAG_CHARS[0], 1 << (2 * rows).bit_length()), FLAG_CHARS[1])


def _flagged(rows: DataFrame, h: str) -> tuple[Column, int]:
    """A table of flags for the hashes of ``rows``, and its places."""
    size = _flag_chars(rows.count())
    return cut(flags(rows.select(F.pmod(F.col(h), F.lit(size * FLAGS)).alias("place")), size), "flags").scalar(), size * FLAGS


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, r, line: the lines that go."""
    lines = _lines(docs.select("doc_id", "text").filter("text <> ''")).filter(F.trim("s") != "")
    named = cut(lines.select("doc_id", "r", "line", *_hashes(F.col("s"))), "lines")
    counts = frequencies(lines)
    place = F.struct("doc_id", "r", "line")
    copies = cut(named.groupBy("h", "h2").agg(F.min(place).alias("first"), F.count("*").alias("c")).filter("c > 1"), "copies")
    repeated, places = _flagged(copies, "h")
    said = lines.select(F.xxhash64("s").alias("id"), "s")
    again = flag(repeated, F.pmod("id", F.lit(places)))
    several = cut(said.filter(again).dropDuplicates(["id"]), "several")  # written, so that the join's two sides are alike and share an exchange
    suspects = _suspects(said.filter(~again).unionByName(several), counts)
    discard(several)
    marked, places = _flagged(suspects, "id")
    back = lines.select("doc_id", "r", "line", "s", *_hashes(F.col("s"))).filter(flag(marked, F.pmod("h", F.lit(places))))
    # grouped before the join: a line that stands everywhere is a row of each task by then
    firsts = back.groupBy("h", "h2").agg(F.min_by("s", place).alias("s"), F.min(place).alias("first"))
    firsts = cut(firsts.join(suspects.withColumnRenamed("id", "h"), "h", "left_semi"), "firsts")
    # ids that rise with the lines' first places: ranges in order, and rows in order within them
    ordered = firsts.repartitionByRange("first").sortWithinPartitions("first").withColumn("id", F.monotonically_increasing_id())
    sets = cut(_token_sets(ordered).select("id", "h", "h2", "tokens"), "sets")
    discard(firsts)
    similar = sets.select("id", "h", "h2").join(_settle(sets, counts), "id", "left_semi")
    gone = copies.select("h", "h2", "first", F.lit(False).alias("near")).unionByName(similar.select("h", "h2", F.lit(None).cast(copies.schema["first"].dataType).alias("first"), F.lit(True).alias("near")))
    # written, so that the join below reads both sides as they are and a line that stands everywhere can be split
    gone = cut(gone.groupBy("h", "h2").agg(F.max("first").alias("first"), F.bool_or("near").alias("near")), "gone")
    removed = cut(named.join(gone, ["h", "h2"]).filter(F.col("near") | (place > F.col("first"))).select("doc_id", "r", "line"), "removed")
    for used in (named, copies, suspects, sets, gone):
        discard(used)
    return removed


def dedup_lines(docs: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """All columns of ``docs``, with the text's later matches removed; a null text stays null. n_chars follows where there is one."""
    removed = removed_lines(docs) if removed is None else removed
    gone = removed.groupBy("doc_id", "r").agg(F.sort_array(F.collect_list("line")).alias("gone")).select(F.col("doc_id").alias("g_id"), F.col("r").alias("g_r"), "gone")
    # the row goes along as one column, so that no name of it can clash
    row = docs.select("doc_id", "text", F.xxhash64("text").alias("r"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    met = row.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("r") == F.col("g_r")), "left")
    met = met.withColumn("parts", F.when(F.col("gone").isNotNull(), F.split("text", "\n")))  # a column, so that it is split once
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone")
    short = F.array_join(F.transform(left, lambda i: F.get("parts", i)), "\n")
    met = met.select("row", "gone", F.when(F.col("gone").isNull(), F.col("text")).otherwise(short).alias("text"))

    def column(name):
        if name == "text":
            return F.col("text")
        own = F.col("row").getField(name)
        return F.when(F.col("gone").isNull(), own).otherwise(F.char_length("text").cast(docs.schema[name].dataType)) if name == "n_chars" else own

    return met.select(*[column(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = F.when(F.coalesce("text", F.lit("")) == "", F.lit(0)).otherwise(F.regexp_count("text", F.lit("\n")) + 1).cast("long")
    counted = docs.select("doc_id", F.xxhash64("text").alias("r"), lines.alias("n_lines"))
    gone = removed_lines(docs).groupBy("doc_id", "r").agg(F.sort_array(F.collect_list("line")).alias("gone")).select(F.col("doc_id").alias("g_id"), F.col("r").alias("g_r"), "gone")
    out = counted.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("r") == F.col("g_r")), "left")
    return out.select("doc_id", "n_lines", F.greatest(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed"))
