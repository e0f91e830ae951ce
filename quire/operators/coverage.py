"""How code symbols and documentation meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .mining import code_blocks


def symbol_name(symbol_id):
    """The last name in an id such as ``path::Class.method#kind``."""
    tail = F.substring_index(F.substring_index(symbol_id, "::", -1), "#", 1)
    return F.substring_index(tail, ".", -1)


def _title_words(sections: DataFrame) -> DataFrame:
    return sections.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9_]+"), F.lit(0)))).alias("word"))


def doc_coverage(symbols: DataFrame, sections: DataFrame) -> DataFrame:
    """symbol, documented: whether a title holds the symbol's name as a whole word. An equi-join on words for names that are words."""
    named = symbols.select("symbol", F.lower(symbol_name(F.col("symbol"))).alias("name"))
    words = _title_words(sections).select("word").distinct().withColumn("hit", F.lit(True))
    plain = named.join(words, F.col("name") == F.col("word"), "left").select("symbol", "name", F.coalesce("hit", F.lit(False)).alias("documented"))
    odd = named.filter(~F.regexp_like("name", F.lit("^[a-z0-9_]*$")) & (F.col("name") != ""))
    titles = sections.select(F.lower("title").alias("title")).filter("title <> ''").distinct()
    # names with other characters are matched as text, by the first word in them
    keyed = odd.withColumn("first", F.regexp_extract("name", "[a-z0-9_]+", 0)).join(titles.select("title", F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit("[a-z0-9_]+"), F.lit(0)))).alias("first")), "first").filter(F.contains("title", F.col("name"))).select("symbol").distinct().withColumn("found", F.lit(True))
    return plain.join(keyed, "symbol", "left").select("symbol", (F.col("documented") | F.coalesce("found", F.lit(False))).alias("documented"))


def coverage_pct(covered: DataFrame) -> DataFrame:
    return covered.agg(F.count("*").alias("symbols"), F.count_if("documented").alias("documented"), F.round(100.0 * F.count_if("documented") / F.greatest(F.lit(1), F.count("*")), 1).alias("coverage_pct"))


def undocumented_symbols(symbols: DataFrame, sections: DataFrame, max_symbols: int = 1000) -> DataFrame:
    """Symbols none of whose name's terms (three letters or more) stand in any title or summary."""
    terms = sections.select(F.explode(F.array_distinct(F.concat(text.tokenize(F.col("title")), text.tokenize(F.col("summary"))))).alias("t")).distinct()
    each = symbols.select("symbol", F.explode_outer(F.filter(text.tokenize(symbol_name(F.col("symbol"))), lambda t: F.length(t) >= 3)).alias("t"))
    known = each.join(terms, "t", "left_semi").select("symbol").distinct()
    return symbols.select("symbol").join(known, "symbol", "left_anti").orderBy("symbol").limit(max_symbols)


def link_code(sections: DataFrame, symbols: DataFrame, max_per_block: int = 5) -> DataFrame:
    """block_id, symbol: symbols whose name stands in a code block, the first few by name."""
    words = code_blocks(sections).select("block_id", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("word"))
    met = words.join(symbols.select("symbol", symbol_name(F.col("symbol")).alias("word")), "word")
    return met.groupBy("block_id").agg(F.slice(F.array_sort(F.collect_set("symbol")), 1, max_per_block).alias("s")).select("block_id", F.explode("s").alias("symbol"))
