"""Small tables of fixed size as one string of printable characters, looked up inside expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BASE, _PART, FLAGS = 32, 1024, 6


def packed(values: DataFrame, size: int) -> DataFrame:
    """From rows (place, value): one row with a byte for each place under ``size``, 0 where there is no row. Values are 0 to 94. size: a multiple of 1024."""
    every = values.sparkSession.range(size).select(F.col("id").alias("place"), F.lit(0).alias("value"))
    full = values.select("place", F.col("value").cast("int").alias("value")).unionByName(every).groupBy("place").agg(F.max("value").alias("value"))
    char = F.struct(F.col("place"), F.char(F.col("value") + _BASE).alias("c"))
    parts = full.groupBy((F.col("place") / _PART).cast("long").alias("part")).agg(F.array_join(F.sort_array(F.collect_list(char))["c"], "").alias("s"))
    return parts.agg(F.array_join(F.sort_array(F.collect_list(F.struct("part", "s")))["s"], "").cast("binary").alias("packed"))


def numbers(table: DataFrame) -> Column:
    """The table's values as a constant array, for use inside the functions of arrays, where subqueries cannot stand."""
    values = [b - _BASE for b in bytes(table.first()[0])]
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")  # folded into one constant


def look_up(packed_: Column, place: Column) -> Column:
    """The value at a place of a packed table, given as a scalar subquery."""
    return F.ascii(packed_.substr(place.cast("int") + 1, F.lit(1)).cast("string")) - _BASE


def flags(places: DataFrame, size: int) -> DataFrame:
    """From rows (place): one row with a flag for each place under ``size`` * 6."""
    return packed(places.groupBy((F.col("place") / FLAGS).cast("long").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1, cast(place % {FLAGS} as int))")).alias("value")).select(F.col("at").alias("place"), "value"), size)


def flag(packed_: Column, place: Column) -> Column:
    value = look_up(packed_, place / FLAGS)
    return F.getbit(value.cast("int"), (place % FLAGS).cast("int")) == 1
