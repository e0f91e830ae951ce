"""Running sums and exact ranks within groups of any size.

Rows are dealt by range of group and order, so a large group lies in many slices, one after the other. Each slice adds up its
own rows; the slices' totals, of which there are as many as slices and groups together, are added up along the
group and handed back. No task sees more than a slice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import cut

_SLICE, _VALUE, _BEFORE = "_slice", "_value", "_before"


def running(rows: DataFrame, group: list[str], order: list[str | Column], value: Column, name: str, total: str | None = None) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of its group from the first in ``order`` to itself, and ``total``, that of the whole group.

    Null groups are groups; nulls come first; of rows alike in ``order`` any may come first, so the order should be total.
    A null value adds nothing, and a sum without a value is 0. An empty table stays empty."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    named = {f"_order{i}": k for i, k in enumerate(keys)}
    dealt = rows.withColumns({**named, _VALUE: F.coalesce(value, F.lit(0))}).repartitionByRange(*group, *named).withColumn(_SLICE, F.spark_partition_id())
    dealt = cut(dealt, "slices")
    own = F.sum(_VALUE).over(W.partitionBy(_SLICE, *group).orderBy(*named).rowsBetween(W.unboundedPreceding, W.currentRow))
    whole = W.partitionBy(*group)
    totals = dealt.groupBy(_SLICE, *group).agg(F.sum(_VALUE).alias(_BEFORE))
    before = F.coalesce(F.sum(_BEFORE).over(whole.orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    told = totals.select(F.col(_SLICE).alias("_s"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], before.alias(_BEFORE), *([F.sum(_BEFORE).over(whole).alias("_all")] if total else []))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)], F.col(_SLICE) == F.col("_s"))
    met = dealt.withColumn("_own", own).join(told, same)
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_own") + F.col(_BEFORE)).alias(name), *([F.col("_all").alias(total)] if total else []))


def at_ranks(rows: DataFrame, group: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """``group``, n, and for each name the value at a rank (from 0) of the group's values in order. Ranks are expressions of n.

    Equal values are counted before they are dealt out, so neither a large group nor a common value fills a task. Null values are left out."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c"))
    sums = running(counts, [group], [value], F.col("_c"), "_upto", "n")
    hit = lambda rank: F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank), F.col(value)))
    return sums.groupBy(group, "n").agg(*[hit(rank).alias(name) for name, rank in ranks.items()])
