"""Latency, rings of calls, confidence by mode, tuned weights, and savings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import at_ranks, running

RING, MIN_EVENTS, STEP, LEAST_DELTA, BOUNDS, DEFAULT_WEIGHT = 512, 50, 0.05, 0.05, (0.10, 0.85), 0.5
WINDOWS = {"1h": 3600, "24h": 86_400, "7d": 604_800, "all": None}


def within(calls: DataFrame, window: str, as_of: Column) -> DataFrame:
    """Calls of a window that ends at ``as_of``."""
    seconds = WINDOWS[window]
    return calls if seconds is None else calls.filter(F.col("ts") >= as_of - F.make_dt_interval(secs=F.lit(float(seconds))))


def latency_stats(calls: DataFrame) -> DataFrame:
    """tool, calls, p50, p95, max, error_rate; percentiles by nearest rank, halves to even, over the calls whose time is known.

    Ranks come from counts of slices of the durations (``ranks.at_ranks``), so no task holds a tool's calls."""
    rank = lambda p: F.bround(p * (F.col("n") - 1)).cast("long")
    picked = at_ranks(calls, "tool", "duration_ms", {"p50": rank(0.5), "p95": rank(0.95)}).drop("n").withColumnRenamed("tool", "named")
    per = calls.groupBy("tool").agg(F.count("*").alias("calls"), F.round(F.max("duration_ms"), 3).alias("max_ms"), F.round(F.count_if(F.col("ok") == 0) / F.count("*"), 4).alias("error_rate"))
    met = per.join(picked, F.col("tool").eqNullSafe(F.col("named")), "left")
    return met.select("tool", "calls", F.round("p50", 3).alias("p50_ms"), F.round("p95", 3).alias("p95_ms"), "max_ms", "error_rate")


def ring(calls: DataFrame, size: int = RING) -> DataFrame:
    """The latest calls of each tool."""
    order = W.partitionBy("tool").orderBy(F.desc("ts"), F.desc("event_id"))
    return calls.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= size).drop("rn")


def ring_stats(calls: DataFrame, size: int = RING) -> DataFrame:
    return ring(calls, size).groupBy("tool").agg(F.count("*").alias("calls"), F.min("event_id").alias("first_event"), F.round(F.avg("duration_ms"), 4).alias("mean_ms"))


def tune_weights(events: DataFrame, min_events: int = MIN_EVENTS) -> DataFrame:
    """repo, status, delta, weight: from confidences with and without vectors. events: repo, confidence, semantic_used, and the current weight if any."""
    with_, without = F.avg(F.when(F.col("semantic_used") == 1, F.col("confidence"))), F.avg(F.when(F.col("semantic_used") == 0, F.col("confidence")))
    now = F.max("weight") if "weight" in events.columns else F.lit(DEFAULT_WEIGHT)
    per = events.groupBy("repo").agg(F.count("*").alias("events"), with_.alias("w"), without.alias("o"), F.coalesce(now, F.lit(DEFAULT_WEIGHT)).alias("current"))
    delta = F.col("w") - F.col("o")
    status = F.when(F.col("events") < min_events, "insufficient_events").when(delta.isNull(), "no_signal_split").when(delta >= LEAST_DELTA, "semantic_helps").when(delta <= -LEAST_DELTA, "semantic_hurts").otherwise("no_significant_signal")
    clamp = lambda x: F.greatest(F.lit(BOUNDS[0]), F.least(F.lit(BOUNDS[1]), x))
    weight = F.when(status == "semantic_helps", clamp(F.col("current") + STEP)).when(status == "semantic_hurts", clamp(F.col("current") - STEP)).otherwise(F.col("current"))
    return per.select("repo", "events", status.alias("status"), F.round(delta, 4).alias("delta"), F.round(weight, 4).alias("weight"))


def savings(calls: DataFrame) -> DataFrame:
    """One row: tokens that answers left out, from raw_bytes and sent_bytes."""
    from ..functions.text import tokens_saved

    return calls.agg(F.sum(tokens_saved(F.col("raw_bytes"), F.col("sent_bytes"))).alias("tokens_saved"))


# The price of a million tokens, in dollars, by the names that reports use.
PRICES = {"claude_opus": 15.00, "gpt5_latest": 10.00}


def ledger(calls: DataFrame, order: str = "ts") -> DataFrame:
    """Each call with tokens_saved and total_tokens_saved, the running total of its session so far. A session may lie in many tasks."""
    from ..functions.text import tokens_saved

    saved = calls.withColumn("tokens_saved", tokens_saved(F.col("raw_bytes"), F.col("sent_bytes")))
    return running(saved, ["session"], [order], F.col("tokens_saved"), "total_tokens_saved")


def session_stats(calls: DataFrame) -> DataFrame:
    """session, calls, tokens_saved, and what each model's price makes of them."""
    from ..functions.text import tokens_saved

    per = calls.groupBy("session").agg(F.count("*").alias("calls"), F.sum(tokens_saved(F.col("raw_bytes"), F.col("sent_bytes"))).alias("tokens_saved"))
    return per.select("*", *[F.round(F.col("tokens_saved") * (price / 1_000_000), 4).alias(f"cost_avoided_{name}") for name, price in PRICES.items()])
