"""Streams: documents that arrive update the index, and calls are counted in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.pipeline import build, replace_documents
from ..scratch import cut
from ..sources.store import Store


def index_stream(spark: SparkSession, folder: str, repo: str, store: Store, checkpoint: str):
    """Follows a folder of parquet files with doc_path, raw, deleted and, if there, at (when a document changed); each
    batch replaces its documents in the store.

    Of several events of one document in a batch the latest counts; of those without a time or at the same time, a
    deletion comes before an edit. A batch that is run again replaces documents by the same rows, so a restart does no harm."""
    arriving = spark.readStream.schema("doc_path string, raw binary, deleted boolean, at timestamp").parquet(folder)

    def apply(batch: DataFrame, _: int) -> None:
        order = F.struct("at", (~F.coalesce("deleted", F.lit(False))).alias("live"), "raw", "deleted")
        latest = cut(batch.groupBy("doc_path").agg(F.max(order).alias("e")).select("doc_path", "e.raw", "e.deleted"), "batch")
        live = latest.filter("NOT coalesce(deleted, false)").select(F.lit(repo).alias("repo"), "doc_path", "raw")
        replace_documents(store, repo, cut(build(spark, live), "built"), latest.filter("deleted").select("doc_path"))

    return arriving.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def call_windows(calls: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls, errors and mean duration by tool and window; on a stream, late rows are waited for and then dropped."""
    rows = calls.withWatermark("ts", late) if calls.isStreaming else calls
    grouped = rows.groupBy(F.window("ts", window), "tool").agg(F.count("*").alias("calls"), F.sum(F.when(F.col("ok") == 0, 1).otherwise(0)).alias("errors"), F.avg("duration_ms").alias("mean_ms"))
    return grouped.select(F.col("window.start").alias("window_start"), "tool", "calls", "errors", "mean_ms")
