"""Reading tables, and cutting lineage through tables in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one of our own only in local mode, where it is unset."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if path:
        return path
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="quire-")
    context.setCheckpointDir(path)
    return path


_WRITTEN: list[list[str]] = []
#: Lets Spark delete a plan's shuffle files when the plan has run, instead of when the driver happens to collect its garbage.
_CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Folders that a task may write at once; what goes to no more of them is not sorted by folder first.
_WRITERS = {"spark.sql.maxConcurrentOutputFileWriters": "16"}


@contextmanager
def cleaned(spark: SparkSession, more: dict[str, str] | None = None):
    """What is shuffled by plans that run inside is deleted as soon as they have run. more: other settings that hold inside."""
    settings = {_CLEANS: "true"} | (more or {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, label: str = "t", compression: str | None = None, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later failures recompute from files, not from the source. by: a column by which rows lie in folders.

    What was shuffled to make it is not needed any more, and is deleted at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quire/{label}-{uuid.uuid4().hex}"
    for made in _WRITTEN:
        made.append(path)
    with cleaned(spark, _WRITERS if by else None):
        df.write.parquet(path, partitionBy=by, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``cut`` of what ``make`` gives. All scratch tables that are written on the way are deleted then."""
    _WRITTEN.append([])
    try:
        return cut(make(), label)
    finally:
        for path in _WRITTEN.pop()[:-1]:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bounds the Arrow batches that go to Python by their bytes, unless the session has a lower bound: rows may be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(key) or "").rstrip("bB")
    if not now.isdigit() or int(now) > size:
        spark.conf.set(key, str(size))


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``cut`` wrote, once nothing reads it any more."""
    for f in df.inputFiles()[:1]:
        _delete(df.sparkSession, re.sub(r"(/[^/=]+=[^/]*)?/[^/]*$", "", f))


def read_small(spark: SparkSession, path: str) -> str | None:
    """The text of a small file wherever Spark reads files, or None where there is none."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(context._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return context._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
