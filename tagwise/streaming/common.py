"""Shared streaming plumbing: file sources, idempotent foreachBatch sinks, runs.

Sinks written from ``foreachBatch`` go to ``<path>/batch_id=<n>`` with overwrite, so a
micro-batch re-executed after a failure replaces its own output instead of appending a
duplicate: together with the checkpointed source offsets this gives exactly-once
results on a file sink. Checkpoints live under the shared checkpoint folder.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwise.session import scratch_path


def stage_files(df: DataFrame, path: str, key: str, triggers: int) -> int:
    """Write ``df`` as files of consecutive ``key`` ranges, stamped with times in that order, so
    that the file source (oldest first) replays the data in ``key`` order. One range sort by as
    many tasks as the session shuffles with writes all of them at once. Returns how many files
    a trigger takes for about ``triggers`` triggers. Staging helper for local replays; in
    production the source is a landing folder or a topic."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("append").parquet(path)
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    now = int(time.time() * 1000)
    for i, name in enumerate(names):                    # metadata only: task numbers are in key order
        fs.setTimes(hadoop.Path(f"{path}/{name}"), now - 1000 * (len(names) - i), -1)
    return max(1, -(-len(names) // triggers))


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(path))


def idempotent_writer(path: str, transform: Callable[[DataFrame, int], DataFrame]):
    """foreachBatch function writing ``transform(batch)`` to ``path/batch_id=<id>``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch, batch_id).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def finished(spark: SparkSession, path: str, column: str) -> set[int]:
    """Values of the ``column=<number>`` folders below ``path`` that a job finished (it leaves a
    mark when all its files are there)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return set()
    found = set()
    for s in fs.listStatus(folder):
        key, _, value = s.getPath().getName().partition("=")
        if key == column and value.isdigit() and fs.exists(hadoop.Path(s.getPath(), "_SUCCESS")):
            found.add(int(value))
    return found


def run_available_now(writer, name: str, spark: SparkSession, checkpoint: str | None = None) -> int:
    """Start ``writer`` (a DataStreamWriter) with an availableNow trigger, from ``checkpoint`` on
    (a fresh one without it); block until all available input is processed. Returns how many rows
    came behind the watermark and were dropped (ST10)."""
    ckpt = checkpoint or scratch_path(spark, f"ckpt-{name}")
    q = writer.option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return sum(int(s["numRowsDroppedByWatermark"]) for p in q.recentProgress for s in p["stateOperators"])


def latest_per_key(df: DataFrame, key: str, order: str = "batch_id") -> DataFrame:
    """Upsert-on-read: the newest row per key across micro-batch folders (partial
    aggregate, no sort of the whole table)."""
    cols = [c for c in df.columns if c not in (key, order)]
    agg = [F.max_by(F.col(c), F.col(order)).alias(c) for c in cols]
    return df.groupBy(key).agg(*agg)
