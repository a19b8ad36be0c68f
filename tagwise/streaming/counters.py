"""ST6: running per-account webhook counters.

A streaming ``groupBy(account).agg(count, count_if, max)`` in ``update`` mode keeps the
counters in the (RocksDB) state store; each trigger emits only the accounts that
changed, which ``foreachBatch`` writes to its own folder. Readers take the newest row
per account (upsert on read). Counts come from the log, so concurrent events cannot
lose increments (the reference's read-modify-write can).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwise.streaming import common


def start_counters(spark: SparkSession, log_stream: DataFrame, out_path: str) -> None:
    counts = log_stream.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("total_classified"),
        F.count_if(~F.col("success")).alias("total_errors"),
        F.max("ts").alias("last_processed_at"))
    writer = counts.writeStream.outputMode("update").foreachBatch(
        common.idempotent_writer(out_path, lambda b, i: b.withColumn("batch_id_", F.lit(i))))
    common.run_available_now(writer, "counters", spark)


def read_counters(spark: SparkSession, out_path: str) -> DataFrame:
    rows = spark.read.parquet(out_path).drop("batch_id_")
    return common.latest_per_key(rows, "account_id", "batch_id")
