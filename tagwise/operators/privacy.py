"""Opt-in, privacy-preserving capture of low-confidence examples and erasure.

* F8: the caller key is ``rapid_<user>`` or ``direct_`` + md5(ip)[:12]; raw IPs never
  leave this expression.
* P12 + J6: capture when confidence < 0.75 (strict) **and** the user opted in
  (default out) — an inner join with the opted-in users.
* S13: rows carry ``file_key = md5(user_key)``; the sink is partitioned by a bucket of that
  key, so its directories and files are bounded however many users there are.
* U4 + A23: erasure of a list of users is an anti join, with the deleted-row counts; on the
  written log only the buckets that hold a requesting user are read and written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwise import taxonomy as tx
from tagwise.functions import text as fx
from tagwise.session import materialize

LOG_BUCKETS = 256


def capture_low_confidence(calls: DataFrame, opted_in: DataFrame) -> DataFrame:
    """``calls``: ``user_key, text, intent, confidence, ts``; ``opted_in``: ``user_key``
    of users whose latest setting is opt-in. Only the hash of the text is kept."""
    low = calls.filter(F.col("confidence") < tx.LOW_CONFIDENCE_CAPTURE)
    return (low.join(opted_in.select("user_key"), "user_key", "inner")
               .select(fx.file_key("user_key").alias("file_key"), "user_key",
                       fx.text_hash("text").alias("text_hash"), "intent",
                       F.round("confidence", 4).alias("confidence"), "ts"))


def latest_opt_in(changes: DataFrame) -> DataFrame:
    """User settings from a change log ``(user_key, opt_in, ts, seq)``: the latest value
    per user wins; created = first change (the reference leaves it null)."""
    return changes.groupBy("user_key").agg(
        F.max_by("opt_in", F.struct("ts", "seq")).alias("opt_in"),
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))


def erase(log: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """U4 + A23: ``(remaining log, deleted counts per requesting user)``."""
    remaining = log.join(requests.select("file_key"), "file_key", "left_anti")
    counts = (requests.select("file_key").distinct()
              .join(log.groupBy("file_key").agg(F.count(F.lit(1)).alias("examples_deleted")), "file_key", "left")
              .select("file_key", F.coalesce("examples_deleted", F.lit(0)).cast("bigint").alias("examples_deleted")))
    return remaining, counts


def file_bucket() -> F.Column:
    return F.pmod(F.xxhash64("file_key"), F.lit(LOG_BUCKETS)).cast("int")


def write_capture_log(df: DataFrame, path: str) -> None:
    """S13 sink: append, one partition directory per bucket of user file keys."""
    df.withColumn("file_bucket", file_bucket()).repartition("file_bucket") \
        .write.mode("append").partitionBy("file_bucket").parquet(path)


def erase_from_log(spark: SparkSession, path: str, requests: DataFrame) -> list[int]:
    """U4 on the written log: rewrite the buckets of the requesting users, and no other, without
    their rows. Returns the buckets touched (at most LOG_BUCKETS). What stays of them is written
    to the shared folder first, so a lost job leaves the log or that copy whole."""
    keys = requests.select("file_key").distinct()
    touched = sorted(r[0] for r in keys.select(file_bucket().alias("b")).distinct().collect())
    log = spark.read.parquet(path).where(F.col("file_bucket").isin(touched))
    kept = materialize(log.join(keys, "file_key", "left_anti"), "erasure")
    kept.repartition("file_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("file_bucket").parquet(path)
    left = {r[0] for r in kept.select("file_bucket").distinct().collect()}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for b in touched:
        if b not in left:                                   # nothing of the bucket stays
            fs.delete(hadoop.Path(f"{path}/file_bucket={b}"), True)
    return touched
