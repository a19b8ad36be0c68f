"""ST5 / ST7 / ST8 / ST10: event-time windows with watermarks.

* ST7 intent volume: tumbling windows per intent, ``append`` mode — a window is written
  once, when the watermark (max event time - delay) passes its end; later data for it
  is late and dropped (the delay is the job's lateness parameter).
* Windows that the watermark has not passed at the end of a run are still in the state; they are
  read from there (:func:`open_windows`) without closing them: the next run goes on with them.
* ST5 rate audit: calls per client key and endpoint in 1-second windows against the endpoint's
  limit, same mechanics.
* ST8 replay protection: ``dropDuplicatesWithinWatermark(event id)`` so a redelivered
  event is counted once (the reference counts it twice; the job makes it explicit).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwise import taxonomy as tx
from tagwise.streaming import common


def start_intent_windows(spark: SparkSession, log_stream: DataFrame, out_path: str,
                         window: str = "1 day", delay: str = "1 hour", checkpoint: str | None = None) -> int:
    agg = (log_stream.withWatermark("ts", delay)
           .groupBy(F.window("ts", window).alias("w"), "intent")
           .agg(F.count(F.lit(1)).alias("n"))
           .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "intent", "n"))
    writer = agg.writeStream.outputMode("append").format("parquet").option("path", out_path)
    return common.run_available_now(writer, "intent-windows", spark, checkpoint)


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What an aggregation by window keeps in its state after the last batch: ``window`` and the other
    grouping columns, and ``value``, the aggregate. Closed windows have left the state."""
    state = spark.read.format("statestore").load(checkpoint)
    value = state.schema["value"].dataType.names[0]
    return state.select("key.*", F.col("value")[value].alias("value"))


def all_intent_windows(spark: SparkSession, out_path: str, checkpoint: str) -> DataFrame:
    """Every window of a run: the closed ones and, with ``closed`` false, those still open."""
    still = open_windows(spark, checkpoint)
    return spark.read.parquet(out_path).withColumn("closed", F.lit(True)).unionByName(still.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "intent", F.col("value").alias("n"), F.lit(False).alias("closed")))


def limited(calls: DataFrame) -> DataFrame:
    """Counted calls with their endpoint's limit a second and whether they pass it."""
    limit = F.create_map(*[F.lit(x) for kv in tx.RATE_LIMITS.items() for x in kv])[F.col("endpoint")]
    return calls.withColumn("rate_limit", limit).withColumn("exceeded", F.col("n") > F.col("rate_limit"))


def start_rate_audit(spark: SparkSession, log_stream: DataFrame, out_path: str, delay: str = "10 seconds",
                     checkpoint: str | None = None) -> int:
    """``log_stream``: ``ts, client_key, endpoint, calls``. Every closed window of a client and
    endpoint, flagged where it has more calls than the endpoint allows a second."""
    agg = (log_stream.withWatermark("ts", delay)
           .groupBy(F.window("ts", "1 second").alias("w"), "client_key", "endpoint")
           .agg(F.sum("calls").alias("n"))
           .select("client_key", "endpoint", F.col("w.start").alias("second"), "n"))
    writer = limited(agg).writeStream.outputMode("append").format("parquet").option("path", out_path)
    return common.run_available_now(writer, "rate-audit", spark, checkpoint)


def all_rate_windows(spark: SparkSession, out_path: str, checkpoint: str) -> DataFrame:
    """Every second of a run, closed or (with ``closed`` false) still open."""
    still = open_windows(spark, checkpoint).select("client_key", "endpoint", F.col("window.start").alias("second"), F.col("value").alias("n"))
    return spark.read.parquet(out_path).withColumn("closed", F.lit(True)) \
        .unionByName(limited(still).withColumn("closed", F.lit(False)))


def start_dedup_counts(spark: SparkSession, log_stream: DataFrame, out_path: str,
                       delay: str = "1 hour") -> int:
    """Counts per account after dropping redeliveries of the same ticket id."""
    dedup = log_stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["ticket_id"])
    writer = dedup.select("account_id", "ticket_id", "ts").writeStream.outputMode("append") \
        .format("parquet").option("path", out_path)
    return common.run_available_now(writer, "dedup", spark)
