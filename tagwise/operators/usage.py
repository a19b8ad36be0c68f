"""Usage and volume analytics over the classification log."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwise import taxonomy as tx
from tagwise.functions import text as fx


def plans_df(spark: SparkSession) -> DataFrame:
    schema = T.StructType([T.StructField("plan", T.StringType()), T.StructField("monthly_price", T.DoubleType()),
                           T.StructField("quota", T.LongType()), T.StructField("overage_price", T.DecimalType(18, 6))])
    rows = [(p, m, q, None if o is None else Decimal(str(o))) for p, m, q, o in tx.PLAN_QUOTAS]
    return spark.createDataFrame(rows, schema)


def monthly_usage(spark: SparkSession, log: DataFrame, plan_state: DataFrame) -> DataFrame:
    """Calls per account per month (``units`` of each logged request) against the plan
    quota; overage priced per call in decimal.
    Accounts without a billing record are on ``free``. Metering is not enforced by the
    reference; this is the report its pricing table implies."""
    calls = log.groupBy("account_id", F.date_trunc("month", "ts").alias("month")).agg(
        F.sum("units").cast("bigint").alias("calls"))
    plans = plan_state.select("account_id", "plan")
    out = (calls.join(plans, "account_id", "left")
                .withColumn("plan", F.coalesce("plan", F.lit("free")))
                .join(F.broadcast(plans_df(spark)), "plan", "left"))       # fixed 4-row dimension
    over = F.when(F.col("quota").isNull(), F.lit(0)).otherwise(F.greatest(F.col("calls") - F.col("quota"), F.lit(0)))
    return out.select("account_id", "month", "plan", "calls", "quota",
                      over.cast("bigint").alias("over_quota_calls"),
                      (over.cast("decimal(18,0)") * F.coalesce("overage_price", F.lit(0).cast("decimal(18,6)"))).alias("overage_usd"))


def weekly_volume(log: DataFrame) -> DataFrame:
    """Tickets per (week, intent) with rollup rows for weekly and grand totals."""
    return (log.rollup(F.date_trunc("week", "ts").alias("week"), "intent")
               .agg(F.count(F.lit(1)).alias("n")))


def volume_spikes(log: DataFrame, intent: str | None = None, days: int = 7, sigmas: float = 2.0) -> DataFrame:
    """Daily count per intent vs the mean and sample stddev of the previous ``days``
    daily rows; spike when above mean + sigmas * stddev. The window runs over the daily
    aggregate (intents x days rows), not over events."""
    daily = log.groupBy("intent", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    if intent:
        daily = daily.filter(F.col("intent") == intent)
    w = Window.partitionBy("intent").orderBy("day").rowsBetween(-days, -1)
    return (daily.withColumn("prev_mean", F.round(F.avg("n").over(w), 4))
                 .withColumn("prev_std", F.round(F.stddev_samp("n").over(w), 4))
                 .withColumn("spike", F.col("n") > F.col("prev_mean") + sigmas * F.col("prev_std")))


def target_vs_got(spark: SparkSession, labelled: DataFrame) -> DataFrame:
    """Obtained rows per intent against the per-intent generation target."""
    target = spark.createDataFrame(sorted(tx.SYNTHETIC_TARGET_PER_INTENT.items()), "intent string, target bigint")
    got = labelled.groupBy("intent").agg(F.count(F.lit(1)).alias("got"))
    return (F.broadcast(target).join(got, "intent", "left")
            .select("intent", "target", F.coalesce("got", F.lit(0)).cast("bigint").alias("got"))
            .withColumn("shortfall", F.greatest(F.col("target") - F.col("got"), F.lit(0)))
            .withColumn("pct_of_target", F.round(F.col("got") * 100.0 / F.col("target"), 4)))


def clean_generated_lines(docs: DataFrame, max_lines) -> DataFrame:
    """Split on newline, strip, keep lines of >= 5 characters that start with
    neither a digit nor '-', first ``max_lines`` per document (a response) in order.
    All of it is row-local array work on the document (filter, slice, posexplode): no
    shuffle and no window, however many lines a document or the corpus holds."""
    lines = F.transform(F.split("text", "\n"), lambda l: fx.strip(l))
    kept = F.filter(lines, lambda l: (F.length(l) >= 5) & ~l.rlike(r"^[\p{Nd}-]"))
    limit = max_lines if not isinstance(max_lines, (int, float)) else F.lit(int(max_lines))
    return (docs.select("doc_id", "intent", F.posexplode(F.slice(kept, 1, limit.cast("int"))).alias("pos", "line"))
                .withColumn("line_no", (F.col("pos") + 1).cast("int")).drop("pos"))
