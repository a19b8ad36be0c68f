"""Evaluation as aggregates over a predictions table ``(id, y_true, y_pred, confidence)``.

Everything reduces first to the (true, pred) count table — at most 9 x 9 rows however
many predictions there are — and per-class / averaged metrics are computed on that.
Labels are the union of true and predicted labels (sklearn's default), and a zero
denominator yields 0 (``zero_division=0``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwise import taxonomy as tx
from tagwise.operators import curate as cu
from tagwise.operators.ordered import percentiles


def pair_counts(pred: DataFrame) -> DataFrame:
    """J12 + A14 core: ``(y_true, y_pred, n)`` — predictions joined to truth by key
    upstream; here only the counts, map-side combined."""
    return pred.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def present_labels(pairs: DataFrame) -> DataFrame:
    return (pairs.select(F.col("y_true").alias("label"))
            .union(pairs.select(F.col("y_pred").alias("label"))).distinct())


def confusion_matrix(spark: SparkSession, pred: DataFrame) -> DataFrame:
    """Every (true, pred) cell over the present labels, zero cells included, with
    label ids. The grid comes from the fixed 9 x 9 taxonomy table, filtered to present
    labels by semi joins (no cross join of data)."""
    pairs = pair_counts(pred)
    present = present_labels(pairs)
    grid = spark.createDataFrame([(a, i, b, j) for i, a in enumerate(tx.LABELS) for j, b in enumerate(tx.LABELS)],
                                 "y_true string, true_id int, y_pred string, pred_id int")
    grid = (grid.join(present.withColumnRenamed("label", "y_true"), "y_true", "left_semi")
                .join(present.withColumnRenamed("label", "y_pred"), "y_pred", "left_semi"))
    return (grid.join(pairs, ["y_true", "y_pred"], "left")
                .select("y_true", "true_id", "y_pred", "pred_id",
                        F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def class_report(pred: DataFrame) -> DataFrame:
    """A15 + P17: per label support / predicted / tp, precision, recall, F1 (4 dp), flag."""
    pairs = pair_counts(pred)
    long = pairs.selectExpr(
        "stack(2, y_true, n, CAST(0 AS BIGINT), CASE WHEN y_true = y_pred THEN n ELSE CAST(0 AS BIGINT) END, "
        "y_pred, CAST(0 AS BIGINT), n, CAST(0 AS BIGINT)) AS (label, sup, prd, tp)")
    agg = long.groupBy("label").agg(F.sum("sup").cast("bigint").alias("support"),
                                    F.sum("prd").cast("bigint").alias("predicted"),
                                    F.sum("tp").cast("bigint").alias("tp"))
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0))
    return (agg.withColumn("label_id", cu.label_id("label"))
               .withColumn("precision", F.round(p, 4)).withColumn("recall", F.round(r, 4))
               .withColumn("f1", F.round(f1, 4))
               .withColumn("flag", F.when(f1 >= tx.F1_OK, "OK").otherwise("!!")))


def summary(pred: DataFrame) -> DataFrame:
    """A13 + A16 + A17 + P18: accuracy, macro and weighted P/R/F1, worst class, gate —
    one row, from the per-class table (<= 9 rows)."""
    rep = class_report(pred)
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0))
    n = F.sum("support")
    out = rep.agg(
        n.cast("bigint").alias("n"),
        F.round(F.sum("tp") / n, 4).alias("accuracy"),
        F.round(F.avg(p), 4).alias("precision_macro"), F.round(F.avg(r), 4).alias("recall_macro"),
        F.round(F.avg(f1), 4).alias("f1_macro"),
        F.round(F.sum(p * F.col("support")) / n, 4).alias("precision_weighted"),
        F.round(F.sum(r * F.col("support")) / n, 4).alias("recall_weighted"),
        F.round(F.sum(f1 * F.col("support")) / n, 4).alias("f1_weighted"),
        F.min_by("label", F.struct(f1, F.col("label"))).alias("worst_label"),
        F.round(F.min(f1), 4).alias("worst_f1"),
        (F.sum(f1 * F.col("support")) / n >= tx.RELEASE_GATE_F1).alias("release_gate_passed"))
    return out


def threshold_sweep(scored: DataFrame, thresholds=tx.SWEEP_THRESHOLDS) -> DataFrame:
    """Per threshold, coverage (share tagged: confidence >= t) and precision among
    the tagged. One pass with conditional counts, then ``stack`` into one row per
    threshold — no join against the threshold list."""
    aggs = []
    for i, t in enumerate(thresholds):
        ok = F.col("confidence") >= F.lit(float(t))
        aggs += [F.count_if(ok).alias(f"c{i}"), F.count_if(ok & F.col("correct")).alias(f"k{i}")]
    one = scored.agg(F.count(F.lit(1)).alias("n"), *aggs)
    body = ", ".join(f"CAST({t} AS DOUBLE), c{i}, k{i}" for i, t in enumerate(thresholds))
    return (one.selectExpr("n", f"stack({len(thresholds)}, {body}) AS (threshold, tagged, correct)")
               .select("threshold", F.col("tagged").cast("bigint").alias("tagged"),
                       F.round(F.col("tagged") / F.col("n"), 4).alias("coverage"),
                       F.round(F.coalesce(F.try_divide(F.col("correct"), F.col("tagged")), F.lit(0.0)), 4)
                       .alias("precision")))


def latency_report(log: DataFrame, latency_col: str = "latency_ms") -> DataFrame:
    """A18 + A19: p50/p95/p99 (linear interpolation) and mean latency of the raw values, cost
    per 1k calls at the GPU hourly price. The percentiles come from the ranks of a range sort,
    so no task holds all values."""
    v = log.select(F.col(latency_col).cast("double").alias("v")).where(F.col("v").isNotNull())
    at = percentiles(v, "v", [0.5, 0.95, 0.99])
    q = v.agg(F.avg("v").alias("_mean"), F.count(F.lit(1)).alias("n_calls"))
    p95 = F.lit(at[1])
    return q.select("n_calls",
                    F.round(F.lit(at[0]), 4).alias("p50_ms"), F.round(p95, 4).alias("p95_ms"),
                    F.round(F.lit(at[2]), 4).alias("p99_ms"), F.round("_mean", 4).alias("mean_ms"),
                    F.round(p95 / 1000 * (tx.GPU_DOLLARS_PER_HOUR / 3600) * 1000, 4)
                    .alias("cost_per_1k_calls_usd"))


COMPARISON_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("cost_per_1k_calls_usd", T.DoubleType()),
    T.StructField("cost_note", T.StringType()), T.StructField("p95_latency_ms", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()), T.StructField("f1_weighted", T.DoubleType())])


def model_comparison(spark: SparkSession, measured: DataFrame) -> DataFrame:
    """The measured row (``model, cost_per_1k_calls_usd, p95_latency_ms, accuracy,
    f1_weighted``) next to the fixed published baseline rows."""
    base = spark.createDataFrame(tx.BASELINE_MODELS, COMPARISON_SCHEMA)
    return measured.withColumn("cost_note", F.lit(None).cast("string")).select(*COMPARISON_SCHEMA.names) \
        .unionByName(base)


def automation_share(tagged: DataFrame) -> DataFrame:
    """Share of tickets that got a specific (not unclassified) tag."""
    return tagged.agg(F.count(F.lit(1)).alias("n"),
                      F.round(F.avg((F.col("tag") != tx.UNCLASSIFIED_TAG).cast("double")), 4)
                      .alias("automation_share"))


def ranked_scores(scored: DataFrame, id_col: str) -> DataFrame:
    """All class scores per row, ranked (score desc, label asc)."""
    ex = scored.select(id_col, F.posexplode(F.array_sort(
        F.transform("scores", lambda s: F.struct((-s["score"]).alias("neg"), s["label"].alias("label"))))
    ).alias("pos", "s"))
    return ex.select(id_col, (F.col("pos") + 1).alias("rank"), F.col("s.label").alias("label"),
                     (-F.col("s.neg")).alias("score"))


def release_targets(spark: SparkSession, summary_df: DataFrame, latency_df: DataFrame) -> DataFrame:
    """``metric, value, target, passed`` for each published release target."""
    values = summary_df.selectExpr("stack(3, 'accuracy', accuracy, 'f1_weighted', f1_weighted, 'worst_f1', worst_f1) AS (metric, value)") \
        .unionByName(latency_df.select(F.lit("p95_ms").alias("metric"), F.col("p95_ms").alias("value")))
    targets = spark.createDataFrame(tx.RELEASE_TARGETS, "metric string, target double, at_most boolean")
    met = F.when(F.col("at_most"), F.col("value") <= F.col("target")).otherwise(F.col("value") >= F.col("target"))
    return values.join(targets, "metric").select("metric", "value", "target", met.alias("passed"))


def final_results(summary_df: DataFrame, latency_df: DataFrame, report_df: DataFrame) -> DataFrame:
    """M5: the final results and each class's F1 as ``(metric, value)`` rows (union, no join)."""
    a = summary_df.selectExpr("stack(3, 'test_accuracy', accuracy, 'f1_weighted', f1_weighted, "
                              "'f1_macro', f1_macro) AS (metric, value)")
    b = latency_df.selectExpr("stack(5, 'p50_ms', p50_ms, 'p95_ms', p95_ms, 'p99_ms', p99_ms, "
                              "'mean_ms', mean_ms, 'cost_per_1k_calls_usd', cost_per_1k_calls_usd) "
                              "AS (metric, value)")
    return a.unionByName(b).unionByName(report_df.select(F.concat(F.lit("f1_"), "label").alias("metric"), F.col("f1").alias("value")))
