"""Exact per-class ranking with few, skewed classes (W2 cap, W3 split, RAWSPLIT).

A plain ``row_number() over (partition by label order by k)`` puts each class in one
task; with 9 labels and one label holding a third of the data that is one task
sorting a third of the corpus. Instead:

1. ``k = md5(seed || '|' || id)``; bucket ``b`` = first 16 bits of ``k``. Ordering by
   ``(k, id)`` inside a class is the same as ordering by ``(b, k, id)``.
2. Count rows per ``(class, b)`` — a partial/final aggregate whose result is bounded by
   ``#classes x 65536`` rows regardless of data size.
3. Prefix-sum the counts over ``b`` inside each class on that small table.
4. The caller supplies per-class *cut points* (e.g. cap, train quota, train+val quota).
   A bucket whose rank range ``(prefix, prefix + n]`` straddles no cut lies wholly in
   one segment: its rows are labelled by a broadcast join, no sort. Only the few
   buckets that straddle a cut (at most one per cut per class) are ranked with
   ``row_number`` over ``(class, b)``, i.e. ~1/65536 of a class each.

Result: identical to the plain window (tested against DuckDB's plain form), fully
deterministic (hash order, never ``rand()``), so a lost executor recomputes the same
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_HEX_CHARS = 4          # 16 bits -> 65,536 buckets per class


def hash_order_key(id_col: str, seed: int) -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))


def sql_hash_order_key(id_col: str, seed: int) -> str:
    return f"md5('{seed}|' || CAST({id_col} AS VARCHAR))"


def with_order_key(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    k = hash_order_key(id_col, seed)
    return (df.withColumn("_k", k)
              .withColumn("_b", F.conv(F.substring("_k", 1, BUCKET_HEX_CHARS), 16, 10).cast("int")))


def bucket_counts(keyed: DataFrame, class_col: str) -> DataFrame:
    """``(class, _b, _n, _prefix)`` — rows per bucket and rows in earlier buckets."""
    counts = keyed.groupBy(class_col, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(class_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_prefix", F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("bigint"))


def segment_by_rank(keyed: DataFrame, buckets: DataFrame, cuts: DataFrame,
                    class_col: str, id_col: str, cut_cols: list[str]) -> DataFrame:
    """Add ``segment`` = number of cuts strictly below the row's 1-based class rank.

    ``keyed``   rows with ``_k, _b`` (from :func:`with_order_key`)
    ``buckets`` output of :func:`bucket_counts`
    ``cuts``    one row per class with the cut columns (non-decreasing ints)
    """
    lo, hi = F.col("_prefix"), F.col("_prefix") + F.col("_n")
    straddle = F.lit(False)
    base = F.lit(0)
    for c in cut_cols:
        straddle = straddle | ((lo < F.col(c)) & (F.col(c) < hi))
        base = base + F.when(F.col(c) <= lo, 1).otherwise(0)
    # Bounded by #classes x 65,536 rows and #classes <= taxonomy size: safe to broadcast.
    plan = F.broadcast(buckets.join(F.broadcast(cuts), class_col)
                       .select(class_col, "_b", "_prefix", *cut_cols,
                               straddle.alias("_straddle"), base.alias("_base")))
    joined = keyed.join(plan, [class_col, "_b"])
    whole = joined.filter(~F.col("_straddle")).withColumn("segment", F.col("_base"))
    w = Window.partitionBy(class_col, "_b").orderBy("_k", id_col)
    rank = F.col("_prefix") + F.row_number().over(w)
    seg = F.lit(0)
    for c in cut_cols:
        seg = seg + F.when(F.col(c) < F.col("_rank"), 1).otherwise(0)
    edge = (joined.filter(F.col("_straddle"))
            .withColumn("_rank", rank)
            .withColumn("segment", seg)
            .drop("_rank"))
    return whole.unionByName(edge).drop("_straddle", "_base", "_prefix", *cut_cols)


def exact_class_rank(keyed: DataFrame, buckets: DataFrame, class_col: str, id_col: str) -> DataFrame:
    """Full 1-based rank inside the class for every row (needed when the rank itself is
    reported). Sorts only within ``(class, bucket)``."""
    plan = F.broadcast(buckets.select(class_col, "_b", "_prefix"))
    w = Window.partitionBy(class_col, "_b").orderBy("_k", id_col)
    return (keyed.join(plan, [class_col, "_b"])
            .withColumn("class_rank", F.col("_prefix") + F.row_number().over(w))
            .drop("_prefix"))
