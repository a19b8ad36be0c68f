"""Order-dependent per-key computations that stay balanced when one key is hot.

``lead`` / ``row_number`` over ``Window.partitionBy(key)`` send every row of a key to
one task; a key holding a third of the rows makes that task a third of the job. Here
the rows are range-partitioned on ``(key, order...)`` instead (Spark samples the bounds,
so a hot key spans many equal-sized ranges), the computation runs inside each range,
and the few rows at range boundaries are fixed up from a per-range summary table whose
size is bounded by the number of ranges (for ``next_in_key``) or by the number of
(range, key) pairs (for ``rank_in_key``). Results equal the plain window (tested).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagwise.session import materialize as write_once


def _ranges(df: DataFrame, key: str, order: list[str], parts: int | None) -> DataFrame:
    """Range-partition on ``(key, order)`` and store the range id with the rows.

    The id comes from ``spark_partition_id()`` right after the range exchange; the rows are
    written once to the shared folder so every later branch (in-range window, boundary
    summary) sees the same assignment — two independent evaluations of a sampled range
    exchange are not guaranteed to agree."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, key, *order).withColumn("_pid", F.spark_partition_id())
    return write_once(ranged, "key-ranges")


def next_in_key(df: DataFrame, key: str, order: list[str], cols: list[str], prefix: str = "next_",
                parts: int | None = None) -> DataFrame:
    """Add ``<prefix><c>`` = value of ``c`` on the next row of the same key in ``order``
    (null on a key's last row)."""
    r = _ranges(df, key, order, parts)
    w = Window.partitionBy("_pid").orderBy(key, *order)
    out = r.withColumn("_last", F.lead(F.lit(1)).over(w).isNull()).withColumn("_nkey", F.lead(key).over(w))
    for c in cols:
        out = out.withColumn(f"_n_{c}", F.lead(c).over(w))
    # first row of every non-empty range, and for each range the first row of the next one
    ordering = F.struct(*[F.col(k) for k in [key, *order]])
    firsts = r.groupBy("_pid").agg(F.min_by(F.struct(key, *cols), ordering).alias("_f"))
    nxt = firsts.withColumn("_nf", F.lead("_f").over(Window.partitionBy(F.lit(0)).orderBy("_pid"))) \
        .select("_pid", "_nf")                     # one row per range: bounded by the range count
    out = out.join(F.broadcast(nxt), "_pid", "left")
    for c in cols:
        in_range = F.when(F.col("_nkey") == F.col(key), F.col(f"_n_{c}"))
        across = F.when(F.col("_nf")[key] == F.col(key), F.col("_nf")[c])
        out = out.withColumn(f"{prefix}{c}", F.when(F.col("_last"), across).otherwise(in_range))
    return out.drop("_pid", "_last", "_nkey", "_nf", *[f"_n_{c}" for c in cols])


def rank_in_key(df: DataFrame, key: str, order: list[str], name: str = "rank",
                parts: int | None = None, dtype: str = "int") -> DataFrame:
    """Add ``name`` = 1-based ``row_number`` of the row within its key in ``order``
    (``dtype="long"`` where a key may hold more than 2^31 rows)."""
    r = _ranges(df, key, order, parts)
    local = F.row_number().over(Window.partitionBy("_pid", key).orderBy(*order))
    counts = r.groupBy("_pid", key).agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("_off", F.coalesce(before, F.lit(0))).select("_pid", key, "_off")
    return (_join_on_range_key(r.withColumn("_local", local), offsets, key)
             .withColumn(name, (F.col("_off") + F.col("_local")).cast(dtype))
             .drop("_local", "_off"))


def percentiles(df: DataFrame, col: str, shares: list[float]) -> list[float | None]:
    """Exact percentiles of a non-null column, interpolated linearly between the two values at
    ``share * (n - 1)``: the rows of those ranks in a range sort, at most two a share, reach
    the driver. None for an empty column."""
    n = df.count()
    if not n:
        return [None for _ in shares]
    places = [share * (n - 1) for share in shares]
    wanted = sorted({1 + k for p in places for k in (math.floor(p), math.ceil(p))})
    ranked = rank_in_key(df.select(F.lit(0).alias("_all"), col), "_all", [col], "_rank", dtype="long")
    at = {r["_rank"]: r[col] for r in ranked.where(F.col("_rank").isin(wanted)).collect()}
    return [at[1 + math.floor(p)] + (p - math.floor(p)) * (at[1 + math.ceil(p)] - at[1 + math.floor(p)]) for p in places]


def fill_forward(df: DataFrame, key: str, order: list[str], col: str, name: str | None = None,
                 parts: int | None = None) -> DataFrame:
    """Add ``name`` (default ``col``) = the last non-null ``col`` at or before the row
    within its key in ``order`` (``last(col, ignorenulls)`` over an unbounded-preceding
    window). Inside each range a window over ``(range, key)`` fills locally; the value a
    key carries into a range comes from a per-(range, key) summary (one row per pair, a
    hot key spans at most one row per range)."""
    name = name or col
    r = _ranges(df, key, order, parts)
    upto = Window.partitionBy("_pid", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = F.last(col, ignorenulls=True).over(upto)
    summ = r.groupBy("_pid", key).agg(
        F.max_by(col, F.when(F.col(col).isNotNull(), F.struct(*order))).alias("_lastv"))
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = summ.select("_pid", key, F.last("_lastv", ignorenulls=True).over(before).alias("_carry"))
    return (_join_on_range_key(r.withColumn("_local", local), carry, key)
             .withColumn(name, F.coalesce("_local", "_carry"))
             .drop("_local", "_carry"))


def _join_on_range_key(rows: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """Attach the per-(range, key) summary to its rows; a null key is a key like any
    other here (null-safe equality), so rows with a null key are kept."""
    s = summary.withColumnRenamed("_pid", "_spid").withColumnRenamed(key, "_skey")
    cond = (F.col("_pid") == F.col("_spid")) & F.col(key).eqNullSafe(F.col("_skey"))
    return rows.join(s, cond).drop("_pid", "_spid", "_skey")
