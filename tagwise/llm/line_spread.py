"""Boilerplate lines by the number of distinct sites that carry them.

Each line (trimmed of white space; empty ones never count) is a 64-bit pair of hashes. One
aggregation by line merges HyperLogLog sketches of its sites: map tasks send a sketch a line,
however often a line or a site repeats. A line whose estimate lies clearly on one side of
the threshold, :data:`MARGIN` standard errors of the sketch, is decided by it; those nearer
get the exact number of distinct sites from a second, small aggregation. Lines carried by at
least ``least`` sites leave every document. Built from DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwise.llm.common import written

LEAST_SITES = 8
LG_K = 10                           # 2^10 registers: standard error 3.3 %
MARGIN = 5
_EDGES = "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$"


def line_hash(line: Column) -> Column:
    """128 bits of a trimmed line; null for one without characters."""
    bare = F.regexp_replace(line, _EDGES, "")
    return F.when(bare != "", F.unhex(F.md5(bare)))


def spread_lines(lines: DataFrame, least: int = LEAST_SITES) -> DataFrame:
    """``line`` of ``lines(line, site)`` that at least ``least`` distinct sites carry. A null
    site is no site."""
    band = MARGIN * 1.04 / 2 ** (LG_K / 2)
    low, high = least * (1 - band), least * (1 + band)
    rows = lines.where(F.col("line").isNotNull() & F.col("site").isNotNull())
    spread = written(rows.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
                     .where(F.col("sites") >= F.lit(min(low, least - 1))), "line-spread")
    sure = spread.where(F.col("sites") > high).select("line")
    near = spread.where(F.col("sites").between(min(low, least - 1), high)).select("line")
    exact = rows.join(near, "line", "left_semi").groupBy("line", "site").agg(F.count(F.lit(1)).alias("_n")) \
        .groupBy("line").agg(F.count(F.lit(1)).alias("exact")).where(F.col("exact") >= least).select("line")
    return sure.unionByName(exact)


def clean_lines(docs: DataFrame, least: int = LEAST_SITES, text: str = "text", key: str = "doc_id",
                site: str = "source") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_lines`` (lines with characters), ``n_removed`` and the
    cleaned ``text`` (the other lines, in order; null stays null). Repeated lines of a document
    or site count once for the spread and all of them leave. Rows that share key, site and text
    are one document here. Extra columns are ignored."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(site).alias("site"), F.col(text).alias("text"))
    rows = rows.withColumn("row", F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("site").isNull(), F.coalesce("site", F.lit(""))))
    lines = written(rows.select("doc_id", "row", "site", F.posexplode(F.transform(F.split("text", "\n", -1), line_hash)).alias("at", "line"))
                    .where(F.col("line").isNotNull()), "lines")
    gone = spread_lines(lines.select("line", "site"), least)
    removed = lines.join(gone, "line", "left_semi").groupBy("doc_id", "row").agg(F.collect_set("at").alias("at"))
    marked = rows.join(removed.withColumnRenamed("doc_id", "_id").withColumnRenamed("row", "_row"),
                       F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    split = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(split, lambda _, i: ~F.array_contains("at", i)), "\n")
    return marked.select(
        "doc_id",
        F.coalesce(F.size(F.filter(split, lambda x: F.regexp_replace(x, _EDGES, "") != "")), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("at").isNotNull(), F.size("at")).otherwise(0).cast("long").alias("n_removed"),
        F.when(F.col("at").isNull(), F.col("text")).otherwise(kept).alias("text"))
