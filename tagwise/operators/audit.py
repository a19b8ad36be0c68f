"""Integrity audit: split leakage, near-duplicates, diversity, length statistics, samples.

Every overlap check is one aggregation over a 16-byte key (md5 of the exact or folded
text) with a bit per split, so all three split pairs are answered in one shuffle and a
text repeated in a third of all rows is collapsed by the map-side partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagwise import taxonomy as tx
from tagwise.functions import text as fx
from tagwise.operators import curate as cu
from tagwise.operators import ranking

SPLIT_BIT = {"train": 1, "validation": 2, "test": 4}
PAIRS = [("train", "validation"), ("train", "test"), ("validation", "test")]


def split_bit() -> F.Column:
    return cu.literal_map(SPLIT_BIT)[F.col("split")]


def raw_split(df: DataFrame, class_col: str = "label", id_col: str = "doc_id",
              seed: int = tx.SPLIT_SEED) -> DataFrame:
    """RAWSPLIT fixture: rank r in hash order inside the class; r/n <= 0.8 train,
    <= 0.9 validation, else test (cuts floor(4n/5), floor(9n/10) in integers)."""
    keyed = ranking.with_order_key(df, id_col, seed)
    buckets = ranking.bucket_counts(keyed, class_col)
    n = buckets.groupBy(class_col).agg(F.sum("_n").alias("_cn"))
    cuts = n.select(class_col, F.floor(F.col("_cn") * 4 / 5).cast("bigint").alias("_c1"),
                    F.floor(F.col("_cn") * 9 / 10).cast("bigint").alias("_c2"))
    seg = ranking.segment_by_rank(keyed, buckets, cuts, class_col, id_col, ["_c1", "_c2"])
    return (seg.withColumn("split", F.when(F.col("segment") == 0, "train")
                           .when(F.col("segment") == 1, "validation").otherwise("test"))
               .drop("segment", "_k", "_b"))


def split_overlap(df: DataFrame, key: F.Column) -> DataFrame:
    """Distinct shared keys per split pair + verdict, from one aggregate."""
    per_key = df.groupBy(key.alias("_h")).agg(F.bit_or(split_bit()).alias("_m"))
    agg = per_key.agg(*[
        F.count_if((F.col("_m").bitwiseAND(SPLIT_BIT[a] | SPLIT_BIT[b])) == (SPLIT_BIT[a] | SPLIT_BIT[b]))
        .alias(f"{a}__{b}") for a, b in PAIRS])
    stack = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in PAIRS)
    return (agg.selectExpr(f"stack({len(PAIRS)}, {stack}) AS (split_a, split_b, shared)")
               .withColumn("shared", F.col("shared").cast("bigint"))
               .withColumn("verdict", F.when(F.col("shared") == 0, "CLEAN").otherwise("LEAKAGE DETECTED")))


def test_rows_in_train(df: DataFrame, key: F.Column) -> DataFrame:
    """Test rows (not distinct) whose exact text (``key``) is also in train."""
    per_key = df.groupBy(key.alias("_h")).agg(
        F.bit_or(split_bit()).alias("_m"),
        F.count_if(F.col("split") == "test").alias("_t"))
    return per_key.agg(
        F.sum(F.when(F.col("_m").bitwiseAND(1) == 1, F.col("_t")).otherwise(0)).cast("bigint").alias("test_rows_in_train"),
        F.sum("_t").cast("bigint").alias("test_rows")
    ).withColumn("verdict", F.when(F.col("test_rows_in_train") == 0, "CLEAN — no leakage")
                 .otherwise("LEAKAGE DETECTED"))


def near_exact(df: DataFrame, exact: F.Column, folded: F.Column) -> DataFrame:
    """Train ∩ test by the key of the text after case/whitespace folding, next to the
    exact key's count."""
    tt = df.filter(F.col("split").isin("train", "test"))
    keys = tt.select(F.explode(F.array(
        F.struct(F.lit("exact").alias("kind"), exact.alias("_h")),
        F.struct(F.lit("folded").alias("kind"), folded.alias("_h")))).alias("k"),
        split_bit().alias("_bit")).select("k.kind", "k._h", "_bit")
    per_key = keys.groupBy("kind", "_h").agg(F.bit_or("_bit").alias("_m"))
    return per_key.agg(
        F.count_if((F.col("kind") == "exact") & (F.col("_m") == 5)).cast("bigint").alias("exact_shared"),
        F.count_if((F.col("kind") == "folded") & (F.col("_m") == 5)).cast("bigint").alias("folded_shared"))


def near_exact_examples(df: DataFrame, folded: F.Column, preview: F.Column, n: int = 3) -> DataFrame:
    """Up to ``n`` shared folded texts (smallest md5 first), 80-char previews: one
    aggregation carries the split bits and the smallest preview per folded key (16 bytes), so
    the split is read once (no second pass to fetch previews)."""
    tt = df.filter(F.col("split").isin("train", "test"))
    per_key = tt.groupBy(F.lower(F.hex(folded)).alias("folded_hash")).agg(
        F.bit_or(split_bit()).alias("_m"), F.min(preview).alias("preview"))
    return per_key.filter(F.col("_m") == 5).orderBy("folded_hash").limit(n).drop("_m")


def unique_ratio(df: DataFrame, group_col: str = "source") -> DataFrame:
    """distinct/total non-null texts per group (exact distinct on md5 keys)."""
    t = df.filter(F.col("text").isNotNull())
    per = t.groupBy(group_col, F.unhex(F.md5("text")).alias("_h")).agg(F.count(F.lit(1)).alias("_c"))
    return per.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("unique_texts"), F.sum("_c").cast("bigint").alias("total_texts")
    ).withColumn("unique_ratio", F.round(F.col("unique_texts") / F.col("total_texts"), 4))


def word_count_stats(df: DataFrame, group_col: str = "source") -> DataFrame:
    """A10: mean, median, p95 (linear interpolation), max of word counts per group.

    Exact ``percentile`` keeps a value->count map per group; word counts are small
    integers, so that map is bounded by the longest text, not by the row count."""
    wc = fx.word_count("text")
    return df.filter(F.col("text").isNotNull()).withColumn("_wc", wc).groupBy(group_col).agg(
        F.round(F.avg("_wc"), 4).alias("wc_mean"),
        F.round(F.percentile("_wc", 0.5), 4).alias("wc_p50"),
        F.round(F.percentile("_wc", 0.95), 4).alias("wc_p95"),
        F.max("_wc").alias("wc_max"))


def token_length_stats(train: DataFrame) -> DataFrame:
    """p50/p95/p99/max (truncated to int) of token lengths over every training text,
    and the recommended max length (128 if p95 <= 128 else 256). Exact ``percentile``
    keeps a length->count map bounded by the longest text, not by the row count."""
    first = train.withColumn("_len", F.size(fx.word_tokens("text")))
    return first.agg(
        F.percentile("_len", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("_p"),
        F.max("_len").alias("max_len"), F.count(F.lit(1)).alias("n_texts")
    ).select(F.col("_p")[0].cast("int").alias("p50"), F.col("_p")[1].cast("int").alias("p95"),
             F.col("_p")[2].cast("int").alias("p99"), F.col("max_len").cast("int").alias("max_len"),
             F.col("n_texts"),
             F.when(F.col("_p")[1].cast("int") <= 128, 128).otherwise(256).alias("recommended_max_length"))


def sample_per_label(df: DataFrame, k: int, label_col: str = "label", chars: int = 90,
                     seed: int = tx.SPLIT_SEED) -> DataFrame:
    """Up to ``k`` rows per label in seeded hash order (WindowGroupLimit)."""
    w = Window.partitionBy(label_col).orderBy(ranking.hash_order_key("doc_id", seed), "doc_id")
    short = df.select(label_col, "doc_id", F.substring("text", 1, chars).alias("preview"))
    return short.withColumn("sample_rank", F.row_number().over(w)).filter(F.col("sample_rank") <= k) \
        .select(label_col, "doc_id", "sample_rank", "preview")


def top_labels(df: DataFrame, k: int = 3, group_col: str = "source", label_col: str = "label") -> DataFrame:
    """Top-k labels by count per group (count desc, label asc)."""
    g = df.groupBy(group_col, label_col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group_col).orderBy(F.col("n").desc(), F.col(label_col))
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_label_samples(df: DataFrame, k: int = 4, group_col: str = "source", label_col: str = "label",
                      seed: int = tx.SPLIT_SEED) -> DataFrame:
    """Up to ``k`` examples (80 chars) of each group's most frequent label."""
    top = top_labels(df, 1, group_col, label_col).select(group_col, label_col)
    short = df.select(group_col, label_col, "doc_id", F.substring("text", 1, tx.PREVIEW_CHARS).alias("preview"))
    rows = short.join(top, [group_col, label_col], "left_semi")
    w = Window.partitionBy(group_col).orderBy(ranking.hash_order_key("doc_id", seed), "doc_id")
    return (rows.withColumn("sample_rank", F.row_number().over(w)).filter(F.col("sample_rank") <= k)
                .select(group_col, label_col, "doc_id", "sample_rank", "preview"))
