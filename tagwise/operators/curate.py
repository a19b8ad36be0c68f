"""Corpus curation: label mapping, length filter, exact dedup, class cap, stratified split.

Plan shape (one lazy DataFrame from scan to split):

    scan(documents: doc_id, text, lang, source)      -- pruned parquet scan
      -> strip, word count, 3 <= words <= 200         -- narrow, before any shuffle
      -> dedup on md5(lower(strip(text)))             -- one shuffle; WindowGroupLimit
                                                         keeps 1 row/key/task map-side
      -> label map (literal map, row-local) + label id
      -> bucket counts (partial agg, <= 9 x 65,536 rows)
      -> class plan (cap, quotas) on <= 9 rows
      -> segment by exact rank (broadcast bucket plan; only cut-straddling buckets sort)

The length filter runs before dedup although the reference filters after it: equal
dedup keys have equal word counts (``lower`` never creates or removes whitespace), so
the surviving rows are identical and the shuffle carries fewer rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagwise import taxonomy as tx
from tagwise.functions import text as fx
from tagwise.operators import ranking
from tagwise.session import materialize as write_once

SPLITS = ["train", "validation", "test"]


def literal_map(mapping: dict[str, object]) -> Column:
    """A fixed lookup as a map literal: evaluated row-locally inside codegen, no join."""
    return F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv])


def map_label(col, mapping: dict[str, str] | None = None) -> Column:
    """Source label -> canonical label on ``lower().strip()``; miss -> OTHER."""
    mapping = tx.SOURCE_LABEL_MAP if mapping is None else mapping
    return F.coalesce(literal_map(mapping)[fx.label_key(col)], F.lit(tx.DEFAULT_LABEL))


def label_id(col) -> Column:
    """Canonical label -> id (miss -> null)."""
    return literal_map(tx.LABEL_ID)[F.col(col) if isinstance(col, str) else col].cast("int")


def id_to_label(col) -> Column:
    return literal_map({i: lab for i, lab in enumerate(tx.LABELS)})[F.col(col) if isinstance(col, str) else col]


def sql_map(expr: str, mapping: dict, default: str | None = None) -> str:
    whens = " ".join(f"WHEN {_sql_lit(k)} THEN {_sql_lit(v)}" for k, v in sorted(mapping.items()))
    dflt = "NULL" if default is None else _sql_lit(default)
    return f"(CASE {expr} {whens} ELSE {dflt} END)"


def _sql_lit(v) -> str:
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def sql_map_label(expr: str, mapping: dict[str, str] | None = None) -> str:
    mapping = tx.SOURCE_LABEL_MAP if mapping is None else mapping
    return sql_map(fx.sql_label_key(expr), mapping, tx.DEFAULT_LABEL)


def sql_label_id(expr: str) -> str:
    return f"CAST({sql_map(expr, tx.LABEL_ID)} AS INTEGER)"


# --- P1/P2/F1/F4/P3 ------------------------------------------------------------------

def normalise(df: DataFrame) -> DataFrame:
    """P1 + P2 + F1: keep ``doc_id, text, raw_label, source``, drop rows whose text or
    label is null, strip the text."""
    return (df.select("doc_id", "text", "raw_label", "source")
              .na.drop(subset=["text", "raw_label"])
              .withColumn("text", fx.strip("text")))


def length_filter(df: DataFrame, lo: int = tx.MIN_WORDS, hi: int = tx.MAX_WORDS) -> DataFrame:
    """``lo <= words <= hi`` (both inclusive).

    The filter is pushed below the projection with the word count inlined, so it is
    written with a single reference to it (``|2w - (lo + hi)| <= hi - lo`` is the same
    integer range) and the count of a long text is computed once, not once per bound."""
    return df.withColumn("word_count", fx.word_count("text")) \
        .filter(F.abs(F.col("word_count") * 2 - (lo + hi)) <= (hi - lo))


# --- W1 ---------------------------------------------------------------------------------

def dedup_keep_first(df: DataFrame, order_col: str = "doc_id") -> DataFrame:
    """One row per ``md5(lower(strip(text)))``, the first by ``order_col``.

    ``row_number() = 1`` is planned as WindowGroupLimit (partial before the shuffle,
    final after), so a hot key — one text repeated in a third of the rows — reaches the
    reducer as at most one row per map task.
    """
    w = Window.partitionBy("text_hash").orderBy(order_col)
    return (df.withColumn("text_hash", fx.text_hash("text"))
              .withColumn("_rn", F.row_number().over(w))
              .filter(F.col("_rn") == 1).drop("_rn"))


# --- J1 + J2 + P4 -----------------------------------------------------------------------

def attach_labels(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Map the raw label to the taxonomy, attach ``label_id``, drop rows without one."""
    return (df.withColumn("label", map_label("raw_label", mapping))
              .withColumn("label_id", label_id("label"))
              .filter(F.col("label_id").isNotNull()))


# --- A5 + W3 quotas on the class table ----------------------------------------------------

def _approximate_mode(df: DataFrame, count_col: str, draws_col: str, out: str) -> DataFrame:
    """Per-class share of ``draws`` by floor + largest remainder, ties to the lower label
    id (integer arithmetic, so equal remainders are exactly equal). ``df`` is the tiny
    class table; the global window runs over <= 9 rows."""
    everything = Window.partitionBy(F.lit(0))
    total = F.sum(count_col).over(everything)
    num = F.col(count_col) * F.col(draws_col)
    df = (df.withColumn("_total", total)
            .withColumn("_floor", F.when(F.col("_total") > 0, F.floor(num / F.col("_total"))).otherwise(0))
            .withColumn("_rem", F.when(F.col("_total") > 0, num % F.col("_total")).otherwise(0)))
    need = F.col(draws_col) - F.sum("_floor").over(everything)
    rk = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("_rem").desc(), F.col("label_id")))
    return (df.withColumn(out, (F.col("_floor") + F.when(rk <= need, 1).otherwise(0)).cast("bigint"))
              .drop("_total", "_floor", "_rem"))


def class_plan(class_counts: DataFrame, cap_multiplier: int = tx.CAP_MULTIPLIER) -> DataFrame:
    """From ``(label, label_id, n)`` compute ``cap, kept, n_train, n_val, n_test``.

    cap = multiplier x smallest class; kept = min(n, cap). Split as a two-stage
    stratified 80/10/10: stage 1 holds out ceil(0.2 N) and allocates the kept side
    (train) per class first; stage 2 gives test ceil(half) of the hold-out and allocates
    validation first.
    """
    everything = Window.partitionBy(F.lit(0))
    df = (class_counts
          .withColumn("cap", (F.min("n").over(everything) * cap_multiplier).cast("bigint"))
          .withColumn("kept", F.least("n", "cap").cast("bigint")))
    big_n = F.sum("kept").over(everything)
    # ceil(0.2 N) held out, in integers: ceil(N / 5)
    df = df.withColumn("_draw_train", big_n - F.floor((big_n + 4) / 5))
    df = _approximate_mode(df, "kept", "_draw_train", "n_train")
    df = df.withColumn("_temp", F.col("kept") - F.col("n_train"))
    temp_n = F.sum("_temp").over(everything)
    df = df.withColumn("_draw_val", temp_n - F.floor((temp_n + 1) / 2))
    df = _approximate_mode(df, "_temp", "_draw_val", "n_val")
    return (df.withColumn("n_test", F.col("_temp") - F.col("n_val"))
              .drop("_draw_train", "_temp", "_draw_val"))


SQL_CLASS_PLAN = """
WITH c0 AS (
  SELECT label, label_id, n, CAST(min(n) OVER () * {mult} AS BIGINT) AS cap FROM class_counts),
c1 AS (SELECT *, least(n, cap) AS kept FROM c0),
c2 AS (SELECT *, sum(kept) OVER () - (sum(kept) OVER () + 4) // 5 AS draw_train,
              sum(kept) OVER () AS tot FROM c1),
c3 AS (SELECT *, (kept * draw_train) // tot AS fl, (kept * draw_train) % tot AS rem FROM c2),
c4 AS (SELECT *, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, label_id)
                              <= draw_train - sum(fl) OVER () THEN 1 ELSE 0 END AS n_train FROM c3),
c5 AS (SELECT label, label_id, n, cap, kept, n_train, kept - n_train AS tmp FROM c4),
c6 AS (SELECT *, sum(tmp) OVER () - (sum(tmp) OVER () + 1) // 2 AS draw_val,
              sum(tmp) OVER () AS tot2 FROM c5),
c7 AS (SELECT *, CASE WHEN tot2 > 0 THEN (tmp * draw_val) // tot2 ELSE 0 END AS fl2,
              CASE WHEN tot2 > 0 THEN (tmp * draw_val) % tot2 ELSE 0 END AS rem2 FROM c6),
c8 AS (SELECT *, fl2 + CASE WHEN row_number() OVER (ORDER BY rem2 DESC, label_id)
                              <= draw_val - sum(fl2) OVER () THEN 1 ELSE 0 END AS n_val FROM c7)
SELECT label, label_id, n, cap, kept, CAST(n_train AS BIGINT) AS n_train, CAST(n_val AS BIGINT) AS n_val,
       CAST(tmp - n_val AS BIGINT) AS n_test FROM c8"""


# --- full curation ---------------------------------------------------------------------

def curated_base(raw: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """normalise -> length filter -> dedup -> labels."""
    return attach_labels(dedup_keep_first(length_filter(normalise(raw))), mapping)


def cap_and_split(base: DataFrame, seed: int = tx.SPLIT_SEED,
                  materialize: bool = True) -> tuple[DataFrame, DataFrame]:
    """W2 + W3 over ``base``: returns ``(rows with split, class plan)``.

    One hash-order rank serves both: the cap keeps ranks <= kept, and the split takes
    ranks <= n_train as train, the next n_val as validation, the rest as test. The
    deduplicated base feeds three branches (bucket counts, class plan, row assignment),
    so it is written once to the shared folder first (``materialize``).
    """
    if materialize:
        base = write_once(base, "curated-base")
    keyed = ranking.with_order_key(base, "doc_id", seed)
    buckets = ranking.bucket_counts(keyed, "label")
    counts = buckets.groupBy("label").agg(F.sum("_n").alias("n")) \
        .withColumn("label_id", label_id("label"))
    plan = class_plan(counts.select("label", "label_id", "n"))
    cuts = plan.select("label",
                       F.col("n_train").alias("_c1"),
                       (F.col("n_train") + F.col("n_val")).alias("_c2"),
                       F.col("kept").alias("_c3"))
    seg = ranking.segment_by_rank(keyed, buckets, cuts, "label", "doc_id", ["_c1", "_c2", "_c3"])
    split = (F.when(F.col("segment") == 0, "train").when(F.col("segment") == 1, "validation")
             .when(F.col("segment") == 2, "test"))
    rows = seg.filter(F.col("segment") < 3).withColumn("split", split).drop("segment", "_k", "_b")
    return rows, plan


def curate(raw: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Full curation: ``doc_id, text, source, label, label_id, word_count, text_hash, split``."""
    rows, _ = cap_and_split(curated_base(raw, mapping))
    return rows


def curate_sources(corpus: DataFrame) -> DataFrame:
    """Full curation of a corpus read from files in order (``sources.files.read_corpus`` with
    ``ordered``): ``text, source, label, label_id, word_count, text_hash, split``. Of equal texts the
    one that comes first in the sources stays, with its label and source. Afterwards a text is
    known by its hash, which ranks it for cap and split: where the files lie does not matter."""
    kept = dedup_keep_first(length_filter(corpus.withColumn("text", fx.strip("text"))), "source_order").drop("source_order")
    known = kept.withColumn("label_id", label_id("label")).filter(F.col("label_id").isNotNull())
    rows, _ = cap_and_split(known.withColumn("doc_id", F.col("text_hash")))
    return rows.drop("doc_id")


def split_distribution(curated: DataFrame) -> DataFrame:
    """A3: counts and % per (split, label); the share window runs on the small result."""
    g = curated.groupBy("split", "label", "label_id").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("split"))
    return g.withColumn("pct", F.round(F.col("n") * 100.0 / total, 4))


def label_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """A1 + A2: value_counts (descending, label tiebreak) with class share %."""
    g = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    return (g.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))
             .orderBy(F.col("n").desc(), F.col(label_col)))


def imbalance(class_counts: DataFrame) -> DataFrame:
    """A4 + A5: max/min ratio, flag above 4.0, cap = 4 x min."""
    return class_counts.agg(
        F.max("n").alias("max_count"), F.min("n").alias("min_count")
    ).select("max_count", "min_count",
             F.round(F.col("max_count") / F.col("min_count"), 4).alias("ratio"),
             (F.col("max_count") / F.col("min_count") > tx.IMBALANCE_FLAG).alias("needs_review"),
             (F.col("min_count") * tx.CAP_MULTIPLIER).alias("cap"))


def funnel(raw: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """``(stage_no, stage, n)`` rows before dedup, after dedup, after the length
    filter and after the cap — the reference's stage order — from one key-level
    aggregate plus the class plan."""
    norm = normalise(raw).withColumn("text_hash", fx.text_hash("text")) \
        .withColumn("word_count", fx.word_count("text"))
    per_key = norm.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies"),
                                            F.min("word_count").alias("wc"))
    stage = per_key.agg(F.sum("copies").alias("n_raw"), F.count(F.lit(1)).alias("n_dedup"),
                        F.count_if(F.col("wc").between(tx.MIN_WORDS, tx.MAX_WORDS)).alias("n_length"))
    stages = stage.selectExpr(
        "stack(3, 1, 'loaded', CAST(n_raw AS BIGINT), 2, 'dedup', CAST(n_dedup AS BIGINT), "
        "3, 'length_filter', CAST(n_length AS BIGINT)) AS (stage_no, stage, n)")
    _, plan = cap_and_split(curated_base(raw, mapping))
    capped = plan.agg(F.sum("kept").cast("bigint").alias("n")).select(
        F.lit(4).alias("stage_no"), F.lit("class_cap").alias("stage"), "n")
    return stages.unionByName(capped)
