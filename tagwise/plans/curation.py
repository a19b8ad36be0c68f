"""Curation queries over ``documents`` (lang plays the source label)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwise import taxonomy as tx
from tagwise.functions import text as fx
from tagwise.operators import curate as cu
from tagwise.operators import ranking
from tagwise.plans.registry import query
from tagwise.sources import tables as tb

LANG = tx.LANG_LABEL_MAP

# --- shared SQL fragments ------------------------------------------------------------

SQL_NORM = f"""norm AS (
  SELECT doc_id, {fx.sql_strip('text')} AS text, lang AS raw_label, source
  FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL)"""

SQL_BASE = f"""{SQL_NORM},
lf AS (SELECT *, {fx.sql_word_count('text')} AS word_count FROM norm),
lf2 AS (SELECT * FROM lf WHERE word_count BETWEEN {tx.MIN_WORDS} AND {tx.MAX_WORDS}),
dd0 AS (SELECT *, {fx.sql_text_hash('text')} AS text_hash FROM lf2),
dd AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY doc_id) AS rn FROM dd0) WHERE rn = 1),
lab0 AS (SELECT *, {cu.sql_map_label('raw_label', LANG)} AS label FROM dd),
base AS (SELECT *, {cu.sql_label_id('label')} AS label_id FROM lab0
         WHERE {cu.sql_label_id('label')} IS NOT NULL),
class_counts AS (SELECT label, label_id, count(*) AS n FROM base GROUP BY label, label_id),
plan AS ({cu.SQL_CLASS_PLAN.format(mult=tx.CAP_MULTIPLIER)}),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.label
                 ORDER BY {ranking.sql_hash_order_key('b.doc_id', tx.SPLIT_SEED)}, b.doc_id) AS r
           FROM base b),
curated AS (
  SELECT r.doc_id, r.text, r.source, r.label, r.label_id, r.word_count, r.text_hash,
         CASE WHEN r.r <= p.n_train THEN 'train'
              WHEN r.r <= p.n_train + p.n_val THEN 'validation' ELSE 'test' END AS split
  FROM ranked r JOIN plan p ON r.label = p.label WHERE r.r <= p.kept)"""


def curated(spark, d):
    return cu.curate(tb.raw_corpus(spark, d), LANG)


# --- queries ------------------------------------------------------------------------------

@query("curated_corpus", covers="P1 P2 F1 F2 F4 P3 W1 J1 J2 P4 A5 W2 W3 S9",
       sql=f"""WITH {SQL_BASE}
SELECT doc_id, source, label, label_id, word_count, text_hash, split FROM curated""")
def curated_corpus(spark, d):
    return curated(spark, d).select("doc_id", "source", "label", "label_id", "word_count",
                                    "text_hash", "split")


@query("split_label_distribution", covers="A3 A2",
       sql=f"""WITH {SQL_BASE},
g AS (SELECT split, label, label_id, count(*) AS n FROM curated GROUP BY split, label, label_id)
SELECT split, label, label_id, n, round(n * 100.0 / sum(n) OVER (PARTITION BY split), 4) AS pct FROM g""")
def split_label_distribution(spark, d):
    return cu.split_distribution(curated(spark, d))


@query("class_plan", covers="A5 W2 W3 A1",
       sql=f"""WITH {SQL_BASE}
SELECT label, label_id, n, cap, kept, n_train, n_val, n_test FROM plan""")
def class_plan_q(spark, d):
    base = cu.curated_base(tb.raw_corpus(spark, d), LANG)
    _, plan = cu.cap_and_split(base)
    return plan.select("label", "label_id", "n", "cap", "kept", "n_train", "n_val", "n_test")


@query("dedup_keep_first", covers="W1 F1 F2",
       sql=f"""WITH {SQL_NORM},
h AS (SELECT *, {fx.sql_text_hash('text')} AS text_hash FROM norm)
SELECT doc_id, source, raw_label, text_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY doc_id) AS rn FROM h) WHERE rn = 1""")
def dedup_q(spark, d):
    return cu.dedup_keep_first(cu.normalise(tb.raw_corpus(spark, d))) \
        .select("doc_id", "source", "raw_label", "text_hash")


@query("word_count_filter", covers="P3 F4",
       sql=f"""WITH {SQL_NORM}
SELECT doc_id, word_count FROM (SELECT doc_id, {fx.sql_word_count('text')} AS word_count FROM norm)
WHERE word_count BETWEEN {tx.MIN_WORDS} AND {tx.MAX_WORDS}""")
def word_count_q(spark, d):
    return cu.length_filter(cu.normalise(tb.raw_corpus(spark, d))).select("doc_id", "word_count")


@query("imbalance_report", covers="A4 A5",
       sql=f"""WITH {SQL_BASE}
SELECT max(n) AS max_count, min(n) AS min_count, round(max(n) / min(n), 4) AS ratio,
       (max(n) / min(n) > {tx.IMBALANCE_FLAG}) AS needs_review, min(n) * {tx.CAP_MULTIPLIER} AS cap
FROM class_counts""")
def imbalance_q(spark, d):
    base = cu.curated_base(tb.raw_corpus(spark, d), LANG)
    counts = base.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return cu.imbalance(counts)


@query("curation_funnel", covers="A12",
       sql=f"""WITH {SQL_BASE},
keys AS (SELECT {fx.sql_text_hash('text')} AS h, count(*) AS copies, min({fx.sql_word_count('text')}) AS wc
         FROM norm GROUP BY h)
SELECT 1 AS stage_no, 'loaded' AS stage, CAST(sum(copies) AS BIGINT) AS n FROM keys
UNION ALL SELECT 2, 'dedup', CAST(count(*) AS BIGINT) FROM keys
UNION ALL SELECT 3, 'length_filter', CAST(count(*) FILTER (WHERE wc BETWEEN {tx.MIN_WORDS} AND {tx.MAX_WORDS}) AS BIGINT) FROM keys
UNION ALL SELECT 4, 'class_cap', CAST(sum(kept) AS BIGINT) FROM plan""")
def funnel_q(spark, d):
    return cu.funnel(tb.raw_corpus(spark, d), LANG)


@query("curated_class_counts", covers="A1 A2 T4",
       sql=f"""WITH {SQL_BASE},
g AS (SELECT label, count(*) AS n FROM curated GROUP BY label)
SELECT label, n, round(n * 100.0 / sum(n) OVER (), 4) AS pct FROM g""")
def curated_class_counts(spark, d):
    return cu.label_counts(curated(spark, d))
