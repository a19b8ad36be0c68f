"""Audit queries: leakage on RAWSPLIT and on the curated split, diversity, lengths, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwise import taxonomy as tx
from tagwise.functions import text as fx
from tagwise.operators import audit as au
from tagwise.operators import curate as cu
from tagwise.operators import ranking
from tagwise.plans.curation import SQL_BASE, curated
from tagwise.plans.registry import query
from tagwise.session import materialize, shared_table
from tagwise.sources import tables as tb

LANG = tx.LANG_LABEL_MAP


def rawsplit(spark, d):
    """RAWSPLIT as keys: one pass over the un-deduplicated documents writes ``doc_id, label`` (mapped
    lang), the 16-byte keys ``exact`` of the stripped text, ``respaced`` and ``folded`` of the text
    whose spaces are doubled in every seventh document, and a preview; the split then moves no
    texts. Written once for an application and input."""
    def keys():
        norm = cu.normalise(tb.raw_corpus(spark, d))
        text = F.when(F.col("doc_id") % 7 == 0, F.regexp_replace("text", " ", "  ")).otherwise(F.col("text"))
        spaced = norm.withColumn("spaced", text).withColumn("fold", fx.fold("spaced"))
        narrow = spaced.select("doc_id", cu.map_label("raw_label", LANG).alias("label"), F.unhex(F.md5("text")).alias("exact"),
                               F.unhex(F.md5("spaced")).alias("respaced"), F.unhex(F.md5("fold")).alias("folded"),
                               F.substring("fold", 1, tx.PREVIEW_CHARS).alias("preview"))
        return au.raw_split(materialize(narrow, "rawsplit-keys"))
    return shared_table(spark, "rawsplit", d, keys)


SQL_RAWSPLIT = f"""norm AS (
  SELECT doc_id, {fx.sql_strip('text')} AS text, source, {cu.sql_map_label('lang', LANG)} AS label
  FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY label
                 ORDER BY {ranking.sql_hash_order_key('doc_id', tx.SPLIT_SEED)}, doc_id) AS r,
              count(*) OVER (PARTITION BY label) AS cn FROM norm),
rs AS (SELECT doc_id, text, source, label,
              CASE WHEN r / cn <= 0.8 THEN 'train' WHEN r / cn <= 0.9 THEN 'validation'
                   ELSE 'test' END AS split FROM rk)"""


def _sql_overlap(src: str, key: str) -> str:
    return f"""k AS (SELECT {key} AS h, bit_or(CASE split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 4 END) AS m
       FROM {src} GROUP BY h),
p AS (SELECT 'train' AS split_a, 'validation' AS split_b, CAST(count(*) FILTER (WHERE m & 3 = 3) AS BIGINT) AS shared FROM k
      UNION ALL SELECT 'train', 'test', CAST(count(*) FILTER (WHERE m & 5 = 5) AS BIGINT) FROM k
      UNION ALL SELECT 'validation', 'test', CAST(count(*) FILTER (WHERE m & 6 = 6) AS BIGINT) FROM k)
SELECT split_a, split_b, shared, CASE WHEN shared = 0 THEN 'CLEAN' ELSE 'LEAKAGE DETECTED' END AS verdict FROM p"""


@query("rawsplit_leakage", covers="J9 U2",
       sql=f"WITH {SQL_RAWSPLIT},\n{_sql_overlap('rs', 'md5(text)')}")
def rawsplit_leakage(spark, d):
    return au.split_overlap(rawsplit(spark, d), F.col("exact"))


@query("curated_split_leakage", covers="U2 J9",
       sql=f"WITH {SQL_BASE},\n{_sql_overlap('curated', 'md5(text)')}")
def curated_split_leakage(spark, d):
    return au.split_overlap(curated(spark, d), F.unhex(F.md5("text")))


@query("test_rows_in_train", covers="J10",
       sql=f"""WITH {SQL_RAWSPLIT},
k AS (SELECT md5(text) AS h, bit_or(CASE split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 4 END) AS m,
             count(*) FILTER (WHERE split = 'test') AS t FROM rs GROUP BY h)
SELECT CAST(sum(CASE WHEN m & 1 = 1 THEN t ELSE 0 END) AS BIGINT) AS test_rows_in_train,
       CAST(sum(t) AS BIGINT) AS test_rows,
       CASE WHEN sum(CASE WHEN m & 1 = 1 THEN t ELSE 0 END) = 0 THEN 'CLEAN — no leakage'
            ELSE 'LEAKAGE DETECTED' END AS verdict FROM k""")
def test_rows_in_train_q(spark, d):
    return au.test_rows_in_train(rawsplit(spark, d), F.col("exact"))


SQL_RESPACED = f"""{SQL_RAWSPLIT},
rs2 AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN replace(text, ' ', '  ') ELSE text END AS text,
               split FROM rs WHERE split IN ('train', 'test'))"""


@query("near_exact_leakage", covers="J11 F3",
       sql=f"""WITH {SQL_RESPACED},
e AS (SELECT md5(text) AS h, bit_or(CASE split WHEN 'train' THEN 1 ELSE 4 END) AS m FROM rs2 GROUP BY h),
f AS (SELECT md5({fx.sql_fold('text')}) AS h, bit_or(CASE split WHEN 'train' THEN 1 ELSE 4 END) AS m FROM rs2 GROUP BY h)
SELECT (SELECT CAST(count(*) FILTER (WHERE m = 5) AS BIGINT) FROM e) AS exact_shared,
       (SELECT CAST(count(*) FILTER (WHERE m = 5) AS BIGINT) FROM f) AS folded_shared""")
def near_exact_leakage(spark, d):
    return au.near_exact(rawsplit(spark, d), F.col("respaced"), F.col("folded"))


@query("near_exact_examples", covers="J11 T5",
       sql=f"""WITH {SQL_RESPACED},
f AS (SELECT md5({fx.sql_fold('text')}) AS h, substr({fx.sql_fold('text')}, 1, {tx.PREVIEW_CHARS}) AS pv, split FROM rs2),
k AS (SELECT h FROM f GROUP BY h HAVING bit_or(CASE split WHEN 'train' THEN 1 ELSE 4 END) = 5 ORDER BY h LIMIT 3)
SELECT h AS folded_hash, min(pv) AS preview FROM f WHERE h IN (SELECT h FROM k) GROUP BY h""")
def near_exact_examples_q(spark, d):
    return au.near_exact_examples(rawsplit(spark, d), F.col("folded"), F.col("preview"))


@query("unique_text_ratio", covers="A9 S4",
       sql="""WITH per AS (SELECT source, md5(text) AS h, count(*) AS c FROM documents
                    WHERE text IS NOT NULL GROUP BY source, h)
SELECT source, count(*) AS unique_texts, CAST(sum(c) AS BIGINT) AS total_texts,
       round(count(*) / sum(c), 4) AS unique_ratio FROM per GROUP BY source""")
def unique_text_ratio(spark, d):
    return au.unique_ratio(tb.table(spark, d, "documents"))


@query("word_count_stats", covers="A10 F4",
       sql=f"""WITH w AS (SELECT source, {fx.sql_word_count('text')} AS wc FROM documents WHERE text IS NOT NULL)
SELECT source, round(avg(wc), 4) AS wc_mean, round(quantile_cont(wc, 0.5), 4) AS wc_p50,
       round(quantile_cont(wc, 0.95), 4) AS wc_p95, max(wc) AS wc_max FROM w GROUP BY source""")
def word_count_stats_q(spark, d):
    return au.word_count_stats(tb.table(spark, d, "documents"))


@query("token_length_stats", covers="A11 T5 M3",
       sql=f"""WITH {SQL_BASE},
h AS (SELECT * FROM curated WHERE split = 'train'),
l AS (SELECT len(list_filter(regexp_split_to_array(text, '{fx.WS}+'), lambda x: x <> '')) AS n FROM h),
q AS (SELECT quantile_cont(n, [0.5, 0.95, 0.99]) AS p, max(n) AS mx, count(*) AS c FROM l)
SELECT CAST(trunc(p[1]) AS INTEGER) AS p50, CAST(trunc(p[2]) AS INTEGER) AS p95,
       CAST(trunc(p[3]) AS INTEGER) AS p99, CAST(mx AS INTEGER) AS max_len, c AS n_texts,
       CASE WHEN CAST(trunc(p[2]) AS INTEGER) <= 128 THEN 128 ELSE 256 END AS recommended_max_length FROM q""")
def token_length_stats_q(spark, d):
    return au.token_length_stats(curated(spark, d).filter(F.col("split") == "train"))


@query("test_sample_inspection", covers="W4 F7",
       sql=f"""WITH {SQL_BASE},
t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY
        {ranking.sql_hash_order_key('doc_id', tx.SPLIT_SEED)}, doc_id) AS sample_rank
      FROM curated WHERE split = 'test')
SELECT label, doc_id, CAST(sample_rank AS INTEGER) AS sample_rank, substr(text, 1, 90) AS preview
FROM t WHERE sample_rank <= 3""")
def test_sample_inspection(spark, d):
    return au.sample_per_label(curated(spark, d).filter(F.col("split") == "test"), 3)


SQL_SOURCE_LABELS = f"""sl AS (SELECT doc_id, source, text, {cu.sql_map_label('lang', LANG)} AS label
       FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
g AS (SELECT source, label, count(*) AS n FROM sl GROUP BY source, label),
t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, label) AS rank FROM g)"""


def _source_labels(spark, d):
    return (tb.raw_corpus(spark, d).na.drop(subset=["text", "raw_label"])
            .withColumn("label", cu.map_label("raw_label", LANG)))


@query("top_labels_per_source", covers="T2 A8",
       sql=f"WITH {SQL_SOURCE_LABELS}\nSELECT source, label, n, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 3")
def top_labels_per_source(spark, d):
    return au.top_labels(_source_labels(spark, d), 3)


@query("top_label_samples", covers="W5 T2 F7",
       sql=f"""WITH {SQL_SOURCE_LABELS},
r AS (SELECT sl.*, row_number() OVER (PARTITION BY sl.source ORDER BY
        {ranking.sql_hash_order_key('sl.doc_id', tx.SPLIT_SEED)}, sl.doc_id) AS sample_rank
      FROM sl JOIN t ON sl.source = t.source AND sl.label = t.label AND t.rank = 1)
SELECT source, label, doc_id, CAST(sample_rank AS INTEGER) AS sample_rank,
       substr(text, 1, {tx.PREVIEW_CHARS}) AS preview
FROM r WHERE sample_rank <= 4""")
def top_label_samples(spark, d):
    return au.top_label_samples(_source_labels(spark, d), 4)
