"""Source and sink round trips: each query writes driver-table data in a source/sink
format to the shared scratch folder, reads it back through the library's readers and
reports what arrived. The oracle computes the same report from the original tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwise import taxonomy as tx
from tagwise.functions import text as fx
from tagwise.operators import curate as cu
from tagwise.plans import routing
from tagwise.plans.curation import SQL_BASE, curated
from tagwise.plans.registry import query
from tagwise.session import scratch_path
from tagwise.sources import files as fl
from tagwise.sources import tables as tb

DOC_CSV_SCHEMA = "doc_id bigint, text string, lang string"
RAW_CSV_SCHEMA = "Instruction string, Intent string"


@query("csv_roundtrip", covers="S1 S10",
       sql="SELECT doc_id, md5(text) AS text_md5, lang FROM documents")
def csv_roundtrip(spark, d):
    path = scratch_path(spark, "documents-csv")
    fl.write_csv(tb.table(spark, d, "documents").select("doc_id", "text", "lang"), path)
    back = fl.read_csv(spark, path, DOC_CSV_SCHEMA)
    return back.select("doc_id", F.md5("text").alias("text_md5"), "lang")


@query("multi_source_ingest", covers="S3 S4 S5 S6 S2 P2 A8 U1",
       sql="""WITH r AS (SELECT 'bitext_' || (CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 4)::VARCHAR AS source, lang AS label
           FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND doc_id % 11 <> 0),
g AS (SELECT source, label, count(*) AS n FROM r GROUP BY source, label)
SELECT source, label, n, CAST(sum(n) OVER (PARTITION BY source) AS BIGINT) AS total_rows,
       count(*) OVER (PARTITION BY source) AS num_labels FROM g""")
def multi_source_ingest(spark, d):
    folder = _raw_sources(spark, d)
    src = fl.read_sources(spark, folder, RAW_CSV_SCHEMA).na.drop(subset=["text", "label"])
    from pyspark.sql import Window
    g = src.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source")
    return g.withColumn("total_rows", F.sum("n").over(w)).withColumn("num_labels", F.count(F.lit(1)).over(w))


def _raw_sources(spark, d) -> str:
    """``documents`` as source files in a new folder, rows in descending order of ``doc_id``. Four
    layouts: reference names, canonical names, no known name (first and last column), and a
    CSV whose header is in the other order; and a CSV that its Parquet namesake shadows."""
    folder = scratch_path(spark, "raw-sources")
    docs = tb.table(spark, d, "documents").select(
        "doc_id", F.col("text").alias("Instruction"),
        F.when(F.col("doc_id") % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("lang")).alias("Intent"),
        (F.regexp_extract("source", r"([0-9]+)$", 1).cast("int") % 4).alias("stem"))

    def layout(stem, *names):
        return docs.filter(F.col("stem") == stem).orderBy(F.desc("doc_id")).select(*[F.col(old).alias(new) for old, new in names])

    layout(0, ("Instruction", "Instruction"), ("Intent", "Intent")).write.parquet(f"{folder}/bitext_0.parquet")
    layout(1, ("Intent", "label"), ("Instruction", "text")).write.parquet(f"{folder}/bitext_1.parquet")
    layout(2, ("Instruction", "utterance"), ("stem", "batch"), ("Intent", "category")).write.parquet(f"{folder}/bitext_2.parquet")
    fl.write_csv(layout(3, ("Intent", "Intent"), ("Instruction", "Instruction")), f"{folder}/bitext_3.csv")
    fl.write_csv(layout(0, ("Instruction", "Instruction"), ("Intent", "Intent")), f"{folder}/bitext_0.csv")
    return folder


_SQL_FILES = SQL_BASE[SQL_BASE.index("lf AS"):].replace("b.doc_id", "b.text_hash").replace("ORDER BY doc_id", "ORDER BY rk, pos") \
    .replace(cu.sql_map_label("raw_label", tx.LANG_LABEL_MAP), "mapped").replace("r.doc_id, ", "")


@query("file_curated_corpus", covers="S3 S4 S5 S6 W1 U1 J1 A5 W2 W3",
       sql=f"""WITH norm AS (
  SELECT {fx.sql_strip('text')} AS text, 'bitext_' || stem::VARCHAR AS source, stem AS rk, -doc_id AS pos,
         {cu.sql_map_label('lang', tx.LANG_LABEL_MAP)} AS mapped
  FROM (SELECT *, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 4 AS stem FROM documents)
  WHERE text IS NOT NULL AND lang IS NOT NULL AND doc_id % 11 <> 0
  UNION ALL SELECT {fx.sql_strip('text')}, 'synthetic_claude', 9, doc_id, 'OTHER' FROM documents WHERE doc_id % 5 = 0 AND text IS NOT NULL),
{_SQL_FILES}
SELECT source, label, label_id, word_count, text_hash, split FROM curated""")
def file_curated_corpus(spark, d):
    """Files of four layouts and a synthetic table that repeats texts, curated in source order."""
    folder = _raw_sources(spark, d)
    made = tb.table(spark, d, "documents").where("doc_id % 5 = 0 AND text IS NOT NULL").orderBy("doc_id") \
        .select(F.concat("text", F.lit(" ")).alias("text"), F.lit("OTHER").alias("label"), F.lit("synthetic_claude").alias("source"))
    made.write.parquet(f"{folder}/synthetic.parquet")
    corpus = fl.read_corpus(spark, folder, RAW_CSV_SCHEMA, lambda c: cu.map_label(c, tx.LANG_LABEL_MAP), f"{folder}/synthetic.parquet", ordered=True)
    return cu.curate_sources(corpus).select("source", "label", "label_id", "word_count", "text_hash", "split")


@query("taxonomy_config_scan", covers="S7 J1 J2",
       sql=f"""SELECT event_type, {cu.sql_map_label('event_type', {**tx.SOURCE_LABEL_MAP, **tx.EVENT_LABEL_MAP})}
       AS canonical_label,
       {cu.sql_label_id(cu.sql_map_label('event_type', {**tx.SOURCE_LABEL_MAP, **tx.EVENT_LABEL_MAP}))} AS label_id,
       count(*) AS n FROM events GROUP BY event_type""")
def taxonomy_config_scan(spark, d):
    path = scratch_path(spark, "label-config")
    fl.write_json_config(spark, path, {
        "labels": tx.LABELS, "label_to_id": tx.LABEL_ID,
        "id_to_label": {str(i): lab for i, lab in enumerate(tx.LABELS)},
        "source_to_canonical": {**tx.SOURCE_LABEL_MAP, **tx.EVENT_LABEL_MAP}})
    cfg = fl.read_json_config(spark, path)
    dim = cfg.select(F.explode("source_to_canonical").alias("source_key", "canonical_label"))
    ids = cfg.select(F.explode("label_to_id").alias("canonical_label", "label_id"))
    dim = dim.join(ids, "canonical_label", "left")
    ev = tb.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    # The config dimension is bounded by the taxonomy file (77 + a few entries).
    out = ev.withColumn("source_key", fx.label_key("event_type")).join(F.broadcast(dim), "source_key", "left")
    return out.select("event_type", F.coalesce("canonical_label", F.lit(tx.DEFAULT_LABEL)).alias("canonical_label"),
                      F.coalesce("label_id", F.lit(tx.LABEL_ID[tx.DEFAULT_LABEL])).cast("int").alias("label_id"), "n")


@query("split_sink_roundtrip", covers="S8 S9",
       sql=f"""WITH {SQL_BASE}
SELECT split, label, label_id, count(*) AS n FROM curated GROUP BY split, label, label_id""")
def split_sink_roundtrip(spark, d):
    path = scratch_path(spark, "final-dataset")
    fl.write_partitioned(curated(spark, d).select("doc_id", "text", "label", "label_id", "split"), path, "split")
    back = spark.read.parquet(path)
    return back.groupBy("split", "label", "label_id").agg(F.count(F.lit(1)).alias("n"))


@query("test_csv_export", covers="S10 F2",
       sql=f"""WITH {SQL_BASE}
SELECT label, label_id, count(*) AS n, count(DISTINCT md5(text)) AS distinct_texts
FROM curated WHERE split = 'test' GROUP BY label, label_id""")
def test_csv_export(spark, d):
    path = scratch_path(spark, "test-set-csv")
    test = curated(spark, d).filter(F.col("split") == "test")
    fl.write_csv(test.select("text", "label_id", cu.id_to_label("label_id").alias("label")), path)
    back = fl.read_csv(spark, path, "text string, label_id int, label string")
    return back.groupBy("label", "label_id").agg(F.count(F.lit(1)).alias("n"),
                                                 F.count_distinct(F.md5("text")).alias("distinct_texts"))


@query("stats_json_sink", covers="S11 A8",
       sql="""WITH g AS (SELECT source, lang AS label, count(*) AS n FROM documents
                  WHERE text IS NOT NULL AND lang IS NOT NULL GROUP BY source, lang)
SELECT source, label, n, CAST(sum(n) OVER (PARTITION BY source) AS BIGINT) AS total_rows,
       count(*) OVER (PARTITION BY source) AS num_labels FROM g""")
def stats_json_sink(spark, d):
    path = scratch_path(spark, "ingest-stats")
    docs = tb.table(spark, d, "documents").na.drop(subset=["text", "lang"])
    per = docs.groupBy("source", F.col("lang").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    stats = per.groupBy("source").agg(
        F.sum("n").alias("total_rows"), F.count(F.lit(1)).alias("num_labels"),
        F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("label_distribution"))
    stats.write.mode("overwrite").json(path)
    back = spark.read.schema("source string, total_rows bigint, num_labels bigint, "
                             "label_distribution map<string,bigint>").json(path)
    return back.select("source", "total_rows", "num_labels",
                       F.explode("label_distribution").alias("label", "n"))


@query("classification_log_append", covers="S12",
       sql=f"""WITH log AS ({tb.SQL_CLASSIFICATION_LOG})
SELECT account_id, count(*) AS n, count(*) FILTER (WHERE NOT success) AS errors FROM log GROUP BY account_id""")
def classification_log_append(spark, d):
    path = scratch_path(spark, "classifications-jsonl")
    log = tb.classification_log(spark, d).select("ts", "account_id", "ticket_id", "intent", "confidence", "success")
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp")
    fl.append_jsonl(log.filter(F.col("ts") < cut), path)
    fl.append_jsonl(log.filter(F.col("ts") >= cut), path)
    back = spark.read.schema("ts timestamp, account_id bigint, ticket_id bigint, intent string, "
                             "confidence double, success boolean").json(path)
    return back.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"),
                                          F.count_if(~F.col("success")).alias("errors"))


@query("capture_log_partitioned", covers="S13 U4",
       sql=f"""WITH {routing.SQL_CAPTURED}, {routing.SQL_REQUESTS}
SELECT file_key, count(*) AS n FROM cap WHERE file_key NOT IN (SELECT file_key FROM req) GROUP BY file_key""")
def capture_log_partitioned(spark, d):
    path = scratch_path(spark, "optin-logs")
    from tagwise.operators import privacy as pv
    pv.write_capture_log(routing.captured(spark, d), path)
    pv.erase_from_log(spark, path, routing._erasure_requests(spark, d))
    back = spark.read.parquet(path)
    return back.groupBy("file_key").agg(F.count(F.lit(1)).alias("n"))
