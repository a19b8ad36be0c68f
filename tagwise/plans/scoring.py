"""Scoring and evaluation queries over the NB3 fixture: naive Bayes on the letter tokens
of whole texts, fitted on the train split of the curated corpus and scored on its test
split (the reference's fit-on-train / report-on-test protocol); classes are the intents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwise import taxonomy as tx
from tagwise.functions import text as fx
from tagwise.operators import curate as cu
from tagwise.operators import evaluate as ev
from tagwise.operators import naive_bayes as nb
from tagwise.plans.curation import SQL_BASE, curated
from tagwise.plans.registry import query
from tagwise.session import materialize as write_once
from tagwise.session import shared_table
from tagwise.sources import tables as tb


def given_label(doc_id, label, label_id):
    """The label that the scored fixture gives a document: every fourth one carries one of the
    eight other labels instead of its own, so a model of the texts is wrong about some."""
    labels = F.array(*[F.lit(x) for x in tx.LABELS])
    turned = (label_id + 1 + F.floor(doc_id / 4) % 8) % len(tx.LABELS)
    return F.when(doc_id % 4 == 0, F.get(labels, turned.cast("int"))).otherwise(label)


SQL_GIVEN_LABEL = ("CASE WHEN doc_id % 4 = 0 THEN [" + ", ".join(f"'{x}'" for x in tx.LABELS)
                   + f"][1 + ((label_id + 1 + (doc_id // 4) % 8) % {len(tx.LABELS)})::INTEGER] ELSE label END")


def nb_docs(spark, d):
    """The curated corpus, tokenised: written once for an application and input."""
    return shared_table(spark, "nb-docs", d, lambda: curated(spark, d).select(
        "doc_id", given_label(F.col("doc_id"), F.col("label"), F.col("label_id")).alias("label"), "split",
        nb.tokens("text").alias("tokens")))


def nb_model(spark, d):
    return nb.from_table(shared_table(spark, "nb-model", d, lambda: nb.model_table(
        nb_docs(spark, d).filter(F.col("split") == "train"))))


def nb_scored(spark, d):
    return nb.score(nb_model(spark, d), nb_docs(spark, d).filter(F.col("split") == "test"), "doc_id", keep=["label"])


def predictions(spark, d):
    """``doc_id, y_true, y_pred`` (intents), confidence, P5 threshold 0.70."""
    s = nb_scored(spark, d)
    p = s.select("doc_id", F.col("label").alias("y_true"), F.col("pred").alias("intent_raw"), "confidence")
    return (nb.apply_threshold(p, tx.DEFAULT_CONFIDENCE_THRESHOLD)
            .withColumn("y_pred", F.col("intent_raw"))
            .withColumn("correct", F.col("y_true") == F.col("y_pred")))


SQL_NB_TRAIN = f"""{SQL_BASE},
docs AS (SELECT doc_id, {SQL_GIVEN_LABEL} AS label, split, {fx.sql_letter_tokens('text')} AS toks FROM curated),
train AS (SELECT label, toks FROM docs WHERE split = 'train')"""

SQL_NB_DOCS = f"""{SQL_NB_TRAIN},
test AS (SELECT doc_id, label AS true_label, toks FROM docs WHERE split = 'test')"""

SQL_PRED = f"""{nb.sql_scores(SQL_NB_DOCS)},
pred AS (SELECT b.doc_id, t.true_label AS y_true, b.pred AS y_pred, b.confidence,
                b.confidence < {tx.DEFAULT_CONFIDENCE_THRESHOLD}::DOUBLE AS below_threshold
         FROM best b JOIN test t ON t.doc_id = b.doc_id)"""


@query("nb_predictions", covers="M2 T1 P5 F9 J12",
       sql=f"""WITH {SQL_PRED}
SELECT doc_id, y_true, y_pred, confidence, below_threshold,
       CASE WHEN below_threshold THEN 'OTHER' ELSE y_pred END AS intent FROM pred""")
def nb_predictions(spark, d):
    return predictions(spark, d).select("doc_id", "y_true", "y_pred", "confidence", "below_threshold", "intent")


SQL_ALL = nb.sql_scores(f"""{SQL_NB_TRAIN},
test AS (SELECT doc_id, split, toks FROM docs)""")


@query("nb_corpus_scores", covers="M2 F9",
       sql=f"""WITH {SQL_ALL}
SELECT b.doc_id, t.split, b.pred, b.confidence FROM best b JOIN test t ON t.doc_id = b.doc_id""")
def nb_corpus_scores(spark, d):
    """The model over the whole curated corpus, every split."""
    return nb.score(nb_model(spark, d), nb_docs(spark, d), "doc_id", keep=["split"]) \
        .select("doc_id", "split", "pred", "confidence")


@query("nb_ranked_scores", covers="T3 F16 F9",
       sql=f"""WITH {nb.sql_scores(SQL_NB_DOCS)}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(p, 4) DESC, label) AS INTEGER) AS rank,
       label, round(p, 4) AS score FROM probs""")
def nb_ranked_scores(spark, d):
    return ev.ranked_scores(nb_scored(spark, d), "doc_id")


@query("nb_accuracy", covers="A13 P5",
       sql=f"""WITH {SQL_PRED}
SELECT count(*) AS n, round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 4) AS accuracy,
       min(confidence) AS min_confidence,
       count(*) FILTER (WHERE confidence < 0.70::DOUBLE) AS below_070,
       count(*) FILTER (WHERE confidence < 0.75::DOUBLE) AS below_075 FROM pred""")
def nb_accuracy(spark, d):
    p = predictions(spark, d)
    return p.agg(F.count(F.lit(1)).alias("n"),
                 F.round(F.avg(F.col("correct").cast("double")), 4).alias("accuracy"),
                 F.min("confidence").alias("min_confidence"),
                 F.count_if(F.col("confidence") < 0.70).alias("below_070"),
                 F.count_if(F.col("confidence") < tx.LOW_CONFIDENCE_CAPTURE).alias("below_075"))


SQL_GRID = tx.sql_values([(a, i, b, j) for i, a in enumerate(tx.LABELS) for j, b in enumerate(tx.LABELS)],
                         ["y_true", "true_id", "y_pred", "pred_id"])


@query("confusion_matrix", covers="A14 J12",
       sql=f"""WITH {SQL_PRED},
pairs AS (SELECT y_true, y_pred, count(*) AS n FROM pred GROUP BY y_true, y_pred),
lab AS (SELECT y_true AS label FROM pairs UNION SELECT y_pred FROM pairs),
grid AS (SELECT * FROM {SQL_GRID})
SELECT g.y_true, CAST(g.true_id AS INTEGER) AS true_id, g.y_pred, CAST(g.pred_id AS INTEGER) AS pred_id,
       CAST(coalesce(p.n, 0) AS BIGINT) AS n
FROM grid g LEFT JOIN pairs p ON p.y_true = g.y_true AND p.y_pred = g.y_pred
WHERE g.y_true IN (SELECT label FROM lab) AND g.y_pred IN (SELECT label FROM lab)""")
def confusion_matrix_q(spark, d):
    return ev.confusion_matrix(spark, predictions(spark, d))


SQL_REPORT = f"""{SQL_PRED},
pairs AS (SELECT y_true, y_pred, count(*) AS n FROM pred GROUP BY y_true, y_pred),
agg AS (SELECT label, CAST(sum(sup) AS BIGINT) AS support, CAST(sum(prd) AS BIGINT) AS predicted,
               CAST(sum(tp) AS BIGINT) AS tp FROM (
          SELECT y_true AS label, n AS sup, 0 AS prd, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp FROM pairs
          UNION ALL SELECT y_pred, 0, n, 0 FROM pairs) GROUP BY label),
rep AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS p,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r,
               CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0.0 END AS f FROM agg)"""


@query("class_report", covers="A15 P17",
       sql=f"""WITH {SQL_REPORT}
SELECT label, {cu.sql_label_id('label')} AS label_id, support, predicted, tp,
       round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1,
       CASE WHEN f >= {tx.F1_OK} THEN 'OK' ELSE '!!' END AS flag FROM rep""")
def class_report_q(spark, d):
    return ev.class_report(predictions(spark, d))


@query("eval_summary", covers="A13 A16 A17 P18",
       sql=f"""WITH {SQL_REPORT}
SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 4) AS accuracy,
       round(avg(p), 4) AS precision_macro, round(avg(r), 4) AS recall_macro, round(avg(f), 4) AS f1_macro,
       round(sum(p * support) / sum(support), 4) AS precision_weighted,
       round(sum(r * support) / sum(support), 4) AS recall_weighted,
       round(sum(f * support) / sum(support), 4) AS f1_weighted,
       (SELECT label FROM rep ORDER BY f, label LIMIT 1) AS worst_label,
       round(min(f), 4) AS worst_f1,
       sum(f * support) / sum(support) >= {tx.RELEASE_GATE_F1} AS release_gate_passed FROM rep""")
def eval_summary(spark, d):
    return ev.summary(predictions(spark, d))


SQL_THRESHOLDS = tx.sql_values([(t,) for t in tx.SWEEP_THRESHOLDS], ["threshold"])


@query("threshold_sweep", covers="A28",
       sql=f"""WITH {SQL_PRED},
th AS (SELECT CAST(threshold AS DOUBLE) AS threshold FROM {SQL_THRESHOLDS}),
n AS (SELECT count(*) AS n FROM pred)
SELECT th.threshold, CAST(count(p.doc_id) AS BIGINT) AS tagged, round(count(p.doc_id) / max(n.n), 4) AS coverage,
       round(CASE WHEN count(p.doc_id) > 0 THEN count(p.doc_id) FILTER (WHERE p.y_true = p.y_pred) / count(p.doc_id)
             ELSE 0.0 END, 4) AS precision
FROM th CROSS JOIN n LEFT JOIN pred p ON p.confidence >= th.threshold GROUP BY th.threshold""")
def threshold_sweep_q(spark, d):
    return ev.threshold_sweep(predictions(spark, d))


SQL_LATENCY = """lat AS (SELECT quantile_cont(value, [0.5, 0.95, 0.99]) AS q, avg(value) AS m,
                count(value) AS n_calls FROM events),
latr AS (SELECT n_calls, round(q[1], 4) AS p50_ms, round(q[2], 4) AS p95_ms, round(q[3], 4) AS p99_ms,
                round(m, 4) AS mean_ms, round(q[2] / 1000 * (1.10 / 3600) * 1000, 4) AS cost_per_1k_calls_usd
         FROM lat)"""


@query("latency_report", covers="A18 A19",
       sql=f"WITH {SQL_LATENCY}\nSELECT * FROM latr")
def latency_report_q(spark, d):
    return ev.latency_report(tb.classification_log(spark, d))


def _measured_row(spark, d):
    s = ev.summary(predictions(spark, d)).selectExpr(
        "stack(2, 'accuracy', accuracy, 'f1_weighted', f1_weighted) AS (metric, value)")
    lat = ev.latency_report(tb.classification_log(spark, d)).selectExpr(
        "stack(2, 'p95', p95_ms, 'cost', cost_per_1k_calls_usd) AS (metric, value)")
    long = s.unionByName(lat)
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    return long.agg(F.lit("tagwise_naive_bayes").alias("model"), pick("cost").alias("cost_per_1k_calls_usd"),
                    pick("p95").alias("p95_latency_ms"), pick("accuracy").alias("accuracy"),
                    pick("f1_weighted").alias("f1_weighted"))


SQL_BASELINES = tx.sql_values(tx.BASELINE_MODELS, ["model", "cost_per_1k_calls_usd", "cost_note", "p95_latency_ms",
                                                   "accuracy", "f1_weighted"])


@query("model_comparison", covers="A20 A19",
       sql=f"""WITH {SQL_REPORT}, {SQL_LATENCY},
meas AS (SELECT round(sum(f * support) / sum(support), 4) AS f1w, round(sum(tp) / sum(support), 4) AS acc FROM rep)
SELECT 'tagwise_naive_bayes' AS model, latr.cost_per_1k_calls_usd, CAST(NULL AS VARCHAR) AS cost_note,
       latr.p95_ms AS p95_latency_ms, meas.acc AS accuracy, meas.f1w AS f1_weighted FROM meas, latr
UNION ALL
SELECT model, CAST(cost_per_1k_calls_usd AS DOUBLE), cost_note, CAST(p95_latency_ms AS DOUBLE),
       CAST(accuracy AS DOUBLE), CAST(f1_weighted AS DOUBLE) FROM {SQL_BASELINES}""")
def model_comparison_q(spark, d):
    return ev.model_comparison(spark, _measured_row(spark, d))


@query("final_results", covers="M5 A13 A16 A18 A19",
       sql=f"""WITH {SQL_REPORT}, {SQL_LATENCY},
s AS (SELECT round(sum(tp) / sum(support), 4) AS accuracy, round(sum(f * support) / sum(support), 4) AS f1_weighted,
             round(avg(f), 4) AS f1_macro FROM rep)
SELECT 'test_accuracy' AS metric, accuracy AS value FROM s UNION ALL SELECT 'f1_weighted', f1_weighted FROM s
UNION ALL SELECT 'f1_macro', f1_macro FROM s UNION ALL SELECT 'p50_ms', p50_ms FROM latr
UNION ALL SELECT 'p95_ms', p95_ms FROM latr UNION ALL SELECT 'p99_ms', p99_ms FROM latr
UNION ALL SELECT 'mean_ms', mean_ms FROM latr UNION ALL SELECT 'cost_per_1k_calls_usd', cost_per_1k_calls_usd FROM latr
UNION ALL SELECT 'f1_' || label, round(f, 4) FROM rep""")
def final_results_q(spark, d):
    pred = write_once(predictions(spark, d).select("y_true", "y_pred"), "predictions")
    return ev.final_results(ev.summary(pred), ev.latency_report(tb.classification_log(spark, d)), ev.class_report(pred))


@query("release_targets", covers="P18",
       sql=f"""WITH {SQL_REPORT}, {SQL_LATENCY},
m AS (SELECT 'accuracy' AS metric, round(sum(tp) / sum(support), 4) AS value FROM rep
      UNION ALL SELECT 'f1_weighted', round(sum(f * support) / sum(support), 4) FROM rep
      UNION ALL SELECT 'worst_f1', round(min(f), 4) FROM rep
      UNION ALL SELECT 'p95_ms', p95_ms FROM latr)
SELECT metric, value, CAST(target AS DOUBLE) AS target,
       CASE WHEN at_most THEN value <= target ELSE value >= target END AS passed
FROM m JOIN {tx.sql_values(tx.RELEASE_TARGETS, ['metric', 'target', 'at_most'])} USING (metric)""")
def release_targets_q(spark, d):
    return ev.release_targets(spark, ev.summary(predictions(spark, d)), ev.latency_report(tb.classification_log(spark, d)))
