"""Spark ML training (no SQL oracle: iterative training is not SQL-expressible; metrics are
re-derived relationally) and the nearest-centroid scorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwise.operators import curate as cu
from tagwise.operators import evaluate as ev
from tagwise.operators import ml
from tagwise.plans.curation import curated
from tagwise.plans.registry import query
from tagwise.sources import tables as tb


def _fit(spark, d):
    # Iterative training re-reads its input many times: cut the curation lineage once
    # with a reliable checkpoint in the shared checkpoint folder.
    cur = curated(spark, d).select("doc_id", "text", "label_id", "split").checkpoint(eager=True)
    model, summary = ml.train_select(cur.filter(F.col("split") == "train"),
                                     cur.filter(F.col("split") == "validation"))
    return cur, model, summary


@query("mllib_training_summary", covers="M1 M4 P18")
def mllib_training_summary(spark, d):
    _, _, summary = _fit(spark, d)
    return summary


@query("mllib_test_report", covers="M1 M2 A15 A14")
def mllib_test_report(spark, d):
    cur, model, _ = _fit(spark, d)
    pred = ml.predict(model, cur.filter(F.col("split") == "test"), "doc_id")
    pred = pred.select("doc_id", cu.id_to_label("label_id").alias("y_true"),
                       cu.id_to_label("pred_label_id").alias("y_pred"), "confidence")
    return ev.class_report(pred)


@query("external_scorer", covers="UDF3",
       sql="""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
c AS (SELECT label, dim, avg(x) AS m FROM x GROUP BY label, dim),
d AS (SELECT x.vec_id, x.label AS true_label, c.label, sum((x.x - c.m) * (x.x - c.m)) AS d2
      FROM x JOIN c USING (dim) GROUP BY ALL)
SELECT vec_id, true_label, label AS pred_label, round(d2, 4) AS distance2
FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, label) = 1""")
def external_scorer(spark, d):
    """Every embedding scored by the centroids of the labels of all of them."""
    emb = tb.table(spark, d, "embeddings")
    scored = ml.nearest_centroid(emb, ml.centroids(emb, "embedding", "label"), "embedding", "label")
    return scored.select("vec_id", F.col("label").alias("true_label"), "pred_label", F.round("distance2", 4).alias("distance2"))
