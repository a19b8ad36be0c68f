"""Multinomial naive Bayes text scorer as relational jobs.

Fit:   tokens of training docs -> (class, token) counts (partial aggregate) ->
       one row per token with a class->count map (a group has <= #classes rows).
Score: each document's tokens are counted in its own row (sorted array, run lengths) ->
       rows (id, token, tf) without any other column -> join on the token -> sum of
       tf * log-probability per document and class -> joined back to the document ->
       softmax and argmax in array expressions. No Python on the row path.

The token join carries three narrow columns; AQE broadcasts the token table if it turns out
small and splits the partitions of hot tokens otherwise.

The per-class statistics (count, tokens, prior) are collected to the driver: one row per
class, bounded by the taxonomy, never by data size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwise import taxonomy as tx
from tagwise.functions import text as fx
from tagwise.session import materialize as write_once


@dataclass
class NaiveBayesModel:
    classes: list[str]            # sorted class names
    log_priors: list[float]
    totals: list[int]             # training tokens per class
    vocab_size: int
    token_counts: DataFrame       # token string, counts map<string, bigint>


def tokens(text_col: str = "text") -> F.Column:
    """Letter tokens of the whole text."""
    return fx.letter_tokens(text_col)


def fit(train: DataFrame, label_col: str = "label", tokens_col: str = "tokens") -> NaiveBayesModel:
    """``train``: one row per document with a label and its token array.

    The model table — ``(class, token, n)`` token counts plus one ``(class, null, docs)``
    row per class — is computed in one pass and written once to the shared folder (the
    model artifact); the driver statistics and the scoring join both read it, so the
    training corpus is scanned and tokenised once."""
    return from_table(write_once(model_table(train, label_col, tokens_col), "nb-model"))


def model_table(train: DataFrame, label_col: str = "label", tokens_col: str = "tokens") -> DataFrame:
    """``(class, token, n)`` token counts and one ``(class, null, documents)`` row per class."""
    per = (train.select(F.col(label_col).alias("_c"), F.explode(tokens_col).alias("token"))
                .groupBy("_c", "token").agg(F.count(F.lit(1)).alias("n")))
    docs = train.groupBy(F.col(label_col).alias("_c")).agg(F.count(F.lit(1)).alias("n")) \
        .select("_c", F.lit(None).cast("string").alias("token"), "n")
    return per.unionByName(docs)


def from_table(table: DataFrame) -> NaiveBayesModel:
    """The model of a written :func:`model_table`."""
    counts = table.filter(F.col("token").isNotNull())
    token_counts = counts.groupBy("token").agg(
        F.map_from_entries(F.collect_list(F.struct("_c", "n"))).alias("counts"))
    # One driver round trip for the bounded statistics (<= 2 x #classes + 1 rows).
    stats_rows = (table.groupBy("_c").agg(
        F.sum(F.when(F.col("token").isNull(), F.col("n"))).alias("docs"),
        F.sum(F.when(F.col("token").isNotNull(), F.col("n"))).alias("toks"))
        .unionByName(counts.agg(F.lit(None).cast("string").alias("_c"),
                                F.lit(None).cast("bigint").alias("docs"),
                                F.count_distinct("token").cast("bigint").alias("toks"))))
    stats: dict[str, list[int]] = {}
    vocab = 0
    for r in stats_rows.collect():
        if r["_c"] is None:
            vocab = r["toks"]
        else:
            stats[r["_c"]] = [r["docs"] or 0, r["toks"] or 0]
    classes = sorted(stats)
    n_docs = sum(v[0] for v in stats.values())
    return NaiveBayesModel(classes, [math.log(stats[c][0] / n_docs) for c in classes],
                           [int(stats[c][1]) for c in classes], int(vocab), token_counts)


def token_frequencies(tokens: F.Column) -> F.Column:
    """``array<struct<token, tf>>`` of a token array: sorted, then the lengths of equal runs."""
    def runs(s: F.Column) -> F.Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return F.get(F.transform(F.array(starts), lambda at: F.transform(at, lambda i, j: F.struct(
            F.get(s, i).alias("token"), (F.coalesce(F.get(at, j + 1), F.size(s)) - i).alias("tf")))), F.lit(0))
    return F.get(F.transform(F.array(F.array_sort(tokens)), runs), F.lit(0))


def score(model: NaiveBayesModel, docs: DataFrame, id_col: str, tokens_col: str = "tokens",
          keep: list[str] | None = None) -> DataFrame:
    """Add ``scores`` (array of (label, prob) sorted by class), ``pred``, ``confidence``
    (rounded to 4 dp) for each row of ``docs`` keyed by the unique ``id_col``. Equal scores go
    to the smaller label id."""
    keep = keep or []
    rows = docs.select(F.col(id_col).alias("_id"), F.explode(token_frequencies(F.col(tokens_col))).alias("t")) \
        .select("_id", "t.token", "t.tf")
    joined = rows.join(model.token_counts, "token", "left")
    # Contribution of one token to each class with add-one smoothing over the training
    # vocabulary: a token unseen in a class (or in training at all) counts 0.
    parts = []
    for c, tot in zip(model.classes, model.totals):
        lp = F.log((F.coalesce(F.col("counts")[c], F.lit(0)) + 1) / F.lit(float(tot + model.vocab_size)))
        parts.append(F.sum(F.col("tf") * lp).alias(f"_s{len(parts)}"))
    sums = joined.groupBy("_id").agg(*parts)
    per_doc = docs.select(id_col, *keep).join(sums, F.col(id_col) == F.col("_id"), "left")
    s = F.array(*[F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) + F.lit(p) for i, p in enumerate(model.log_priors)])
    cls = F.array(*[F.lit(c) for c in model.classes])
    order = F.array(*[F.lit(-tx.LABEL_ID.get(c, len(tx.LABEL_ID) + i)) for i, c in enumerate(model.classes)])
    out = (per_doc.withColumn("_ls", s)
           .withColumn("_mx", F.array_max("_ls"))
           .withColumn("_e", F.transform("_ls", lambda x: F.exp(x - F.col("_mx"))))
           .withColumn("_z", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
           .withColumn("_best", F.array_max(F.arrays_zip(F.col("_ls").alias("s"), order.alias("o"), cls.alias("label"))))
           .withColumn("pred", F.col("_best.label"))
           .withColumn("_p", F.transform("_e", lambda x: x / F.col("_z")))
           .withColumn("confidence", F.round(F.array_max("_p"), 4))
           .withColumn("scores", F.arrays_zip(cls.alias("label"),
                                              F.transform("_p", lambda x: F.round(x, 4)).alias("score"))))
    return out.drop("_id", "_ls", "_mx", "_e", "_z", "_best", "_p", *[f"_s{i}" for i in range(len(model.classes))])


def apply_threshold(df: DataFrame, threshold, pred_col: str = "intent_raw") -> DataFrame:
    """P5: below = confidence < threshold (strict, on the rounded value); the intent
    becomes OTHER when below while confidence and scores are kept."""
    thr = threshold if isinstance(threshold, F.Column) else F.lit(float(threshold))
    return (df.withColumn("below_threshold", F.col("confidence") < thr)
              .withColumn("intent", F.when(F.col("below_threshold"), F.lit(tx.DEFAULT_LABEL))
                          .otherwise(F.col(pred_col))))


def sql_label_order(label: str) -> str:
    """The label's id in the taxonomy, by which ties are broken."""
    return f"(CASE {label} " + " ".join(f"WHEN '{x}' THEN {i}" for x, i in tx.LABEL_ID.items()) + f" ELSE {len(tx.LABEL_ID)} END), {label}"


def sql_scores(docs_sql: str, id_col: str = "doc_id") -> str:
    """DuckDB twin. ``docs_sql`` must define CTEs ``train(label, toks)`` and
    ``test(<id_col>, toks, ...)``; the result CTE ``best`` has ``<id_col>, pred,
    confidence`` and ``probs`` has ``<id_col>, label, p``."""
    return f"""{docs_sql},
tt AS (SELECT label, unnest(toks) AS token FROM train),
cnt AS (SELECT label, token, count(*) AS n FROM tt GROUP BY label, token),
v AS (SELECT count(DISTINCT token) AS vs FROM cnt),
cls AS (SELECT label, count(*) AS nd FROM train GROUP BY label),
cls2 AS (SELECT c.label, ln(c.nd / sum(c.nd) OVER ()) AS prior,
                (SELECT sum(n) FROM cnt WHERE cnt.label = c.label) AS tot FROM cls c),
te AS (SELECT {id_col}, unnest(toks) AS token FROM test),
sc AS (SELECT te.{id_col}, c.label, sum(ln((coalesce(cnt.n, 0) + 1) / (c.tot + v.vs))) AS ls
       FROM te CROSS JOIN cls2 c CROSS JOIN v
       LEFT JOIN cnt ON cnt.label = c.label AND cnt.token = te.token
       GROUP BY te.{id_col}, c.label),
allsc AS (SELECT t.{id_col}, c.label, c.prior + coalesce(sc.ls, 0) AS s
          FROM test t CROSS JOIN cls2 c
          LEFT JOIN sc ON sc.{id_col} = t.{id_col} AND sc.label = c.label),
sm AS (SELECT *, exp(s - max(s) OVER (PARTITION BY {id_col})) AS e FROM allsc),
probs AS (SELECT {id_col}, label, s, e / sum(e) OVER (PARTITION BY {id_col}) AS p FROM sm),
best AS (SELECT {id_col}, label AS pred, round(p, 4) AS confidence FROM (
           SELECT *, row_number() OVER (PARTITION BY {id_col} ORDER BY s DESC, {sql_label_order('label')}) AS rn
           FROM probs) WHERE rn = 1)"""
