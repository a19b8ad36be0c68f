"""From raw documents to token files, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all but
the last return the columns of ``documents``. :func:`run` writes every stage's result as
Parquet in the shared folder and hands the reread table on.

Null and repeated rows: a null or letterless text is rejected by the first stage. Rows that
repeat an id (or, without an id, a text) are one document to the second stage, which keeps one
of them. Later stages see each document once; the mix may repeat it on purpose. An empty table
stays empty. Columns beyond those of ``documents`` are handed on as they are.

Stages follow each other on the same executors, and what one of them has touched stays with
the JVM and the Python workers. So every stage bounds what goes to Python at once by bytes.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagwise.llm import decontam, langid, minhash, mixing, token_files
from tagwise.llm.common import in_residue, table, written
from tagwise.llm.queries import tokenizer_path
from tagwise.session import bound_batches

#: Least share of the largest possible out-of-place distance that a text must stay below its
#: nearest language's profile to count as written in it.
LEAST_SCORE = 0.1

#: Documents are near copies if 100 * intersection >= 80 * union of their word 5-grams.
SIMILARITY = (80, 100)


def _bounded(stage):
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)
    return run


def _key() -> Column:
    """The document's id, or a hash of its text if it has none."""
    return F.coalesce(F.col("doc_id"), F.xxhash64(F.col("text")))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less those whose key is in ``gone(key)``."""
    return _keyed_without(docs, gone).select(*docs.columns)


def _keyed_without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.withColumn("_key", _key()).join(gone.select(F.col("key").alias("_key")), "_key", "left_anti")


@_bounded
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that resemble one of the languages learned from three quarters of
    the labelled ones; texts without a letter, or unlike every profile, go. Row-local."""
    profiles = langid.train(docs.where(~in_residue("doc_id", 4, 2)))
    found = langid.predicted(profiles, F.col("text"))
    names = docs.columns
    return docs.withColumn("_found", found) \
        .where((F.col("_found.lang") != langid.UNKNOWN) & (F.col("_found.score") >= LEAST_SCORE)).select(*names)


@_bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each component of near-duplicates. One shuffle
    of the texts serves both who goes and who is left once."""
    found = minhash.near_duplicates(docs.select(_key().alias("doc_id"), "text"), least=SIMILARITY)
    left = _keyed_without(docs, found.where(~F.col("kept")).select(F.col("doc_id").alias("key")).distinct())
    names = docs.columns
    once = Window.partitionBy("_key").orderBy("_order")
    return left.withColumn("_order", F.xxhash64(*[F.col(c) for c in names])) \
        .withColumn("_n", F.row_number().over(once)).where("_n = 1").select(*names)


@_bounded
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the documents that hold a passage of a benchmark item."""
    index = decontam.build_index(docs.select(_key().alias("doc_id"), "text"))
    hits = decontam.phrase_matches(index, table(spark, sf_dir, "benchmark"))
    # written, so that its size is known before the texts are dealt out for it
    return _without(docs, written(hits.select(F.col("doc_id").alias("key")).distinct(), "contaminated"))


@_bounded
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the sources' words meet their targets."""
    return mixing.mix(docs)


@_bounded
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left: ``doc_id, start, n_tokens, ids_crc32`` of each document."""
    return token_files.token_table(spark, docs, tokenizer_path(), keep_encoder=False, added_tokens=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("mix", mix), ("tokens", tokens)]

#: Profiles, hashed draws and token ids are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
