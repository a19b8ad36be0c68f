"""ST1 / ST3 / ST4: ticket tagging and its logs as Structured Streaming jobs.

A micro-batch takes the batch functions of :mod:`tagwise.operators.route` in the order of the
webhook: signature, parse, agent skip, known account, settings, usable text, score, tag, log,
counters (stream-static joins against the account tables, scoring against a model table written
once). What it decides is staged once; the sinks (tags, log, rejects, quarantine, counters) are
written from the stage, each to a folder of the batch. A replayed batch overwrites its folders,
and a sink that fails is reported and written later from the stage (:meth:`Sinks.redrive`)
without holding up the others or the stream.

The opt-in capture (ST4) is a separate query over the log stream, so a failure of that sink never
stops tagging.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwise import taxonomy as tx
from tagwise.functions import text as fx
from tagwise.operators import asof
from tagwise.operators import naive_bayes as nb
from tagwise.operators import route as rt
from tagwise.session import materialize, scratch_path
from tagwise.streaming import common


def materialise_model(spark: SparkSession, model: nb.NaiveBayesModel) -> nb.NaiveBayesModel:
    """Write the token table once and score every micro-batch against the written copy
    (cuts the model's lineage instead of recomputing it per batch). It is joined by shuffles: a
    broadcast would send it through the driver anew in every micro-batch."""
    path = scratch_path(spark, "nb-model")
    model.token_counts.write.mode("overwrite").parquet(path)
    return nb.NaiveBayesModel(model.classes, model.log_priors, model.totals, model.vocab_size,
                              spark.read.parquet(path).hint("merge"))


LOG = ["account_id", "ticket_id", "text_hash", "intent", "confidence", "success", "ts"]
TAGS = ["conv_id", "turn", "account_id", "ticket_id", "threshold", "intent", "confidence", "below_threshold", "tag"]


def counted(log: DataFrame) -> DataFrame:
    """ST6 from the log of one batch: what it adds to each account's counters."""
    return rt.webhook_counters(log)


class Sinks:
    """The tables of a tagging stream below ``root``; readers see whole batches only."""

    #: name -> rows of the sink, from the staged decisions and rejects of a batch
    MADE = {
        "tags": lambda staged: staged.where("outcome = 'ready'").select(*TAGS),
        "log": lambda staged: staged.where("outcome = 'ready'").select(*LOG),
        "rejects": lambda staged: staged.where(F.col("outcome").isin(*rt.REJECTED))
                                        .select("conv_id", "turn", "account_id", F.col("outcome").alias("reason"), "ts"),
        "quarantine": lambda staged: staged.where("outcome = 'malformed'").select("conv_id", "turn", "account_id", "value", "ts"),
        "counters": lambda staged: counted(staged.where("outcome = 'ready'")),
    }

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str, batch_id: int | None = None) -> str:
        return f"{self.root}/{name}" if batch_id is None else f"{self.root}/{name}/batch_id={batch_id}"

    def write(self, name: str, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(self.path(name, batch_id))

    def commit(self, staged: DataFrame, batch_id: int) -> dict[str, Exception]:
        """Stage a batch, then write every sink from the stage; returns the sinks that failed."""
        self.write("staged", staged, batch_id)
        return self._sinks(batch_id, list(self.MADE))

    def _sinks(self, batch_id: int, names: list[str]) -> dict[str, Exception]:
        staged = self.spark.read.parquet(self.path("staged", batch_id))
        failed: dict[str, Exception] = {}
        for name in names:
            try:
                self.write(name, self.MADE[name](staged), batch_id)
            except Exception as error:                   # any sink's own fault; it stays due
                failed[name] = error
        return failed

    def done(self, name: str) -> set[int]:
        """Batches whose folder of this sink was finished."""
        return common.finished(self.spark, self.path(name), "batch_id")

    def due(self) -> list[tuple[int, list[str]]]:
        """Staged batches and the sinks they still lack, in order."""
        done = {name: self.done(name) for name in self.MADE}
        missing = ((b, [n for n in self.MADE if b not in done[n]]) for b in sorted(self.done("staged")))
        return [(b, names) for b, names in missing if names]

    def redrive(self) -> dict[tuple[int, str], Exception]:
        """Write what is due; returns what failed again."""
        return {(b, n): e for b, names in self.due() for n, e in self._sinks(b, names).items()}

    def read(self, name: str) -> DataFrame:
        """All rows of finished batches."""
        folders = [self.path(name, b) for b in sorted(self.done(name))]
        return self.spark.read.option("basePath", self.path(name)).parquet(*folders)

    def counters(self) -> DataFrame:
        """Totals by account: the latest snapshot and the batches after it."""
        upto = max(common.finished(self.spark, self.path("counter_snapshots"), "upto"), default=-1)
        later = [self.path("counters", b) for b in sorted(self.done("counters")) if b > upto]
        paths = ([f"{self.path('counter_snapshots')}/upto={upto}"] if upto >= 0 else []) + later
        rows = self.spark.read.parquet(*paths)
        return rows.groupBy("account_id").agg(F.sum("total_classified").alias("total_classified"),
                                              F.sum("total_errors").alias("total_errors"), F.max("last_processed_at").alias("last_processed_at"))

    def compact_counters(self) -> int:
        """Fold all batches without a gap into a snapshot, so that readers open one table and the
        batches after it; returns the last batch in it (-1 if there is none). A snapshot is a new
        folder and counts once it is finished: a job killed halfway leaves the old one in use."""
        done, last = self.done("counters"), -1
        while last + 1 in done:
            last += 1
        if last > max(common.finished(self.spark, self.path("counter_snapshots"), "upto"), default=-1):
            upto = max(common.finished(self.spark, self.path("counter_snapshots"), "upto"), default=-1)
            paths = ([f"{self.path('counter_snapshots')}/upto={upto}"] if upto >= 0 else []) + \
                [self.path("counters", b) for b in range(upto + 1, last + 1)]
            rows = self.spark.read.parquet(*paths)
            rows.groupBy("account_id").agg(F.sum("total_classified").alias("total_classified"), F.sum("total_errors").alias("total_errors"),
                                           F.max("last_processed_at").alias("last_processed_at")) \
                .write.mode("overwrite").parquet(f"{self.path('counter_snapshots')}/upto={last}")
        return last


def decided(events: DataFrame, secrets: list[str], model: nb.NaiveBayesModel, installed: DataFrame, settings: DataFrame,
            class_to_intent: dict[str, str] | None) -> DataFrame:
    """One row for each delivery: its outcome, and for those that are ready the decision. The
    parsed deliveries are written once, as scoring reads their tokens and columns apart. The account
    tables grow with the customers and are joined in every micro-batch: by shuffles, so that
    nothing of their size passes the driver."""
    triaged = rt.triage(events, secrets, installed.hint("merge"), settings.hint("merge")).withColumn("text_hash", fx.text_hash("text")).drop("signature")
    triaged = materialize(triaged, "triaged")
    done = rt.decide(triaged.where(F.col("outcome") == rt.READY), model, class_to_intent)
    rest = triaged.where(F.col("outcome") != rt.READY).select("conv_id", "turn", "account_id", "outcome", "value", "ts")
    return done.select(*TAGS, "text_hash", "success", "ts", "outcome").unionByName(rest, allowMissingColumns=True)


def start_tagging(spark: SparkSession, source: DataFrame, secrets: list[str], model: nb.NaiveBayesModel, installed: DataFrame,
                  settings: DataFrame, class_to_intent: dict[str, str] | None, root: str, checkpoint: str | None = None,
                  on_failure=None) -> Sinks:
    """Run the tagging stream to completion of the available input (availableNow), from
    ``checkpoint`` on if one is given. ``on_failure(batch_id, {sink: error})`` hears of sinks that
    failed; they are due until :meth:`Sinks.redrive`. If nobody hears of them, what is due at the
    end is written once more, and the run fails if that fails: its readers would take the
    batches that are there for all of them."""
    sinks = Sinks(spark, root)

    def handle(batch: DataFrame, batch_id: int) -> None:
        failed = sinks.commit(decided(batch, secrets, model, installed, settings, class_to_intent), batch_id)
        if failed and on_failure is not None:
            on_failure(batch_id, failed)

    common.run_available_now(source.writeStream.foreachBatch(handle), "tagging", spark, checkpoint)
    if on_failure is None and (failed := sinks.redrive()):
        raise RuntimeError(f"not written: {', '.join(f'{name} of batch {b}' for b, name in failed)}") from next(iter(failed.values()))
    return sinks


def start_capture(spark: SparkSession, calls: DataFrame, opt_in_changes: DataFrame, out_path: str) -> None:
    """ST4: low-confidence capture of opted-in callers, as its own query. Each
    micro-batch is merged with the opt-in changes of the callers it contains (a semi
    join) and the latest change is forward-filled: linear in the batch plus those
    callers' changes, with no pairing of a caller's calls and changes."""
    def transform(batch: DataFrame, batch_id: int) -> DataFrame:
        mine = opt_in_changes.join(batch.select("user_key").distinct(), "user_key", "left_semi")
        low = batch.filter(F.col("confidence") < tx.LOW_CONFIDENCE_CAPTURE) \
            .select("user_key", "ts", "ticket_id", fx.text_hash("text").alias("text_hash"), "intent", "confidence")
        at_call = asof.asof_lookup(low, mine, "user_key", "ts", ["opt_in"], event_seq="ticket_id")
        opted = at_call.filter(F.coalesce("opt_in", F.lit(False)))
        return opted.select(fx.file_key("user_key").alias("file_key"), "user_key", "ticket_id", "text_hash", "intent",
                          F.round("confidence", 4).alias("confidence"), "ts")
    common.run_available_now(calls.writeStream.foreachBatch(common.idempotent_writer(out_path, transform)),
                             "capture", spark)
