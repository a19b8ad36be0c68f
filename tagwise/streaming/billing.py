"""ST9: billing lifecycle stream, incremental per micro-batch.

The plan of an account depends on events of *other* keys (a checkout for one account
decides which account a later customer-keyed event resolves to), so keyed state per
customer or per account alone cannot express it. The job keeps two account-sized
tables as versioned state in the shared folder instead of re-reading the event history:

* ``holders``: each account's latest checkout ``(customer, ts, seq)``;
* ``state``: the plan state per account (W6).

Events count in the order of their times, whenever they arrive. A micro-batch none of whose
events is older than what was seen is resolved against the previous holders (as synthetic
checkouts) plus its own checkouts with the batch operator (as-of lookup, J8), and its plan
changes are merged into the previous state: O(batch + accounts). A batch with late events can
change which account earlier events resolved to. It reaches the accounts that ever held a
customer of its events, or of its checkouts' accounts; those accounts' states are computed anew
from their own part of the event log (:func:`recomputed`), all others stay.

Versions are written as ``version=<batch_id>`` with overwrite, and the batch's events as
``batch_id=<batch_id>`` of the log, so a replayed micro-batch rebuilds its own version from the
previous one (exactly-once with the checkpointed offsets).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwise.operators import billing as bl
from tagwise.session import materialize
from tagwise.streaming import common

HOLDERS_SCHEMA = "account_id bigint, customer string, ts timestamp, seq bigint"
STATE_SCHEMA = ("account_id bigint, plan string, stripe_customer_id string, last_event_ts timestamp, "
                "n_changes bigint")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _version(spark: SparkSession, root: str, v: int, schema: str) -> DataFrame:
    path = f"{root}/version={v}"
    if v < 0 or not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _with_holders(batch: DataFrame, holders: DataFrame) -> DataFrame:
    """The events of ``batch`` and each holder's latest checkout."""
    synthetic = holders.select(
        F.col("seq").alias("event_seq"), "ts", F.lit(bl.CHECKOUT).alias("type"),
        F.col("account_id").cast("string").alias("client_reference_id"), "customer",
        F.lit(None).cast("bigint").alias("attempt_count"))
    return batch.select(*synthetic.columns).unionByName(synthetic)


def latest_holders(batch: DataFrame, holders: DataFrame) -> DataFrame:
    """The holders after the events of ``batch``, late ones included."""
    return (bl.checkouts(_with_holders(batch, holders)).groupBy("account_id")
            .agg(F.max_by(F.struct("customer", "ts", "seq"), F.struct("ts", "seq")).alias("h"))
            .select("account_id", "h.customer", "h.ts", "h.seq"))


def apply_batch(batch: DataFrame, holders: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(new holders, new state)`` after the billing events of ``batch``, none of them late."""
    events = _with_holders(batch, holders)
    acts = bl.plan_actions(events).join(holders.select("account_id", "seq"), ["account_id", "seq"], "left_anti")
    new = bl.state_from_actions(acts)
    p, n = state.alias("p"), new.alias("n")
    merged = p.join(n, "account_id", "full").select(
        "account_id",
        F.coalesce("n.plan", "p.plan").alias("plan"),
        F.coalesce("n.stripe_customer_id", "p.stripe_customer_id").alias("stripe_customer_id"),
        F.greatest("n.last_event_ts", "p.last_event_ts").alias("last_event_ts"),
        (F.coalesce("n.n_changes", F.lit(0)) + F.coalesce("p.n_changes", F.lit(0))).cast("bigint").alias("n_changes"))
    return latest_holders(batch, holders), merged


EVENTS_SCHEMA = "event_seq bigint, ts timestamp, type string, client_reference_id string, customer string, attempt_count bigint"


def recomputed(batch: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(state rows, accounts)`` of every account that the events of ``batch`` can touch, from
    ``log``, which holds all events so far, those of ``batch`` included.

    A checkout moves its account from one customer to another, so what earlier and later events
    of both customers resolve to may change, for every account that ever held either. Those
    accounts' own states depend on the customers they ever held, and whom these resolve to on
    all of their holders' checkouts: nothing else of the log is read into the computation. Where
    most accounts are touched there is little else, and the log is taken as it is: to join and
    write nearly all of it first costs more than the rest of it.
    """
    held = materialize(bl.checkouts(log).select("account_id", "customer").distinct(), "billing-held")
    moved = bl.checkouts(batch).select("account_id").distinct()
    named = batch.where("customer IS NOT NULL").select("customer")
    customers = named.unionByName(held.join(moved, "account_id", "left_semi").select("customer")).distinct()
    accounts = materialize(held.join(customers, "customer", "left_semi").select("account_id").unionByName(moved).distinct(), "billing-touched")
    if _most(accounts, held):
        return bl.state_from_actions(bl.plan_actions(log).join(accounts, "account_id", "left_semi")), accounts
    their = held.join(accounts, "account_id", "left_semi").select("customer").distinct()
    holders = held.join(their, "customer", "left_semi").select("account_id").distinct()
    account = F.col("client_reference_id").try_cast("bigint")
    is_checkout = F.col("type") == bl.CHECKOUT
    part = log.where(is_checkout).withColumn("account_id", account).join(holders, "account_id", "left_semi").drop("account_id") \
        .unionByName(log.where(~is_checkout).join(their, "customer", "left_semi").select(*log.columns))
    acts = bl.plan_actions(materialize(part.select(*log.columns), "billing-part")).join(accounts, "account_id", "left_semi")
    return bl.state_from_actions(acts), accounts


def _most(accounts: DataFrame, held: DataFrame) -> bool:
    """Whether ``accounts`` are more than those of ``held`` that are not among them."""
    others = held.join(accounts, "account_id", "left_anti").select("account_id").distinct()
    return others.count() < accounts.count()


def start_billing(spark: SparkSession, events_stream: DataFrame, holders_path: str, state_path: str,
                  checkpoint: str | None = None) -> None:
    log_path, high_path = f"{state_path}-events", f"{state_path}-high"
    names = [f.split(" ")[0] for f in EVENTS_SCHEMA.split(", ")]

    def handle(batch: DataFrame, batch_id: int) -> None:
        path = f"{log_path}/batch_id={batch_id}"
        batch.select(*names).write.mode("overwrite").parquet(path)
        batch = spark.read.schema(EVENTS_SCHEMA).parquet(path)
        before = _version(spark, high_path, batch_id - 1, "ts timestamp, seq bigint").first()
        order = F.struct("ts", F.col("event_seq").alias("seq"))
        low, high = batch.agg(F.min(order), F.max(order)).first()
        holders, state = (_version(spark, p, batch_id - 1, schema) for p, schema in ((holders_path, HOLDERS_SCHEMA), (state_path, STATE_SCHEMA)))
        if before is not None and low is not None and tuple(low) < tuple(before):
            done = sorted(b for b in common.finished(spark, log_path, "batch_id") if b <= batch_id)
            log = spark.read.schema(EVENTS_SCHEMA).parquet(*[f"{log_path}/batch_id={b}" for b in done])
            rows, accounts = recomputed(batch, log)
            new_holders = latest_holders(batch, holders)
            new_state = state.join(accounts, "account_id", "left_anti").unionByName(rows)
        else:
            new_holders, new_state = apply_batch(batch, holders, state)
        new_holders.write.mode("overwrite").parquet(f"{holders_path}/version={batch_id}")
        new_state.write.mode("overwrite").parquet(f"{state_path}/version={batch_id}")
        seen = [tuple(x) for x in (before, high) if x is not None]
        spark.createDataFrame([max(seen)] if seen else [], "ts timestamp, seq bigint").coalesce(1) \
            .write.mode("overwrite").parquet(f"{high_path}/version={batch_id}")

    common.run_available_now(events_stream.writeStream.foreachBatch(handle), "billing", spark, checkpoint)


def read_state(spark: SparkSession, state_path: str) -> DataFrame:
    """The newest state version (found by listing the version folders)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(state_path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = [int(st.getPath().getName().split("=", 1)[1]) for st in fs.listStatus(p)
                if st.isDirectory() and st.getPath().getName().startswith("version=")]
    return _version(spark, state_path, max(versions) if versions else -1, STATE_SCHEMA)
