"""Billing lifecycle: plan state per account from an ordered event log.

Rules (per event, in (ts, seq) order):
* ``checkout.session.completed`` with account and customer -> account on ``pro`` and
  its billing customer becomes ``customer`` (a later checkout replaces it);
* ``customer.subscription.created`` -> the account holding ``customer`` -> ``pro``;
* ``customer.subscription.deleted`` -> that account -> ``free`` (customer kept);
* ``invoice.payment_failed`` with ``attempt_count`` (missing = 1) >= 3 -> ``free``;
* anything else is ignored; a customer no account holds is ignored.

"The account holding a customer" is evaluated at the event's time: only checkouts
change the customer mapping, so the smallest holder is a step function of each customer's
hold toggles and the mapping is one as-of lookup (J8); the whole history is computed in
batch without replaying events one by one.
Several accounts holding the same customer resolve to the smallest account id (the
reference scans files in undefined order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwise import taxonomy as tx
from tagwise.operators import asof, ordered
from tagwise.session import materialize

CHECKOUT = "checkout.session.completed"
SUB_CREATED = "customer.subscription.created"
SUB_DELETED = "customer.subscription.deleted"
PAYMENT_FAILED = "invoice.payment_failed"


def checkouts(events: DataFrame) -> DataFrame:
    """Checkouts with both an account and a customer; a malformed account id counts as
    missing (``try_cast``: one bad event must not fail the job)."""
    acct = F.col("client_reference_id").try_cast("bigint")
    return (events.filter((F.col("type") == CHECKOUT) & acct.isNotNull() & F.col("customer").isNotNull())
                  .select(acct.alias("account_id"), "customer", "ts", F.col("event_seq").alias("seq")))


def customer_intervals(events: DataFrame) -> DataFrame:
    """Per account, the customer id it holds and for how long (validity intervals)."""
    return asof.validity_intervals(checkouts(events), "account_id")


#: Customers that more accounts ever held are looked up in the step function.
FEW_HOLDERS = 4
#: A block of positions is 2 ** BLOCK_BITS toggles of a customer.
BLOCK_BITS = 10


def _pieces(first: str, end: str) -> F.Column:
    """The aligned pieces ``struct<level, index>`` (2 ** level positions from
    index * 2 ** level on) that make up the positions ``first <= p < end``; at most two a level."""
    def of_level(k):
        size = F.pow(F.lit(2), k).cast("long")
        lo, hi = F.floor((F.col(first) + size - 1) / size).cast("long"), F.floor(F.col(end) / size).cast("long")
        left = F.when((lo < hi) & (lo % 2 == 1), F.struct(k.alias("level"), lo.alias("index")))
        right = F.when((lo < hi) & (hi % 2 == 1), F.struct(k.alias("level"), (hi - 1).alias("index")))
        return F.filter(F.array(left, right), lambda x: x.isNotNull())

    levels = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.col(end), F.lit(2)))).cast("int"))
    return F.flatten(F.transform(levels, of_level))


def _parts_of(level, index, down_to) -> F.Column:
    """The positions (or blocks, for ``down_to`` = BLOCK_BITS) that a piece is made of."""
    times = F.pow(F.lit(2), level - down_to).cast("long")
    return F.sequence(index * times, (index + 1) * times - 1)


def holder_steps(events: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """J7 over time, of all customers or of those in ``customers(customer)``: ``customer, ts, seq, account_id``, the smallest account that holds the
    customer from (ts, seq) on until the customer's next row, null if none.

    A hold runs from an account's checkout to its next one. The starts and ends of a
    customer's holds are numbered in order; a hold is cut into aligned pieces of positions,
    the least account of a piece is an aggregate, and pieces are handed down to blocks of
    1,024 positions and on to positions, by aggregation again. Rows: toggles x (at most two
    pieces a level, then one row a position and level of a block), however many accounts
    hold a customer at once; no step groups or joins by the customer alone, so one with a
    third of all checkouts spreads over all tasks."""
    holds = ordered.next_in_key(checkouts(events), "account_id", ["ts", "seq"], ["ts", "seq"], prefix="to_")
    hold = F.struct("account_id", "ts", "seq", "to_ts", "to_seq")
    toggles = holds.select("customer", "ts", "seq", F.lit(1).alias("starts"), hold.alias("hold")).unionByName(
        holds.where(F.col("to_seq").isNotNull()).select(
            "customer", F.col("to_ts").alias("ts"), F.col("to_seq").alias("seq"), F.lit(0).alias("starts"), hold.alias("hold")))
    if customers is not None:
        toggles = toggles.join(customers, "customer", "left_semi")
    placed = materialize(ordered.rank_in_key(toggles, "customer", ["ts", "seq", "starts"], "pos", dtype="long"), "hold-toggles")
    spans = placed.groupBy("customer", "hold").agg(
        F.max(F.when(F.col("starts") == 1, F.col("pos"))).alias("first"), F.max(F.when(F.col("starts") == 0, F.col("pos"))).alias("end"))
    # a hold that has not ended lasts to the customer's last toggle; the number of these is
    # joined by (customer, block), one row a block
    block = F.floor(F.col("first") / 2 ** BLOCK_BITS).cast("long")
    last = placed.groupBy("customer").agg(F.max("pos").alias("last")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / 2 ** BLOCK_BITS).cast("long"))))
    open_ = spans.where(F.col("end").isNull()).withColumn("block", block).join(last, ["customer", "block"]) \
        .select("customer", "hold", "first", (F.col("last") + 1).alias("end"))
    pieces = spans.where(F.col("end").isNotNull()).unionByName(open_) \
        .select("customer", F.col("hold.account_id").alias("account_id"), F.explode(_pieces("first", "end")).alias("piece")) \
        .groupBy("customer", "piece").agg(F.min("account_id").alias("account_id")) \
        .select("customer", F.col("piece.level").alias("level"), F.col("piece.index").alias("index"), "account_id")
    bits = F.lit(BLOCK_BITS)
    blocks = pieces.where(F.col("level") >= bits) \
        .select("customer", "account_id", F.explode(_parts_of(F.col("level"), F.col("index"), bits)).alias("index")) \
        .groupBy("customer", "index").agg(F.min("account_id").alias("account_id")) \
        .select("customer", bits.alias("level"), "index", "account_id")
    held = pieces.where(F.col("level") < bits).unionByName(blocks) \
        .select("customer", F.explode(_parts_of(F.col("level"), F.col("index"), F.lit(0))).alias("pos"), "account_id")
    steps = placed.select("customer", "pos", "ts", "seq").unionByName(held, allowMissingColumns=True) \
        .groupBy("customer", "pos").agg(F.min("account_id").alias("account_id"), F.max("ts").alias("ts"), F.max("seq").alias("seq")) \
        .where(F.col("seq").isNotNull())                       # a block's end past the last toggle
    return steps.groupBy("customer", "ts", "seq").agg(F.max_by("account_id", "pos").alias("account_id"))


def resolve_accounts(events: DataFrame, held_only: bool = False) -> DataFrame:
    """Lookup events (created / deleted / failed >= 3) with the account holding the
    event's customer at the event's time (null when none; the smallest when several). An
    event that occurs twice counts once.

    Customers that at most FEW_HOLDERS accounts ever held: a lookup is fanned out to these
    accounts and the customer of each one's latest checkout is forward-filled. Customers
    with more: one as-of lookup in :func:`holder_steps`. So a lookup makes at most
    FEW_HOLDERS rows, and the work follows lookups and toggles, however many accounts hold
    a customer; the steps cost about three times the fan-out where there is one holder.

    With ``held_only`` lookups that no account holds are left out, most of them before the
    rows are sorted: an account cannot hold a customer before its first checkout of it."""
    lookups = events.filter(
        F.col("type").isin(SUB_CREATED, SUB_DELETED) |
        ((F.col("type") == PAYMENT_FAILED) &
         (F.coalesce("attempt_count", F.lit(1)) >= tx.FAILED_PAYMENT_DOWNGRADE_ATTEMPTS))
    ).select("event_seq", "ts", "type", "customer")
    held_by = checkouts(events).select("customer", "account_id").distinct()
    crowded = materialize(held_by.groupBy("customer").agg(F.count(F.lit(1)).alias("n"))
                          .where(F.col("n") > FEW_HOLDERS).select("customer"), "crowded-customers")
    if crowded.isEmpty():
        return _by_fan_out(events, lookups, held_only=held_only)
    by_steps = asof.asof_lookup(lookups.join(crowded, "customer", "left_semi").select(*lookups.columns).distinct(),
                                holder_steps(events, crowded), "customer", "ts", ["account_id"], event_seq="event_seq")
    few = lookups.join(crowded, "customer", "left_anti").select(*lookups.columns)
    if held_only:
        by_steps = by_steps.where(F.col("account_id").isNotNull())
    return _by_fan_out(events, few, crowded, held_only).unionByName(by_steps)


def _by_fan_out(events: DataFrame, lookups: DataFrame, crowded: DataFrame | None = None, held_only: bool = False) -> DataFrame:
    """Lookups of customers outside ``crowded``, by lookups x accounts that ever held them."""
    co = checkouts(events)
    holders = co.groupBy("customer", "account_id").agg(F.min(F.struct("ts", F.col("seq").alias("event_seq"))).alias("_first"))
    if crowded is not None:
        holders = holders.join(crowded, "customer", "left_anti")
    if held_only:
        fanned = lookups.join(holders, "customer").where(F.struct("ts", "event_seq") >= F.col("_first")).drop("_first")
    else:
        fanned = lookups.join(holders.drop("_first"), "customer", "left")
    latest = co.select("account_id", "ts", "seq", F.col("customer").alias("held_customer"))
    at = asof.asof_lookup(fanned, latest, "account_id", "ts", ["held_customer"], event_seq="event_seq")
    holds = F.coalesce(F.col("held_customer") == F.col("customer"), F.lit(False))
    if held_only:
        at = at.where(holds)
    return at.groupBy("event_seq", "ts", "type", "customer").agg(
        F.min(F.when(holds, F.col("account_id"))).alias("account_id"))


def plan_actions(events: DataFrame) -> DataFrame:
    """Every plan change ``(account_id, ts, seq, plan, customer)``."""
    up = checkouts(events).select("account_id", "ts", "seq", F.lit("pro").alias("plan"), "customer")
    found = resolve_accounts(events, held_only=True).select(
        "account_id", "ts", F.col("event_seq").alias("seq"),
        F.when(F.col("type") == SUB_CREATED, "pro").otherwise("free").alias("plan"), "customer")
    return up.unionByName(found)


def plan_state(events: DataFrame) -> DataFrame:
    """W6 final state: latest plan per account, its billing customer (latest upgrade)."""
    return state_from_actions(plan_actions(events))


def state_from_actions(acts: DataFrame) -> DataFrame:
    """Per account: latest plan, customer of the latest upgrade, last event, #changes."""
    order = F.struct("ts", "seq")
    return acts.groupBy("account_id").agg(
        F.max_by("plan", order).alias("plan"),
        F.max_by("customer", F.when(F.col("plan") == "pro", order)).alias("stripe_customer_id"),
        F.max("ts").alias("last_event_ts"),
        F.count(F.lit(1)).alias("n_changes"))


def plan_history(events: DataFrame) -> DataFrame:
    """W6 as SCD-2: one row per plan change with ``valid_from`` / ``valid_to``."""
    acts = ordered.next_in_key(plan_actions(events), "account_id", ["ts", "seq"], ["ts"])
    return acts.select("account_id", F.col("ts").alias("valid_from"),
                       F.col("next_ts").alias("valid_to"), "seq", "plan")


def customer_lookup(events: DataFrame) -> DataFrame:
    """J7 at the end of the log: each customer -> the smallest account holding it."""
    cur = (customer_intervals(events).filter(F.col("valid_to").isNull())
           .groupBy("customer").agg(F.min("account_id").alias("account_id"),
                                    F.count(F.lit(1)).alias("n_accounts")))
    return cur
