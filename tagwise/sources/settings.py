"""Account settings as a change log.

The reference reads and overwrites one JSON document per account. At table scale the
same information is an append-only change log ``(account_id, ts, seq, <fields>)``
where a null field means "not updated". The current snapshot is, per field, the last
non-null value in ``(ts, seq)`` order — ``max_by`` with an ordering that is null for
rows not touching the field — which is a partial/final aggregate (no sort of the whole
log, no per-account collect). Accounts with no document get the defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwise import taxonomy as tx

FIELDS = ["api_key", "confidence_threshold", "enabled_intents", "plan", "stripe_customer_id"]
DEFAULTS = {"api_key": "", "confidence_threshold": tx.DEFAULT_CONFIDENCE_THRESHOLD,
            "plan": "free", "stripe_customer_id": ""}


def snapshot(changes: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Last non-null value per field per account, plus created/updated times."""
    fields = [f for f in (fields or FIELDS) if f in changes.columns]
    order = F.struct("ts", "seq")
    aggs = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields]
    return changes.groupBy("account_id").agg(*aggs, F.min("ts").alias("created_at"),
                                             F.max("ts").alias("updated_at"))


def with_defaults(accounts: DataFrame, snap: DataFrame) -> DataFrame:
    """Every account with every settings field; missing documents and missing
    fields take the defaults. An empty ``enabled_intents`` list is kept as stored (it
    means "all" at tagging time)."""
    out = accounts.select("account_id").join(snap, "account_id", "left")
    for f, dflt in DEFAULTS.items():
        value = F.coalesce(F.col(f), F.lit(dflt)) if f in out.columns else F.lit(dflt)
        out = out.withColumn(f, value)
    all_intents = F.array(*[F.lit(x) for x in tx.LABELS])
    out = out.withColumn("enabled_intents", F.coalesce("enabled_intents", all_intents)
                         if "enabled_intents" in out.columns else all_intents)
    return out


def apply_update(current: DataFrame, update: DataFrame) -> DataFrame:
    """a partial update — only non-null fields of ``update`` overwrite."""
    u = update.select("account_id", *[F.col(f).alias(f"_u_{f}") for f in FIELDS if f in update.columns])
    out = current.join(u, "account_id", "left")
    for f in FIELDS:
        if f in current.columns and f in update.columns:
            out = out.withColumn(f, F.coalesce(F.col(f"_u_{f}"), F.col(f))).drop(f"_u_{f}")
    return out
