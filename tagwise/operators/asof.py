"""As-of lookups: the value of a slowly changing attribute at each event's time.

:func:`asof_lookup` (one value per key at a time, e.g. a caller's opt-in) merges events
and changes into one stream per key and forward-fills the latest change with the
skew-safe :func:`tagwise.operators.ordered.fill_forward`: linear in events + changes, no
pairing of a key's events with its changes, so a key holding a third of both stays
balanced.

:func:`asof_join` is the interval form, kept as the reference formulation in tests and
for small dimension lookups; it pairs each event with the intervals of its key. Changes ``(key, ts, seq, value...)`` become validity intervals ``[valid_from, valid_to)``
with a skew-safe per-key ``lead`` over the change log (:mod:`tagwise.operators.ordered`:
a key with a third of the changes still spreads over many tasks); the change log is the
only side that is sorted. Events then join on ``key`` plus the range predicate:
an equi-join with a residual filter, so Spark plans a sort-merge (or, when AQE measures
the interval side as small, a broadcast hash) join; a hot key on the event side is
split by AQE's skew-join handling. No window runs over the event side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwise.operators import ordered


def validity_intervals(changes: DataFrame, key: str, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Add ``valid_from`` (= ts) and ``valid_to`` (next change's ts, null = open)."""
    nxt = ordered.next_in_key(changes, key, [ts, seq], [ts, seq], prefix="_nx_")
    return (nxt.withColumn("valid_from", F.col(ts))
               .withColumnRenamed(f"_nx_{ts}", "valid_to")
               .withColumnRenamed(f"_nx_{seq}", "_next_seq"))


def asof_join(events: DataFrame, intervals: DataFrame, key: str, ts: str, values: list[str],
              how: str = "left", event_seq: str | None = None, change_seq: str = "seq") -> DataFrame:
    """Attach ``values`` valid at each event's ``ts``.

    A change applies from its own timestamp on (inclusive). When ``event_seq`` is given,
    events and changes sharing a timestamp are ordered by sequence numbers from the same
    sequence space (a change applies to events with ``event_seq >= seq``)."""
    iv = intervals.select(F.col(key).alias("_k"), "valid_from", "valid_to", "_next_seq",
                          F.col(change_seq).alias("_cseq"), *values)
    e_ts = F.col(ts)
    if event_seq is None:
        after_start = e_ts >= F.col("valid_from")
        before_end = F.col("valid_to").isNull() | (e_ts < F.col("valid_to"))
    else:
        es = F.col(event_seq)
        after_start = (e_ts > F.col("valid_from")) | ((e_ts == F.col("valid_from")) & (es >= F.col("_cseq")))
        before_end = (F.col("valid_to").isNull() | (e_ts < F.col("valid_to")) |
                      ((e_ts == F.col("valid_to")) & (es < F.col("_next_seq"))))
    cond = (F.col(key) == F.col("_k")) & after_start & before_end
    return events.join(iv, cond, how).drop("_k", "valid_from", "valid_to", "_next_seq", "_cseq")


def asof_lookup(events: DataFrame, changes: DataFrame, key: str, ts: str, values: list[str],
                event_seq: str | None = None, change_seq: str = "seq", how: str = "left",
                parts: int | None = None) -> DataFrame:
    """Attach ``values`` of the latest change (``key, ts, change_seq, values``) at or
    before each event; same tie rules as :func:`asof_join` (a change applies from its
    own timestamp on; with ``event_seq`` ties on the timestamp are ordered by the shared
    sequence space, a change applying to events with ``event_seq >= seq``). ``how``:
    ``left`` keeps events without a change (null values), ``inner`` drops them."""
    ev_type = events.schema
    chg = F.struct(*[F.col(v) for v in values])
    e = events.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"),
                      (F.col(event_seq) if event_seq else F.lit(None)).cast("bigint").alias("_s"),
                      F.lit(1).alias("_kind"), F.struct(*[F.col(c) for c in events.columns]).alias("_ev"),
                      F.lit(None).cast(changes.select(chg.alias("c")).schema["c"].dataType).alias("_chg"))
    # a change without a key applies to nothing (as in an equi-join); events without a
    # key are kept with null values
    c = changes.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.col(change_seq).cast("bigint").alias("_s"),
                       F.lit(0).alias("_kind"), F.lit(None).cast(ev_type).alias("_ev"), chg.alias("_chg"))
    order = ["_ts", "_s", "_kind"] if event_seq else ["_ts", "_kind", "_s"]
    filled = ordered.fill_forward(e.unionByName(c), "_key", order, "_chg", parts=parts)
    out = filled.filter(F.col("_kind") == 1)
    if how == "inner":
        out = out.filter(F.col("_chg").isNotNull())
    return out.select("_ev.*", *[F.col("_chg")[v].alias(v) for v in values])
