"""Billing lifecycle (W6, J7, J8), settings change log (S15, F18), opt-in capture and
erasure (P12, J6, U4, A23)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tagwise.operators import asof
from tagwise.operators import billing as bl
from tagwise.operators import privacy as pv
from tagwise.sources import settings as st

T0 = dt.datetime(2024, 1, 1)


def _ev(spark, rows):
    return spark.createDataFrame(
        [(seq, T0 + dt.timedelta(days=day), typ, acct, cust, att) for seq, day, typ, acct, cust, att in rows],
        "event_seq long, ts timestamp, type string, client_reference_id string, customer string, attempt_count long")


def test_plan_lifecycle(spark):
    rows = [
        (1, 0, bl.CHECKOUT, "a1", "c1", None),         # a1 -> pro with c1
        (2, 1, bl.PAYMENT_FAILED, None, "c1", 2),      # attempt 2: nothing
        (3, 2, bl.PAYMENT_FAILED, None, "c1", None),   # missing attempt = 1: nothing
        (4, 3, bl.PAYMENT_FAILED, None, "c1", 3),      # attempt 3: a1 -> free
        (5, 4, bl.CHECKOUT, "a1", "c2", None),         # a1 -> pro, customer replaced by c2
        (6, 5, bl.SUB_DELETED, None, "c1", None),      # c1 no longer held: ignored
        (7, 6, bl.CHECKOUT, "a2", None, None),         # missing customer: ignored
        (8, 7, bl.SUB_DELETED, None, "c2", None),      # a1 -> free (customer kept)
        (9, 8, bl.SUB_CREATED, None, "c2", None),      # a1 -> pro again
        (10, 9, "invoice.paid", None, "c2", None),     # other types ignored
    ]
    ev = _ev(spark, [(s, d, t, ("1" if a == "a1" else "2") if a else None, c, att) for s, d, t, a, c, att in rows])
    state = {r["account_id"]: r for r in bl.plan_state(ev).collect()}
    assert list(state) == [1]
    assert state[1]["plan"] == "pro" and state[1]["stripe_customer_id"] == "c2" and state[1]["n_changes"] == 5
    hist = [(r["seq"], r["plan"]) for r in bl.plan_history(ev).orderBy("seq").collect()]
    assert hist == [(1, "pro"), (4, "free"), (5, "pro"), (8, "free"), (9, "pro")]
    res = {r["event_seq"]: r["account_id"] for r in bl.resolve_accounts(ev).collect()}
    assert res == {4: 1, 6: None, 8: 1, 9: 1}
    junk = _ev(spark, [(1, 0, bl.CHECKOUT, "not-a-number", "c1", None)])
    assert bl.plan_state(junk).count() == 0                     # malformed account id: ignored


def test_asof_inclusive_start_and_seq_ties(spark):
    ch = spark.createDataFrame([("k", T0, 5, "v1"), ("k", T0, 7, "v2")], "key string, ts timestamp, seq long, v string")
    iv = asof.validity_intervals(ch, "key")
    ev = spark.createDataFrame([("k", T0, 6), ("k", T0, 8), ("k", T0, 4)], "key string, ts timestamp, eseq long")
    got = {r["eseq"]: r["v"] for r in asof.asof_join(ev, iv, "key", "ts", ["v"], event_seq="eseq").collect()}
    assert got == {6: "v1", 8: "v2", 4: None}


def test_settings_snapshot_last_non_null_and_defaults(spark):
    ch = spark.createDataFrame([
        (1, T0, 1, 0.5, None), (1, T0 + dt.timedelta(1), 2, None, ["WISMO"]), (1, T0 + dt.timedelta(2), 3, None, None),
        (2, T0, 4, None, []),
    ], "account_id long, ts timestamp, seq long, confidence_threshold double, enabled_intents array<string>")
    snap = st.snapshot(ch)
    accts = spark.createDataFrame([(1,), (2,), (3,)], "account_id long")
    out = {r["account_id"]: r for r in st.with_defaults(accts, snap).collect()}
    assert out[1]["confidence_threshold"] == 0.5 and out[1]["enabled_intents"] == ["WISMO"]
    assert out[1]["created_at"] == T0 and out[1]["updated_at"] == T0 + dt.timedelta(2)
    assert out[2]["confidence_threshold"] == 0.70 and out[2]["enabled_intents"] == []
    assert out[3]["plan"] == "free" and len(out[3]["enabled_intents"]) == 9
    upd = spark.createDataFrame([(1, None, ["OTHER"])], "account_id long, confidence_threshold double, enabled_intents array<string>")
    after = {r["account_id"]: r for r in st.apply_update(st.with_defaults(accts, snap), upd).collect()}
    assert after[1]["confidence_threshold"] == 0.5 and after[1]["enabled_intents"] == ["OTHER"]


def test_optin_capture_hash_only_and_erasure(spark):
    import hashlib
    raw = "where is my order it has been 8 days"
    calls = spark.createDataFrame([("u1", raw, "WISMO", 0.62, T0), ("u1", "x", "OTHER", 0.8, T0),
                                   ("u2", "y", "OTHER", 0.1, T0)],
                                  "user_key string, text string, intent string, confidence double, ts timestamp")
    opted = spark.createDataFrame([("u1",)], "user_key string")          # u2 never opted in
    cap = pv.capture_low_confidence(calls, opted).collect()
    assert len(cap) == 1
    row = cap[0].asDict()
    assert raw not in str(row) and len(row["text_hash"]) == 32
    assert row["file_key"] == hashlib.md5(b"u1").hexdigest()
    log = pv.capture_low_confidence(calls, opted)
    req = spark.createDataFrame([(hashlib.md5(b"u1").hexdigest(),), (hashlib.md5(b"u9").hexdigest(),)], "file_key string")
    remaining, counts = pv.erase(log, req)
    assert remaining.count() == 0
    assert sorted(r["examples_deleted"] for r in counts.collect()) == [0, 1]


def test_latest_opt_in_reverts(spark):
    ch = spark.createDataFrame([("u1", True, T0, 1), ("u1", False, T0 + dt.timedelta(1), 2)],
                               "user_key string, opt_in boolean, ts timestamp, seq long")
    assert pv.latest_opt_in(ch).first()["opt_in"] is False
    _ = F


def test_resolve_accounts_equals_interval_join(spark):
    """Shared customers, repeated checkouts, ties on the timestamp: the toggle log +
    forward fill gives what the plain interval join gives."""
    import random
    random.seed(11)
    types = [bl.CHECKOUT] * 4 + [bl.SUB_CREATED, bl.SUB_DELETED, bl.PAYMENT_FAILED]
    rows = []
    for seq in range(1, 1500):
        typ = random.choice(types)
        acct = str(random.randint(1, 6)) if typ == bl.CHECKOUT else None
        cust = f"c{random.randint(1, 4)}" if random.random() < 0.7 else "hot"
        rows.append((seq, random.randint(0, 60), typ, acct, cust, random.choice([None, 2, 3, 4])))
    ev = _ev(spark, rows)
    got = {r["event_seq"]: r["account_id"] for r in bl.resolve_accounts(ev).collect()}
    lookups = ev.filter(F.col("type").isin(bl.SUB_CREATED, bl.SUB_DELETED) |
                        ((F.col("type") == bl.PAYMENT_FAILED) & (F.coalesce("attempt_count", F.lit(1)) >= 3)))
    iv = bl.customer_intervals(ev).withColumnRenamed("account_id", "held_by")
    plain = asof.asof_join(lookups, iv, "customer", "ts", ["held_by"], event_seq="event_seq") \
        .groupBy("event_seq").agg(F.min("held_by").alias("a"))
    want = {r["event_seq"]: r["a"] for r in plain.collect()}
    assert got == want and any(v is not None for v in got.values())


def test_incremental_billing_batches_equal_batch_state(spark):
    """Two micro-batches through the incremental stream step give the batch state."""
    from tagwise.streaming import billing as sb
    rows = [
        (1, 0, bl.CHECKOUT, "1", "c1", None), (2, 1, bl.PAYMENT_FAILED, None, "c1", 3),
        (3, 2, bl.CHECKOUT, "2", "c1", None), (4, 3, bl.SUB_CREATED, None, "c1", None),
        (5, 4, bl.CHECKOUT, "1", "c2", None), (6, 5, bl.SUB_DELETED, None, "c1", None),
        (7, 6, bl.SUB_DELETED, None, "c2", None), (8, 7, bl.CHECKOUT, "3", "c2", None),
        (9, 8, bl.SUB_CREATED, None, "c2", None),
    ]
    ev = _ev(spark, rows)
    h = spark.createDataFrame([], sb.HOLDERS_SCHEMA)
    s = spark.createDataFrame([], sb.STATE_SCHEMA)
    for lo, hi in [(0, 4), (4, 9)]:
        h, s = sb.apply_batch(ev.filter(F.col("event_seq").between(lo + 1, hi)), h, s)
        h, s = spark.createDataFrame(h.collect(), sb.HOLDERS_SCHEMA), spark.createDataFrame(s.collect(), sb.STATE_SCHEMA)
    cols = ["account_id", "plan", "stripe_customer_id", "last_event_ts", "n_changes"]
    assert sorted(s.select(*cols).collect()) == sorted(bl.plan_state(ev).select(*cols).collect())


def test_late_billing_events_count_by_their_times(spark):
    """Events in random order, in five batches with a restart in between: the state equals that of
    all events in time order, also where a late checkout moves an account to another customer."""
    import random

    from tagwise.session import scratch_path
    from tagwise.streaming import billing as sb
    from tagwise.streaming import common
    rng = random.Random(11)
    kinds = [bl.CHECKOUT] * 4 + [bl.SUB_CREATED, bl.SUB_DELETED, bl.PAYMENT_FAILED, "other"]
    rows = []
    for i in range(150):
        kind = rng.choice(kinds)
        rows.append((i, 1_700_000_000 + rng.randrange(60) * 60, kind, str(rng.randrange(7)) if kind == bl.CHECKOUT else None,
                     rng.choice([None, *[f"c{k}" for k in range(9)]]), rng.choice([None, 1, 3, 5])))
    schema = "event_seq bigint, t bigint, type string, client_reference_id string, customer string, attempt_count bigint"

    def frame(some):
        return spark.createDataFrame(some, schema).select("event_seq", F.timestamp_seconds("t").alias("ts"), "type", "client_reference_id", "customer", "attempt_count")

    want = sorted(map(tuple, bl.plan_state(frame(rows)).collect()))
    rng.shuffle(rows)
    path, holders, state, checkpoint = (scratch_path(spark, n) for n in ("landing-b", "holders-b", "state-b", "ckpt-b"))
    for first in (True, False):
        for part in ((rows[:40], rows[40:75]) if first else (rows[75:90], rows[90:120], rows[120:])):
            frame(part).coalesce(1).write.mode("append").parquet(path)
        sb.start_billing(spark, common.file_stream(spark, path, frame(rows[:1]).schema), holders, state, checkpoint)
    assert sorted(map(tuple, sb.read_state(spark, state).collect())) == want


def _brute_holders(rows):
    """event_seq -> smallest holder, replaying (seq, day, type, account, customer) in order."""
    held, out = {}, {}
    for seq, day, typ, acct, cust in sorted(rows, key=lambda r: (r[1], r[0])):
        if typ == bl.CHECKOUT:
            held[acct] = cust
        else:
            out[seq] = min((a for a, c in held.items() if c == cust), default=None)
    return out


def test_holder_steps_with_one_customer_held_by_thousands(spark, monkeypatch):
    """The hot customer is held by thousands of accounts at once (several blocks of toggles);
    the steps equal a replay, and no row is made a holder for a lookup."""
    import random
    random.seed(5)
    rows = [(i, i % 700, bl.CHECKOUT, random.randint(1, 3000), "hot" if random.random() < 0.9 else f"c{random.randint(1, 600)}")
            for i in range(1, 10_001)]
    rows += [(i, random.randint(0, 700), random.choice([bl.SUB_CREATED, bl.SUB_DELETED]), None, random.choice(["hot", "none", *(f"c{k}" for k in range(1, 601))]))
             for i in range(10_001, 10_601)]
    ev = _ev(spark, [(s, d, t, str(a) if a else None, c, None) for s, d, t, a, c in rows])
    want = _brute_holders(rows)
    for bits, few in ((10, 4), (3, 0)):                   # the hot customer only, and all of them, by steps
        monkeypatch.setattr(bl, "BLOCK_BITS", bits)
        monkeypatch.setattr(bl, "FEW_HOLDERS", few)
        got = {r["event_seq"]: r["account_id"] for r in bl.resolve_accounts(ev).collect()}
        assert got == want and len(set(want.values())) >= 15
    hot = bl.holder_steps(ev).where("customer = 'hot'").count()
    assert 9_000 < hot <= 2 * 10_000                      # a row a toggle


@pytest.mark.parametrize("few", [0, 4])
def test_holder_steps_edge_cases(spark, monkeypatch, few):
    monkeypatch.setattr(bl, "FEW_HOLDERS", few)
    assert bl.resolve_accounts(_ev(spark, [])).count() == 0
    rows = [(1, 0, bl.CHECKOUT, "1", "c", None), (1, 0, bl.CHECKOUT, "1", "c", None),        # delivered twice
            (2, 0, bl.SUB_CREATED, None, "c", None), (2, 0, bl.SUB_CREATED, None, "c", None),
            (3, 1, bl.CHECKOUT, "1", "c", None),                                             # held on
            (4, 1, bl.SUB_CREATED, None, "c", None), (5, 2, bl.CHECKOUT, "1", "d", None),
            (6, 2, bl.SUB_DELETED, None, "c", None), (7, 2, bl.SUB_DELETED, None, None, None), (8, 2, bl.SUB_DELETED, None, "d", None)]
    got = sorted((r["event_seq"], r["account_id"]) for r in bl.resolve_accounts(_ev(spark, rows)).collect())
    assert got == [(2, 1), (4, 1), (6, None), (7, None), (8, 1)]


@pytest.mark.parametrize("few", [0, 4])
def test_held_lookups_are_all_lookups_less_those_nobody_holds(spark, monkeypatch, few):
    import random
    monkeypatch.setattr(bl, "FEW_HOLDERS", few)
    rng = random.Random(few)
    rows = [(i, rng.randrange(30), t, str(rng.randrange(5)) if t == bl.CHECKOUT else None, rng.choice([None, "c1", "c2", "c3", "c4"]), None)
            for i in range(200) for t in [rng.choice([bl.CHECKOUT, bl.SUB_CREATED, bl.SUB_DELETED])]]
    rows += [r for r in rows if r[0] % 9 == 0]                                               # delivered twice
    ev = _ev(spark, rows)
    every = bl.resolve_accounts(ev).where("account_id IS NOT NULL").collect()
    assert sorted(map(tuple, bl.resolve_accounts(ev, held_only=True).collect())) == sorted(map(tuple, every))


def test_late_batches_are_computed_once(spark, monkeypatch):
    """A batch with late events is not resolved as one in order first, and gives the same state
    where few accounts are touched and where most are."""
    from tagwise.session import scratch_path
    from tagwise.streaming import billing as sb
    from tagwise.streaming import common
    early = [(100 + k, 50 + k, bl.CHECKOUT, str(k), f"c{k}", None) for k in range(8)]
    calls, most = [], []
    apply, share = sb.apply_batch, sb._most
    monkeypatch.setattr(sb, "apply_batch", lambda *a: calls.append(1) or apply(*a))
    monkeypatch.setattr(sb, "_most", lambda *a: most.append(share(*a)) or most[-1])
    for late in ([(1, 0, bl.CHECKOUT, "1", "c2", None), (2, 60, bl.SUB_DELETED, None, "c1", None)],
                 [(k, k, bl.CHECKOUT, str(k), f"c{k}", None) for k in range(8)] + [(9, 9, bl.SUB_DELETED, None, "c3", None)]):
        calls.clear()
        path, holders, state, checkpoint = (scratch_path(spark, n) for n in ("landing-c", "holders-c", "state-c", "ckpt-c"))
        for part in (early, late):
            _ev(spark, part).coalesce(1).write.mode("append").parquet(path)
            sb.start_billing(spark, common.file_stream(spark, path, _ev(spark, part).schema), holders, state, checkpoint)
        assert len(calls) == 1
        assert sorted(map(tuple, sb.read_state(spark, state).collect())) == sorted(map(tuple, bl.plan_state(_ev(spark, early + late)).collect()))
    assert most == [False, True]
