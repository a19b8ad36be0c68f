"""The tagging stream whole: order of steps, failed decisions, sinks, replay and restart."""

import json

import pytest
from pyspark.sql import functions as F

from tagwise.functions import crypto
from tagwise.operators import naive_bayes as nb
from tagwise.operators import route as rt
from tagwise.session import scratch_path
from tagwise.streaming import common
from tagwise.streaming import tagging as stag

SECRET = "s3cret"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def model(spark):
    rows = [("WISMO", "where is my order parcel"), ("CANCEL_ORDER", "cancel my order please"), ("WISMO", "parcel late where")] * 5
    docs = spark.createDataFrame(rows, "label string, text string").withColumn("tokens", nb.tokens("text"))
    return stag.materialise_model(spark, nb.fit(docs))


def deliveries(spark, rows):
    """rows: (conv_id, account, payload dict or raw string, signature kind)."""
    rows = [(c, 0, a, p if isinstance(p, str) else json.dumps(p), kind) for c, a, p, kind in rows]
    df = spark.createDataFrame(rows, "conv_id long, turn int, account_id long, value string, kind string")
    body = F.encode("value", "UTF-8")
    return df.withColumn("signature", F.when(F.col("kind") == "valid", crypto.hmac_sha256_b64(body, SECRET))
                         .when(F.col("kind") == "invalid", F.lit("bm90IGl0")).when(F.col("kind") == "empty", F.lit(""))) \
        .withColumn("ts", F.timestamp_seconds(F.col("conv_id") * 60)).drop("kind")


def ticket(i, text="where is my order", agent="False"):
    return {"ticket_id": str(i), "from_agent": agent, "body_text": text}


ROWS = [(1, 10, ticket(1), "valid"), (2, 10, ticket(2), "invalid"), (3, 10, ticket(3), None), (4, 10, "{not json", "valid"),
        (5, 10, "{not json", "invalid"), (6, 10, ticket(6, agent="TRUE"), "empty"), (7, 99, ticket(7), "valid"), (8, 10, ticket(0), "valid"),
        (9, 10, ticket(9, " \t"), "valid"), (10, 11, ticket(10, "12345 !!"), "valid"), (11, 11, ticket(11, "cancel my order please"), "valid"),
        (12, 10, None, "empty")]


def tables(spark):
    installed = spark.createDataFrame([(10,), (11,)], "account_id long")
    settings = spark.createDataFrame([(10, 0.5, ["WISMO"]), (11, 0.5, None)], "account_id long, confidence_threshold double, enabled_intents array<string>")
    return installed, settings


def test_every_delivery_has_one_outcome(spark, model):
    got = {r.conv_id: r for r in stag.decided(deliveries(spark, [r for r in ROWS if r[2] is not None]), [SECRET], model, *tables(spark), None).collect()}
    assert {c: r.outcome for c, r in got.items()} == {
        1: "ready", 2: "invalid_signature", 3: "ready", 4: "malformed", 5: "invalid_signature", 6: "agent_message", 7: "unknown_account",
        8: "unusable", 9: "unusable", 10: "ready", 11: "ready"}
    assert (got[1].intent, got[1].tag, got[1].success) == ("WISMO", "ei-wismo", True)
    assert (got[10].intent, got[10].confidence, got[10].tag, got[10].success, got[10].below_threshold) == ("OTHER", 0.0, "ei-unclassified", False, True)
    assert got[11].intent == "CANCEL_ORDER" and got[11].success


def test_invalid_signatures_are_not_parsed(spark):
    """The branch of invalid deliveries holds no parse; the other holds three."""
    triaged = rt.triage(deliveries(spark, [r for r in ROWS if r[2] is not None]), [SECRET], *tables(spark))
    plan = plan_of(triaged)
    assert plan.count("from_json") == 3
    first = plan_of(triaged.where("outcome = 'invalid_signature' AND text IS NULL"))
    assert first.count("from_json") <= 3


def test_parse_is_bound_once(spark):
    """Filters on parsed columns and further columns do not copy the parse."""
    parsed, quarantine = rt.parse_events(deliveries(spark, [r for r in ROWS if r[2] is not None]))
    for df in (parsed, quarantine, rt.usable(rt.customer_messages(parsed)).withColumn("n", F.length("text")).where("n > 3")):
        assert plan_of(df).count("from_json") == 3


def feed(spark, path, rows, files_at):
    deliveries(spark, rows).coalesce(1).write.mode("append").parquet(path)
    return len(files_at)


def snapshot(sinks):
    names = {"tags": stag.TAGS, "log": stag.LOG, "rejects": ["conv_id", "turn", "account_id", "reason", "ts"], "quarantine": ["conv_id", "value"]}
    return {n: sorted(map(str, sinks.read(n).select(*c).collect())) for n, c in names.items()} | {"counters": sorted(map(str, sinks.counters().collect()))}


def run(spark, model, path, root, checkpoint, **options):
    schema = deliveries(spark, ROWS[:1]).schema
    return stag.start_tagging(spark, common.file_stream(spark, path, schema), [SECRET], model, *tables(spark), None, root, checkpoint, **options)


def test_restart_redelivery_and_replay(spark, model):
    """Two batches, a restart from the checkpoint, and a delivery that comes again in a later
    batch: the sinks equal one batch over all that was delivered. Replaying a batch, and
    compacting the counters, change nothing."""
    rows = [r for r in ROWS if r[2] is not None]
    path, root, checkpoint = (scratch_path(spark, n) for n in ("landing-t", "tagging-t", "ckpt-t"))
    for part in (rows[:4], rows[4:7]):
        deliveries(spark, part).coalesce(1).write.mode("append").parquet(path)
    sinks = run(spark, model, path, root, checkpoint)
    assert sinks.done("tags") == {0, 1}
    assert sinks.compact_counters() == 1
    for part in (rows[7:], rows[:1]):                       # the last one is delivered again
        deliveries(spark, part).coalesce(1).write.mode("append").parquet(path)
    sinks = run(spark, model, path, root, checkpoint)
    assert sinks.done("log") == {0, 1, 2, 3} and sinks.due() == []
    whole = stag.decided(deliveries(spark, rows + rows[:1]), [SECRET], model, *tables(spark), None)
    got = snapshot(sinks)
    assert got["log"] == sorted(map(str, stag.Sinks.MADE["log"](whole).collect()))
    assert got["counters"] == sorted(map(str, stag.counted(whole.where("outcome = 'ready'")).collect()))
    sinks.commit(spark.read.parquet(sinks.path("staged", 2)).checkpoint(), 2)
    assert snapshot(sinks) == got
    assert sinks.compact_counters() == 3 and snapshot(sinks) == got and sinks.compact_counters() == 3


def test_a_failing_sink_does_not_stop_the_others(spark, model, monkeypatch):
    rows = [r for r in ROWS if r[2] is not None]
    path, root, checkpoint = (scratch_path(spark, n) for n in ("landing-f", "tagging-f", "ckpt-f"))
    for part in (rows[:5], rows[5:]):
        deliveries(spark, part).coalesce(1).write.mode("append").parquet(path)
    heard, write = [], stag.Sinks.write

    def broken(self, name, made, batch_id):
        if name == "rejects" and batch_id == 0:
            raise OSError("no space")
        write(self, name, made, batch_id)

    monkeypatch.setattr(stag.Sinks, "write", broken)
    sinks = run(spark, model, path, root, checkpoint, on_failure=lambda b, failed: heard.append((b, sorted(failed))))
    assert heard == [(0, ["rejects"])] and sinks.due() == [(0, ["rejects"])]
    assert sinks.done("log") == sinks.done("counters") == {0, 1} and sinks.done("rejects") == {1}
    monkeypatch.setattr(stag.Sinks, "write", write)
    assert sinks.redrive() == {} and sinks.due() == []
    whole = stag.decided(deliveries(spark, rows), [SECRET], model, *tables(spark), None)
    assert snapshot(sinks)["rejects"] == sorted(map(str, stag.Sinks.MADE["rejects"](whole).collect()))


@pytest.mark.parametrize("times", [1, 9])
def test_a_failure_that_nobody_hears_is_no_result(spark, model, monkeypatch, times):
    """Without ``on_failure`` a sink that failed once is written at the end; one that fails again
    fails the run, which goes on from its stage when it is started again."""
    rows = [r for r in ROWS if r[2] is not None]
    path, root, checkpoint = (scratch_path(spark, n) for n in ("landing-n", "tagging-n", "ckpt-n"))
    for part in (rows[:5], rows[5:]):
        deliveries(spark, part).coalesce(1).write.mode("append").parquet(path)
    left, write = [times], stag.Sinks.write

    def broken(self, name, made, batch_id):
        if name == "counters" and batch_id == 0 and left[0]:
            left[0] -= 1
            raise OSError("no space")
        write(self, name, made, batch_id)

    monkeypatch.setattr(stag.Sinks, "write", broken)
    if times > 1:
        with pytest.raises(RuntimeError, match="not written: counters of batch 0"):
            run(spark, model, path, root, checkpoint)
        left[0] = 0
    sinks = run(spark, model, path, root, checkpoint)
    assert sinks.due() == [] and sinks.done("counters") == {0, 1}
    whole = stag.decided(deliveries(spark, rows), [SECRET], model, *tables(spark), None)
    assert snapshot(sinks)["counters"] == sorted(map(str, stag.counted(whole.where("outcome = 'ready'")).collect()))


def test_fixture_reaches_every_outcome(spark):
    from tagwise.plans import routing
    from tests.conftest import SF_CHECK
    got = {(r.outcome, r.success): r.n for r in routing.decided_deliveries(spark, SF_CHECK).groupBy("outcome", "success").agg(F.count("*").alias("n")).collect()}
    assert {o for o, _ in got} >= {"ready", "invalid_signature", "malformed", "agent_message", "unknown_account"}
    assert got["ready", False] > 0 and got["ready", True] > 0


def test_open_windows_are_read_from_the_state(spark):
    """Windows still open after a run come from its state; the next run, from the same checkpoint,
    goes on with them and closes them."""
    from tagwise.streaming import windows as sw
    path, out, checkpoint = (scratch_path(spark, n) for n in ("landing-w", "windows-w", "ckpt-w"))

    def feed(rows):
        df = spark.createDataFrame(rows, "t string, intent string").select(F.to_timestamp("t").alias("ts"), "intent")
        df.coalesce(1).write.mode("append").parquet(path)
        return df.schema

    schema = feed([("2024-01-01 10:00:00", "A"), ("2024-01-01 11:00:00", "A"), ("2024-01-02 10:00:00", "B")])
    sw.start_intent_windows(spark, common.file_stream(spark, path, schema), out, checkpoint=checkpoint)
    got = {(str(r.window_start)[:10], r.intent): (r.n, r.closed) for r in sw.all_intent_windows(spark, out, checkpoint).collect()}
    assert got == {("2024-01-01", "A"): (2, True), ("2024-01-02", "B"): (1, False)}
    feed([("2024-01-02 12:00:00", "B"), ("2024-01-04 10:00:00", "A")])
    sw.start_intent_windows(spark, common.file_stream(spark, path, schema), out, checkpoint=checkpoint)
    got = {(str(r.window_start)[:10], r.intent): (r.n, r.closed) for r in sw.all_intent_windows(spark, out, checkpoint).collect()}
    assert got == {("2024-01-01", "A"): (2, True), ("2024-01-02", "B"): (2, True), ("2024-01-04", "A"): (1, False)}


def test_no_table_is_broadcast_in_every_batch(spark, model, monkeypatch):
    """Model and account tables, however small, are joined by shuffles: a broadcast would pass
    the driver in every micro-batch."""
    plans = []
    monkeypatch.setattr(stag, "materialize", lambda df, name: plans.append(plan_of(df)) or df.localCheckpoint())
    done = stag.decided(deliveries(spark, [r for r in ROWS if r[2] is not None]), [SECRET], model, *tables(spark), None)
    assert len(plans) == 1 and plans[0].count("rightHint=(strategy=merge)") == 2
    assert plan_of(done).count("rightHint=(strategy=merge)") == 1
