"""Streaming jobs run to completion over staged driver-table files (availableNow); each
query returns the job's sink table. Oracles are the equivalent batch SQL (for append-mode
windows: the windows the final watermark has closed)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwise import taxonomy as tx
from tagwise.plans import routing, scoring
from tagwise.plans.registry import ORACLES, query
from tagwise.session import scratch_path, shared_path
from tagwise.sources import tables as tb
from tagwise.streaming import billing as sbill
from tagwise.streaming import common
from tagwise.streaming import counters as scnt
from tagwise.streaming import tagging as stag
from tagwise.streaming import windows as swin

TRIGGERS = 4
LOG_SCHEMA = ("ts timestamp, account_id bigint, ticket_id bigint, event_type string, intent string, "
              "confidence double, success boolean, latency_ms double, text string")


def _log_stream(spark, d, name, df=None, key="ts"):
    path = scratch_path(spark, f"landing-{name}")
    df = tb.classification_log(spark, d) if df is None else df
    files = common.stage_files(df, path, key, TRIGGERS)
    return common.file_stream(spark, path, df.schema, files)


def _tagging(spark, d):
    """The tagging stream over all deliveries, run once for an application and input."""
    def run() -> str:
        src = scratch_path(spark, "landing-payloads")
        events = tb.ticket_events(spark, d)
        files = common.stage_files(events, src, "conv_id", TRIGGERS)
        stream = common.file_stream(spark, src, events.schema, files)
        model = stag.materialise_model(spark, scoring.nb_model(spark, d))
        root = scratch_path(spark, "tagging")
        sinks = stag.start_tagging(spark, stream, [tb.WEBHOOK_SECRET], model, tb.installed_accounts(spark, d), tb.account_settings(spark, d), None, root)
        sinks.compact_counters()
        return root
    return stag.Sinks(spark, shared_path(spark, "tagging", d, run))


@query("stream_ticket_tags", covers="ST1 S14",
       sql=f"WITH {routing.SQL_DECIDED}\nSELECT {', '.join(stag.TAGS)} FROM decided")
def stream_ticket_tags(spark, d):
    return _tagging(spark, d).read("tags").select(*stag.TAGS)


@query("stream_classification_log", covers="ST3 S12",
       sql=ORACLES["ticket_classification_log"])
def stream_classification_log(spark, d):
    return _tagging(spark, d).read("log").select(*stag.LOG)


@query("stream_webhook_rejects", covers="ST1 ST2 F14",
       sql=ORACLES["webhook_rejects"])
def stream_webhook_rejects(spark, d):
    return _tagging(spark, d).read("rejects").select("conv_id", "turn", "account_id", "reason", "ts")


@query("stream_decision_counters", covers="ST1 ST6 A21",
       sql=f"""WITH {routing.SQL_DECIDED}
SELECT account_id, count(*) AS total_classified, count(*) FILTER (WHERE NOT success) AS total_errors,
       max(ts) AS last_processed_at FROM decided GROUP BY account_id""")
def stream_decision_counters(spark, d):
    """Counters fed by the tagging stream's own log, from a snapshot and the batches after it."""
    return _tagging(spark, d).counters()


@query("stream_optin_capture", covers="ST4 P12 J6",
       sql=ORACLES["optin_capture_log"])
def stream_optin_capture(spark, d):
    calls = routing._calls(spark, d)
    stream = _log_stream(spark, d, "calls", calls)
    changes = routing._opt_in_changes(calls)
    out = scratch_path(spark, "capture")
    stag.start_capture(spark, stream, changes, out)
    return spark.read.parquet(out).drop("batch_id")


@query("stream_webhook_counters", covers="ST6 A21",
       sql=ORACLES["webhook_counters"])
def stream_webhook_counters(spark, d):
    out = scratch_path(spark, "counters")
    scnt.start_counters(spark, _log_stream(spark, d, "log-counters"), out)
    return scnt.read_counters(spark, out)


@query("stream_intent_windows", covers="ST7 ST10 A25",
       sql=f"""WITH log AS ({tb.SQL_CLASSIFICATION_LOG}),
wm AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM log),
g AS (SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
             intent, count(*) AS n FROM log GROUP BY ALL)
SELECT g.*, g.window_end <= wm.wm AS closed FROM g, wm""")
def stream_intent_windows(spark, d):
    """All windows, the ones still open at the end of the run from the stream's state."""
    out, checkpoint = scratch_path(spark, "intent-windows"), scratch_path(spark, "ckpt-intent-windows")
    swin.start_intent_windows(spark, _log_stream(spark, d, "log-windows"), out, checkpoint=checkpoint)
    return swin.all_intent_windows(spark, out, checkpoint)


@query("stream_rate_audit", covers="ST5 ST10",
       sql=f"""WITH log AS ({tb.SQL_CLASSIFICATION_LOG}),
wm AS (SELECT max(ts) - INTERVAL 10 SECOND AS wm FROM log),
g AS (SELECT account_id AS client_key, CASE WHEN event_type = 'purchase' THEN 'classify_batch' ELSE 'classify' END AS endpoint,
             date_trunc('second', ts) AS second, sum(1 + ticket_id % 40 * 5)::BIGINT AS n FROM log GROUP BY ALL),
h AS (SELECT *, CASE endpoint WHEN 'classify' THEN 100 ELSE 20 END AS rate_limit FROM g)
SELECT h.*, n > rate_limit AS exceeded, h.second + INTERVAL 1 SECOND <= wm.wm AS closed FROM h, wm""")
def stream_rate_audit(spark, d):
    """All seconds, the ones still open at the end of the run from the stream's state."""
    out, checkpoint = scratch_path(spark, "rate-audit"), scratch_path(spark, "ckpt-rate-audit")
    log = tb.classification_log(spark, d)
    # a logged row stands for up to 196 calls of its second, so both limits are passed
    calls = log.select("ts", F.col("account_id").alias("client_key"),
                       F.when(F.col("event_type") == "purchase", "classify_batch").otherwise("classify").alias("endpoint"),
                       (1 + F.col("ticket_id") % 40 * 5).alias("calls"))
    swin.start_rate_audit(spark, _log_stream(spark, d, "log-rate", calls), out, checkpoint=checkpoint)
    return swin.all_rate_windows(spark, out, checkpoint)


@query("stream_dedup_replay", covers="ST8",
       sql=f"""WITH log AS ({tb.SQL_CLASSIFICATION_LOG})
SELECT account_id, count(*) AS n FROM log GROUP BY account_id""")
def stream_dedup_replay(spark, d):
    log = tb.classification_log(spark, d)
    twice = log.unionByName(log)                       # every event delivered twice
    out = scratch_path(spark, "dedup")
    swin.start_dedup_counts(spark, _log_stream(spark, d, "log-dedup", twice), out)
    return spark.read.parquet(out).groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))


@query("stream_billing_state", covers="ST9 W6",
       sql=ORACLES["billing_plan_state"])
def stream_billing_state(spark, d):
    ev = tb.billing_events(spark, d)
    src = scratch_path(spark, "landing-billing")
    files = common.stage_files(ev, src, "ts", TRIGGERS)
    holders, state = scratch_path(spark, "billing-holders"), scratch_path(spark, "billing-state")
    sbill.start_billing(spark, common.file_stream(spark, src, ev.schema, files), holders, state)
    return sbill.read_state(spark, state)


@query("stream_billing_late", covers="ST9 ST10 W6 J8",
       sql=ORACLES["billing_plan_state"])
def stream_billing_late(spark, d):
    """The same events delivered in an order that has nothing to do with their times: the state
    is the one of the events in time order."""
    ev = tb.billing_events(spark, d).withColumn("arrival", F.xxhash64("event_seq"))
    src = scratch_path(spark, "landing-billing-late")
    files = common.stage_files(ev, src, "arrival", TRIGGERS)
    holders, state = scratch_path(spark, "billing-holders"), scratch_path(spark, "billing-state")
    sbill.start_billing(spark, common.file_stream(spark, src, ev.schema, files), holders, state)
    return sbill.read_state(spark, state)
