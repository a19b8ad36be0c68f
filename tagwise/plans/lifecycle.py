"""Billing lifecycle, usage metering, volume analytics and taxonomy reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwise import taxonomy as tx
from tagwise.functions import text as fx
from tagwise.operators import billing as bl
from tagwise.operators import curate as cu
from tagwise.operators import usage as us
from tagwise.plans.registry import query
from tagwise.session import materialize as write_once
from tagwise.sources import tables as tb

# --- billing ------------------------------------------------------------------------

SQL_BILLING = f"""ev AS ({tb.SQL_BILLING_EVENTS}),
co AS (SELECT CAST(client_reference_id AS BIGINT) AS account_id, customer, ts, event_seq AS seq FROM ev
       WHERE type = '{bl.CHECKOUT}' AND client_reference_id IS NOT NULL AND customer IS NOT NULL),
iv AS (SELECT *, lead(ts) OVER (PARTITION BY account_id ORDER BY ts, seq) AS valid_to,
              lead(seq) OVER (PARTITION BY account_id ORDER BY ts, seq) AS next_seq FROM co),
lk AS (SELECT * FROM ev WHERE type IN ('{bl.SUB_CREATED}', '{bl.SUB_DELETED}')
       OR (type = '{bl.PAYMENT_FAILED}' AND coalesce(attempt_count, 1) >= {tx.FAILED_PAYMENT_DOWNGRADE_ATTEMPTS})),
found AS (SELECT lk.event_seq, lk.ts, lk.type, lk.customer, min(iv.account_id) AS account_id
          FROM lk LEFT JOIN iv ON iv.customer = lk.customer
            AND (lk.ts > iv.ts OR (lk.ts = iv.ts AND lk.event_seq >= iv.seq))
            AND (iv.valid_to IS NULL OR lk.ts < iv.valid_to OR (lk.ts = iv.valid_to AND lk.event_seq < iv.next_seq))
          GROUP BY lk.event_seq, lk.ts, lk.type, lk.customer),
acts AS (SELECT account_id, ts, seq, 'pro' AS plan, customer FROM co
         UNION ALL SELECT account_id, ts, event_seq, CASE WHEN type = '{bl.SUB_CREATED}' THEN 'pro' ELSE 'free' END,
                          customer FROM found WHERE account_id IS NOT NULL),
state AS (SELECT account_id, arg_max(plan, (ts, seq)) AS plan,
                 arg_max(customer, (ts, seq)) FILTER (WHERE plan = 'pro') AS stripe_customer_id,
                 max(ts) AS last_event_ts, count(*) AS n_changes FROM acts GROUP BY account_id)"""


@query("billing_plan_state", covers="W6 ST9 J7 J8",
       sql=f"WITH {SQL_BILLING}\nSELECT * FROM state")
def billing_plan_state(spark, d):
    return bl.plan_state(tb.billing_events(spark, d))


@query("billing_plan_history", covers="W6 J8",
       sql=f"""WITH {SQL_BILLING}
SELECT account_id, ts AS valid_from, lead(ts) OVER (PARTITION BY account_id ORDER BY ts, seq) AS valid_to,
       seq, plan FROM acts""")
def billing_plan_history(spark, d):
    return bl.plan_history(tb.billing_events(spark, d))


@query("billing_account_resolution", covers="J8 J7",
       sql=f"WITH {SQL_BILLING}\nSELECT event_seq, ts, type, customer, account_id FROM found")
def billing_account_resolution(spark, d):
    return bl.resolve_accounts(tb.billing_events(spark, d))


@query("customer_account_lookup", covers="J7",
       sql=f"""WITH {SQL_BILLING}
SELECT customer, min(account_id) AS account_id, count(*) AS n_accounts FROM iv WHERE valid_to IS NULL
GROUP BY customer""")
def customer_account_lookup(spark, d):
    return bl.customer_lookup(tb.billing_events(spark, d))


# --- usage / volume --------------------------------------------------------------------

# A logged request stands for a batch of 1 to 1,951 texts, so quotas are reached.
SQL_UNITS = "1 + ticket_id % 40 * 50"
SQL_PLANS = tx.sql_values(tx.PLAN_QUOTAS, ["plan", "monthly_price", "quota", "overage_price"])


@query("monthly_usage", covers="A24",
       sql=f"""WITH {SQL_BILLING}, log AS ({tb.SQL_CLASSIFICATION_LOG}),
calls AS (SELECT account_id, date_trunc('month', ts) AS month, sum({SQL_UNITS})::BIGINT AS calls FROM log GROUP BY ALL),
j AS (SELECT c.*, coalesce(s.plan, 'free') AS plan FROM calls c LEFT JOIN state s ON s.account_id = c.account_id),
k AS (SELECT j.*, CAST(p.quota AS BIGINT) AS quota, CAST(p.overage_price AS DECIMAL(18, 6)) AS overage_price
      FROM j LEFT JOIN (SELECT * FROM {SQL_PLANS}) p ON p.plan = j.plan)
SELECT account_id, month, plan, calls, quota,
       CAST(CASE WHEN quota IS NULL THEN 0 ELSE greatest(calls - quota, 0) END AS BIGINT) AS over_quota_calls,
       (CAST(CASE WHEN quota IS NULL THEN 0 ELSE greatest(calls - quota, 0) END AS DECIMAL(18, 0))
        * coalesce(overage_price, CAST(0 AS DECIMAL(18, 6))))::DOUBLE AS overage_usd FROM k""")
def monthly_usage(spark, d):
    log = tb.classification_log(spark, d).withColumn("units", 1 + F.col("ticket_id") % 40 * 50)
    usage = us.monthly_usage(spark, log, bl.plan_state(tb.billing_events(spark, d)))
    return usage.withColumn("overage_usd", F.col("overage_usd").cast("double"))     # computed in decimal


@query("weekly_intent_volume", covers="A25 ST7",
       sql=f"""WITH log AS ({tb.SQL_CLASSIFICATION_LOG})
SELECT date_trunc('week', ts) AS week, intent, count(*) AS n FROM log GROUP BY ROLLUP (date_trunc('week', ts), intent)""")
def weekly_intent_volume(spark, d):
    return us.weekly_volume(tb.classification_log(spark, d))


@query("volume_spikes", covers="W7",
       sql=f"""WITH log AS ({tb.SQL_CLASSIFICATION_LOG}),
daily AS (SELECT intent, date_trunc('day', ts) AS day, count(*) AS n FROM log GROUP BY ALL),
w AS (SELECT *, round(avg(n) OVER (PARTITION BY intent ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 4) AS prev_mean,
             round(stddev_samp(n) OVER (PARTITION BY intent ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 4)
               AS prev_std FROM daily)
SELECT intent, day, n, prev_mean, prev_std, n > prev_mean + 2.0 * prev_std AS spike FROM w""")
def volume_spikes(spark, d):
    return us.volume_spikes(tb.classification_log(spark, d))


SQL_TARGETS = tx.sql_values(sorted(tx.SYNTHETIC_TARGET_PER_INTENT.items()), ["intent", "target"])


@query("synthetic_target_vs_got", covers="A27",
       sql=f"""WITH log AS ({tb.SQL_CLASSIFICATION_LOG}),
got AS (SELECT intent, count(*) AS got FROM log GROUP BY intent)
SELECT t.intent, CAST(t.target AS BIGINT) AS target, CAST(coalesce(g.got, 0) AS BIGINT) AS got,
       CAST(greatest(t.target - coalesce(g.got, 0), 0) AS BIGINT) AS shortfall,
       round(coalesce(g.got, 0) * 100.0 / t.target, 4) AS pct_of_target
FROM {SQL_TARGETS} LEFT JOIN got g ON g.intent = t.intent""")
def synthetic_target_vs_got(spark, d):
    return us.target_vs_got(spark, tb.classification_log(spark, d))


@query("generated_line_cleaning", covers="P16",
       sql=f"""WITH docs AS (SELECT doc_id, {cu.sql_map_label('lang', tx.LANG_LABEL_MAP)} AS intent, text
              FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, intent, {fx.sql_strip('l.line')} AS line, l.pos FROM docs,
          LATERAL (SELECT unnest(string_split(text, chr(10))) AS line,
                          generate_subscripts(string_split(text, chr(10)), 1) AS pos) l),
kept AS (SELECT * FROM lines WHERE length(line) >= 5 AND NOT regexp_matches(line, '^[\\p{{Nd}}-]')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS line_no FROM kept),
t AS (SELECT * FROM {SQL_TARGETS})
SELECT r.doc_id, r.intent, CAST(r.line_no AS INTEGER) AS line_no, md5(r.line) AS line_md5
FROM r JOIN t ON t.intent = r.intent WHERE r.line_no <= t.target""")
def generated_line_cleaning(spark, d):
    docs = (tb.table(spark, d, "documents").filter(F.col("text").isNotNull())
            .select("doc_id", cu.map_label("lang", tx.LANG_LABEL_MAP).alias("intent"), "text"))
    limit = cu.literal_map(tx.SYNTHETIC_TARGET_PER_INTENT)[F.col("intent")]
    out = us.clean_generated_lines(docs, limit)
    return out.select("doc_id", "intent", "line_no", F.md5("line").alias("line_md5"))


# --- taxonomy reports -------------------------------------------------------------------

def _source_labels(spark, d):
    """Raw labels of two sources (part types, event types) in one frame."""
    part = tb.table(spark, d, "part").select(F.lit("part").alias("source"), F.col("p_type").alias("raw_label"))
    ev = tb.table(spark, d, "events").select(F.lit("events").alias("source"), F.col("event_type").alias("raw_label"))
    return part.unionByName(ev)


SQL_SOURCE_LABELS = """src AS (SELECT 'part' AS source, p_type AS raw_label FROM part
        UNION ALL SELECT 'events', event_type FROM events)"""


@query("source_label_set", covers="A6 U1 J1 F5",
       sql=f"""WITH {SQL_SOURCE_LABELS}
SELECT source, raw_label, {cu.sql_map_label('raw_label')} AS canonical_label, count(*) AS n
FROM src GROUP BY source, raw_label""")
def source_label_set(spark, d):
    s = _source_labels(spark, d)
    return s.groupBy("source", "raw_label").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("canonical_label", cu.map_label("raw_label"))


@query("unmapped_labels", covers="A7 U3 T4",
       sql=f"""WITH {SQL_SOURCE_LABELS},
u AS (SELECT raw_label, count(*) AS n FROM src WHERE {cu.sql_map(fx.sql_label_key('raw_label'), tx.SOURCE_LABEL_MAP)} IS NULL
      GROUP BY raw_label)
SELECT raw_label, n, (SELECT count(*) FROM u) > 10 AS needs_review FROM u""")
def unmapped_labels(spark, d):
    keys = spark.createDataFrame([(k,) for k in sorted(tx.SOURCE_LABEL_MAP)], "source_key string")
    u = (_source_labels(spark, d).withColumn("source_key", fx.label_key("raw_label"))
         .join(F.broadcast(keys), "source_key", "left_anti")          # fixed 77-row dimension
         .groupBy("raw_label").agg(F.count(F.lit(1)).alias("n")))
    # the flag is one row of an aggregate; the labels stay spread over their partitions
    u = write_once(u, "unmapped-labels")
    return u.withColumn("needs_review", F.lit(u.count() > 10))


@query("label_id_filter", covers="P4 U1 J1 J2",
       sql=f"""WITH m AS (SELECT 'events' AS source, {cu.sql_map_label('event_type', tx.EVENT_LABEL_MAP)} AS label FROM events
        UNION ALL SELECT 'part', p_type FROM part),
i AS (SELECT source, label, {cu.sql_label_id('label')} AS label_id FROM m)
SELECT source, label, label_id, count(*) AS n FROM i WHERE label_id IS NOT NULL GROUP BY source, label, label_id
UNION ALL SELECT source, NULL, NULL, count(*) FROM i WHERE label_id IS NULL GROUP BY source""")
def label_id_filter(spark, d):
    ev = tb.table(spark, d, "events").select(F.lit("events").alias("source"),
                                             cu.map_label("event_type", tx.EVENT_LABEL_MAP).alias("label"))
    # the verbatim source: labels used as canonical without mapping (synthetic-style)
    part = tb.table(spark, d, "part").select(F.lit("part").alias("source"), F.col("p_type").alias("label"))
    both = ev.unionByName(part).withColumn("label_id", cu.label_id("label"))
    kept = both.filter(F.col("label_id").isNotNull()).groupBy("source", "label", "label_id") \
        .agg(F.count(F.lit(1)).alias("n"))
    dropped = both.filter(F.col("label_id").isNull()).groupBy("source").agg(F.count(F.lit(1)).alias("n")) \
        .select("source", F.lit(None).cast("string").alias("label"), F.lit(None).cast("int").alias("label_id"), "n")
    return kept.unionByName(dropped)
