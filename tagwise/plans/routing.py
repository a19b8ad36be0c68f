"""Ticket routing and governance queries (batch forms of the webhook path)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwise import taxonomy as tx
from tagwise.functions import crypto
from tagwise.functions import payload as pl
from tagwise.functions import text as fx
from tagwise.operators import asof
from tagwise.operators import curate as cu
from tagwise.operators import evaluate as ev
from tagwise.operators import naive_bayes as nb
from tagwise.operators import ordered
from tagwise.operators import privacy as pv
from tagwise.operators import route as rt
from tagwise.plans import scoring
from tagwise.plans.registry import query
from tagwise.session import materialize
from tagwise.sources import settings as st
from tagwise.sources import tables as tb
from tagwise.streaming import tagging as stag

ALL_SQL = "[" + ", ".join(f"'{x}'" for x in tx.LABELS) + "]"


def _sql_tag(intent: str, below: str, enabled: str) -> str:
    eff = f"(CASE WHEN {enabled} IS NULL OR len({enabled}) = 0 THEN {ALL_SQL} ELSE {enabled} END)"
    return (f"CASE WHEN NOT {below} AND list_contains({eff}, {intent}) "
            f"THEN coalesce({cu.sql_map(intent, tx.INTENT_TO_TAG)}, '{tx.UNCLASSIFIED_TAG}') "
            f"ELSE '{tx.UNCLASSIFIED_TAG}' END")


# --- ST2 parse ------------------------------------------------------------------------

SQL_PARSED = f"""pay AS ({tb.SQL_TICKET_PAYLOADS}),
parsed AS (SELECT conv_id, turn, account_id, {pl.sql_parse_ticket_payload('value')['from_agent']} AS from_agent,
                  {pl.sql_parse_ticket_payload('value')['ticket_id']} AS ticket_id,
                  {pl.sql_parse_ticket_payload('value')['text']} AS text
           FROM pay WHERE json_valid(value))"""


@query("ticket_payload_parse", covers="ST2 F6 F7 F11 F12 S14",
       sql=f"""WITH {SQL_PARSED}
SELECT conv_id, turn, account_id, from_agent, ticket_id, md5(text) AS text_md5,
       CAST(length(text) AS INTEGER) AS text_len FROM parsed""")
def ticket_payload_parse(spark, d):
    parsed, _ = rt.parse_events(tb.ticket_payloads(spark, d))
    return parsed.select("conv_id", "turn", "account_id", "from_agent", "ticket_id",
                         F.md5("text").alias("text_md5"), F.length("text").alias("text_len"))


# --- ST1 batch: tag tickets -----------------------------------------------------------

def tagged_tickets(spark, d):
    parsed, _ = rt.parse_events(tb.ticket_payloads(spark, d))
    known = rt.known_accounts(rt.customer_messages(parsed), tb.installed_accounts(spark, d))
    ready = rt.usable(rt.with_settings(known, tb.account_settings(spark, d)))
    ready = ready.withColumn("msg_id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))) \
        .withColumn("text_hash", fx.text_hash("text"))
    # written once: the scorer reads the tokens and the other columns apart
    ready = materialize(ready.select("conv_id", "turn", "account_id", "ticket_id", "text", "text_hash", "msg_id", "threshold", "enabled_intents"),
                        "parsed-tickets")
    return rt.score_and_tag(ready, scoring.nb_model(spark, d), "msg_id", None,
                            keep=["conv_id", "turn", "account_id", "ticket_id", "text_hash"])


SQL_TAGGED = f"""{SQL_PARSED},
sett AS ({tb.SQL_ACCOUNT_SETTINGS}),
ready AS (SELECT p.conv_id::VARCHAR || ':' || p.turn::VARCHAR AS msg_id, p.*, coalesce(s.confidence_threshold, 0.70::DOUBLE) AS threshold,
                 s.enabled_intents
          FROM parsed p LEFT JOIN sett s ON s.account_id = p.account_id
          WHERE NOT p.from_agent AND p.account_id IN (SELECT c_custkey FROM customer)
            AND p.text <> '' AND p.ticket_id <> 0),
{nb.sql_scores(f'''{scoring.SQL_NB_TRAIN},
test AS (SELECT msg_id, {fx.sql_letter_tokens('text')} AS toks FROM ready)''', 'msg_id')},
scored AS (SELECT r.*, b.confidence, b.pred AS intent_raw
           FROM ready r JOIN best b ON b.msg_id = r.msg_id),
tagged AS (SELECT *, confidence < threshold AS below_threshold,
                  CASE WHEN confidence < threshold THEN 'OTHER' ELSE intent_raw END AS intent FROM scored),
tagged2 AS (SELECT *, {_sql_tag('intent', 'below_threshold', 'enabled_intents')} AS tag FROM tagged)"""


@query("ticket_tags", covers="ST1 P9 J5 P11 J4 P10 M2 P5 P13 J3 T1",
       sql=f"""WITH {SQL_TAGGED}
SELECT conv_id, turn, account_id, ticket_id, threshold, intent, confidence, below_threshold, tag FROM tagged2""")
def ticket_tags(spark, d):
    return tagged_tickets(spark, d).select("conv_id", "turn", "account_id", "ticket_id", "threshold",
                                           "intent", "confidence", "below_threshold", "tag")


@query("ticket_routing", covers="J13",
       sql=f"""WITH {SQL_TAGGED}
SELECT conv_id, turn, tag, {cu.sql_map('tag', {x[0]: x[1] for x in tx.ROUTING_RULES if x[1]})} AS team,
       {cu.sql_map('tag', {x[0]: x[2] for x in tx.ROUTING_RULES if x[2]})} AS priority,
       {cu.sql_map('tag', {x[0]: x[3] for x in tx.ROUTING_RULES if x[3]})} AS macro,
       (intent = '{tx.AUTO_REPLY_INTENT}' AND confidence >= {tx.AUTO_REPLY_MIN_CONFIDENCE}) AS auto_reply
FROM tagged2""")
def ticket_routing(spark, d):
    return rt.route(tagged_tickets(spark, d)).select("conv_id", "turn", "tag", "team", "priority", "macro",
                                                     "auto_reply")


@query("automation_share", covers="A26",
       sql=f"""WITH {SQL_TAGGED}
SELECT count(*) AS n, round(avg(CASE WHEN tag <> '{tx.UNCLASSIFIED_TAG}' THEN 1.0 ELSE 0.0 END), 4)
       AS automation_share FROM tagged2""")
def automation_share(spark, d):
    return ev.automation_share(tagged_tickets(spark, d))


# --- ST1 / ST3 whole: signature, rejects, failed decisions ------------------------------

SQL_DECIDED = f"""ev AS ({tb.SQL_TICKET_EVENTS}),
accepted AS (SELECT *, CASE WHEN json_valid(value) THEN value ELSE '{{}}' END AS doc FROM ev WHERE signature_status <> 'invalid'),
read_ AS (SELECT conv_id, turn, account_id, ts, json_valid(value) AS ok, {pl.sql_parse_ticket_payload('doc')['from_agent']} AS from_agent,
                 {pl.sql_parse_ticket_payload('doc')['ticket_id']} AS ticket_id, {pl.sql_parse_ticket_payload('doc')['text']} AS text
          FROM accepted),
triaged AS (SELECT *, CASE WHEN NOT ok THEN 'malformed' WHEN from_agent THEN 'agent_message'
                           WHEN account_id NOT IN (SELECT c_custkey FROM customer) THEN 'unknown_account'
                           WHEN text = '' OR ticket_id = 0 THEN 'unusable' ELSE 'ready' END AS outcome FROM read_),
rejects AS (SELECT conv_id, turn, account_id, outcome AS reason, ts FROM triaged WHERE outcome NOT IN ('ready', 'agent_message')
            UNION ALL SELECT conv_id, turn, account_id, 'invalid_signature', ts FROM ev WHERE signature_status = 'invalid'),
sett AS ({tb.SQL_ACCOUNT_SETTINGS}),
ready AS (SELECT p.conv_id::VARCHAR || ':' || p.turn::VARCHAR AS msg_id, p.*, coalesce(s.confidence_threshold, 0.70::DOUBLE) AS threshold,
                 s.enabled_intents, {fx.sql_letter_tokens('p.text')} AS toks
          FROM triaged p LEFT JOIN sett s ON s.account_id = p.account_id WHERE outcome = 'ready'),
{nb.sql_scores(f"""{scoring.SQL_NB_TRAIN},
test AS (SELECT msg_id, toks FROM ready)""", 'msg_id')},
scored AS (SELECT r.*, len(r.toks) > 0 AS success, CASE WHEN len(r.toks) > 0 THEN b.confidence ELSE 0.0::DOUBLE END AS confidence, b.pred AS intent_raw
           FROM ready r JOIN best b ON b.msg_id = r.msg_id),
tagged AS (SELECT *, NOT success OR confidence < threshold AS below_threshold,
                  CASE WHEN NOT success OR confidence < threshold THEN 'OTHER' ELSE intent_raw END AS intent FROM scored),
decided AS (SELECT *, {_sql_tag('intent', 'below_threshold', 'enabled_intents')} AS tag, {fx.sql_text_hash('text')} AS text_hash FROM tagged)"""


def decided_deliveries(spark, d):
    """Batch form of the tagging stream: every delivery with its outcome and decision."""
    return stag.decided(tb.ticket_events(spark, d), [tb.WEBHOOK_SECRET], scoring.nb_model(spark, d),
                        tb.installed_accounts(spark, d), tb.account_settings(spark, d), None)


@query("ticket_classification_log", covers="S12 ST3 F2",
       sql=f"""WITH {SQL_DECIDED}
SELECT account_id, ticket_id, text_hash, intent, confidence, success, ts FROM decided""")
def ticket_classification_log(spark, d):
    return stag.Sinks.MADE["log"](decided_deliveries(spark, d))


@query("webhook_rejects", covers="ST1 F14",
       sql=f"WITH {SQL_DECIDED}\nSELECT conv_id, turn, account_id, reason, ts FROM rejects")
def webhook_rejects(spark, d):
    """Deliveries that are not classified, with the first check they fail; invalid signatures are
    not parsed."""
    return stag.Sinks.MADE["rejects"](decided_deliveries(spark, d))


@query("unknown_account_events", covers="J5 P11",
       sql=f"""WITH {SQL_PARSED}
SELECT account_id, count(*) AS rejected FROM parsed
WHERE NOT from_agent AND account_id NOT IN (SELECT c_custkey FROM customer) GROUP BY account_id""")
def unknown_account_events(spark, d):
    parsed, _ = rt.parse_events(tb.ticket_payloads(spark, d))
    rej = rt.unknown_accounts(rt.customer_messages(parsed), tb.installed_accounts(spark, d))
    return rej.groupBy("account_id").agg(F.count(F.lit(1)).alias("rejected"))


# --- A21 counters over the classification log ------------------------------------------

@query("webhook_counters", covers="A21 ST6",
       sql=f"""WITH log AS ({tb.SQL_CLASSIFICATION_LOG})
SELECT account_id, count(*) AS total_classified, count(*) FILTER (WHERE NOT success) AS total_errors,
       max(ts) AS last_processed_at FROM log GROUP BY account_id""")
def webhook_counters(spark, d):
    return rt.webhook_counters(tb.classification_log(spark, d))


# --- opt-in capture / erasure -----------------------------------------------------------

def _calls(spark, d):
    log = tb.classification_log(spark, d)
    header = F.when(F.col("account_id") % 4 == 0, F.lit("")).otherwise(F.col("account_id").cast("string"))
    ip = F.concat(F.lit("10.0.0."), (F.col("account_id") % 256).cast("string"))
    return log.withColumn("user_key", fx.user_key(header, ip))


def _opt_in_changes(calls):
    """Opt-in change log: signups set the caller's opt-in, sequenced with the calls."""
    return (calls.filter(F.col("event_type") == "signup")
            .select("user_key", "ts", F.col("ticket_id").alias("seq"),
                    (F.col("ticket_id") % 3 != 0).alias("opt_in")))


def captured(spark, d):
    calls = _calls(spark, d)
    # only the low-confidence calls look up their opt-in, and without their texts
    low = calls.filter(F.col("confidence") < tx.LOW_CONFIDENCE_CAPTURE) \
        .select("user_key", "ts", "ticket_id", fx.text_hash("text").alias("text_hash"), "intent", "confidence")
    at_call = asof.asof_lookup(low, _opt_in_changes(calls), "user_key", "ts", ["opt_in"], event_seq="ticket_id")
    opted = at_call.filter(F.coalesce("opt_in", F.lit(False)))
    return opted.select(fx.file_key("user_key").alias("file_key"), "user_key", "ticket_id",
                      "text_hash", "intent",
                      F.round("confidence", 4).alias("confidence"), "ts")


SQL_CAPTURED = f"""log AS ({tb.SQL_CLASSIFICATION_LOG}),
calls AS (SELECT *, coalesce('rapid_' || nullif(CASE WHEN account_id % 4 = 0 THEN '' ELSE account_id::VARCHAR END, ''),
                             'direct_' || substr(md5('10.0.0.' || (account_id % 256)::VARCHAR), 1, 12)) AS user_key
          FROM log),
ch AS (SELECT user_key, ts, ticket_id AS seq, ticket_id % 3 <> 0 AS opt_in FROM calls WHERE event_type = 'signup'),
iv AS (SELECT *, lead(ts) OVER (PARTITION BY user_key ORDER BY ts, seq) AS valid_to,
              lead(seq) OVER (PARTITION BY user_key ORDER BY ts, seq) AS next_seq FROM ch),
at_call AS (SELECT c.*, iv.opt_in FROM calls c LEFT JOIN iv ON iv.user_key = c.user_key
            AND (c.ts > iv.ts OR (c.ts = iv.ts AND c.ticket_id >= iv.seq))
            AND (iv.valid_to IS NULL OR c.ts < iv.valid_to OR (c.ts = iv.valid_to AND c.ticket_id < iv.next_seq))),
cap AS (SELECT md5(user_key) AS file_key, user_key, ticket_id, {fx.sql_text_hash('text')} AS text_hash, intent,
               round(confidence, 4) AS confidence, ts
        FROM at_call WHERE coalesce(opt_in, FALSE) AND confidence < {tx.LOW_CONFIDENCE_CAPTURE}::DOUBLE)"""


@query("optin_capture_log", covers="P12 J6 F8 F2 S13 J8",
       sql=f"WITH {SQL_CAPTURED}\nSELECT * FROM cap")
def optin_capture_log(spark, d):
    return captured(spark, d)


def _erasure_requests(spark, d):
    """Users whose account id is a multiple of 10 ask for deletion."""
    calls = _calls(spark, d).filter(F.col("account_id") % 10 == 0).select("user_key").distinct()
    return calls.select(fx.file_key("user_key").alias("file_key"))


SQL_REQUESTS = """req AS (SELECT DISTINCT md5(user_key) AS file_key FROM calls WHERE account_id % 10 = 0)"""


@query("optin_erasure_counts", covers="A23 U4",
       sql=f"""WITH {SQL_CAPTURED}, {SQL_REQUESTS}
SELECT r.file_key, CAST(coalesce(c.n, 0) AS BIGINT) AS examples_deleted FROM req r
LEFT JOIN (SELECT file_key, count(*) AS n FROM cap GROUP BY file_key) c ON c.file_key = r.file_key""")
def optin_erasure_counts(spark, d):
    _, counts = pv.erase(captured(spark, d), _erasure_requests(spark, d))
    return counts


@query("optin_log_after_erasure", covers="U4 U3",
       sql=f"""WITH {SQL_CAPTURED}, {SQL_REQUESTS}
SELECT * FROM cap WHERE file_key NOT IN (SELECT file_key FROM req)""")
def optin_log_after_erasure(spark, d):
    remaining, _ = pv.erase(captured(spark, d), _erasure_requests(spark, d))
    return remaining


# --- settings snapshot ---------------------------------------------------------------------

def settings_changes(spark, d):
    """``events`` as settings updates: click/view set the threshold (value/400, 2 dp),
    signup sets the enabled intents (validated, duplicates kept), purchase sets the API
    key; error rows change nothing (all-null partial update). An update whose threshold
    lies outside [0, 1] is rejected as a whole (P6), like a failed request validation."""
    e = tb.table(spark, d, "events")
    et = F.col("event_type")
    raw_list = F.array(F.lit("WISMO"), F.lit("BOGUS"),
                       cu.literal_map(dict(enumerate(tx.LABELS)))[F.col("event_id") % 9], F.lit("WISMO"))
    thr = F.when(et.isin("click", "view"), F.round(F.col("value") / 400, 2))
    return e.filter(thr.isNull() | thr.between(0.0, 1.0)).select(
        F.col("user_id").alias("account_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        thr.alias("confidence_threshold"),
        F.when(et == "signup", rt.valid_intents(raw_list)).alias("enabled_intents"),
        F.when(et == "purchase", F.concat(F.lit("key_"), F.col("event_id").cast("string"))).alias("api_key"))


@query("settings_snapshot", covers="S15 F18 P14 J4 F15 P6",
       sql=f"""WITH ev AS (
  SELECT *, CASE WHEN event_type IN ('click', 'view') THEN round(value / 400, 2) END AS thr FROM events),
ch AS (
  SELECT user_id AS account_id, ts, event_id AS seq, thr AS confidence_threshold,
         CASE WHEN event_type = 'signup' THEN list_filter(['WISMO', 'BOGUS',
              {cu.sql_map('event_id % 9', dict(enumerate(tx.LABELS)))}, 'WISMO'],
              lambda x: list_contains({ALL_SQL}, x)) END AS enabled_intents,
         CASE WHEN event_type = 'purchase' THEN 'key_' || event_id::VARCHAR END AS api_key
  FROM ev WHERE thr IS NULL OR thr BETWEEN 0.0 AND 1.0),
snap AS (SELECT account_id,
   arg_max(confidence_threshold, (ts, seq)) FILTER (WHERE confidence_threshold IS NOT NULL) AS confidence_threshold,
   arg_max(enabled_intents, (ts, seq)) FILTER (WHERE enabled_intents IS NOT NULL) AS enabled_intents,
   arg_max(api_key, (ts, seq)) FILTER (WHERE api_key IS NOT NULL) AS api_key,
   min(ts) AS created_at, max(ts) AS updated_at FROM ch GROUP BY account_id)
SELECT c.c_custkey AS account_id, coalesce(s.api_key, '') AS api_key,
       coalesce(s.confidence_threshold, 0.70::DOUBLE) AS confidence_threshold,
       array_to_string(coalesce(s.enabled_intents, {ALL_SQL}), ',') AS enabled_intents,
       'free' AS plan, s.created_at, s.updated_at
FROM customer c LEFT JOIN snap s ON s.account_id = c.c_custkey""")
def settings_snapshot(spark, d):
    snap = st.snapshot(settings_changes(spark, d), ["api_key", "confidence_threshold", "enabled_intents"])
    snap = snap.withColumn("plan", F.lit(None).cast("string"))
    out = st.with_defaults(tb.installed_accounts(spark, d), snap)
    return out.select("account_id", "api_key", "confidence_threshold",
                      F.array_join("enabled_intents", ",").alias("enabled_intents"), "plan",
                      "created_at", "updated_at")


PAY_BASE = "https://billing.example/pay"


@query("payment_links", covers="F17",
       sql=f"""SELECT c_custkey AS account_id,
       '{PAY_BASE}?client_reference_id=' || url_encode(c_custkey::VARCHAR) AS payment_link FROM customer""")
def payment_links(spark, d):
    return tb.installed_accounts(spark, d).select("account_id", fx.payment_link(PAY_BASE, "account_id")
                                                  .alias("payment_link"))


TOKEN_AS_OF = "1998-08-01 00:00:00"


@query("expiring_tokens", covers="P15 F13",
       sql=f"""WITH inst AS (
  SELECT o_custkey % 100 AS account_id, arg_max(o_orderdate, (o_orderdate, o_orderkey)) AS installed_at
  FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '{TOKEN_AS_OF}' GROUP BY account_id)
SELECT account_id, installed_at, installed_at + INTERVAL {tx.TOKEN_EXPIRY_SECONDS} SECOND AS expires_at,
       installed_at + INTERVAL {tx.TOKEN_EXPIRY_SECONDS} SECOND
         < TIMESTAMP '{TOKEN_AS_OF}' + INTERVAL {tx.TOKEN_REFRESH_MARGIN_SECONDS} SECOND AS needs_refresh
FROM inst""")
def expiring_tokens(spark, d):
    o = tb.table(spark, d, "orders")
    as_of = F.lit(TOKEN_AS_OF).cast("timestamp")
    inst = (o.filter((F.col("o_orderstatus") == "O") & (F.col("o_orderdate").cast("timestamp") <= as_of))
             .groupBy((F.col("o_custkey") % 100).alias("account_id"))
             .agg(F.max(F.col("o_orderdate").cast("timestamp")).alias("installed_at")))
    exp = F.col("installed_at") + F.expr(f"INTERVAL {tx.TOKEN_EXPIRY_SECONDS} SECONDS")
    return inst.select("account_id", "installed_at", exp.alias("expires_at"),
                       (exp < as_of + F.expr(f"INTERVAL {tx.TOKEN_REFRESH_MARGIN_SECONDS} SECONDS"))
                       .alias("needs_refresh"))


# --- request validation / batching ------------------------------------------------------

@query("input_validation", covers="P6 P7 F1 F7",
       sql=f"""SELECT doc_id,
  CASE WHEN length(text) > {tx.MAX_TEXT_LENGTH} THEN 'rejected' WHEN length(text) = 0 THEN 'rejected'
       ELSE 'valid' END AS status,
  CASE WHEN length(text) > {tx.MAX_TEXT_LENGTH} THEN 'too_long' WHEN length(text) = 0 THEN 'empty' END AS reject_reason,
  CASE WHEN length(text) BETWEEN 1 AND {tx.MAX_TEXT_LENGTH} THEN md5({fx.sql_strip('text')}) END AS single_clean_md5,
  md5({fx.sql_strip(f'substr(text, 1, {tx.MAX_TEXT_LENGTH})')}) AS batch_clean_md5
FROM documents WHERE text IS NOT NULL""")
def input_validation(spark, d):
    t = tb.table(spark, d, "documents").filter(F.col("text").isNotNull())
    n = F.length("text")
    reason = F.when(n > tx.MAX_TEXT_LENGTH, "too_long").when(n == 0, "empty")
    return t.select("doc_id", F.when(reason.isNull(), "valid").otherwise("rejected").alias("status"),
                    reason.alias("reject_reason"),
                    F.when(reason.isNull(), F.md5(fx.strip("text"))).alias("single_clean_md5"),
                    F.md5(fx.strip(fx.truncate("text", tx.MAX_TEXT_LENGTH))).alias("batch_clean_md5"))


@query("request_batches", covers="P8",
       sql=f"""WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
           FROM conversations WHERE role = 'user')
SELECT conv_id, CAST((rn - 1) // {tx.MAX_BATCH_SIZE} AS INTEGER) AS batch_no, count(*) AS n_texts
FROM u GROUP BY conv_id, batch_no""")
def request_batches(spark, d):
    u = tb.table(spark, d, "conversations").filter(F.col("role") == "user").select("conv_id", "turn")
    ranked = ordered.rank_in_key(u, "conv_id", ["turn"], name="rn")    # skew-safe per-conversation rank
    return (ranked.groupBy("conv_id", F.floor((F.col("rn") - 1) / tx.MAX_BATCH_SIZE).cast("int").alias("batch_no"))
                  .agg(F.count(F.lit(1)).alias("n_texts")))


@query("batch_mean_latency", covers="A22 F9",
       sql="""SELECT l_orderkey AS request_id, count(*) AS n_texts, round(sum(l_quantity), 2) AS total_latency_ms,
       round(round(sum(l_quantity), 2) / count(*), 2) AS latency_ms FROM lineitem GROUP BY l_orderkey""")
def batch_mean_latency(spark, d):
    li = tb.table(spark, d, "lineitem")
    g = li.groupBy(F.col("l_orderkey").alias("request_id")).agg(
        F.count(F.lit(1)).alias("n_texts"), F.round(F.sum("l_quantity"), 2).alias("total_latency_ms"))
    return g.withColumn("latency_ms", F.round(F.col("total_latency_ms") / F.col("n_texts"), 2))


@query("html_text", covers="F6",
       sql=f"""SELECT page_id, md5({fx.sql_strip_html('html')}) AS text_md5,
       CAST(length({fx.sql_strip_html('html')}) AS INTEGER) AS text_len FROM pages""")
def html_text(spark, d):
    p = tb.table(spark, d, "pages")
    t = fx.strip_html("html")
    return p.select("page_id", F.md5(t).alias("text_md5"), F.length(t).alias("text_len"))


@query("label_names", covers="F10 J2",
       sql=f"""SELECT vec_id, 'LABEL_' || label::VARCHAR AS raw_label,
       TRY_CAST(regexp_extract('LABEL_' || label::VARCHAR, '^LABEL_([0-9]+)$', 1) AS INTEGER) AS label_id,
       {cu.sql_map("TRY_CAST(regexp_extract('LABEL_' || label::VARCHAR, '^LABEL_([0-9]+)$', 1) AS INTEGER)",
                   dict(enumerate(tx.LABELS)))} AS label_name FROM embeddings""")
def label_names(spark, d):
    e = tb.table(spark, d, "embeddings")
    raw = F.concat(F.lit("LABEL_"), F.col("label").cast("string"))
    idx = fx.label_index(raw)
    return e.select("vec_id", raw.alias("raw_label"), idx.alias("label_id"), cu.id_to_label(idx).alias("label_name"))


TEST_SECRET = "test-secret-1"
OTHER_SECRET = "not-the-secret"


def _signed(spark, d):
    pay = tb.ticket_payloads(spark, d).withColumn("body", F.encode("value", "UTF-8"))
    sig = (F.when(F.col("turn") % 3 == 0, crypto.hmac_sha256_b64(F.col("body"), TEST_SECRET))
           .when(F.col("turn") % 3 == 1, crypto.hmac_sha256_b64(F.col("body"), OTHER_SECRET))
           .otherwise(F.lit("")))
    return pay.withColumn("signature", sig)


@query("signature_check", covers="F14",
       sql=f"""WITH pay AS ({tb.SQL_TICKET_PAYLOADS}),
s AS (SELECT conv_id, turn, encode(value) AS body, turn FROM pay),
g AS (SELECT conv_id, turn, body, CASE WHEN turn % 3 = 0 THEN {crypto.sql_hmac_sha256_b64('body', TEST_SECRET)}
                                    WHEN turn % 3 = 1 THEN {crypto.sql_hmac_sha256_b64('body', OTHER_SECRET)}
                                    ELSE '' END AS signature FROM pay, LATERAL (SELECT encode(value) AS body))
SELECT conv_id, turn, CASE WHEN signature = '' THEN 'missing'
                           WHEN {crypto.sql_hmac_sha256_b64('body', TEST_SECRET)} = signature THEN 'valid'
                           ELSE 'invalid' END AS status FROM g""")
def signature_check(spark, d):
    s = _signed(spark, d)
    return s.select("conv_id", "turn", crypto.signature_status(F.col("body"), F.col("signature"),
                                                               [TEST_SECRET]).alias("status"))
