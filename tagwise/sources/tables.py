"""Driver tables and the fixture bindings that give them ticket-analytics roles.

Each loader reads only parquet through ``spark.read.parquet`` and selects the columns it
needs, so Catalyst prunes the scan (``ReadSchema``) and pushes filters to the reader.
The bindings (which column plays which role) are documented in FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwise import taxonomy as tx
from tagwise.functions import text as fx

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name``, one plan at every size: filters and columns reach the scan, and
    its splits (``spark.sql.files.maxPartitionBytes``, row groups) are its parallelism."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- ticket corpus ------------------------------------------------------------------

def raw_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a raw labelled source: ``doc_id, text, label (raw), source``.

    ``doc_id`` is the stable order key (the reference keeps the first row in file order).
    """
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("lang").alias("raw_label"), "source")


# --- accounts / settings ------------------------------------------------------------



def installed_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token registry: every ``customer`` key is an installed account."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"))


def account_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored settings documents, deterministic from the key; keys with ``key % 5 = 0``
    have no document (defaults apply).

    threshold: key % 4 -> 0.70, 0.75, 0.50, unset (null -> default 0.70)
    enabled:   key % 3 -> unset (all), [WISMO, RETURN_REQUEST], [] (empty = all)
    opt_in:    key % 2 == 0
    """
    k = F.col("c_custkey")
    threshold = (F.when(k % 4 == 0, F.lit(0.70)).when(k % 4 == 1, F.lit(0.75))
                 .when(k % 4 == 2, F.lit(0.50)).otherwise(F.lit(None).cast("double")))
    enabled = (F.when(k % 3 == 1, F.array(F.lit("WISMO"), F.lit("RETURN_REQUEST")))
               .when(k % 3 == 2, F.array().cast("array<string>"))
               .otherwise(F.lit(None).cast("array<string>")))
    return table(spark, sf_dir, "customer").filter(k % 5 != 0).select(
        k.alias("account_id"), threshold.alias("confidence_threshold"),
        enabled.alias("enabled_intents"), (k % 2 == 0).alias("opt_in"))


SQL_ACCOUNT_SETTINGS = """
SELECT c_custkey AS account_id,
       CASE c_custkey % 4 WHEN 0 THEN 0.70::DOUBLE WHEN 1 THEN 0.75::DOUBLE
                          WHEN 2 THEN 0.50::DOUBLE ELSE NULL::DOUBLE END AS confidence_threshold,
       CASE c_custkey % 3 WHEN 1 THEN ['WISMO', 'RETURN_REQUEST']
                          WHEN 2 THEN []::VARCHAR[] ELSE NULL::VARCHAR[] END AS enabled_intents,
       (c_custkey % 2 = 0) AS opt_in
FROM customer WHERE c_custkey % 5 <> 0"""


# --- ticket events from conversations -----------------------------------------------

def ticket_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` re-encoded as helpdesk webhook payloads (JSON strings).

    ticket id = conv_id + 1 (0 would mean missing); account = conv_id, except every
    fourth conversation, whose account is -(conv_id + 1): never a ``customer`` key, so
    a quarter of the traffic comes from unknown accounts at every scale;
    ``role != 'user'`` -> ``from_agent = "True"``. Every third turn uses the nested
    ``event.object`` shape with the text as ``body_html``; every fifth is unsigned-flat
    with an HTML-wrapped body; the rest are flat.
    """
    return _payloads(table(spark, sf_dir, "conversations"))


def _payloads(c: DataFrame) -> DataFrame:
    tid = (F.col("conv_id") + 1).cast("string")
    agent = F.when(F.col("role") == "user", F.lit("False")).otherwise(F.lit("True"))
    flat = F.to_json(F.struct(tid.alias("ticket_id"), agent.alias("from_agent"),
                              F.col("text").alias("body_text"), F.lit("").alias("subject")))
    flat_html = F.to_json(F.struct(tid.alias("ticket_id"), agent.alias("from_agent"),
                                   F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")).alias("body_text")))
    nested = F.to_json(F.struct(
        agent.alias("from_agent"),
        F.struct(F.struct((F.col("conv_id") + 1).alias("id"),
                          F.array(F.struct(F.lit("").alias("body_text"),
                                           F.col("text").alias("body_html"))).alias("messages"),
                          F.lit("subject line").alias("subject")).alias("object")).alias("event")))
    value = (F.when(F.col("turn") % 3 == 2, nested)
             .when(F.col("turn") % 5 == 4, flat_html).otherwise(flat))
    return c.select("conv_id", "turn", F.when(F.col("conv_id") % 4 == 3, -(F.col("conv_id") + 1))
                    .otherwise(F.col("conv_id")).alias("account_id"),
                    value.alias("value"))


SQL_TICKET_PAYLOADS = """
SELECT conv_id, turn, CASE WHEN conv_id % 4 = 3 THEN -(conv_id + 1) ELSE conv_id END AS account_id,
  CASE WHEN turn % 3 = 2 THEN
         json_object('from_agent', CASE WHEN role = 'user' THEN 'False' ELSE 'True' END,
                     'event', json_object('object', json_object('id', conv_id + 1,
                        'messages', [json_object('body_text', '', 'body_html', text)],
                        'subject', 'subject line')))::VARCHAR
       WHEN turn % 5 = 4 THEN
         json_object('ticket_id', (conv_id + 1)::VARCHAR,
                     'from_agent', CASE WHEN role = 'user' THEN 'False' ELSE 'True' END,
                     'body_text', '<p>' || text || '</p>')::VARCHAR
       ELSE
         json_object('ticket_id', (conv_id + 1)::VARCHAR,
                     'from_agent', CASE WHEN role = 'user' THEN 'False' ELSE 'True' END,
                     'body_text', text, 'subject', '')::VARCHAR
  END AS value
FROM conversations"""


#: A message of one number, which no classifier can place, in every seventh conversation; every
#: 13th conversation's payloads are cut short, hence malformed.
WEBHOOK_SECRET, WRONG_SECRET = "test-secret-1", "not-the-secret"


def ticket_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Webhook deliveries as they arrive: ``conv_id, turn, account_id, value, signature, ts``. By
    turn, a third is signed, a third signed with another secret and a third not signed."""
    from tagwise.functions import crypto
    c = table(spark, sf_dir, "conversations").withColumn(
        "text", F.when(F.col("conv_id") % 7 == 3, F.concat(F.col("conv_id").cast("string"), F.lit(" 4711"))).otherwise(F.col("text")))
    value = F.when(F.col("conv_id") % 13 == 5, F.substring("value", F.lit(1), F.length("value") - 1)).otherwise(F.col("value"))
    body = F.encode("value", "UTF-8")
    signature = F.when(F.col("turn") % 3 == 0, crypto.hmac_sha256_b64(body, WEBHOOK_SECRET)) \
        .when(F.col("turn") % 3 == 1, crypto.hmac_sha256_b64(body, WRONG_SECRET)).otherwise(F.lit(""))
    return _payloads(c).withColumn("value", value).withColumn("signature", signature) \
        .withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 600 + F.col("turn") * 30))


SQL_TICKET_EVENTS = f"""
SELECT conv_id, turn, account_id, CASE WHEN conv_id % 13 = 5 THEN value[:-2] ELSE value END AS value,
       CASE WHEN turn % 3 = 0 THEN 'valid' WHEN turn % 3 = 1 THEN 'invalid' ELSE 'missing' END AS signature_status,
       make_timestamp((1700000000 + conv_id * 600 + turn * 30) * 1000000) AS ts
FROM ({SQL_TICKET_PAYLOADS.replace('FROM conversations', """FROM (SELECT * REPLACE (
  CASE WHEN conv_id % 7 = 3 THEN conv_id::VARCHAR || ' 4711' ELSE text END AS text) FROM conversations)""")})"""


# --- classification log from events --------------------------------------------------

def event_confidence() -> F.Column:
    return (F.col("event_id") % 100) / F.lit(100.0)


def classification_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as the classification log: account = user_id, ticket = event_id,
    intent = mapped ``event_type``, confidence = (event_id % 100)/100,
    success = event_type <> 'error', latency = value (ms), text = props."""
    ev = table(spark, sf_dir, "events")
    label_map = F.create_map(*[x for kv in sorted(tx.EVENT_LABEL_MAP.items()) for x in map(F.lit, kv)])
    return ev.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("account_id"),
        F.col("event_id").alias("ticket_id"),
        F.col("event_type"),
        F.coalesce(label_map[fx.label_key("event_type")], F.lit(tx.DEFAULT_LABEL)).alias("intent"),
        event_confidence().alias("confidence"),
        (F.col("event_type") != "error").alias("success"),
        F.col("value").alias("latency_ms"),
        F.col("props").alias("text"))


def sql_event_intent(col: str = "event_type") -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sorted(tx.EVENT_LABEL_MAP.items()))
    return f"(CASE {fx.sql_label_key(col)} {whens} ELSE '{tx.DEFAULT_LABEL}' END)"


SQL_CLASSIFICATION_LOG = f"""
SELECT ts, user_id AS account_id, event_id AS ticket_id, event_type,
       {sql_event_intent()} AS intent,
       (event_id % 100) / 100.0::DOUBLE AS confidence,
       (event_type <> 'error') AS success, value AS latency_ms, props AS text
FROM events"""


# --- billing lifecycle from orders -----------------------------------------------------

BILLING_ACCOUNTS = 100


def billing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as a billing event log.

    status O -> checkout.session.completed (account = custkey % 100, customer = custkey)
    status P -> invoice.payment_failed (attempt = orderkey % 5 + 1, null when % 7 = 0)
    status F -> customer.subscription.deleted; event time = o_orderdate, ties by orderkey.
    """
    o = table(spark, sf_dir, "orders")
    etype = (F.when(F.col("o_orderstatus") == "O", F.lit("checkout.session.completed"))
             .when(F.col("o_orderstatus") == "P", F.lit("invoice.payment_failed"))
             .when(F.col("o_orderstatus") == "F", F.lit("customer.subscription.deleted")))
    attempt = F.when(F.col("o_orderkey") % 7 == 0, F.lit(None).cast("bigint")) \
        .otherwise(F.col("o_orderkey") % 5 + 1)
    return o.select(
        F.col("o_orderkey").alias("event_seq"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        etype.alias("type"),
        F.when(F.col("o_orderstatus") == "O", (F.col("o_custkey") % BILLING_ACCOUNTS).cast("string"))
        .alias("client_reference_id"),
        F.concat(F.lit("cus_"), F.col("o_custkey").cast("string")).alias("customer"),
        F.when(F.col("o_orderstatus") == "P", attempt).alias("attempt_count"))


SQL_BILLING_EVENTS = """
SELECT o_orderkey AS event_seq, o_orderdate AS ts,
       CASE o_orderstatus WHEN 'O' THEN 'checkout.session.completed'
                          WHEN 'P' THEN 'invoice.payment_failed'
                          WHEN 'F' THEN 'customer.subscription.deleted' END AS type,
       CASE WHEN o_orderstatus = 'O' THEN (o_custkey % 100)::VARCHAR END AS client_reference_id,
       'cus_' || o_custkey::VARCHAR AS customer,
       CASE WHEN o_orderstatus = 'P' THEN
            CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 5 + 1 END END AS attempt_count
FROM orders"""
