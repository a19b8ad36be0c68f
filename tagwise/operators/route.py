"""Ticket tagging and routing (ST1 batch form): parse -> agent skip -> known account ->
settings with defaults -> usable text -> score -> threshold -> enabled-intent gate ->
tag -> routing rule.

Joins: accounts and settings are dimension tables keyed by account id. They are joined
without a broadcast hint — AQE broadcasts them when their measured size is small and
falls back to a shuffle join otherwise (account tables grow with the customer base).
The tag and rule tables are fixed constants, so they are row-local map lookups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwise import taxonomy as tx
from tagwise.functions import crypto
from tagwise.functions import payload as pl
from tagwise.operators import curate as cu
from tagwise.operators import naive_bayes as nb


def all_intents() -> Column:
    return F.array(*[F.lit(x) for x in tx.LABELS])


def parse_events(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ST2: ``(parsed, quarantine)``; malformed payloads go to quarantine, not failure."""
    parsed = pl.parse_ticket_payload(raw)
    return parsed.filter(~F.col("malformed")), parsed.filter(F.col("malformed"))


#: How a delivery ends before it is scored, in the order of the checks; ``READY`` goes on.
REJECTED = ("invalid_signature", "malformed", "unknown_account", "unusable")
SKIPPED, READY = "agent_message", "ready"


def triage(events: DataFrame, secrets: list[str], installed: DataFrame, settings: DataFrame) -> DataFrame:
    """ST1 up to scoring: signature, then parse, agent skip, known account, settings, usable text.

    ``events`` carry ``value, signature, account_id``; an unsigned delivery is accepted, one whose
    signature no secret explains is rejected unparsed. Adds ``outcome`` (of :data:`REJECTED`,
    :data:`SKIPPED` or :data:`READY`), ``ticket_id, text, threshold, enabled_intents``; every delivery
    is one row. Which account is known is a left join, so that one pass tells all outcomes.
    """
    status = crypto.signature_status(F.encode("value", "UTF-8"), F.col("signature"), secrets)
    signed = events.withColumn("_invalid", status == "invalid")
    invalid = signed.where("_invalid").drop("_invalid").withColumn("outcome", F.lit(REJECTED[0]))
    parsed = pl.parse_ticket_payload(signed.where("NOT _invalid").drop("_invalid"))
    known = parsed.join(installed.select("account_id", F.lit(True).alias("_known")), "account_id", "left")
    outcome = (F.when(F.col("malformed"), REJECTED[1]).when(F.col("from_agent"), SKIPPED)
               .when(F.col("_known").isNull(), REJECTED[2])
               .when((F.col("text") == "") | (F.col("ticket_id") == 0), REJECTED[3]).otherwise(READY))
    checked = with_settings(known, settings).withColumn("outcome", outcome).drop("malformed", "from_agent", "_known")
    return checked.unionByName(invalid, allowMissingColumns=True)


def decide(ready: DataFrame, model: nb.NaiveBayesModel, class_to_intent: dict[str, str] | None) -> DataFrame:
    """ST3: a decision for every ready delivery, failed ones included. A text without a letter
    token cannot be classified: intent OTHER, confidence 0.0, the unclassified tag, and
    ``success`` false. Each text is scored once, however often it was delivered."""
    ready = ready.withColumn("_text", F.md5("text"))
    texts = ready.select("_text", "text").distinct().withColumn("tokens", nb.tokens("text")).where(F.size("tokens") > 0)
    scored = nb.score(model, texts, "_text").select("_text", "pred", "confidence")
    found = ready.join(scored, "_text", "left").drop("_text")
    ok = F.col("pred").isNotNull()
    intent = F.col("pred") if class_to_intent is None else cu.map_label("pred", class_to_intent)
    found = found.withColumn("success", ok).withColumn("confidence", F.coalesce("confidence", F.lit(0.0))) \
        .withColumn("intent_raw", F.when(ok, intent))
    found = nb.apply_threshold(found, F.col("threshold"))
    return found.withColumn("below_threshold", ~ok | F.col("below_threshold")) \
        .withColumn("intent", F.when(ok, F.col("intent")).otherwise(F.lit(tx.DEFAULT_LABEL))) \
        .withColumn("tag", choose_tag(F.col("intent"), F.col("below_threshold"), F.col("enabled_intents"))).drop("pred", "intent_raw")


def customer_messages(parsed: DataFrame) -> DataFrame:
    """Drop agent-authored messages (``from_agent`` 'true' in any case)."""
    return parsed.filter(~F.col("from_agent"))


def known_accounts(events: DataFrame, installed: DataFrame) -> DataFrame:
    """Keep events whose account has an installation (left semi join)."""
    return events.join(installed.select("account_id"), "account_id", "left_semi")


def unknown_accounts(events: DataFrame, installed: DataFrame) -> DataFrame:
    """Rejects report for J5: events whose account has no installation (left anti)."""
    return events.join(installed.select("account_id"), "account_id", "left_anti")


def with_settings(events: DataFrame, settings: DataFrame) -> DataFrame:
    """Left join the settings document; a missing document or a missing field
    takes the default (threshold 0.70, all intents)."""
    s = settings.select("account_id", F.col("confidence_threshold").alias("_thr"),
                        F.col("enabled_intents").alias("_enabled"))
    return (events.join(s, "account_id", "left")
            .withColumn("threshold", F.coalesce("_thr", F.lit(tx.DEFAULT_CONFIDENCE_THRESHOLD)))
            .withColumn("enabled_intents", F.col("_enabled"))
            .drop("_thr", "_enabled"))


def usable(events: DataFrame) -> DataFrame:
    """P10: non-empty text and non-zero ticket id."""
    return events.filter((F.col("text") != "") & (F.col("ticket_id") != 0))


def valid_intents(col) -> Column:
    """Keep known labels in the caller's order, duplicates kept."""
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(c, lambda x: F.array_contains(all_intents(), x))


def choose_tag(intent: Column, below: Column, enabled: Column) -> Column:
    """P13 + J3: the intent's tag when not below threshold and the intent is enabled;
    an empty or missing enabled list means every intent is enabled."""
    effective = F.coalesce(F.when(F.size(enabled) > 0, enabled), all_intents())
    tag = cu.literal_map(tx.INTENT_TO_TAG)[intent]
    return F.when(~below & F.array_contains(effective, intent), F.coalesce(tag, F.lit(tx.UNCLASSIFIED_TAG))) \
        .otherwise(F.lit(tx.UNCLASSIFIED_TAG))


def score_and_tag(events: DataFrame, model: nb.NaiveBayesModel, id_col: str,
                  class_to_intent: dict[str, str] | None, keep: list[str]) -> DataFrame:
    """M2 + P5 + P13 + J3 on usable events carrying ``threshold`` and ``enabled_intents``.
    ``class_to_intent`` maps model classes to intents; ``None`` when the classes are
    intents already."""
    toks = events.withColumn("tokens", nb.tokens("text"))
    scored = nb.score(model, toks, id_col, keep=keep + ["threshold", "enabled_intents"])
    intent = F.col("pred") if class_to_intent is None else cu.map_label("pred", class_to_intent)
    scored = scored.withColumn("intent_raw", intent)
    scored = nb.apply_threshold(scored, F.col("threshold"))
    return scored.withColumn("tag", choose_tag(F.col("intent"), F.col("below_threshold"),
                                               F.col("enabled_intents")))


def route(tagged: DataFrame) -> DataFrame:
    """Documented automation rule per tag (team / priority / macro) and the
    auto-reply trigger (confidence >= 0.85 and intent WISMO)."""
    team = cu.literal_map({x[0]: x[1] for x in tx.ROUTING_RULES if x[1]})
    prio = cu.literal_map({x[0]: x[2] for x in tx.ROUTING_RULES if x[2]})
    macro = cu.literal_map({x[0]: x[3] for x in tx.ROUTING_RULES if x[3]})
    return (tagged.withColumn("team", team[F.col("tag")])
                  .withColumn("priority", prio[F.col("tag")])
                  .withColumn("macro", macro[F.col("tag")])
                  .withColumn("auto_reply", (F.col("intent") == tx.AUTO_REPLY_INTENT) &
                              (F.col("confidence") >= tx.AUTO_REPLY_MIN_CONFIDENCE)))


def webhook_counters(log: DataFrame) -> DataFrame:
    """Per account total classified, errors (success = false), last processed."""
    return log.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("total_classified"),
        F.count_if(~F.col("success")).alias("total_errors"),
        F.max("ts").alias("last_processed_at"))
