"""Ticket payload parsing (ST2) and the HMAC signature check."""

import base64
import hashlib
import hmac
import json
import re

from pyspark.sql import functions as F

from tagwise.functions import crypto
from tagwise.operators import route as rt


def _parse(spark, payloads):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, value string")
    parsed = rt.parse_events(df)
    ok = {r["i"]: r for r in parsed[0].collect()}
    bad = {r["i"] for r in parsed[1].collect()}
    return ok, bad


def test_flat_nested_and_fallbacks(spark):
    payloads = [
        json.dumps({"ticket_id": "123", "from_agent": "False", "body_text": "  where is my order ", "subject": "s"}),
        json.dumps({"event": {"object": {"id": 9, "messages": [{"body_text": "", "body_html": "<p>Hi <b>there</b></p>"}],
                                         "subject": "subj"}}}),
        json.dumps({"data": {"object": {"id": 5, "messages": [], "subject": "only subject"}}}),
        json.dumps({"ticket_id": "12x", "body_text": "bad id"}),
        json.dumps({"ticket_id": "7", "from_agent": "true", "body_text": "agent"}),
        json.dumps({"ticket_id": "8", "from_agent": True, "body_text": "agent bool"}),
        json.dumps({"ticket_id": "", "body_text": "", "subject": "top subject"}),
        "{not json",
        json.dumps({"ticket_id": "4", "body_text": "x" * 600}),
    ]
    ok, bad = _parse(spark, payloads)
    assert bad == {7}
    assert (ok[0]["ticket_id"], ok[0]["text"], ok[0]["from_agent"]) == (123, "where is my order", False)
    assert (ok[1]["ticket_id"], ok[1]["text"]) == (9, re.sub(r"<[^>]+>", " ", "<p>Hi <b>there</b></p>").strip())
    assert (ok[2]["ticket_id"], ok[2]["text"]) == (5, "only subject")
    assert ok[3]["ticket_id"] == 0
    assert ok[4]["from_agent"] and ok[5]["from_agent"]
    assert (ok[6]["ticket_id"], ok[6]["text"]) == (0, "top subject")
    assert len(ok[8]["text"]) == 512


def test_hmac_matches_python(spark):
    bodies = [b"", b"hello", "ünïcode".encode(), b"x" * 200]
    secret = "s3cret"
    df = spark.createDataFrame([(b,) for b in bodies], "body binary")
    got = [r[0] for r in df.select(crypto.hmac_sha256_b64(F.col("body"), secret)).collect()]
    want = [base64.b64encode(hmac.new(secret.encode(), b, hashlib.sha256).digest()).decode() for b in bodies]
    assert got == want
    long_secret = "k" * 100          # keys longer than the block are hashed first
    got2 = df.select(crypto.hmac_sha256_b64(F.col("body"), long_secret)).first()[0]
    assert got2 == base64.b64encode(hmac.new(long_secret.encode(), b"", hashlib.sha256).digest()).decode()


def test_signature_status(spark):
    secret = "s"
    good = base64.b64encode(hmac.new(b"s", b"body", hashlib.sha256).digest()).decode()
    df = spark.createDataFrame([(b"body", good), (b"body", "tampered"), (b"body", None), (b"body", "")],
                               "body binary, sig string")
    got = [r[0] for r in df.select(crypto.signature_status(F.col("body"), F.col("sig"), [secret])).collect()]
    assert got == ["valid", "invalid", "missing", "missing"]


def test_payload_documents(spark):
    """One object and nothing else; the last of repeated keys; numbers that are no integers."""
    from tagwise.functions import payload
    rows = [("a", '\n{"ticket_id": "1", "body_text": "x"}'), ("b", '{"ticket_id": "1", "body_text": "x"} xx'),
            ("c", '{"ticket_id": "1", "ticket_id": "2", "body_text": "x"}'), ("d", '{"ticket_id": 12.0, "body_text": "x"}'),
            ("e", '{"event": {"object": {"id": 12.0, "subject": "s"}}}'), ("f", '{"ticket_id": "12.0", "body_text": "x"}'),
            ("g", '{"ticket_id": "1"}, {"ticket_id": "2"}'), ("h", '[{"ticket_id": "1"}]'), ("i", ' \t\r\n{"ticket_id": "7", "body_text": "x"}\n'),
            ("j", '"text"'), ("k", None), ("l", '{"ticket_id": "1", "body_text": "x"'), ("m", '{"ticket_id": 9007199254740993, "body_text": "x"}'),
            ("n", '{"event": {"object": {"id": 3, "subject": "a"}, "object": {"id": 4, "subject": "b"}}}'), ("o", '{}')]
    got = {r.k: (r.malformed, None if r.malformed else r.ticket_id) for r in payload.parse_ticket_payload(
        spark.createDataFrame(rows, "k string, value string")).collect()}
    assert got == {"a": (False, 1), "b": (True, None), "c": (False, 2), "d": (False, 12), "e": (False, 12), "f": (False, 0),
                   "g": (True, None), "h": (True, None), "i": (False, 7), "j": (True, None), "k": (True, None), "l": (True, None),
                   "m": (False, 9007199254740993), "n": (False, 4), "o": (False, 0)}
