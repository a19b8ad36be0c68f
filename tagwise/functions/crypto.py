"""HMAC-SHA256 signature check (F14) in pure Catalyst expressions.

HMAC(key, m) = H((K ^ opad) || H((K ^ ipad) || m)). The two padded keys depend only on
the secret, so they are computed once on the driver and enter the plan as literals;
everything per row (two SHA-256 calls, concat, base64) runs in whole-stage codegen.
Secrets appear in the plan text, so use this with test secrets or a secret-injected
session only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def _pads(secret: str) -> tuple[str, str]:
    key = secret.encode()
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\x00")
    ipad = bytes(b ^ 0x36 for b in key).hex()
    opad = bytes(b ^ 0x5C for b in key).hex()
    return ipad, opad


def hmac_sha256_b64(body: Column, secret: str) -> Column:
    """Base64 HMAC-SHA256 of a binary ``body`` column under ``secret``."""
    ipad, opad = _pads(secret)
    inner = F.unhex(F.sha2(F.concat(F.unhex(F.lit(ipad)), body), 256))
    return F.base64(F.unhex(F.sha2(F.concat(F.unhex(F.lit(opad)), inner), 256)))


def signature_status(body: Column, signature: Column, secrets: list[str]) -> Column:
    """``missing`` (accepted: unsigned integrations are expected), ``valid`` when any
    candidate secret matches, else ``invalid`` (dropped by the caller)."""
    sig = F.coalesce(signature, F.lit(""))
    match = F.lit(False)
    for s in secrets:
        match = match | (hmac_sha256_b64(body, s) == sig)
    return (F.when(sig == "", F.lit("missing"))
            .when(match, F.lit("valid"))
            .otherwise(F.lit("invalid")))


def sql_hmac_sha256_b64(body: str, secret: str) -> str:
    """DuckDB twin over a BLOB expression ``body``."""
    ipad, opad = _pads(secret)
    inner = f"unhex(sha256(unhex('{ipad}') || {body}))"
    return f"to_base64(unhex(sha256(unhex('{opad}') || {inner})))"
