"""Text expressions (F1–F11, F15–F17): all built-in Catalyst functions, no Python UDFs.

Each Spark builder has a ``sql_*`` twin that renders the same rule as DuckDB SQL for the
oracle queries; both read the character classes below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python ``str.isspace`` code points (29 of them), derived from the rule rather than
# listed. Spark's one-argument ``trim`` removes only ASCII space and Java's ``\s`` misses
# U+000B and the Unicode spaces, so both the trim set and the regex class are explicit.
WS_CHARS = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
WS_CLASS = "".join(f"\\x{{{ord(c):x}}}" for c in WS_CHARS)      # valid in Java regex and RE2
WS = f"[{WS_CLASS}]"
HTML_TAG_RE = "<[^>]+>"
TOKEN_SPLIT_RE = r"[^\p{L}]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- F1 strip / F5 label key / F2 hash key / F3 fold -------------------------------

def strip(col) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace. ``trim`` with
    a character set only inspects the two ends (a regex would scan the whole text)."""
    return F.trim(_c(col), F.lit(WS_CHARS))


def label_key(col) -> Column:
    """``lower().strip()`` — the lookup key of the source-label map."""
    return strip(F.lower(_c(col)))


def text_hash(col) -> Column:
    """``md5(lower(text).strip())`` — dedup key and privacy hash (32 hex chars)."""
    return F.md5(label_key(col))


def fold(col) -> Column:
    """``" ".join(text.lower().strip().split())`` — case/whitespace fold."""
    return strip(F.regexp_replace(F.lower(_c(col)), f"{WS}+", " "))


# --- F4 word count / tokens ---------------------------------------------------------

def spaces_to_blank(col) -> Column:
    """Every whitespace code point -> ' ' (a per-character map, no regex)."""
    return F.translate(_c(col), WS_CHARS, " " * len(WS_CHARS))


def word_count(col) -> Column:
    """``len(text.split())`` with Python's Unicode whitespace: map all whitespace to ' '
    and split on the single character (no regex engine on the long text); empties are
    dropped with ``array_remove`` (code-generated, unlike a lambda ``filter``)."""
    return F.size(F.array_remove(F.split(spaces_to_blank(col), " "), ""))


def word_tokens(col) -> Column:
    """Whitespace tokens (the word-level length proxy used for token statistics)."""
    return F.array_remove(F.split(_c(col), f"{WS}+"), "")


def letter_tokens(col) -> Column:
    """Lower-cased runs of letters over the whole text (the naive Bayes features)."""
    return F.array_remove(F.split(F.lower(_c(col)), TOKEN_SPLIT_RE), "")


# --- F6 html / F7 truncate -----------------------------------------------------------

def strip_html(col) -> Column:
    """Only when the text contains '<': every tag becomes one space, then strip."""
    c = _c(col)
    return F.when(F.instr(c, "<") > 0, strip(F.regexp_replace(c, HTML_TAG_RE, " "))).otherwise(c)


def truncate(col, n: int) -> Column:
    """First ``n`` code points (Python ``s[:n]``)."""
    return F.substring(_c(col), 1, n)


# --- F8 pseudonymous user key ---------------------------------------------------------

def user_key(user_col, ip_col) -> Column:
    """``rapid_<user>`` when a user header is present, else ``direct_`` + md5(ip)[:12]."""
    ip = F.coalesce(F.nullif(_c(ip_col), F.lit("")), F.lit("unknown"))
    return F.coalesce(F.concat(F.lit("rapid_"), F.nullif(_c(user_col), F.lit(""))),
                      F.concat(F.lit("direct_"), F.substring(F.md5(ip), 1, 12)))


def file_key(col) -> Column:
    """md5 of the user key: the per-user partition (file) name."""
    return F.md5(_c(col))


# --- F10 LABEL_k names / F11 safe int --------------------------------------------------

def label_index(col) -> Column:
    """``LABEL_3`` -> 3; anything else -> null."""
    return F.regexp_extract(_c(col), r"^LABEL_([0-9]+)$", 1).try_cast("int")


def safe_bigint(col) -> Column:
    """``int(x)`` with failure -> 0 (ANSI ``cast`` would throw, so ``try_cast``)."""
    return F.coalesce(strip(_c(col)).try_cast("bigint"), F.lit(0).cast("bigint"))


# --- F17 link building -------------------------------------------------------------------

def payment_link(base: str, account_col) -> Column:
    return F.concat(F.lit(base), F.lit("?client_reference_id="), F.url_encode(_c(account_col).cast("string")))


# ---------------------------------------------------------------------------------------
# DuckDB twins for the oracle SQL
# ---------------------------------------------------------------------------------------

SQL_WS_CHARS = "(" + " || ".join(f"chr({ord(c)})" for c in WS_CHARS) + ")"


def sql_strip(e: str) -> str:
    return f"trim({e}, {SQL_WS_CHARS})"


def sql_label_key(e: str) -> str:
    return sql_strip(f"lower({e})")


def sql_text_hash(e: str) -> str:
    return f"md5({sql_label_key(e)})"


def sql_fold(e: str) -> str:
    return sql_strip(f"regexp_replace(lower({e}), '{WS}+', ' ', 'g')")


def sql_word_count(e: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array({e}, '{WS}+'), lambda x: x <> '')) AS INTEGER)"


def sql_letter_tokens(e: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({e}), '{TOKEN_SPLIT_RE}'), lambda x: x <> '')"


def sql_strip_html(e: str) -> str:
    return (f"CASE WHEN strpos({e}, '<') > 0 THEN "
            f"{sql_strip(f'regexp_replace({e}, {chr(39)}{HTML_TAG_RE}{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')} "
            f"ELSE {e} END")


def sql_safe_bigint(e: str) -> str:
    return f"coalesce(TRY_CAST({sql_strip(e)} AS BIGINT), CAST(0 AS BIGINT))"
