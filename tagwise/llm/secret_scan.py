"""Secret scan: fixed patterns, and a battery of randomness tests for what they miss.

Base kinds are three patterns (:data:`BASE`). Beside them, any other run of 20 or more
characters of base64's alphabets is a candidate. Its encoding is inferred (hexadecimal,
base32, upper-case with digits, letters with digits, base64; plain decimal numbers are
none), which fixes the alphabet whose uniform draw would make it random:

* chi-squared: counts of the alphabet's symbols against equal counts (Wilson-Hilferty);
* runs: number of runs above and below the middle of the alphabet (Wald-Wolfowitz);
* serial correlation: of each symbol's number with the next one's.

A candidate that no test tells from random (``LIMIT`` standard deviations) is held against
the hypothesis that it is writing: letters by their frequency in prose, few capitals,
digits and signs. The likelihood ratio of a uniform draw to that has mean 1 under the
hypothesis, so its reciprocal bounds a p-value, and it falls with length by itself.
Benjamini-Hochberg at :data:`RATE`, within classes of length, over all candidates of the
corpus decides. The p-values are counted in a fixed number of bins, so the decision needs
one small table however many candidates there are. Built from DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagwise.llm.common import written
from tagwise.llm.spans import let, matches

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind -> (pattern, group whose length counts, least length), in the order of ties.
BASE = {"assign": (ASSIGN, 2, 6), "access": ("AKIA[A-Z0-9]{16,}", 0, 20), "hex": ("[0-9a-f]{24,}", 0, 24)}
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
RANDOM = "random"
LIMIT = 4.0
RATE = 0.01
BINS = 2000
BIN_NATS = 0.1

#: Encodings by the characters of the whole token, first match wins; '' is no candidate.
ENCODINGS = (("^[0-9]+$", ""), ("^[0-9a-f]+$", "0123456789abcdef"), ("^[0-9A-F]+$", "0123456789ABCDEF"),
             ("^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
             ("^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
             ("^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
             ("^[A-Za-z0-9_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
             ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))

#: Letters of English prose in the order of their frequency, in per mille.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz"
PER_MILLE = (127, 91, 82, 75, 70, 67, 63, 61, 60, 43, 40, 28, 28, 24, 24, 22, 20, 20, 19, 15, 10, 8, 2, 2, 1, 1)


def _writing() -> dict[str, float]:
    """Chance of each character in writing: 85 % small letters, 8 % capitals, 3 % digits,
    4 % signs."""
    total = sum(PER_MILLE)
    out = {c: 0.85 * n / total for c, n in zip(LETTERS, PER_MILLE)}
    out |= {c.upper(): 0.08 * n / total for c, n in zip(LETTERS, PER_MILLE)}
    return out | {c: 0.003 for c in "0123456789"} | {c: 0.008 for c in "+/_=-"}


def base_spans(text: Column) -> dict[str, Column]:
    """kind -> ``array<struct<start, stop, value>>`` of the base kind's whole matches."""
    def kept(pattern: str, group: int, least: int) -> Column:
        return F.filter(matches(text, pattern), lambda m: F.char_length(F.regexp_extract(m["value"], pattern, group)) >= least)

    return {kind: kept(*rule) for kind, rule in BASE.items()}


def battery(token: Column) -> Column:
    """``struct<z_chi, z_runs, z_serial, nats>`` of a token: the three tests' deviations and
    the log likelihood ratio of its encoding's uniform draw to writing; null if the token has
    no encoding with two symbols."""
    alphabet = F.lit(ENCODINGS[-1][1])
    for pattern, letters in reversed(ENCODINGS[:-1]):
        alphabet = F.when(token.rlike(pattern), F.lit(letters)).otherwise(alphabet)
    table = _writing()
    writing = F.create_map(*[x for c in sorted(table) for x in (F.lit(c), F.lit(math.log(table[c])))])

    def tests(a: Column) -> Column:
        symbols = F.filter(F.split(token, ""), lambda c: (c != "") & (F.instr(a, c) > 0))
        return let(symbols, lambda s: let(F.transform(s, lambda c: F.instr(a, c) - 1),
                                          lambda x: let(F.size(x).cast("double"), lambda n: statistics(a, s, x, n))))

    def statistics(a: Column, s: Column, x: Column, n: Column) -> Column:
        k = F.char_length(a).cast("double")
        squares = F.aggregate(F.transform(F.array_distinct(x), lambda s: F.size(F.filter(x, lambda y: y == s)).cast("double")),
                              F.lit(0.0), lambda t, m: t + m * m)
        chi = k / n * squares - n
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1)))
        high = F.aggregate(x, F.lit(0.0), lambda t, y: t + (y >= k / 2).cast("double"))
        changes = F.aggregate(F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1),
                                         lambda p, q: ((p >= k / 2) != (q >= k / 2)).cast("double")), F.lit(0.0), lambda t, y: t + y)
        product = 2 * high * (n - high)
        mean, spread = product / n + 1, product * (product - n) / (n * n * (n - 1))
        z_runs = F.when(spread > 0, (changes + 1 - mean) / F.sqrt(F.when(spread > 0, spread).otherwise(1.0))).otherwise(F.lit(99.0))
        centre = F.aggregate(x, F.lit(0.0), lambda t, y: t + y) / n
        var = F.aggregate(x, F.lit(0.0), lambda t, y: t + (y - centre) * (y - centre))
        lag = F.aggregate(F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1),
                                     lambda p, q: (p - centre) * (q - centre)), F.lit(0.0), lambda t, y: t + y)
        z_serial = F.when(var > 0, (lag / F.when(var > 0, var).otherwise(1.0) + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
        nats = F.aggregate(s, F.lit(0.0), lambda t, c: t - F.element_at(writing, c)) - n * F.log(k)
        return F.struct(z_chi.alias("z_chi"), z_runs.alias("z_runs"), z_serial.alias("z_serial"), nats.alias("nats"))

    return let(alphabet, lambda a: F.when(a != "", F.when(F.char_length(F.regexp_replace(token, "[=_+/-]", "")) >= 2, tests(a))))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, the base kinds' spans (``assign, access, hex``) and
    ``random``, the spans that the battery adds; each ``array<struct<start, stop>>`` in code
    points. A null or empty text has none; rows with equal ids and texts are scanned each;
    extra columns are ignored.

    The spans of all rows are written once; candidates are a small part of them. The accepted
    p-value of each class of length is at most one row for each power of two, and becomes part of the plan."""
    row = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kinds = base_spans(F.col("text"))
    candidates = F.when(F.col("text").rlike(CANDIDATE), matches(F.col("text"), CANDIDATE)) \
        .otherwise(F.array().cast("array<struct<start:int,stop:int,value:string>>"))
    found = row.select("doc_id", *[x.alias(k) for k, x in kinds.items()], candidates.alias("candidates"))
    base = F.concat(*[F.col(k) for k in kinds])
    free = F.filter("candidates", lambda c: ~F.exists(base, lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])))

    def judged(c: Column) -> Column:
        return let(battery(c["value"]), lambda t: F.when(
            (F.abs(t["z_chi"]) <= LIMIT) & (F.abs(t["z_runs"]) <= LIMIT) & (F.abs(t["z_serial"]) <= LIMIT),
            F.struct(c["start"].alias("start"), c["stop"].alias("stop"),
                     F.floor(F.log2(c["stop"] - c["start"])).cast("int").alias("length_class"),
                     F.least(F.greatest(F.floor(t["nats"] / BIN_NATS), F.lit(0)), F.lit(BINS)).cast("int").alias("bin"))))

    bare = [F.transform(k, lambda m: F.struct(m["start"], m["stop"])).alias(k) for k in kinds]
    classes = F.transform("candidates", lambda c: F.floor(F.log2(c["stop"] - c["start"])).cast("int"))
    found = written(found.select("doc_id", *bare, classes.alias("tried"),
                                 F.filter(F.transform(free, judged), lambda x: x.isNotNull()).alias("passed")), "spans")
    limits = accepted(found).collect()             # at most one row for each power of two
    cut = F.create_map(F.lit(-1), F.lit(BINS + 1), *[F.lit(v) for r in limits for v in (r.length_class, r.bin)])
    keep = F.filter("passed", lambda x: x["bin"] >= F.coalesce(F.try_element_at(cut, x["length_class"]), F.lit(BINS + 1)))
    return found.select("doc_id", *kinds, F.transform(keep, lambda x: F.struct(x["start"], x["stop"])).alias(RANDOM))


def accepted(found: DataFrame, rate: float = RATE) -> DataFrame:
    """Benjamini-Hochberg within each class of length: the least bin of evidence
    (``length_class, bin``) whose tokens are accepted. Every candidate counts as a test."""
    tests = found.select(F.explode("tried").alias("length_class")).groupBy("length_class").agg(F.count(F.lit(1)).alias("tests"))
    bins = found.select(F.explode("passed").alias("x")).groupBy("x.length_class", "x.bin").agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.partitionBy("length_class").orderBy(F.desc("bin")))
    held = bins.withColumn("kept", above).join(tests, "length_class") \
        .where(F.exp(-F.col("bin") * BIN_NATS) * F.col("tests") <= F.col("kept") * rate)
    return held.groupBy("length_class").agg(F.min("bin").alias("bin"))
