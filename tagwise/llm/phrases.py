"""Frequent phrases and collocations by sampling (Toivonen, 1996).

A phrase is a run of words within a piece of text; its *parts* are the phrase without its last
word and without its first. Both parts of a frequent phrase are frequent. So:

* A sample of documents is mined level by level at a lowered threshold. What is frequent there
  is *proposed*.
* One pass over all documents counts every phrase whose parts are proposed: the proposed ones
  and their negative border (all words belong to it). Counts are exact.
* A phrase of the border that turns out frequent is a failure of the sample: phrases that hold
  it were not counted. Failures are proposed too, and a further pass counts the phrases whose
  parts are proposed by now and were not before, until no failure is left. On the whole corpus
  that pass takes what it counts itself as proposed, so one such pass closes the set; the
  sample, where all is new, is closed level by level.

Every frequent phrase is counted then, whatever the sample was: its parts are frequent, hence
counted, hence proposed.

Proposed phrases go to the tasks as one bit each in a table of ``filter_bits`` bits, whatever
their number. Bits shared by chance, or a table that fills up, let more phrases be counted,
never fewer.

Words are known by 64-bit hashes (with their language), longer phrases by the hashes of both
parts: two different phrases are taken for one with a chance of about the square of their
number over 2^65. Tasks count in numpy and emit one row a phrase and a few million words; the
rows meet by phrase, so a frequent phrase is a row for each of them at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagwise.llm.common import slices, written

LEAST, LONGEST, TOP = 100, 5, 2000
SHARE = 8                          # one document in so many is in the sample
LOWERED = 3                        # the sample's threshold is the expected count over this
FILTER_BITS = 27                   # 2^27 bits, 16 MB, at any size of the corpus
UNKNOWN = "und"
SEGMENT = 1 << 20                  # bytes hashed at once
FLUSH_WORDS, FLUSH_PHRASES = 600_000, 1_000_000

_GEN = np.random.Generator(np.random.PCG64(13))
_BYTES = _GEN.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LEFT, _RIGHT = (np.uint64(x) for x in _GEN.integers(1, 1 << 63, 2, np.uint64) * np.uint64(2) + np.uint64(1))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []
#: Kinds of bytes: 1 parts words (space, tab), 2 parts pieces (. , ; : ! ? and line feed to carriage return).
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_BREAK = b"\n"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
                      for b in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def joined(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase of ``n`` words by its parts'."""
    return _mixed(left * _LEFT + right * _RIGHT + np.uint64(n))


def words_of(data: bytes, lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its hash, its piece's number, and where it starts and stops. ``data`` is
    lower-cased UTF-8."""
    buf = np.frombuffer(data, np.uint8)
    kind = _KIND[buf]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], kind > 0, [True]]).astype(np.int8)))
    first, last = edges[::2], edges[1::2]
    pieces = np.cumsum(kind == 2, dtype=np.int32)[first] if len(first) else np.empty(0, np.int32)
    up, down = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTES[buf] * up[:len(buf)], dtype=np.uint64, out=sums[1:])
    salt = np.uint64(int.from_bytes(hashlib.md5(lang.encode(), usedforsecurity=False).digest()[:8], "little"))
    return _mixed((sums[last] - sums[first]) * down[first] ^ salt), pieces, first, last


def has_bit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - int(len(bits) * 8).bit_length() + 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _segments(texts: list[bytes]) -> Iterator[bytes]:
    """The texts, a piece break between them, in stretches that end with a piece."""
    held, size = [], 0
    for t in texts:
        at = 0
        while len(t) - at > SEGMENT:
            stop = max(t.rfind(b, at, at + SEGMENT) for b in (b".", b"\n", b","))
            if stop <= at:
                break                                       # one piece this long stays whole
            yield t[at:stop + 1]
            at = stop + 1
        held.append(t[at:])
        size += len(t) - at
        if size >= SEGMENT:
            yield _BREAK.join(held)
            held, size = [], 0
    if held:
        yield _BREAK.join(held)


class _Counts:
    """Counts of one task. Rows: words of a phrase (0: all words), the hashes of its parts (a
    word: its own and 0), language and word (of words), count."""

    def __init__(self, longest: int, now: np.ndarray | None, before: np.ndarray | None, through: bool):
        self.longest, self.now, self.before, self.through = longest, now, before, through
        self.words, self.n_words = [], 0
        self.grams, self.n_grams = {n: [] for n in range(2, longest + 1)}, 0
        self.totals: dict[str, int] = {}

    @staticmethod
    def _rows(n: int, left, right, count, langs=None, words=None) -> pa.RecordBatch:
        size = len(count)
        text = [pa.nulls(size, pa.string()) if x is None else x for x in (langs, words)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, n, np.int32)), pa.array(left.view(np.int64)), pa.array(right.view(np.int64)), *text,
             pa.array(np.asarray(count, np.int64))], names=["n", "left", "right", "lang", "word", "count"])

    def add(self, data: bytes, lang: str) -> Iterator[pa.RecordBatch]:
        hashes, pieces, first, last = words_of(data, lang)
        if self.before is None:                             # words are counted by the first pass
            self.totals[lang] = self.totals.get(lang, 0) + len(hashes)
            self.words.append((hashes, data, lang, first.astype(np.int32), last.astype(np.int32)))
            self.n_words += len(hashes)
            if self.n_words >= FLUSH_WORDS:
                yield from self.flush_words()
        if self.now is not None:
            at = np.flatnonzero(has_bit(self.now, hashes))
            of, place = hashes[at], at
            # whether the pass before went on from here: its bits, and those of all parts within
            was = np.zeros(len(of), bool) if self.before is None else has_bit(self.before, of)
            for n in range(2, self.longest + 1):
                ok = place[1:] == place[:-1] + 1
                if n == 2:
                    ok &= pieces[place[1:]] == pieces[place[:-1]]
                ok = np.flatnonzero(ok)
                left, right, place = of[ok], of[ok + 1], place[ok]
                of = joined(n, left, right)
                was = was[ok] & was[ok + 1]                  # counted by an earlier pass
                if self.before is None:
                    counted = of
                else:
                    new = ~was
                    left, right, counted = left[new], right[new], of[new]
                if len(counted):
                    self.grams[n].append((counted, left, right))
                    self.n_grams += len(counted)
                if n < self.longest:
                    kept = has_bit(self.now, of)
                    kept = np.flatnonzero(kept | ~was if self.through else kept)
                    of, place, was = of[kept], place[kept], was[kept]
                    if self.before is not None:
                        was &= has_bit(self.before, of)
            if self.n_grams >= FLUSH_PHRASES:
                yield from self.flush_grams()

    def flush_words(self) -> Iterator[pa.RecordBatch]:
        if self.n_words:
            starts = np.cumsum([0, *[len(w[0]) for w in self.words]])
            hashes, where, count = np.unique(np.concatenate([w[0] for w in self.words]), return_index=True, return_counts=True)
            part = np.searchsorted(starts, where, "right") - 1
            names, langs = [], []
            for p, i in zip(part.tolist(), (where - starts[part]).tolist()):
                _, data, lang, first, last = self.words[p]
                names.append(data[first[i]:last[i]])
                langs.append(lang)
            for at in range(0, len(hashes), 50_000):
                end = at + 50_000
                some = hashes[at:end]
                yield self._rows(1, some, np.zeros(len(some), np.uint64), count[at:end], pa.array(langs[at:end], pa.string()),
                                 pa.array(names[at:end], pa.binary()).cast(pa.string()))
        self.words, self.n_words = [], 0

    def flush_grams(self) -> Iterator[pa.RecordBatch]:
        for n, parts in self.grams.items():
            if parts:
                of, left, right = (np.concatenate(x) for x in zip(*parts))
                self.grams[n] = []
                _, where, count = np.unique(of, return_index=True, return_counts=True)
                for at in range(0, len(where), 100_000):
                    some = where[at:at + 100_000]
                    yield self._rows(n, left[some], right[some], count[at:at + 100_000])
        self.n_grams = 0

    def flush(self) -> Iterator[pa.RecordBatch]:
        yield from self.flush_words()
        yield from self.flush_grams()
        if self.totals:
            zero = np.zeros(len(self.totals), np.uint64)
            yield self._rows(0, zero, zero, list(self.totals.values()), pa.array(list(self.totals), pa.string()))


def _count(texts: DataFrame, longest: int, shared) -> DataFrame:
    """Exact counts of one pass: of all words (only without a second table), and of the phrases whose parts
    both have bits in the first table of ``shared`` but not both in the second. The third says
    whether what is counted here is extended like what has a bit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(longest, *shared.value)
        held: dict[str, list[bytes]] = {}
        size = 0

        def done() -> Iterator[pa.RecordBatch]:
            for lang in sorted(held):
                for data in _segments(held[lang]):
                    yield from counts.add(data, lang)

        for batch in (part for whole in batches for part in slices(whole, 200)):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if text:
                    held.setdefault(lang, []).append(text.lower())
                    size += len(text)
            if size >= SEGMENT:
                yield from done()
                held, size = {}, 0
        yield from done()
        yield from counts.flush()

    # the tasks have added up already: rows meet by phrase without a second try in the sending tasks
    return texts.mapInArrow(run, "n int, left long, right long, lang string, word string, count long") \
        .repartition("left", "right").groupBy("n", "left", "right", "lang", "word").agg(F.sum("count").alias("count"))


def _hashed(counted: DataFrame) -> DataFrame:
    """With ``hash``, the phrase's own, by its parts'."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, left, right = (np.asarray(batch.column(c)) for c in ("n", "left", "right"))
            out = left.view(np.uint64).copy()
            for k in np.unique(n[n > 1]).tolist():
                some = n == k
                out[some] = joined(k, left[some].view(np.uint64), right[some].view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], names=[*batch.schema.names, "hash"])

    return counted.mapInArrow(run, counted.schema.simpleString()[7:-1].replace(":", " ") + ", hash bigint")


def _bits(found: DataFrame, size: int) -> np.ndarray:
    """A bit for each phrase of ``found`` in a table of ``2^size``. The driver gets 64 bits for
    every 32 of the table, at most."""
    at = F.shiftrightunsigned("hash", 64 - size)
    rows = found.where("n > 0").groupBy(F.floor(at / 32).cast("long").alias("slot")) \
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(1 << (size - 5), "<u4")
    out[np.asarray(rows["slot"])] = np.asarray(rows["bits"]).astype("<u4")
    return out.view(np.uint8)


def _table(found: DataFrame, filter_bits: int) -> np.ndarray:
    """Bits of all phrases found: 64 for each, up to ``2^filter_bits`` in all."""
    return _bits(found, min(filter_bits, max(8, (64 * found.where("n > 0").count()).bit_length())))


def _closed(texts: DataFrame, least: int, longest: int, filter_bits: int, proposed: DataFrame | None) -> tuple[DataFrame, int]:
    """All phrases that occur ``least`` times, and the numbers of all words by language (n = 0),
    from passes over ``texts`` until no phrase is found that was not proposed; how many."""
    now = None if proposed is None else _table(proposed, filter_bits)
    before, found, passes = None, None, 0
    while True:
        through = proposed is not None and before is not None
        shared = texts.sparkSession.sparkContext.broadcast((now, before, through))     # 2^filter_bits bits each, at any scale
        counted = _count(texts, longest, shared).where((F.col("n") == 0) | (F.col("count") >= least))
        some = written(_hashed(counted), "phrases")
        shared.destroy()
        passes += 1
        found = some if found is None else found.unionByName(some)
        known = now if now is not None else np.zeros(1 << 5, np.uint8)
        # a frequent phrase's parts are frequent: after a pass that went through, both had bits
        # or were counted by that pass, so the phrase was counted too
        if through or not (_bits(some, len(known).bit_length() + 2) & ~known).any():
            return found, passes
        before, now = known, _table(found if proposed is None else found.select("n", "hash").unionByName(proposed.select("n", "hash")), filter_bits)


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, filter_bits: int = FILTER_BITS,
             text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Every phrase of up to ``longest`` words that occurs ``least`` times in its language:
    ``n`` (words), ``lang, phrase, count``, the counts ``lefts`` of its first 1, 2, ... words and
    ``rights`` of what follows them, ``total`` (all words of the language), and ``longer``, the
    highest count of a frequent phrase with one word more that holds it (0 if none).

    Texts are split at ``. , ; : ! ?`` and line feed to carriage return into pieces, those at space
    and tab into words; A-Z count as a-z. Null and empty texts have no words; a null language is
    ``und``. Rows that repeat count each time; other columns are ignored, whatever their names.
    An empty table gives no phrases.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("l"), F.col(text).alias("t"),
                        F.xxhash64(F.col(key), F.col(text)).alias("h"))
    sample = written(texts.where(F.pmod("h", F.lit(share)) == 0).select("l", "t"), "sample")
    proposed, _ = _closed(sample, max(2, least // (share * LOWERED)), longest, filter_bits, None)
    found, _ = _closed(texts.select("l", "t"), least, longest, filter_bits, proposed)
    total = found.where("n = 0").groupBy("lang").agg(F.sum("count").alias("total"))
    none = F.array().cast("array<long>")
    level = found.where("n = 1").select("n", "hash", "lang", F.col("word").alias("phrase"), "count", none.alias("lefts"),
                                        none.alias("rights"), F.col("word").alias("last"))
    levels = [level]
    for n in range(2, longest + 1):
        head = level.select(F.col("hash").alias("left"), "lang", F.col("phrase").alias("head"), "lefts", F.col("count").alias("left_count"))
        tail = level.select(F.col("hash").alias("right"), "last", "rights", F.col("count").alias("right_count"))
        level = written(found.where(F.col("n") == n).select("n", "hash", "left", "right", "count").join(head, "left").join(tail, "right")
                        .select("n", "hash", "left", "right", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "count",
                                F.concat("lefts", F.array("left_count")).alias("lefts"),
                                F.concat(F.array("right_count"), "rights").alias("rights"), "last"), f"phrases-of-{n}")
        levels.append(level)
    everything = levels[0].withColumns({"left": F.lit(None).cast("long"), "right": F.lit(None).cast("long")})
    for level in levels[1:]:
        everything = everything.unionByName(level)
    holders = everything.where("n > 1").select(F.explode(F.array_distinct(F.array("left", "right"))).alias("hash"), F.col("count").alias("c")) \
        .groupBy("hash").agg(F.max("c").alias("longer"))
    return everything.join(holders, "hash", "left").join(total, "lang") \
        .select("n", "lang", "phrase", "count", "lefts", "rights", "total", F.coalesce("longer", F.lit(0).cast("long")).alias("longer"))


def floor_ratio(a: Column, total: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * total / (left * right)), exact while both products have 38 digits."""
    wide = "decimal(19,0)"
    above = (a * 1000).cast(wide) * total.cast(wide)
    return F.call_function("div", above, left.cast(wide) * right.cast(wide)).cast("long")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, redundant: int = 100, **options) -> DataFrame:
    """Each language's first ``top`` phrases of two words or more: ``lang, rank, phrase, a, l, r,
    n, score``, by score and count descending, then phrase by its bytes.

    A phrase that occurs ``a`` times is cut where ``floor(1000 * a * n / (l * r))`` is least, at the first
    such place; ``l`` and ``r`` are the counts of both sides, ``n`` that of all words of the
    language. A phrase within a longer frequent one that has at least ``redundant`` per cent of
    its count is left out (the highest count of a longer one is that of one with one word more).
    Options and odd rows: :func:`frequent`.
    """
    found = frequent(docs, least, longest, **options).where("n > 1").where(F.col("longer") * 100 < F.col("count") * redundant)
    cuts = F.transform("lefts", lambda l, i: F.struct(
        floor_ratio(F.col("count"), F.col("total"), l, F.get("rights", i)).alias("score"), i.alias("k"), l.alias("l"), F.get("rights", i).alias("r")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("cut", F.array_min(cuts)) \
        .select("lang", "phrase", F.col("count").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("total").alias("n"),
                F.col("cut.score").alias("score")) \
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top) \
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
