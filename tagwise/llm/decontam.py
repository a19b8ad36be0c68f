"""Benchmark decontamination with a distributed positional inverted index.

:func:`build_index` stores the corpus as *segments* of about 400,000 words: the segment's
dictionary and, for each term, the delta-coded positions at which it occurs. A segment is
partitioned by document, so no term's postings meet in one place however common it is.
:func:`phrase_matches` looks up windows of benchmark words: within a segment it starts from
the window's rarest term and intersects the other terms' lists, shifted by their offsets,
from rare to common. :func:`proximity_matches` asks only that all terms lie near the rarest
one. Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwise.llm.common import slices, written

WINDOW = 10
SEGMENT_WORDS = 400_000
QUERY_WORDS = 500_000              # benchmark words sent to the tasks at once

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


# --- index ---------------------------------------------------------------------------

def _segment(number: int, doc_ids: list, lengths: list[int], tokens: list[bytes]) -> dict:
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.uint64)
    order = np.sort((ids << np.uint64(32)) | np.arange(len(ids), dtype=np.uint64))
    place = (order & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    sizes = np.bincount(ids.astype(np.int64), minlength=len(coded.dictionary))
    ends = np.cumsum(sizes)
    delta = np.diff(place, prepend=np.uint32(0))
    starts = (ends - sizes)[sizes > 0]
    delta[starts] = place[starts]
    return {"segment": number, "doc_ids": doc_ids, "lengths": np.array(lengths, "<u4").tobytes(),
            "terms": b" ".join(coded.dictionary.to_pylist()), "sizes": sizes.astype("<u4").tobytes(),
            "postings": delta.astype("<u4").tobytes()}


_INDEX = "segment long, doc_ids array<long>, lengths binary, terms binary, sizes binary, postings binary"
_ARROW = pa.schema([("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()),
                    ("terms", pa.binary()), ("sizes", pa.binary()), ("postings", pa.binary())])


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The stored index: one row per segment. A null text has no words; repeated rows and
    null ids are kept as documents of their own; extra columns are ignored."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        ids, lengths, tokens = [], [], []
        for batch in (part for whole in batches for part in slices(whole)):
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(t)
                if tokens and len(tokens) + len(found) > SEGMENT_WORDS or len(ids) >= SEGMENT_WORDS:
                    yield pa.RecordBatch.from_pylist([_segment(number, ids, lengths, tokens)], _ARROW)
                    number, ids, lengths, tokens = number + 1, [], [], []
                ids.append(d)
                lengths.append(len(found))
                tokens += found
        if ids:
            yield pa.RecordBatch.from_pylist([_segment(number, ids, lengths, tokens)], _ARROW)

    source = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("binary").alias("t"))
    return written(source.mapInArrow(build, _INDEX), "positional-index")


class Segment:
    """Postings and documents of one index row."""

    def __init__(self, row: dict):
        self.number, self.doc_ids = row["segment"], row["doc_ids"]
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(row["lengths"], "<u4").astype(np.int64))])
        self.terms = pa.array(row["terms"].split(b" ") if row["terms"] else [], pa.binary())
        self.sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        self.delta = np.frombuffer(row["postings"], "<u4")
        self.read: dict[int, np.ndarray] = {}

    def lookup(self, terms: pa.Array) -> np.ndarray:
        """Numbers of the terms, -1 for those that the segment lacks."""
        return pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def postings(self, term: int) -> np.ndarray:
        if term not in self.read:
            end = self.ends[term]
            self.read[term] = np.cumsum(self.delta[end - self.sizes[term]:end], dtype=np.int64)
        return self.read[term]

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def phrase(self, window: np.ndarray) -> np.ndarray:
        """Positions where the window's terms follow each other within a document."""
        order = np.argsort(self.sizes[window], kind="stable")
        at = self.postings(window[order[0]]) - order[0]
        for k in order[1:]:
            if not len(at):
                return at
            other = self.postings(window[k])
            hit = np.minimum(np.searchsorted(other, at + k), len(other) - 1)
            at = at[other[hit] == at + k]
        at = at[at >= 0]
        return at[self.document(at) == self.document(at + len(window) - 1)]

    def near(self, window: np.ndarray, within: int) -> np.ndarray:
        """Positions of the window's rarest term that have every other term at most
        ``within`` words away in the same document."""
        order = np.argsort(self.sizes[window], kind="stable")
        at = self.postings(window[order[0]])
        home = self.document(at)
        low, high = np.maximum(at - within, self.starts[home]), np.minimum(at + within, self.starts[home + 1] - 1)
        keep = np.ones(len(at), bool)
        for k in order[1:]:
            other = self.postings(window[k])
            keep &= np.searchsorted(other, low) < np.searchsorted(other, high, "right")
        return at[keep]


# --- queries -------------------------------------------------------------------------

def item_windows(items: list[tuple], size: int = WINDOW) -> dict[tuple[bytes, ...], list]:
    """Each distinct window of the items' words -> the ids of its items. An item of fewer
    words, but not none, is one window."""
    found: dict[tuple[bytes, ...], dict] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            found.setdefault(tuple(w[i:i + size]), {})[item] = None
    return {w: list(x) for w, x in found.items()}


def _item_parts(items: DataFrame, text: str, key: str) -> Iterator[list[tuple]]:
    """The items in parts of bounded size, dealt by hash; every item is in one part."""
    own = items.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t")).where(F.col("t").isNotNull()).distinct()
    size = own.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = 1 + int(size // (6 * QUERY_WORDS))
    for part in range(parts):
        yield [(r.k, bytes(r.t)) for r in own.where(F.pmod(F.xxhash64("t"), F.lit(parts)) == part).collect()]


_HITS = "segment long, ordinal long, doc_id long, item_id long, start long, stop long"


def _search(index: DataFrame, items: DataFrame, text: str, key: str, size: int, find, merge: bool) -> DataFrame:
    found = None
    for part in _item_parts(items, text, key):
        windows = item_windows(part, size)
        if not windows and found is not None:
            continue
        terms = pa.array(sorted({t for w in windows for t in w}), pa.binary())
        numbers = {t: i for i, t in enumerate(terms.to_pylist())}
        coded = [(np.array([numbers[t] for t in w]), owners) for w, owners in windows.items()]

        def search(batches: Iterator[pa.RecordBatch], terms=terms, coded=coded) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in slices(whole, 1)):
                for row in batch.to_pylist():
                    segment = Segment(row)
                    local = segment.lookup(terms)
                    hits: dict[tuple, list[int]] = {}
                    for w, owners in coded:
                        here = local[w]
                        if here.min() < 0:
                            continue
                        at = find(segment, here)
                        for p, d in zip(at.tolist(), segment.document(at).tolist()):
                            for owner in owners:
                                hits.setdefault((d, owner, len(w)), []).append(p)
                    out = []
                    for (d, owner, n), places in hits.items():
                        base, name = int(segment.starts[d]), segment.doc_ids[d]
                        spans: list[list[int]] = []
                        for p in sorted(places):
                            if merge and spans and p <= spans[-1][1]:
                                spans[-1][1] = p + n
                            else:
                                spans.append([p, p + n])
                        out += [(segment.number, d, name, owner, a - base, b - base) for a, b in spans]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)],
                                                         names=["segment", "ordinal", "doc_id", "item_id", "start", "stop"])

        rows = index.mapInArrow(search, _HITS)
        found = rows if found is None else found.unionByName(rows)
    return found


def phrase_matches(index: DataFrame, items: DataFrame, size: int = WINDOW,
                   text: str = "text", key: str = "item_id") -> DataFrame:
    """Exact matches: for each document and item the word spans ``start`` to ``stop``
    (exclusive) covered by occurrences of the item's windows, touching ones merged. An item
    without words or with a null text matches nothing; repeated items count once.

    The windows are the stated query set: they go to the tasks in parts of at most about
    ``QUERY_WORDS`` words, each part reading the stored index once."""
    return _search(index, items, text, key, size, lambda s, w: s.phrase(w), True)


def proximity_matches(index: DataFrame, items: DataFrame, within: int, size: int = WINDOW,
                      text: str = "text", key: str = "item_id") -> DataFrame:
    """Places of a window's rarest word that have all its other words, in any order, at most
    ``within`` words away in the same document: ``start`` is that word's position."""
    return _search(index, items, text, key, size, lambda s, w: s.near(w, within), False)


def contamination(index: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document of the index: ``segment, ordinal, doc_id, n_words, n_hit`` (words inside
    any occurrence of a window), ``items`` (sorted ids of items with occurring windows; a
    null id is no member)."""
    hits = phrase_matches(index, items, size)
    span = F.array_sort(F.collect_list(F.struct("start", "stop")))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["stop"] - F.greatest(x["start"], a["end"]), F.lit(0))).alias("n"),
                              F.greatest(a["end"], x["stop"]).alias("end")),
        lambda a: a["n"])
    per_doc = hits.groupBy("segment", "ordinal").agg(span.alias("spans"), F.collect_set("item_id").alias("items")) \
        .select("segment", "ordinal", covered.alias("n_hit"), "items")
    return documents_of(index).join(per_doc, ["segment", "ordinal"], "left") \
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))) \
        .withColumn("items", F.coalesce("items", F.array().cast("array<long>")))


def documents_of(index: DataFrame) -> DataFrame:
    """``segment, ordinal, doc_id, n_words`` of every indexed document."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["doc_ids"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, row["segment"], np.int64)), pa.array(np.arange(n)),
                     pa.array(row["doc_ids"], pa.int64()),
                     pa.array(np.frombuffer(row["lengths"], "<u4").astype(np.int64))],
                    names=["segment", "ordinal", "doc_id", "n_words"])
    return index.select("segment", "doc_ids", "lengths") \
        .mapInArrow(listed, "segment long, ordinal long, doc_id long, n_words long")
