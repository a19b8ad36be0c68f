"""Packing of documents into token sequences of one length by minimum bin slack.

A document's ids are cut into full windows of ``capacity`` and one remainder. How many
remainders have each length is all that packing needs to know: at most ``capacity`` numbers,
however large the corpus. :func:`plan` fills windows from that multiset. It takes the longest
length left and asks a subset-sum program over a bitset which sums of the other lengths (each
as often as it is left) can be reached; the largest one within the window is backtracked to
counts of each length. The window so found is a *pattern*, used as often as its lengths
last, so a plan has a few thousand patterns and not one for each window.

Where no multiset fills the window, a document that is left over is cut to fill the slack, and
its rest is a remainder of its own length again. What is left in the end, less than a window,
is cut at powers of two, which need no padding. So no sequence is padded, and documents are
only cut where no whole ones would do.

Which document goes where is a matter of rank: the n-th remainder of a length takes the n-th
place that the plan has for the length. Ranks are positions within the partition plus the
counts of the partitions before; the places are found by binary search in each task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagwise.llm.common import Remembered, by_bytes, slices, written

CAPACITY = 4096
END_ID = 2
CACHE_BYTES = 160 << 20            # remembered chunks of a Python worker, by estimated size
LONG_CHUNK = 256                   # characters; longer chunks are not remembered
TEXT_BYTES = 8 << 20               # encoded at once, more only if one text has more
_MARKS = ".,;:!?"
_MARK = "\x01"                      # stands between chunks that are encoded together
_RANK_BITS = 46                    # of a place's search key; the rest is the length


# --- encoding ------------------------------------------------------------------------

class Words:
    """A ``tokenizers`` file that drops white space and lower-cases, with the ids of frequent
    chunks remembered. No token holds white space, so texts are cut at spaces and line feeds.
    Added tokens are recognised, as the tokenizer does when left as loaded."""

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark deals out the work
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        probe = ["Ab", "c1", "'d", "é."]
        apart = [i for c in probe for i in self.model.encode(c, add_special_tokens=False).ids]
        if self.model.encode(" \n ".join(probe), add_special_tokens=False).ids != apart or \
                self.model.encode("Ab", add_special_tokens=False).ids != self.model.encode("ab", add_special_tokens=False).ids:
            raise ValueError(f"{path} does not drop white space or does not lower-case")
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        marks = self.model.encode(_MARK, add_special_tokens=False).ids
        if len(marks) != 1:
            raise ValueError(f"{path} has no single token for U+0001")
        self.mark = marks[0]
        self.chunks = Remembered(CACHE_BYTES)

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """Each chunk's ids. Thousands of chunks are encoded as one text, with a token between
        them that none of them holds."""
        out: list[bytes] = []
        for at in range(0, len(chunks), 5_000):
            part = chunks[at:at + 5_000]
            text = f" {_MARK} ".join(part)
            if text.count(_MARK) >= len(part):
                out += [np.array(self.model.encode(c, add_special_tokens=False).ids, self.dtype).tobytes() for c in part]
                continue
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            between = (np.flatnonzero(ids == self.mark) * ids.itemsize).tolist()
            code, width = ids.tobytes(), ids.itemsize
            out += [code[i:j] for i, j in zip([0, *(x + width for x in between)], [*between, len(code)])]
        return out

    def _learn(self, found: dict[str, bytes], chunks: list[str]) -> None:
        """Puts the ids of these chunks into ``found`` and remembers those that are not long. A
        letter or digit and marks behind it are never one token, so the marks are cut off first."""
        cores = [core if (core := c.rstrip(_MARKS)) and core[-1].isalnum() else c for c in chunks]
        known, put = self.chunks.known, self.chunks.put
        marked = [(c, core, c[len(core):]) for c, core in zip(chunks, cores) if c is not core]
        parts = {*cores, *(tail for _, _, tail in marked)}
        of = {x: known[x] for x in parts if x in known}
        new = [x for x in parts if x not in of]
        for c, ids in zip(new, self._ids(new)):
            of[c] = ids
            if len(c) <= LONG_CHUNK:
                put(c, ids, 180 + len(c) + len(ids))
        for c, core in zip(chunks, cores):
            found[c] = of[core]
        for c, core, tail in marked:
            found[c] = ids = of[core] + of[tail]
            if len(c) <= LONG_CHUNK:
                put(c, ids, 180 + len(c) + len(ids))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's end. Null is empty."""
        texts = pc.fill_null(texts, "")
        # in a text that may hold an added token, letters keep their case: those tokens have one
        low = pc.if_else(pc.match_substring(texts, "<"), texts, pc.ascii_lower(texts))
        cut = pc.split_pattern(pc.replace_substring(low, "\n", " "), " ")
        chunks = cut.flatten().dictionary_encode()
        found, new = self.chunks.look_up(chunks.dictionary.to_pylist())
        self._learn(found, new)
        sizes = np.fromiter(map(len, found.values()), np.int64, len(found)) // self.dtype.itemsize
        ids = np.frombuffer(b"".join(found.values()), self.dtype)
        which = chunks.indices.to_numpy()
        each = sizes[which]
        ends = np.cumsum(each)
        # the i-th id of the n-th chunk is i places behind the first id of its kind
        places = np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - each), each) + np.arange(int(each.sum()))
        last = np.asarray(cut.offsets)[1:] - cut.offsets[0].as_py()
        return ids[places], np.concatenate([[0], ends])[last]


_STATE: dict = {}


def words(path: str) -> Words:
    if path not in _STATE:
        _STATE[path] = Words(path)
    return _STATE[path]


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


# --- plan ----------------------------------------------------------------------------

def closest_fill(left: dict[int, int], target: int) -> dict[int, int]:
    """The multiset of lengths, each at most as often as it is left, whose sum is closest to
    ``target`` from below: a bitset of reachable sums, lengths from the longest on, each count
    in powers of two; the steps are undone from the last for the counts."""
    reached, mask, steps = 1, (1 << (target + 1)) - 1, []
    for length in sorted((x for x, n in left.items() if n > 0 and x <= target), reverse=True):
        n, part = min(left[length], target // length), 1
        while n:
            part = min(part, n)
            steps.append((length, part, reached))
            reached |= (reached << (part * length)) & mask
            n, part = n - part, part * 2
        if reached >> target:
            break
    at = reached.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, part, before in reversed(steps):
        if not (before >> at) & 1:
            chosen[length] = chosen.get(length, 0) + part
            at -= part * length
    return chosen


@dataclass
class Plan:
    """Places of remainders. The i-th entry serves the ranks from ``rank`` of ``length`` on, up to
    the next entry's: ``each`` of them go to one sequence, numbered from ``sequence`` on, side
    by side from ``offset`` on. With ``cut``, only so many ids go there (one remainder a
    sequence) and the rest is a remainder of the shorter length, of rank ``onward`` on."""
    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    onward: list[int] = field(default_factory=list)
    sizes: list[tuple[int, int]] = field(default_factory=list)      # (sequences, length of each)

    def arrays(self) -> dict[str, np.ndarray]:
        out = {c: np.array(getattr(self, c), np.int64) for c in ("length", "rank", "each", "sequence", "offset", "cut", "onward")}
        out["key"] = (out["length"] << _RANK_BITS) + out["rank"]
        order = np.argsort(out["key"])
        return {c: v[order] for c, v in out.items()}


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Windows filled from ``counts`` (remainders of each length, 1 to ``capacity``)."""
    out = Plan()
    left = {x: n for x, n in counts.items() if n > 0}
    used = dict.fromkeys(range(capacity + 1), 0)
    made = {x: counts.get(x, 0) for x in range(capacity + 1)}
    sequence = 0

    def use(chosen: dict[int, int], size: int, times: int) -> None:
        """``times`` sequences of ``size``, each with these lengths, and one cut to fill it."""
        nonlocal sequence
        offset = 0
        for length, each in sorted(chosen.items(), reverse=True):
            for c, v in (("length", length), ("rank", used[length]), ("each", each), ("sequence", sequence), ("offset", offset), ("cut", 0), ("onward", 0)):
                getattr(out, c).append(v)
            used[length] += each * times
            left[length] -= each * times
            offset += each * length
        if offset < size:
            gap = size - offset
            longest = max(x for x, n in left.items() if n > 0)
            rest = longest - gap
            for c, v in (("length", longest), ("rank", used[longest]), ("each", 1), ("sequence", sequence), ("offset", offset), ("cut", gap), ("onward", made[rest])):
                getattr(out, c).append(v)
            used[longest] += times
            left[longest] -= times
            made[rest] += times
            left[rest] = left.get(rest, 0) + times
        out.sizes.append((times, size))
        sequence += times

    total = sum(x * n for x, n in left.items())
    while total >= capacity:
        longest = max(x for x, n in left.items() if n > 0)
        others = dict(left)
        others[longest] -= 1
        chosen = closest_fill(others, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[x] // n for x, n in chosen.items())
        if sum(x * n for x, n in chosen.items()) < capacity:       # the slack is cut from the longest left
            after = max(x for x, n in left.items() if n > chosen.get(x, 0))
            times = min(times, left[after] // (chosen.get(after, 0) + 1))
        use(chosen, capacity, times)
        total -= times * capacity
        left = {x: n for x, n in left.items() if n > 0}
    while total:
        size = 1 << (total.bit_length() - 1)
        use(closest_fill(left, size), size, 1)
        total -= size
        left = {x: n for x, n in left.items() if n > 0}
    return out


def places(arrays: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Where remainders of these lengths and ranks go, in rounds: row numbers, start within the
    remainder, length, sequence, offset, and whether the row was or will be cut. A row that is
    cut comes again in the next round."""
    rows, start = np.arange(len(length)), np.zeros(len(length), np.int64)
    whole = np.ones(len(length), bool)
    while len(rows):
        at = np.searchsorted(arrays["key"], (length << _RANK_BITS) + rank, "right") - 1
        found = {c: v[at] for c, v in arrays.items()}
        nth = rank - found["rank"]
        cut = found["cut"] > 0
        taken = np.where(cut, found["cut"], length)
        yield (rows, start, taken, found["sequence"] + nth // found["each"],
               found["offset"] + (nth % found["each"]) * length, whole & ~cut)
        rows, start, rank, length = rows[cut], (start + taken)[cut], (found["onward"] + nth)[cut], (length - taken)[cut]
        whole = np.zeros(len(rows), bool)


# --- operator ------------------------------------------------------------------------

@dataclass
class Packed:
    """``pieces``: see :func:`pack`. ``encoded``: the written windows and remainders with their ids."""
    pieces: DataFrame
    encoded: DataFrame

    def sequences(self) -> DataFrame:
        """``sequence_id, length, ids``: each sequence's ids, in the tokenizer's width, as one
        binary. A task holds a sequence's pieces, at most the capacity."""
        ids = self.pieces.select("sequence_id", "offset", "part", "size", "nth", "within", "length") \
            .join(self.encoded.select("part", "size", "nth", "ids", "width"), ["part", "size", "nth"]) \
            .select("sequence_id", "offset", "length", F.substring("ids", F.col("within") * F.col("width") + 1, F.col("length") * F.col("width")).alias("ids"))
        parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
        return ids.groupBy("sequence_id").agg(parts.alias("p")).select(
            "sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"),
            F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def _encode(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, text: str, key: str) -> DataFrame:
    """Full windows and remainders: ``part, size`` (ids), ``nth`` (of the size in its partition),
    ``id, start, doc_tokens, ids_crc32, width, ids``; and one row a partition with ``sizes`` and
    ``counts``."""
    kind = docs.schema[key].dataType.simpleString()
    schema = (f"part int, size int, nth long, id {kind}, start long, doc_tokens long, ids_crc32 long, width int, "
              "ids binary, sizes array<int>, counts array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, model = TaskContext.get().partitionId(), words(tokenizer_path)
        end = model.dtype.type(end_id)
        seen = np.zeros(capacity + 1, np.int64)
        id_type = pa.int64()

        def rows(n: int, **columns) -> pa.RecordBatch:
            kinds = {"part": pa.int32(), "size": pa.int32(), "nth": pa.int64(), "id": id_type, "start": pa.int64(), "doc_tokens": pa.int64(),
                     "ids_crc32": pa.int64(), "width": pa.int32(), "ids": pa.binary(), "sizes": pa.list_(pa.int32()), "counts": pa.list_(pa.int64())}
            return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), t) for c, t in kinds.items()], names=list(kinds))

        for batch in (piece for whole in batches for piece in by_bytes(whole, 1, TEXT_BYTES)):
            id_type = batch.column(0).type
            made = []
            flat, ends = model.encode(batch.column(1))
            for d, start, stop in zip(batch.column(0).to_pylist(), [0, *ends.tolist()], ends.tolist()):
                ids = np.append(flat[start:stop], end)
                for at in range(0, len(ids), capacity):
                    some = ids[at:at + capacity]
                    made.append((len(some), int(seen[len(some)]), d, at, len(ids), crc32_of(some), some.tobytes()))
                    seen[len(some)] += 1
            for at in range(0, len(made), 2000):
                some = made[at:at + 2000]
                size, nth, d, start, tokens, crc, ids = zip(*some)
                n = len(some)
                yield rows(n, part=[part] * n, size=size, nth=nth, id=d, start=start, doc_tokens=tokens, ids_crc32=crc,
                           width=[model.dtype.itemsize] * n, ids=ids)
        used = np.flatnonzero(seen)
        if len(used):
            yield rows(1, part=[part], sizes=[used.astype(np.int32)], counts=[seen[used]])

    return docs.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
         text: str = "text", key: str = "doc_id") -> Packed:
    """Encode every whole text, add the end id, and pack all ids into sequences.

    ``pieces`` has ``key, start`` (ids of the document before the piece), ``length, ids_crc32``
    (of the piece's ids as little-endian unsigned 32-bit integers), ``doc_tokens`` (with the end
    id), ``sequence_id`` (from 0) and ``offset`` in the sequence; behind them ``part, size, nth,
    within``, which locate the piece's ids in ``encoded``. Every id is in one piece; a sequence
    has ``capacity`` ids, but for the last few, of different powers of two.

    A null text is an empty one: its end id alone. Null and repeated keys are rows like others.
    Other columns are ignored, whatever their names. An empty table gives no pieces. Which
    documents share a sequence follows the order of the input's partitions and rows.

    The driver sees the number of remainders of each length, at most ``capacity`` rows.
    """
    encoded = written(_encode(docs, tokenizer_path, capacity, end_id, text, key), "encoded")
    counts = encoded.where("counts is not null").select("part", F.explode(F.arrays_zip("sizes", "counts")).alias("c")) \
        .select("part", F.col("c.sizes").alias("size"), F.col("c.counts").alias("n"))
    totals = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    arrays = plan(totals, capacity).arrays()
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    kind = docs.schema[key].dataType.simpleString()
    ranked = encoded.where("counts is null").drop("sizes", "counts", "ids", "width").join(first, ["part", "size"]) \
        .select("id", "start", "doc_tokens", "ids_crc32", "part", "size", "nth", (F.col("first") + F.col("nth")).alias("rank"))
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "size", "nth", "within"]
    schema = (f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
              "part int, size int, nth long, within long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in slices(whole, 20_000)):
            size, rank = (np.asarray(batch.column(c)).astype(np.int64) for c in ("size", "rank"))
            start = np.asarray(batch.column("start")).astype(np.int64)
            for rows, within, length, sequence, offset, whole in places(arrays, size, rank):
                taken = batch.take(pa.array(rows))
                crc = pa.array(np.asarray(taken.column("ids_crc32")), pa.int64(), mask=~whole)     # cut ones: below
                yield pa.RecordBatch.from_arrays(
                    [taken.column("id"), pa.array(start[rows] + within), pa.array(length), crc, taken.column("doc_tokens"),
                     pa.array(sequence), pa.array(offset), taken.column("part"), taken.column("size"), taken.column("nth"), pa.array(within)], names=names)

    placed = written(ranked.mapInArrow(place, schema), "placed")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in slices(whole)):
            sums = [crc32_of(np.frombuffer(ids, f"<u{w}")[at:at + n]) for ids, w, at, n in zip(
                *[batch.column(c).to_pylist() for c in ("ids", "width", "within", "length")])]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64()) if c == "ids_crc32" else batch.column(c) for c in names], names=names)

    # few rows as a rule; written, so that the join is planned by their size
    cut = written(placed.where("ids_crc32 is null"), "cut").join(encoded.select("part", "size", "nth", "ids", "width"), ["part", "size", "nth"]) \
        .select(*names, "ids", "width").mapInArrow(digest, schema)
    return Packed(placed.where("ids_crc32 is not null").unionByName(cut).withColumnRenamed("id", key), encoded)
