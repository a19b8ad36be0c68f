"""Alignment of two tokenizers over a corpus, with an identity map as its fast path.

A text is tokenized twice; where a token of A and one of B end at the same byte, the two
sequences are cut into *groups*. Two tokens are *linked* if their byte ranges overlap, and an
id pair's count is the number of its links in the corpus.

Most groups hold one token of each side, with the same bytes. The identity map has for each id
of A the id of B with the same bytes; such groups are counted in one vector over A's vocabulary
a task. Only the links of the other groups are counted as pairs and shuffled, one row for each
pair and block of documents.

Texts are cut before a space that follows a character other than white space. Both
tokenizers end a token there (A by its splitting pattern, B because no piece has a space after
another character, which is checked), so a chunk's alignment does not depend on the text around
it and equal chunks are aligned once.

Two passes. The first aligns whole texts and writes, in blocks of documents, each document's
distinct links as numbers into the block's list of links. Totals by pair come from the vectors
and the blocks' lists, and go back to the blocks that hold the pair. The second pass looks the
totals up by number. A task holds one block, the identity map's totals are as long as A's
vocabulary and the best counts as long as B's; nothing else is broadcast or collected.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwise.llm.common import Remembered, slices, written

CACHE_BYTES = 128 << 20             # remembered chunks of a Python worker, by estimated size
LONG_CHUNK = 256                    # characters; longer chunks are not remembered
BLOCK_LINKS = 6_000_000             # links of a block of documents, more only if one text has more
_CUT = re.compile(r"(?<=\S)(?= )")
_ODD = re.compile(r"\s ")
_BYTE = re.compile(r"<0x([0-9A-Fa-f]{2})>")


def _chunks(text: str) -> list[str]:
    """The text with a space before it, cut where both tokenizers end a token."""
    whole = " " + text
    return _CUT.split(whole) if _ODD.search(whole) else [" " + c for c in text.split(" ")]


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE writes bytes as letters: printable Latin-1 as itself, the others from
    U+0100 on, in order."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """The two tokenizers: ``tokenizers`` byte-level BPE (A) and SentencePiece BPE (B)."""

    def __init__(self, path_a: str, path_b: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark deals out the work
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True                # their strings are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        special = self.a.get_added_tokens_decoder()
        self.bytes_a: list[bytes | None] = [None] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            if i not in special:
                self.bytes_a[i] = bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{path_b} has pieces with a space after another character")
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode()
                        for p in pieces]
        self.space = self.b.piece_to_id("▁")
        by_bytes = {w: i for i, w in reversed(list(enumerate(self.bytes_b))) if not self.b.is_control(i)}
        #: A's id -> B's smallest id of the same bytes, or -1.
        self.same = np.array([by_bytes.get(w, -1) if w is not None else -1 for w in self.bytes_a], np.int64)
        self.n_a, self.n_b = len(self.bytes_a), len(self.bytes_b)
        self.dtype = np.dtype("<u4" if self.n_a * (self.n_b + 1) < 1 << 32 else "<u8")
        self.lengths_a = np.array([len(w or b"") for w in self.bytes_a], np.int64)
        self.lengths_b = np.array([len(w) for w in self.bytes_b], np.int64)
        self.names = [f"{i}{mark}" for n, last in ((self.n_a, "|"), (self.n_b, ";")) for mark in (",", last) for i in range(n)]
        self.chunks = Remembered(CACHE_BYTES)
        self.sizes: dict[bytes, bytes] = {}

    def _flat(self, ids: list[list[int]], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of many chunks in a row, how many each chunk has, and where each ends in bytes."""
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
        return flat, n, np.cumsum(lengths[flat])

    def _align(self, chunks: list[str], a: list[list[int]], b: list[list[int]]) -> list[tuple | None]:
        """For each chunk: groups as text, links as codes, and the numbers of tokens; None if the
        bytes differ. A link's code is A's id if the identity map has it, else ``n_a + a * n_b + b``.

        The chunks are aligned as one sequence, as all of them end where tokens end. Each stretch
        between two neighbouring token ends lies in one token of A and one of B: a link."""
        raw = [c.encode() for c in chunks]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ids_a, n_a, ends_a = self._flat(a, self.lengths_a)
        ids_b, n_b, ends_b = self._flat(b, self.lengths_b)
        stops = np.cumsum(sizes)
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        same_ends = n_a.all() and n_b.all() and (ends_a[last_a - 1] == stops).all() and (ends_b[last_b - 1] == stops).all()
        whole = b"".join(raw)
        if not same_ends or b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) != whole \
                or b"".join(map(self.bytes_b.__getitem__, ids_b.tolist())) != whole:
            if len(chunks) == 1:
                return [None]
            half = len(chunks) // 2
            return self._align(chunks[:half], a[:half], b[:half]) + self._align(chunks[half:], a[half:], b[half:])
        cuts = ends_a[np.isin(ends_a, ends_b, assume_unique=True)]
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        ends = np.union1d(ends_a, ends_b)
        x, y = ids_a[np.searchsorted(ends_a, ends)], ids_b[np.searchsorted(ends_b, ends)]
        group = np.searchsorted(cuts, ends)
        single = (np.bincount(group_a, minlength=len(cuts)) == 1) & (np.bincount(group_b, minlength=len(cuts)) == 1)
        codes = np.where(single[group] & (self.same[x] == y), x, self.n_a + x * self.n_b + y).astype(self.dtype).tobytes()
        links = np.searchsorted(ends, stops, "right") * self.dtype.itemsize
        # ids with what follows them: within a side "," and after A's last "|", after B's last ";"
        names = np.concatenate([ids_a + np.where(np.diff(group_a, append=-1) != 0, self.n_a, 0),
                                2 * self.n_a + ids_b + np.where(np.diff(group_b, append=-1) != 0, self.n_b, 0)])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        words = list(map(self.names.__getitem__, names[order].tolist()))
        tokens = (last_a + last_b).tolist()
        both = np.stack([n_a, n_b], 1).astype("<u4").tobytes()
        shared = self.sizes.setdefault if len(self.sizes) < 10_000 else lambda _, made: made
        return [("".join(words[i:j])[:-1], codes[k:m], shared(n := both[8 * c:8 * c + 8], n)) for c, (i, j, k, m) in enumerate(
            zip([0, *tokens], tokens, [0, *links.tolist()], links.tolist()))]

    def _aligned(self, chunks: list[str]) -> Iterator[tuple[str, tuple | None]]:
        for at in range(0, len(chunks), 10_000):
            part = chunks[at:at + 10_000]
            left = [e.ids for e in self.a.encode_batch_fast(part, add_special_tokens=False)]
            right = self.b.encode([c[1:] for c in part], num_threads=1)        # B adds the space
            yield from zip(part, self._align(part, left, [y if len(c) > 1 else [self.space] for c, y in zip(part, right)]))

    def align(self, texts: list[str | None]) -> list[tuple | None]:
        """For each text: groups joined by ``;``, the codes of its links, tokens of A and of B.
        None for a null or empty text and one whose tokens' bytes are not its own."""
        cut = [_chunks(t) if t else [] for t in texts]
        found, new = self.chunks.look_up(chain.from_iterable(cut))
        for c, made in self._aligned(new):
            found[c] = made
            if made is not None and len(c) <= LONG_CHUNK:
                self.chunks.put(c, made, 300 + 2 * len(c) + len(made[0]) + len(made[1]))
        out = []
        for chunks in cut:
            rows = list(map(found.__getitem__, chunks))
            if not rows or None in rows:
                out.append(None)
                continue
            groups, codes, sizes = zip(*rows)
            n_a, n_b = np.frombuffer(b"".join(sizes), "<u4").reshape(-1, 2).sum(0, dtype=np.int64).tolist()
            out.append((";".join(groups), np.frombuffer(b"".join(codes), self.dtype), n_a, n_b))
        return out


_STATE: dict = {}


def pair(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _STATE:
        _STATE[path_a, path_b] = Pair(path_a, path_b)
    return _STATE[path_a, path_b]


# --- first pass ----------------------------------------------------------------------

def groups(docs: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each document's alignment: ``key, groups``, an array of ``a`` and ``b`` id arrays; null
    for texts without tokens (see :func:`align`). Row-local."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"id {kind}, groups array<struct<a: array<int>, b: array<int>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(path_a, path_b)
        for batch in (part for whole in batches for part in slices(whole, 100)):
            rows = []
            for found in both.align(batch.column(1).to_pylist()):
                rows.append(None if found is None else [
                    dict(zip("ab", [[int(x) for x in side.split(",")] for side in group.split("|")]))
                    for group in found[0].split(";")])
            kinds = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kinds)], names=["id", "groups"])

    return docs.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(run, schema) \
        .withColumnRenamed("id", key)


def _planes(ascending: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending numbers as gaps and their multiplicities less one, in byte planes: the upper
    planes are nearly all zero, which shuffle and file compression drop."""
    gaps = np.diff(ascending.astype("<u4"), prepend=np.uint32(0)).astype("<u4")
    return np.concatenate([gaps, (times - 1).astype("<u4")]).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(code: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(code, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:] + 1


_ROWS = ("block long, kind int, id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
         "links binary, codes array<long>, counts array<long>")
DOC, LIST, VECTOR = 2, 1, 0          # kinds of rows


def _first_pass(docs: DataFrame, path_a: str, path_b: str, text: str, key: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        both = pair(path_a, path_b)
        block = TaskContext.get().partitionId() << 32
        vector = np.zeros(both.n_a, np.int64)
        held: list[tuple] = []
        size, id_type = 0, None

        def rows(kinds, **columns) -> pa.RecordBatch:
            n = len(kinds)
            types = {"id": id_type, "groups_sha256": pa.string(), "links": pa.binary(), "codes": pa.list_(pa.int64()),
                     "counts": pa.list_(pa.int64())}
            names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "codes", "counts"]
            return pa.RecordBatch.from_arrays(
                [pa.array([block] * n, pa.int64()), pa.array(kinds, pa.int32()),
                 *[pa.array(columns.get(c, [None] * n), types.get(c, pa.int64())) for c in names]], names=["block", "kind", *names])

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal block, held, size
            listed, where = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            times = np.concatenate([h[1] for h in held])
            total = np.bincount(where, weights=times, minlength=len(listed)).astype(np.int64)   # exact below 2^53
            n = int(np.searchsorted(listed, both.n_a))
            vector[listed[:n].astype(np.int64)] += total[:n]
            yield rows([LIST], codes=[listed[:n].astype(np.int64)], counts=[None])              # of the identity map
            for at in range(n, len(listed), 100_000):
                yield rows([LIST], codes=[listed[at:at + 100_000].astype(np.int64) - both.n_a], counts=[total[at:at + 100_000]])
            at = 0
            for h in range(0, len(held), 500):
                some, links = held[h:h + 500], []
                for codes, n_times, *_ in some:
                    links.append(_planes(where[at:at + len(codes)], n_times))
                    at += len(codes)
                columns = dict(zip(["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"], zip(*[s[2:] for s in some])))
                yield rows([DOC] * len(some), links=links, **columns)
            block, held, size = block + 1, [], 0

        for batch in (part for whole in batches for part in slices(whole, 100)):
            id_type = batch.column(0).type
            for d, found in zip(batch.column(0).to_pylist(), both.align(batch.column(1).to_pylist())):
                if found is None:
                    held.append((np.empty(0, both.dtype), np.empty(0, np.int64), d, 0, 0, 0, 0, ""))
                    continue
                text_of, codes, n_a, n_b = found
                distinct, times = np.unique(codes, return_counts=True)
                held.append((distinct, times, d, n_a, n_b, text_of.count(";") + 1, len(codes),
                             hashlib.sha256(text_of.encode()).hexdigest()))
                size += len(codes)
                if size >= BLOCK_LINKS:
                    yield from closed()
        if held:
            yield from closed()
        used = np.flatnonzero(vector)
        if len(used):
            yield rows([VECTOR], codes=[used], counts=[vector[used]])

    return docs.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(run, _ROWS.format(id=kind))


# --- totals and second pass ----------------------------------------------------------

@dataclass
class Aligned:
    """``documents``: one row for each, see :func:`align`. ``pairs``: ``a, b, count, best`` of
    every linked id pair; ``best`` if no other pair of ``b`` has a higher count."""
    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id") -> Aligned:
    """Align every whole text and count links over the corpus.

    ``documents`` has a row for each input row: ``key, n_a, n_b`` (tokens), ``n_groups, n_links``,
    ``n_best`` (links whose pair's count is its B id's highest, ties included), ``count_sum``
    (the pairs' counts, summed over the links) and ``groups_sha256`` of the groups as
    ``a1,a2|b1;a3|b2,b3``. A text that is null or empty, or whose tokens' bytes are not a
    space and its own (B writes a space for U+2581), has zeros and ``''`` and takes no part.
    Null and repeated keys are rows like others; other columns are ignored, whatever their
    names. An empty table gives empty results.
    """
    both = pair(path_a, path_b)
    n_b = both.n_b
    same = both.same.copy()
    passed = written(_first_pass(docs, path_a, path_b, text, key), "aligned")
    lists = passed.where(F.col("kind") == LIST)
    irregular = lists.where("counts is not null") \
        .select("block", F.explode(F.arrays_zip("codes", "counts")).alias("p")).select("block", "p.codes", "p.counts")
    identity = docs.sparkSession.createDataFrame([(a, b) for a, b in enumerate(same.tolist()) if b >= 0], "a long, b long")
    regular = passed.where(F.col("kind") == VECTOR).select(F.explode(F.arrays_zip("codes", "counts")).alias("p")) \
        .groupBy(F.col("p.codes").alias("a")).agg(F.sum("p.counts").alias("n")) \
        .join(F.broadcast(identity), "a").select((F.col("a") * n_b + F.col("b")).alias("code"), "n")     # one row for each id of A
    counted = written(
        irregular.select(F.col("codes").alias("code"), F.col("counts").alias("n")).unionByName(regular)
        .groupBy("code").agg(F.sum("n").alias("count")), "pair-counts")
    b_of = F.col("code") % n_b
    highest = counted.groupBy(b_of.alias("b")).agg(F.max("count").alias("most"))                  # one row for each id of B
    totals = counted.withColumn("b", b_of).join(F.broadcast(highest), "b") \
        .select("code", "count", (F.col("count") == F.col("most")).alias("best"))
    # the identity map's totals: at most as many rows as A has ids
    found = totals.join(F.broadcast(identity.select((F.col("a") * n_b + F.col("b")).alias("code"))), "code").toArrow()
    count_of, best_of = np.zeros(both.n_a, np.int64), np.zeros(both.n_a, bool)
    ids = np.asarray(found["code"]).astype(np.int64) // n_b
    count_of[ids], best_of[ids] = np.asarray(found["count"]), np.asarray(found["best"])

    kind = docs.schema[key].dataType.simpleString()
    back = irregular.select("block", F.col("codes").alias("code")).join(totals, "code") \
        .select("block", F.lit(0).alias("kind"), "code", "count", "best")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("code", "long"), ("count", "long"), ("best", "boolean"))]
    carried = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "codes"]
    kept = passed.where((F.col("kind") == DOC) | ((F.col("kind") == LIST) & F.col("counts").isNull())) \
        .select("block", "kind", *nothing, *carried)
    together = kept.unionByName(back, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind", "code")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        counts, bests, totals_of, best_in = [], [], None, None
        for batch in (part for whole in batches for part in slices(whole, 50_000)):
            blocks, kinds = np.asarray(batch.column("block")), np.asarray(batch.column("kind"))
            edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                part = batch.slice(start, stop - start)
                if blocks[start] != block:
                    block, counts, bests = blocks[start], [], []
                if kinds[start] == 0:
                    counts.append(np.asarray(part.column("count")))
                    bests.append(np.asarray(part.column("best").cast(pa.int8())).astype(bool))
                elif kinds[start] == LIST:
                    a = np.asarray(part.column("codes")[0].values).astype(np.int64)
                    totals_of = np.concatenate([count_of[a], *counts])
                    best_in = np.concatenate([best_of[a], *bests])
                else:
                    n_best, sums = [], []
                    for links in part.column("links"):
                        where, times = _from_planes(links.as_py())
                        n_best.append(int(times[best_in[where]].sum()))
                        sums.append(int((totals_of[where] * times).sum()))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(c) for c in carried[:5]] + [pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()), part.column("groups_sha256")],
                        names=[*carried[:5], "n_best", "count_sum", "groups_sha256"])

    documents = together.mapInArrow(look_up, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                                             "count_sum long, groups_sha256 string").withColumnRenamed("id", key)
    pairs = totals.select(F.floor(F.col("code") / n_b).cast("long").alias("a"), b_of.alias("b"), "count", "best")
    return Aligned(documents, pairs)
