"""Token-id files with Elias-Fano document boundaries.

A corpus becomes a row of *shards* in ascending id order. Each shard is one binary file:

    magic, id width, document count, id count
    ids       the concatenated token ids, 2 bytes each where the vocabulary allows, else 4
    bounds    Elias-Fano code of the n + 1 document starts within the shard
    doc ids   Elias-Fano code of the (ascending) document ids less the shard's smallest

An Elias-Fano code keeps each value's low bits in a packed array and its high part as
unary gaps in a bit vector: 2 + log2(universe / n) bits a value. ``select`` finds the
i-th one of the bit vector from one sampled position per 256 ones and a short scan, so a
document's offset costs O(1) and no table of 64-bit offsets exists. The manifest holds
one row per shard with the number of ids before it, so starts are exact beyond 2^32.

Files go to the shared folder of the session through ``pyarrow.fs``, under a name of the
writing attempt; the manifest names the files of the attempts that ended, so repeated or
lost tasks never leave a half-written shard in use.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwise.llm.common import by_bytes
from tagwise.session import scratch_path

END_ID = 2
SAMPLE = 256                      # ones between two sampled positions of a bit vector
MAGIC = b"TWIDS001"
HEADER = struct.Struct("<8sHHIQqQQQ")   # magic, width, nulls, docs, ids, least id, 3 sizes
CACHE_BYTES = 160 << 20           # remembered pieces of text per Python worker, by estimated size
PIECE_BYTES = 200                 # of a remembered piece, beside its characters
LONG_PIECE = 256                  # characters; longer pieces are not remembered
TEXT_BYTES = 8 << 20              # encoded together, more only if one text has more
JOINT = 100                       # new words encoded as one text


# --- Elias-Fano ----------------------------------------------------------------------

def ef_encode(values: np.ndarray) -> bytes:
    """Ascending non-negative integers as: n, low-bit count, sizes, low bits, high bits,
    sampled positions of the ones."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    low_bits = max(0, int(int(v[-1]) // n).bit_length() - 1) if n else 0
    high = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n, dtype=np.int64)
    bits = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
    bits[high] = 1
    upper = np.packbits(bits, bitorder="little").tobytes()
    if low_bits and n:
        planes = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        lower = np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()
    else:
        lower = b""
    samples = high[::SAMPLE].astype("<u4").tobytes()
    return struct.pack("<QBQQQ", n, low_bits, len(lower), len(upper), len(samples)) + lower + upper + samples


class EliasFano:
    """Random access to an :func:`ef_encode` code."""

    HEAD = struct.Struct("<QBQQQ")

    def __init__(self, code: bytes):
        self.n, self.low_bits, nl, nu, ns = self.HEAD.unpack_from(code)
        at = self.HEAD.size
        self.lower = np.frombuffer(code, np.uint8, nl, at)
        self.upper = np.frombuffer(code, np.uint8, nu, at + nl)
        self.samples = np.frombuffer(code, "<u4", ns // 4, at + nl + nu)

    def select(self, i: int) -> int:
        """Position of the i-th one (from 0) of the bit vector."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = at >> 3, at & 7
        while True:
            ones = np.flatnonzero(np.unpackbits(self.upper[byte:byte + 64], bitorder="little")[skip:])
            if len(ones) > left:
                return byte * 8 + skip + int(ones[left])
            left -= len(ones)
            byte, skip = byte + 64, 0

    def low(self, i: int) -> int:
        at, out = i * self.low_bits, 0
        for k in range(self.low_bits):
            out |= ((int(self.lower[(at + k) >> 3]) >> ((at + k) & 7)) & 1) << k
        return out

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return ((self.select(i) - i) << self.low_bits) | self.low(i)

    def all(self) -> np.ndarray:
        """Every value, from one scan of both arrays."""
        ones = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[:self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        planes = np.unpackbits(self.lower, bitorder="little")[:self.n * self.low_bits]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return high | (planes.reshape(self.n, self.low_bits).astype(np.uint64) * weights).sum(1, dtype=np.uint64)


# --- encoding ------------------------------------------------------------------------

#: Classes of UTF-8 bytes: ASCII letters and digits, other printable ASCII, the space, other
#: ASCII white space, and bytes of longer characters.
_WORD, _MARK, _SPACE, _BREAK, _HIGH = 1, 2, 4, 8, 16
_CLASS = bytes(_HIGH if b > 127 else _WORD if chr(b).isalnum() else _MARK if 32 < b < 127 else _SPACE if b == 32
               else _BREAK if 9 <= b <= 13 else 0 for b in range(256))
#: What a byte of the first table and one of the second behind it share: 1, 2 have a cut between
#: them; 4, 8 may have one.
_BEFORE = bytes({_WORD: 1 | 2, _MARK: 2, _HIGH: 4, _SPACE: 8, _BREAK: 8}.get(c, 0) for c in _CLASS)
_AFTER = bytes({_MARK: 1, _SPACE: 2 | 4 | 8, _BREAK: 2 | 4 | 8}.get(c, 0) for c in _CLASS)
#: White space beyond ASCII: the last two bytes of such characters, then all three of the longer ones.
_WIDE = [c.encode() for c in map(chr, range(128, 1 << 16)) if c.isspace() or c == "\u180e"]
_WIDE_2 = np.array([int.from_bytes(c) for c in _WIDE if len(c) == 2])
_WIDE_3 = np.array([int.from_bytes(c) for c in _WIDE if len(c) == 3])
_STATE: dict = {}


def _cuts(data: bytes, starts: np.ndarray) -> np.ndarray:
    """True at the bytes where a piece starts; ``starts``: where texts do, each cut on its own.

    The vocabulary's splitting pattern has a boundary between a letter or digit and a mark, and
    between anything and white space behind it. It looks ahead from white space only: the last
    character of a run goes apart where a printable one is behind it, and a line break, unlike a
    space, is never one token with that."""
    before, after = np.frombuffer(data.translate(_BEFORE), np.uint8), np.frombuffer(data.translate(_AFTER), np.uint8)
    kind = np.frombuffer(data.translate(_CLASS) + b"\0", np.uint8)
    printable = kind & (_WORD | _MARK) != 0
    met = before[:-1] & after[1:]
    cut, first = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    first[starts] = True
    cut[1:-1] = met != 0
    high = np.flatnonzero(met == 4) + 1                 # white space behind a longer character
    if len(high):
        raw = np.frombuffer(data, np.uint8)
        last, two = raw[high - 1].astype(np.int32), raw[high - 2].astype(np.int32) << 8
        three = raw[np.maximum(high - 3, 0)].astype(np.int32) << 16
        cut[high] = ~(np.isin(two | last, _WIDE_2) | np.isin(three | two | last, _WIDE_3))
    run = np.flatnonzero(met == 8) + 1                  # white space behind white space
    cut[run] = printable[run + 1] & ~first[run + 1]
    cut |= first
    breaks = np.flatnonzero(kind == _BREAK)
    cut[breaks[cut[breaks] & printable[breaks + 1]] + 1] = True
    return cut


class Encoder:
    """Byte-level BPE of a ``tokenizers`` file, with the ids of frequent pieces remembered.

    Strings that look like special tokens are ordinary text, or with ``added_tokens`` the
    file's added tokens. Ids equal those of encoding each whole text at once (tested).
    Texts are cut into pieces and the distinct ones numbered by numpy and Arrow; only those
    become Python strings."""

    def __init__(self, path: str, added_tokens: bool = False):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark deals out the work
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = not added_tokens
        self.added = None
        if added_tokens:
            found = self.model.get_added_tokens_decoder().values()
            if any(t.single_word or t.lstrip or t.rstrip or (t.normalized and self.model.normalizer) for t in found):
                raise ValueError(f"{path} has added tokens that depend on the text around them")
            names = sorted((t.content.encode() for t in found), key=len, reverse=True)
            self.added = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}       # by piece less the space it starts with
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}      # both, as they were when full
        self.size = 0                            # of both, by estimate
        vocabulary = self.model.get_vocab()
        self.starts = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.starts[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True    # byte-level space

    def _pieces(self, data: bytes, ends: np.ndarray) -> np.ndarray:
        """Where the pieces of the texts start, then the end of all. An added token is a piece."""
        spans = []
        if self.added is not None and self.added.search(data):
            for a, b in zip(ends.tolist(), ends[1:].tolist()):
                spans += [(a + m.start(), a + m.end()) for m in self.added.finditer(data[a:b])]
        cut = _cuts(data, np.concatenate([ends[:-1], np.array(spans, ends.dtype).ravel()]))
        for a, b in spans:
            cut[a + 1:b] = False
        cut[-1] = True
        return np.flatnonzero(cut).astype(np.int32)

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text; none is null."""
        texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        _, offsets, buffer = texts.buffers()
        ends = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        data = buffer.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if ends[-1] > ends[0] else b""
        if not data:
            return [b""] * len(texts)
        ends = ends - ends[0]
        cuts = self._pieces(data, ends)
        pieces = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data)).dictionary_encode()
        codes = self._codes(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, codes), np.int32, len(codes)) // self.dtype.itemsize
        ids, which = np.frombuffer(b"".join(codes), self.dtype), pieces.indices.to_numpy()
        each = sizes[which]
        stops = np.concatenate([[0], np.cumsum(each)])
        # the i-th id of a piece is i places behind the first id of its kind
        shift = (np.cumsum(sizes) - sizes)[which] - stops[:-1]
        flat = ids[np.repeat(shift.astype(np.int32), each) + np.arange(stops[-1], dtype=np.int32)].tobytes()
        at = (stops[np.searchsorted(cuts, ends)] * self.dtype.itemsize).tolist()
        return [flat[a:b] for a, b in zip(at, at[1:])]

    def _codes(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of these distinct pieces. When too much is remembered, what was not asked
        for since the time before is forgotten; long pieces are not remembered beyond the call."""
        if self.size > CACHE_BYTES // 2:
            self.older, self.known, self.spaced, self.size = (self.known, self.spaced), {}, {}, 0
        known, spaced = self.known, self.spaced
        codes = [spaced.get(p[1:]) if p[0] == " " else known.get(p) for p in pieces]
        new = [p for p, ids in zip(pieces, codes) if ids is None]
        if not new:
            return codes
        for now, old, space, names in ((known, self.older[0], "", [p for p in new if p[0] != " "]),
                                       (spaced, self.older[1], " ", [p[1:] for p in new if p[0] == " "])):
            now.update({p: old[p] for p in names if p in old})
            names = [p for p in names if p not in now]
            plain = [w for w in names if w.split() == [w]] if space else []
            self._learn(list(set(names).difference(plain)), space, now)
            self._learn_joint(plain)
        codes = [ids if ids is not None else spaced[p[1:]] if p[0] == " " else known[p] for p, ids in zip(pieces, codes)]
        for p in new:
            if len(p) > LONG_PIECE:
                (spaced if p[0] == " " else known).pop(p[1:] if p[0] == " " else p)
        self.size += PIECE_BYTES * len(new) + sum(map(len, new))
        return codes

    def _learn(self, names: list[str], space: str, ids: dict[str, bytes]) -> None:
        for at in range(0, len(names), 20_000):
            part = names[at:at + 20_000]
            for c, e in zip(part, self.model.encode_batch_fast([space + c for c in part], add_special_tokens=False)):
                ids[c] = np.array(e.ids, self.dtype).tobytes()

    def _learn_joint(self, words: list[str]) -> None:
        """Words without white space, encoded many to a text: each word's ids are those from one
        token that starts with a space to the next. Where there are not as many of these as words
        (a token spans words, or hides its space), the words are encoded one by one."""
        width = self.dtype.itemsize
        for at in range(0, len(words), 200 * JOINT):
            groups = [words[i:i + JOINT] for i in range(at, min(at + 200 * JOINT, len(words)), JOINT)]
            for group, e in zip(groups, self.model.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(e.ids, self.dtype)
                starts = np.flatnonzero(self.starts[ids])
                if len(starts) != len(group) or starts[0] != 0:
                    self._learn(group, " ", self.spaced)
                    continue
                code, cuts = ids.tobytes(), [*(starts * width).tolist(), len(ids) * width]
                self.spaced.update(zip(group, [code[a:b] for a, b in zip(cuts, cuts[1:])]))


def encoder(path: str, added_tokens: bool = False) -> Encoder:
    if (path, added_tokens) not in _STATE:
        _STATE[path, added_tokens] = Encoder(path, added_tokens)
    return _STATE[path, added_tokens]


def forget_encoders() -> None:
    _STATE.clear()


# --- files ---------------------------------------------------------------------------

def _filesystem(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def write_shard(uri: str, dtype: np.dtype, doc_ids: list[int | None], codes: list[bytes]) -> tuple[int, int]:
    """Write one shard; returns its numbers of documents and ids. Null ids come first."""
    nulls = sum(d is None for d in doc_ids)
    ids = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(ids[0]) if len(ids) else 0
    lengths = np.array([len(c) // dtype.itemsize for c in codes], np.int64)
    bounds = ef_encode(np.concatenate([[0], np.cumsum(lengths)]))
    keys = ef_encode((ids - least).astype(np.uint64))
    total = int(lengths.sum())
    where, path = _filesystem(uri)
    with where.open_output_stream(path) as out:
        out.write(HEADER.pack(MAGIC, dtype.itemsize, nulls, len(doc_ids), total, least,
                              total * dtype.itemsize, len(bounds), len(keys)))
        for c in codes:
            out.write(c)
        out.write(bounds)
        out.write(keys)
    return len(doc_ids), total


class Shard:
    """One shard file: ``doc_id(i)`` and ``ids(i)`` for any document of it."""

    def __init__(self, uri: str):
        where, path = _filesystem(uri)
        self.file = where.open_input_file(path)
        magic, width, self.nulls, self.n, self.total, self.least, size, nb, nk = \
            HEADER.unpack(self.file.read_at(HEADER.size, 0))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a shard of token ids")
        self.dtype = np.dtype(f"<u{width}")
        tail = self.file.read_at(nb + nk, HEADER.size + size)
        self.bounds, self.keys = EliasFano(tail[:nb]), EliasFano(tail[nb:])

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.keys[i - self.nulls]

    def ids(self, i: int) -> np.ndarray:
        a, b = self.bounds[i], self.bounds[i + 1]
        w = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((b - a) * w, HEADER.size + a * w), self.dtype)

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc id, start in the shard, ids) of each document, read in stretches."""
        starts, w = self.bounds.all().astype(np.int64), self.dtype.itemsize
        names = [None] * self.nulls + (self.keys.all().astype(np.int64) + self.least).tolist()
        i = 0
        while i < self.n:
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + (1 << 22), "right")) - 1)
            block = np.frombuffer(self.file.read_at(int(starts[j] - starts[i]) * w, HEADER.size + int(starts[i]) * w), self.dtype)
            for k in range(i, j):
                yield names[k], int(starts[k]), block[starts[k] - starts[i]:starts[k + 1] - starts[i]]
            i = j


# --- operator ------------------------------------------------------------------------

def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID,
                      text: str = "text", key: str = "doc_id", keep_encoder: bool = True, added_tokens: bool = False) -> DataFrame:
    """Encode every whole text and write shards to ``folder`` in ascending ``key`` order.

    Returns the manifest: ``shard, path, n_docs, n_ids, start`` (ids in earlier shards),
    one row per non-empty shard. A null or empty text is a document of the end id alone; documents with
    a null key come first, repeated keys stay next to each other, ordered by text; extra
    columns are ignored. An empty table gives an empty manifest.

    Texts are range-partitioned by key (one shuffle) and encoded where they are written;
    a task holds one shard's ids (2 bytes each), never the corpus. ``keep_encoder`` leaves the
    encoder and what it remembers (some 200 MB) with the Python worker for its next task;
    without it, a job whose other steps need the memory encodes more chunks anew. With
    ``added_tokens`` the vocabulary's added tokens are recognised in texts, as the tokenizer
    does when left as loaded; without it such strings are ordinary text.
    """
    spark = docs.sparkSession
    ordered = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")) \
        .repartitionByRange("k").sortWithinPartitions("k", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc = encoder(tokenizer_path, added_tokens)
        end = np.array([end_id], enc.dtype).tobytes()
        keys: list[int | None] = []
        codes: list[bytes] = []
        for batch in batches:
            for part in by_bytes(batch, 1, TEXT_BYTES):
                keys += part.column(0).to_pylist()
                codes += [c + end for c in enc.encode(part.column(1))]
        dtype = enc.dtype
        if not keep_encoder:
            enc = forget_encoders()
        if keys:
            shard = TaskContext.get().partitionId()
            uri = f"{folder}/ids-{shard:06d}-{uuid.uuid4().hex[:8]}.bin"
            n, total = write_shard(uri, dtype, keys, codes)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": uri, "n_docs": n, "n_ids": total}])

    shards = ordered.mapInArrow(write, "shard long, path string, n_docs long, n_ids long").collect()
    rows, start = [], 0
    for s in sorted(shards, key=lambda s: s.shard):       # one row per shard, not per document
        rows.append((s.shard, s.path, s.n_docs, s.n_ids, start))
        start += s.n_ids
    manifest = spark.createDataFrame(rows, "shard long, path string, n_docs long, n_ids long, start long")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return manifest


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Each document of the files: ``doc_id, start, n_tokens, ids_crc32`` (crc32 of the
    ids as little-endian unsigned 32-bit integers), one task per shard."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, starts, sizes, sums = [], [], [], []
                for d, at, ids in Shard(row["path"]):
                    docs.append(d)
                    starts.append(row["start"] + at)
                    sizes.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()),
                     pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return manifest.select("path", "start").repartition(n) \
        .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(spark: SparkSession, docs: DataFrame, tokenizer_path: str, keep_encoder: bool = True,
                added_tokens: bool = False) -> DataFrame:
    """Write the files to the session's shared folder and read them back."""
    folder = scratch_path(spark, "token-files")
    where, path = _filesystem(folder)
    where.create_dir(path, recursive=True)
    return read_token_files(write_token_files(docs, tokenizer_path, folder, keep_encoder=keep_encoder, added_tokens=added_tokens))
