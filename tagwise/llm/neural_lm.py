"""Log-bilinear language model (Mnih and Hinton, 2007) trained by noise-contrastive
estimation (Mnih and Teh, 2012), and the add-one unigram model beside it.

Tokens are words (A-Z lower-cased, parted by space or tab to carriage return) and one end a
document. The output symbols are the ``FREQUENT`` most frequent training tokens and
``CLASSES`` classes of all others by their last three bytes, so

    P(token | context) = P(symbol | context) * P(token | symbol)

where a frequent token is its own symbol and a class gives a token ``(c + 1) / (N + V + 1)``,
its share of the class's training tokens, with one part for all that training lacks. The
first factor is the neural model: the two symbols before, each with its embedding scaled by
its place, predict an embedding whose products with the symbols' embeddings, plus biases,
are the logits. As the two places add up, exp of the logits factors, and the normalising sums
of all contexts are one product of two matrices; every probability is normalised exactly.

The corpus is packed once into blocks of token numbers with the block's vocabulary. Counts
are merged in ranges of token hashes, each of bounded size, and go back to the blocks, so
rare tokens are known exactly however many there are. Training passes over all training
tokens: each task starts from weights warmed up on a bounded sample (``WARM_TOKENS``), and
the tasks' weights are averaged by their tokens in a reduction tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwise.llm.common import slices, written

FREQUENT, CLASSES, WIDTH = 768, 256, 32
NOISE, STEP, RATE = 64, 2048, 0.08
WARM_TOKENS, WARM_BLOCKS = 800_000, 16   # tokens visited by the warm-up, more than once if there are fewer
BLOCK_TOKENS = 100_000             # its columns stay below half a megabyte
RANGE_TOKENS = 500_000             # entries of block vocabularies merged by a task
FAN_IN = 32
PIECE = 1 << 22                    # bytes hashed at once
END = np.uint64(0xE0D)             # stands for the end of a document

_GEN = np.random.Generator(np.random.PCG64(7))
_BYTES = _GEN.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


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


def tokens_of(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Hash and suffix class of each word, and the end's."""
    hashes, classes = [], []
    low = (text or b"").lower()
    at = 0
    while at < len(low):
        stop = min(len(low), at + PIECE)
        while stop < len(low) and not low[stop - 1:stop].isspace():     # never within a word
            stop += 1
        buf = np.frombuffer(low, np.uint8, stop - at, at)
        at = stop
        space = (buf == 32) | ((buf >= 9) & (buf <= 13))
        edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        first, last = edges[::2], edges[1::2]
        up, down = _powers(len(buf))
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTES[buf] * up[:len(buf)], dtype=np.uint64, out=sums[1:])
        tail = np.maximum(first, last - 3)
        hashes.append(_mixed((sums[last] - sums[first]) * down[first]))
        classes.append((_mixed((sums[last] - sums[tail]) * down[tail]) % np.uint64(CLASSES)).astype(np.uint16))
    return np.concatenate([*hashes, [END]]).astype(np.uint64), np.concatenate([*classes, [0]]).astype(np.uint16)


# --- packed corpus -------------------------------------------------------------------

_PACKED = ("block long, doc_ids array<long>, held array<boolean>, lengths binary, vocab binary, "
           "classes binary, trained binary, tokens binary, n_vocab long, n_train long")
_PACKED_ARROW = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
                           *[(c, pa.binary()) for c in ("lengths", "vocab", "classes", "trained", "tokens")],
                           ("n_vocab", pa.int64()), ("n_train", pa.int64())])


def pack(docs: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The corpus as blocks: the documents' ids, lengths and whether they are held out, the
    sorted hashes of the block's distinct tokens with their classes and training counts, and
    the tokens as numbers in that vocabulary."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32
        ids, held, found, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            hashes = np.concatenate([h for h, _ in found])
            lengths = np.array([len(h) for h, _ in found], "<u4")
            vocab, where, tokens = np.unique(hashes, return_index=True, return_inverse=True)
            trained = np.bincount(tokens[np.repeat(~np.array(held), lengths)], minlength=len(vocab)).astype("<u4")
            return pa.RecordBatch.from_pylist([{
                "block": block, "doc_ids": ids, "held": held, "lengths": lengths.tobytes(), "vocab": vocab.tobytes(),
                "classes": np.concatenate([c for _, c in found])[where].tobytes(), "trained": trained.tobytes(),
                "tokens": tokens.astype("<u2" if len(vocab) <= 1 << 16 else "<u4").tobytes(), "n_vocab": len(vocab), "n_train": int(trained.sum())}], _PACKED_ARROW)

        for batch in (part for whole in batches for part in slices(whole)):
            for d, h, t in zip(*[c.to_pylist() for c in batch.columns]):
                ids.append(d)
                held.append(h)
                found.append(tokens_of(t))
                size += len(found[-1][0])
                if size >= BLOCK_TOKENS:
                    yield row()
                    block, ids, held, found, size = block + 1, [], [], [], 0
        if ids:
            yield row()

    rows = docs.select(F.col(key).cast("long").alias("k"), held_out.alias("h"), F.col(text).cast("binary").alias("t"))
    return written(rows.mapInArrow(build, _PACKED), "packed")


def merged_counts(packed: DataFrame) -> DataFrame:
    """``part, block, data``: for each range of token hashes the training counts of a block's
    tokens in it, over the whole corpus, in the block's order; with block -1 the range's own
    summary (see :func:`_summary`). A range holds about RANGE_TOKENS block entries."""
    total = packed.agg(F.sum("n_vocab")).first()[0] or 0
    parts = int(-(-total // RANGE_TOKENS)) or 1

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
        for batch in batches:
            for row in _rows(batch):
                vocab = np.frombuffer(row["vocab"], np.uint64)
                cuts = [0, *np.searchsorted(vocab, limits), len(vocab)]
                yield pa.RecordBatch.from_pylist([
                    {"part": i, "block": row["block"], "vocab": row["vocab"][8 * a:8 * b], "classes": row["classes"][2 * a:2 * b], "trained": row["trained"][4 * a:4 * b]}
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:]))],
                    pa.schema([("part", pa.int64()), ("block", pa.int64()), ("vocab", pa.binary()), ("classes", pa.binary()), ("trained", pa.binary())]))

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        vocab = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["vocab"]])
        names, where, at = np.unique(vocab, return_index=True, return_inverse=True)
        trained = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["trained"]])
        sums = np.bincount(at, trained, len(names)).astype("<u8")
        classes = np.concatenate([np.frombuffer(x, np.uint16) for x in pdf["classes"]])[where]
        ends = np.cumsum([len(x) // 8 for x in pdf["vocab"]])
        data = [sums[x].tobytes() for x in np.split(at, ends[:-1])]
        return pd.DataFrame({"part": key[0], "block": [*pdf["block"], -1], "data": [*data, _summary(names, sums, classes)]})

    pieces = packed.select("block", "vocab", "classes", "trained").mapInArrow(split, "part long, block long, vocab binary, classes binary, trained binary")
    return written(pieces.groupBy("part").applyInPandas(merge, "part long, block long, data binary"), "counts")


def _summary(names: np.ndarray, sums: np.ndarray, classes: np.ndarray) -> bytes:
    """Each class's training tokens and distinct ones, then the most frequent tokens of the
    range (hash, count, class)."""
    some = sums > 0
    per = np.stack([np.bincount(classes, sums, CLASSES), np.bincount(classes[some], minlength=CLASSES)]).astype("<i8")
    order = np.lexsort((names, -sums.astype(np.int64)))[:FREQUENT]
    order = order[sums[order] > 0]
    top = np.stack([names[order].astype(np.uint64), sums[order].astype(np.uint64), classes[order].astype(np.uint64)])
    return per.tobytes() + top.tobytes()


@dataclass
class Symbols:
    """The frequent tokens (hashes in ascending order, their symbols), the symbols' counts,
    and for each class the training and distinct tokens that are not frequent."""
    hashes: np.ndarray
    numbers: np.ndarray
    counts: np.ndarray
    rare: np.ndarray
    total: int
    distinct: int

    @property
    def n(self) -> int:
        return len(self.hashes) + CLASSES

    def of(self, vocab: np.ndarray, classes: np.ndarray) -> np.ndarray:
        out = len(self.hashes) + classes.astype(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, vocab), len(self.hashes) - 1)
            hit = self.hashes[at] == vocab
            out[hit] = self.numbers[at[hit]]
        return out


def symbols(counts: DataFrame) -> Symbols:
    """Class sums and the FREQUENT largest counts of all ranges: at most FREQUENT + CLASSES
    rows reach the driver."""
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                per = np.frombuffer(data, "<i8", 2 * CLASSES).reshape(2, CLASSES)
                top = np.frombuffer(data, np.uint64, offset=16 * CLASSES).reshape(3, -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.arange(CLASSES), top[2].astype(np.int64)])),
                     pa.array(np.concatenate([np.zeros(CLASSES, np.int64), top[0].view(np.int64)])),
                     pa.array(np.concatenate([per[0], top[1].view(np.int64)])),
                     pa.array(np.concatenate([per[1], np.full(top.shape[1], -1)]))], names=["class", "hash", "n", "v"])

    rows = counts.where("block = -1").select("data").mapInArrow(told, "class long, hash long, n long, v long")
    per = rows.where("v >= 0").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    best = rows.where("v < 0").orderBy(F.desc("n"), "hash").limit(FREQUENT).collect()
    classes = np.zeros((2, CLASSES), np.int64)
    for r in per:
        classes[:, r["class"]] = r["n"], r["v"]
    total, distinct = int(classes[0].sum()), int(classes[1].sum())
    for r in best:
        classes[:, r["class"]] -= (r["n"], 1)
    hashes = np.array([r["hash"] for r in best], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Symbols(hashes[order], order, np.concatenate([np.array([r["n"] for r in best], np.int64), classes[0]]), classes, total, distinct)


# --- the neural model ----------------------------------------------------------------

class LogBilinear:
    """Weights in one flat array: context embeddings (with one for before the start), output
    embeddings, biases, and the scales of the two places."""

    def __init__(self, n: int, weights: np.ndarray):
        self.n, self.flat = n, weights
        a, b = (n + 1) * WIDTH, (2 * n + 1) * WIDTH
        self.context, self.output = weights[:a].reshape(n + 1, WIDTH), weights[a:b].reshape(n, WIDTH)
        self.bias, self.scale = weights[b:b + n], weights[b + n:].reshape(2, WIDTH)

    @staticmethod
    def start(counts: np.ndarray) -> LogBilinear:
        n, gen = len(counts), np.random.Generator(np.random.PCG64(11))
        model = LogBilinear(n, np.zeros((2 * n + 1) * WIDTH + n + 2 * WIDTH, np.float32))
        model.context[:] = gen.normal(0, 0.1, model.context.shape)
        model.output[:] = gen.normal(0, 0.1, model.output.shape)
        model.bias[:] = np.log((counts + 0.5) / (counts + 0.5).sum())
        model.scale[:] = 1
        return model

    def train(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, counts: np.ndarray, seed: int, memory: np.ndarray | None = None) -> np.ndarray:
        """One pass of noise-contrastive estimation by Adagrad; ``one`` and ``two`` are the
        symbols one and two places before ``target``. The noise of a step is shared by it.
        Returns the sums of squared gradients, to go on with."""
        gen = np.random.Generator(np.random.PCG64(seed))
        share = (counts + 0.5) / (counts + 0.5).sum()
        offset = np.log(NOISE * share).astype(np.float32)
        cumulated = np.cumsum(share)
        grad = LogBilinear(self.n, np.zeros_like(self.flat))
        memory = np.full_like(self.flat, 0.1) if memory is None else memory
        for at in range(0, len(target), STEP):
            c1, c2, w = one[at:at + STEP], two[at:at + STEP], target[at:at + STEP]
            noise = np.minimum(np.searchsorted(cumulated, gen.random(NOISE)), self.n - 1)
            e1, e2, o = self.context[c1], self.context[c2], self.output[w]
            q = e1 * self.scale[0] + e2 * self.scale[1]
            here = 1 - _sigmoid((q * o).sum(1) + self.bias[w] - offset[w])
            there = -_sigmoid(q @ self.output[noise].T + (self.bias[noise] - offset[noise]))
            dq = here[:, None] * o + there @ self.output[noise]
            grad.flat[:] = 0
            _scatter(grad.output, w, here[:, None] * q)
            np.add.at(grad.output, noise, there.T @ q)
            grad.bias += np.bincount(w, here, self.n)
            np.add.at(grad.bias, noise, there.sum(0))
            _scatter(grad.context, c1, dq * self.scale[0])
            _scatter(grad.context, c2, dq * self.scale[1])
            grad.scale[0], grad.scale[1] = (dq * e1).sum(0), (dq * e2).sum(0)
            g = grad.flat
            g *= 1 / np.float32(np.sqrt(len(w)))
            memory += g * g
            self.flat += np.float32(RATE) * g / np.sqrt(memory)
        return memory

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each symbol after a symbol one place before (with the bias) and two
        places before, the first less the log of the context's sum once looked up with it:
        ``(first, second), log sums``."""
        first = (self.context * self.scale[0]).astype(np.float64) @ self.output.T.astype(np.float64) + self.bias
        second = (self.context * self.scale[1]).astype(np.float64) @ self.output.T.astype(np.float64)
        high1, high2 = first.max(1, keepdims=True), second.max(1, keepdims=True)
        sums = np.exp(first - high1) @ np.exp(second - high2).T
        return np.stack([first, second]).astype(np.float32), (np.log(sums) + high1 + high2.T).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _scatter(into: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(at, kind="stable")
    sorted_at = at[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_at[1:] != sorted_at[:-1]]))
    into[sorted_at[first]] += np.add.reduceat(rows[order], first)


def _contexts(target: np.ndarray, lengths: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two places before each token, ``start`` before a document's."""
    one, two = np.roll(target, 1), np.roll(target, 2)
    first = np.cumsum(lengths) - lengths
    one[first] = two[first] = start
    two[(first + 1)[lengths > 1]] = start
    return one, two


def _tokens(row: dict) -> np.ndarray:
    """The block's tokens as numbers in its vocabulary, of two bytes where those suffice."""
    return np.frombuffer(row["tokens"], "<u2" if len(row["vocab"]) <= 8 << 16 else "<u4")


def _sequence(row: dict, names: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the block's tokens, contexts, lengths, and whether each is for training."""
    by_token = names.of(np.frombuffer(row["vocab"], np.uint64), np.frombuffer(row["classes"], np.uint16)).astype(np.uint16)
    target = by_token[_tokens(row)]
    lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
    one, two = _contexts(target, lengths, names.n)
    return target, one, two, lengths, np.repeat(~np.array(row["held"], bool), lengths)


def fit(packed: DataFrame, names: Symbols) -> LogBilinear:
    """The model after a warm-up, WARM_TOKENS visits to the training tokens of WARM_BLOCKS
    blocks (blocks and their stretches drawn by hash), and one pass over all blocks. A task goes through its blocks in turn; the tasks'
    weights are averaged by their training tokens."""
    model = LogBilinear.start(names.counts)
    if not names.total:
        return model
    blocks = packed.where("n_train > 0").select("block", "held", "lengths", "vocab", "classes", "tokens")
    some = [r["block"] for r in packed.where("n_train > 0").select("block").orderBy(F.xxhash64("block")).limit(WARM_BLOCKS).collect()]

    def learn(visits: int | None, begin: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, memory, n, first = LogBilinear(names.n, begin.copy()), None, 0, None
            for batch in batches:
                for row in _rows(batch):
                    target, one, two, _, use = _sequence(row, names)
                    target, one, two = target[use], one[use], two[use]
                    n, first, seed = n + len(target), row["block"] if first is None else first, row["block"] % (1 << 31)
                    for again in range(-(-visits // len(target)) if visits else 1):
                        order = np.random.Generator(np.random.PCG64([seed, again])).permutation(-(-len(target) // STEP))
                        if visits:                      # steps drawn from the whole block
                            order = order[:-(-(visits - again * len(target)) // STEP)]
                        mixed = (order[:, None] * STEP + np.arange(STEP)).ravel()
                        mixed = mixed[mixed < len(target)]
                        memory = own.train(one[mixed], two[mixed], target[mixed], names.counts, seed + again, memory)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([float(n)]), pa.array([(own.flat * np.float64(n)).astype("<f8").tobytes()], pa.binary())],
                                                 names=["block", "n", "weights"])
        return run

    schema = "block long, n double, weights binary"
    warm = _averaged(blocks.where(F.col("block").isin(some)).mapInArrow(learn(WARM_TOKENS // WARM_BLOCKS, model.flat), schema), names.n)
    return _averaged(blocks.mapInArrow(learn(None, warm.flat), schema), names.n)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row at a time: a block is large, so not all of a batch are copied at once."""
    for part in slices(batch, 1):
        yield part.to_pylist()[0]


def _averaged(weights: DataFrame, n: int) -> LogBilinear:
    """Mean of the blocks' weights by tokens: each level of the tree adds up FAN_IN rows."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<f8") for x in pdf["weights"])
        return pd.DataFrame({"block": [int(pdf["block"].min())], "n": [pdf["n"].sum()], "weights": [total.tobytes()]})

    level = written(weights, "weights")
    while (rows := level.count()) > 1:
        groups = -(-rows // FAN_IN)
        dealt = level.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)))
        level = written(dealt.groupBy("g").applyInPandas(add, "block long, n double, weights binary"), "weights")
    r = level.first()
    return LogBilinear(n, (np.frombuffer(r.weights, "<f8") / r.n).astype(np.float32))


# --- scores --------------------------------------------------------------------------

def score(docs: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, n_tokens, n_known`` (in training),
    ``train_tokens, base_score`` (add-one unigram) and ``score`` (the model), both log10 of
    the whole text's probability. Rows that ``held_out`` marks are not learned from. A null
    text is empty: its end alone. Without training rows both models know one unseen token
    only. Repeated rows are documents of their own; extra columns are ignored."""
    packed = pack(docs, held_out, text, key)
    counts = merged_counts(packed)
    names = symbols(counts)
    (first, second), sums = fit(packed, names).tables()
    tables = docs.sparkSession.sparkContext.broadcast((first, second, sums, names))     # 12 MB whatever the corpus

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, sums, names = tables.value
        total, distinct = names.total, names.distinct
        for batch in batches:
            for row in _rows(batch):
                known = np.concatenate([np.frombuffer(x["data"], "<u8") for x in row["known"]]).astype(np.float64)
                vocab, classes = np.frombuffer(row["vocab"], np.uint64), np.frombuffer(row["classes"], np.uint16)
                tokens = _tokens(row)
                target, one, two, lengths, _ = _sequence(row, names)
                base = np.log10((known + 1) / (total + distinct + 1))
                rare = names.of(vocab, classes) >= len(names.hashes)
                within = np.where(rare, np.log10((known + 1) / (names.rare[0, classes] + names.rare[1, classes] + 1.0)), 0.0)
                ends = np.cumsum(lengths)
                out = []
                per_token = np.empty(len(tokens))
                for at in range(0, len(tokens), 1 << 18):
                    s = slice(at, at + (1 << 18))
                    logit = first[one[s], target[s]].astype(np.float64) + second[two[s], target[s]] - sums[one[s], two[s]]
                    per_token[s] = logit / np.log(10) + within[tokens[s]]
                for values in (known[tokens] > 0, base[tokens], per_token):
                    out.append(np.add.reduceat(values.astype(np.float64), ends - lengths))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(lengths), pa.array(out[0].astype(np.int64)),
                     pa.array(np.full(len(lengths), total, np.int64)), pa.array(out[1]), pa.array(out[2])],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    back = counts.where("block >= 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "data"))).alias("known"))
    return packed.join(back, "block").select("doc_ids", "held", "lengths", "vocab", "classes", "tokens", "known") \
        .mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
