"""Near-duplicates by b-bit MinHash (Li and Koenig, 2010).

A document's set holds the 64-bit hashes of its distinct word 5-grams. 190 minima form 38
band keys of 5; documents that share a band are candidates: at a similarity of 0.85 a pair
shares none with a chance of 2e-10. Documents in a shared band get a b-bit signature: the low
:data:`BITS` bits of :data:`HASHES` further minima, packed as bit planes. The share of equal
b-bit minima, counted by bit operations and corrected for the 2^-b that agree by accident,
drops candidates more than :func:`margin` below the threshold (five standard errors). The
rest is confirmed on the full sets.

No bucket is expanded into pairs:

* Equal sets are one node from the start. An id with several texts is several nodes, which
  are linked with each other and only meet there.
* Each node is held against its buckets' smallest members; the best estimate is confirmed.
  These links make components.
* A bucket that still spans several components has every member outside its largest one
  held against all others of another component, in blocks of bounded size; pairs within one
  component need no test, and a pair of several buckets is tested in the first. What this
  confirms joins components, and no pair that shares a bucket and could join two is left.

Components come from repeated contraction on written tables, never on the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwise.llm.common import slices, written

SHINGLE = 5
SIMILARITY = (85, 100)             # linked if 100 * intersection >= 85 * union
BANDS, ROWS = 38, 5
HASHES = 1024
BITS = 2
WORDS = HASHES // 64               # 64-bit words of a bit plane
MARGIN = 0.07                      # five standard errors of the estimate at 0.85
FILTER_BITS = 24                   # the prefilter of documents to confirm is 2 MB at any scale
LEFT_BLOCK, RIGHT_BLOCK = 64, 256

_GEN = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _GEN.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_A = _GEN.integers(0, 1 << 63, BANDS * ROWS + HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_C = _GEN.integers(0, 1 << 63, BANDS * ROWS + HASHES, np.uint64)
_FOLD = _GEN.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n``."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
                      for b in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the text's word 5-grams (of all its words if it has fewer):
    A-Z lower-cased, words parted by space or tab to carriage return."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    parts = []
    for at in range(0, max(1, len(words) - SHINGLE + 1), 1 << 17):
        some = words[at:at + (1 << 17) + SHINGLE - 1]
        joined = np.frombuffer(b" ".join(some), np.uint8)
        lengths = np.fromiter(map(len, some), np.int64, len(some))
        stops = np.cumsum(lengths + 1) - 1
        starts = stops - lengths
        up, down = _powers(len(joined))
        before = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum(_BYTES[joined] * up[:len(joined)], dtype=np.uint64, out=before[1:])
        n = max(1, len(some) - SHINGLE + 1)
        first, last = starts[:n], stops[np.minimum(np.arange(n) + SHINGLE - 1, len(some) - 1)]
        parts.append((before[last] - before[first]) * down[first])
    return np.unique(mixed(np.concatenate(parts)))


def minima(hashes: np.ndarray, which: slice) -> np.ndarray:
    """The least value of each permutation of ``which`` over the set."""
    a, c = _A[which, None], _C[which, None]
    best = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 1024):
        best = np.minimum(best, (hashes[None, at:at + 1024] * a + c).min(1))
    return best


def band_keys(hashes: np.ndarray) -> np.ndarray:
    least = minima(hashes, slice(0, BANDS * ROWS)).reshape(BANDS, ROWS)
    return mixed((least * _FOLD).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Low bits of the further minima, as BITS planes of WORDS signed 64-bit words. The minima
    are mixed first: as they are, the low bits of h * a + c depend on those of h alone, and
    whether two shingles agree by accident would be the same for every permutation."""
    least = mixed(minima(hashes, slice(BANDS * ROWS, None)))
    planes = ((least[None, :] >> np.arange(BITS, dtype=np.uint64)[:, None]) & np.uint64(1)).astype(np.uint8)
    return np.packbits(planes, axis=1, bitorder="little").view("<i8").ravel()


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.md5(hashes.tobytes(), usedforsecurity=False).digest()


def corrected(equal_share):
    """Similarity of two sets of which this share of the b-bit minima is equal."""
    return (equal_share - 2.0 ** -BITS) / (1 - 2.0 ** -BITS)


def margin(similarity: float) -> float:
    """:data:`MARGIN`, or five standard errors of the estimate at this similarity if that is more."""
    equal = similarity + (1 - similarity) * 2.0 ** -BITS
    return max(MARGIN, 5 * math.sqrt(equal * (1 - equal) / HASHES) / (1 - 2.0 ** -BITS))


def estimated(a: Column, b: Column) -> Column:
    """Collision-corrected similarity from two packed signatures by bit counts."""
    unequal = F.lit(0)
    for w in range(WORDS):
        differ = F.lit(0).cast("long")
        for p in range(BITS):
            differ = differ.bitwiseOR(F.get(a, F.lit(p * WORDS + w)).bitwiseXOR(F.get(b, F.lit(p * WORDS + w))))
        unequal = unequal + F.bit_count(differ)
    return corrected(1 - unequal / F.lit(float(HASHES)))


def banded(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, digest`` (of the set) and ``bands`` of every row; the last two are
    null for an empty set."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            sizes, digests, bands = [], [], []
            for t in batch.column(1).to_pylist():
                h = shingles(t)
                sizes.append(len(h))
                digests.append(_digest(h) if len(h) else None)
                bands.append(band_keys(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "bands"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")) \
        .mapInArrow(sign, "doc_id long, n_shingles long, digest binary, bands array<long>")


# --- components ----------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node that is reachable) of every node of
    ``edges(a, b)``. Each round hooks every node to its smallest neighbour, follows the hooks
    to their ends and contracts the graph; nodes at least halve but for local minima, which
    their neighbours absorb in the round after."""
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    label = None
    while not edges.isEmpty():
        hook = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) \
            .groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
        hook = written(hook, "hooks")
        while True:
            higher = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = written(hook.join(higher, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "hooks")
            hook = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        if label is None:
            label = hook.select("node", F.col("up").alias("component"))
        else:
            label = label.join(hook.withColumnRenamed("node", "component"), "component", "left") \
                .select("node", F.coalesce("up", "component").alias("component"))
        label = written(label, "labels")
        edges = edges.join(hook.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a") \
            .join(hook.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b") \
            .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).where("a < b").distinct()
        edges = written(edges, "edges")
    if label is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label


# --- confirmation --------------------------------------------------------------------

def _wanted_bits(ids: DataFrame) -> bytes:
    """A bit for each hash value of the ids: 2^FILTER_BITS bits, whatever their number."""
    bit = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    words = ids.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {1 << FILTER_BITS}) & 63 as int))")).alias("bits")).collect()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in words:
        out[r.w] = r.bits
    return out.tobytes()


def _sets(docs: DataFrame, nodes: DataFrame, text: str, key: str) -> DataFrame:
    """``id, sig, hashes`` (b-bit signature, full set) of ``nodes(id, least, digest)``, taken
    from the rows of document ``least`` with that set: a filter of fixed size lets few other
    rows through, so texts are read once and only the sets move."""
    bits = nodes.sparkSession.sparkContext.broadcast(_wanted_bits(nodes.select(F.col("least").alias("id"))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.int64)
        for batch in batches:
            at = batch.column(1).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero((table[at >> 6] >> (at & 63)) & 1)
            for some in np.array_split(hit, -(-len(hit) // 500)) if len(hit) else []:
                part = batch.take(pa.array(some))
                found = [shingles(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([_digest(h) for h in found], pa.binary()), pa.array([signature(h) for h in found], pa.list_(pa.int64())),
                     pa.array([h.tobytes() for h in found], pa.binary())],
                    names=["least", "digest", "sig", "hashes"])

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("least"), F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(1 << FILTER_BITS)).alias("bit"),
                                                     F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(build, "least long, digest binary, sig array<long>, hashes binary").join(nodes, ["least", "digest"]).select("id", "sig", "hashes")


def _linked(a: bytes, b: bytes, least: tuple[int, int]) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return least[1] * both >= least[0] * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full sets are similar enough. Join by join: what a task
    holds is a stretch of pairs, however often one document occurs in them."""
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 100)):
            keep = [_linked(x, y, least) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.bool_())], names=["a", "b", "same"])

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b")
    return both.select("a", "b", "ha", "hb").mapInArrow(test, "a long, b long, same boolean").where("same").select("a", "b")


# --- operator ------------------------------------------------------------------------

def near_duplicates(docs: DataFrame, least: tuple[int, int] = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    A component is what links of at least ``least`` similarity reach; its id is the smallest
    document id in it and only that document is kept. An empty set (null, empty or blank text)
    is linked with nothing. Rows that repeat an id are one document, linked with whatever one
    of them is; a row with a null id is linked with nothing, has a null component and is kept.
    Extra columns are ignored."""
    signed = written(banded(docs, text, key), "signed")
    floor = least[0] / least[1] - margin(least[0] / least[1])

    # equal sets are one node, named by their smallest id; one whose smallest id has further
    # texts is named by a hash of its set, as that id may be the smallest of several
    known_id = signed.where(F.col("doc_id").isNotNull())
    usable = known_id.where(F.col("digest").isNotNull())
    repeated = known_id.select("doc_id", "digest").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    repeated = written(repeated, "repeated")
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("least")) \
        .join(repeated.select(F.col("doc_id").alias("least"), F.lit(True).alias("several")), "least", "left") \
        .select("digest", "least", F.when(F.col("several"), F.xxhash64("digest")).otherwise(F.col("least")).alias("id"))
    classes = written(classes, "classes")
    members = usable.withColumnRenamed("doc_id", "least").join(classes, ["least", "digest"]) \
        .select("id", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").drop("last")
    buckets = written(members.join(shared, "key"), "buckets")
    wanted = written(classes.join(buckets.select("id").distinct(), "id", "left_semi"), "wanted")
    sets = written(_sets(docs, wanted, text, key), "sets")
    sigs = sets.select("id", "sig")

    # first round: each node against the pivot that it resembles most
    tried = buckets.where("id <> pivot").select("id", "pivot").distinct().join(sigs, "id") \
        .join(sigs.select(F.col("id").alias("pivot"), F.col("sig").alias("pivot_sig")), "pivot") \
        .withColumn("like", estimated(F.col("sig"), F.col("pivot_sig"))).where(F.col("like") >= floor)
    stars = tried.groupBy("id").agg(F.max_by("pivot", F.struct("like", -F.col("pivot"))).alias("b")).select(F.col("id").alias("a"), "b")
    links = written(confirmed(written(stars, "stars"), sets, least), "links")
    spread = written(usable.join(repeated, "doc_id", "left_semi").join(classes, "digest").select("doc_id", "id").distinct(), "spread")
    same_id = spread.join(spread.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b"))
    links = links.unionByName(same_id)
    first = components(links)

    # second round: what shares a bucket and is in different components yet
    more = confirmed(written(_cross(buckets, first, sigs, floor), "cross"), sets, least)
    final = components(links.unionByName(written(more, "links")))

    # a component is named by its smallest document; an empty set's row of an id that has other
    # texts too goes with them
    placed = classes.join(final.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least_of = placed.groupBy("component").agg(F.min("least").alias("name"))
    placed = written(placed.join(least_of, "component").select("digest", "id", "name"), "named")
    of_id = spread.join(placed, "id").groupBy("doc_id").agg(F.min("name").alias("name"))
    mark = F.lpad(F.col("doc_id").cast("string"), 32, "_").cast("binary")        # longer than a digest
    named = placed.select("digest", "name").unionByName(of_id.select(mark.alias("digest"), "name"))
    out = signed.select("doc_id", "n_shingles", F.coalesce("digest", mark).alias("digest")).join(named, "digest", "left")
    component = F.coalesce("name", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _cross(buckets: DataFrame, found: DataFrame, sigs: DataFrame, floor: float) -> DataFrame:
    """Pairs ``a, b`` of different components that share a bucket and pass the estimate.

    In each bucket with several components the members outside its largest one meet all
    members, in units of LEFT_BLOCK by RIGHT_BLOCK members; a unit is a row. Of the buckets
    that a pair shares the one of the first band names it, told by 32 bits of each band key."""
    placed = buckets.select("id", "band", "key").join(found.withColumnRenamed("node", "id"), "id", "left") \
        .select("key", "band", "id", F.coalesce("component", "id").alias("component"))
    spans = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    placed = written(placed.join(spans, "key", "left_semi"), "unsettled")
    marks = placed.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("band", F.col("key").bitwiseAND(0x7FFFFFFF).cast("int").alias("mark")))).alias("m")) \
        .select("id", F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(-1))).alias("marks"))
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n")) \
        .select("key", "main", F.ceil((F.col("n") - F.col("most")) / LEFT_BLOCK).alias("lefts"), F.ceil(F.col("n") / RIGHT_BLOCK).alias("rights"))
    known = written(sigs.dropDuplicates(["id"]).join(marks, "id"), "marked")
    dealt = placed.join(known, "id").join(sizes, "key") \
        .withColumn("l", F.pmod(F.xxhash64("id"), F.col("lefts"))).withColumn("r", F.pmod(F.xxhash64("id", F.lit(1)), F.col("rights")))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = F.struct("id", "component", "sig", "marks")
    unit = ["key", "band", "l", "r"]
    # members are packed into blocks first, and blocks are what is repeated for their units
    left = dealt.where("component <> main").groupBy("key", "band", "l", "rights").agg(F.collect_list(one).alias("left")) \
        .withColumn("r", every("rights")).drop("rights")
    right = dealt.groupBy("key", "band", "r", "lefts").agg(F.collect_list(one).alias("right")) \
        .withColumn("l", every("lefts")).drop("lefts")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 100)):
            out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for band, left, right in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                (ia, ca, sa, ma), (ib, cb, sb, mb) = _columns(left), _columns(right)
                unequal = np.zeros((len(ia), len(ib)), np.int64)
                for w in range(WORDS):
                    differ = np.zeros((len(ia), len(ib)), np.int64)
                    for p in range(BITS):
                        differ |= sa[:, None, p * WORDS + w] ^ sb[None, :, p * WORDS + w]
                    unequal += np.bitwise_count(differ.view(np.uint64))
                i, j = np.nonzero((corrected(1 - unequal / HASHES) >= floor) & (ca[:, None] != cb[None, :]))
                first = ((ma[i] == mb[j]) & (ma[i] >= 0)).argmax(1) == band
                a, b = ia[i[first]], ib[j[first]]
                out_a.append(np.minimum(a, b))
                out_b.append(np.maximum(a, b))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    return left.join(right, unit).select("band", "left", "right").mapInArrow(meet, "a long, b long").distinct()


def _columns(members) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, components, signatures and band marks of a unit's side."""
    ids, comps, sigs, marks = members.values.flatten()
    table = [x.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) for x in (sigs, marks)]
    return ids.to_numpy(zero_copy_only=False), comps.to_numpy(zero_copy_only=False), *table
