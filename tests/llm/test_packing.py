import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tagwise.llm import packing
from tagwise.llm.common import by_bytes
from tagwise.llm.queries import QUERIES, tokenizer_path
from tests.llm.fixtures import awkward_rows, clashing, documents

PATH = tokenizer_path("word_bpe_49k.json")
ODD = ["A  b   C\n\n d \n e", " lead", "trail ", "   ", "\n", "it's  THEY'LL <|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "tab\t x \x85 y\xa0 z",
       "\x1c \x1d a \x1e b", "naïve ﬁ CAFÉ 漢字 🙂 é İstanbul ΣΑΣ Σ", "e ́x", "1234 5.6,7", "x\x01y \x01", "(a). b!? ... c's."]


def encoded(text):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9), st.integers(0, 60))
def test_closest_fill_equals_all_subsets(lengths, target):
    left = dict(Counter(lengths))
    chosen = packing.closest_fill(left, target)
    best = max(s for n in range(len(lengths) + 1) for c in itertools.combinations(lengths, n) if (s := sum(c)) <= target)
    assert sum(x * n for x, n in chosen.items()) == best
    assert all(n <= left[x] for x, n in chosen.items())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_plan_fills_every_sequence(lengths):
    counts = dict(Counter(lengths))
    made = packing.plan(counts, 64)
    assert all(size == 64 or size.bit_count() == 1 for _, size in made.sizes)
    size = np.array(sorted(lengths), np.int64)
    rank = np.concatenate([np.arange(n) for _, n in sorted(counts.items())]).astype(np.int64) if lengths else size
    places, parts = {}, Counter()
    for rows, within, length, sequence, offset, _ in packing.places(made.arrays(), size, rank):
        for r, w, n, s, o in zip(rows, within, length, sequence, offset):
            assert w == parts[r]
            parts[r] += n
            places.setdefault(int(s), []).append((int(o), int(n)))
    assert [parts[i] for i in range(len(size))] == size.tolist()
    full = [size for times, size in made.sizes for _ in range(times)]
    assert sorted(places) == list(range(len(full)))
    for s, pieces in places.items():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at == full[s]


def test_whole_documents_come_first():
    """Where whole documents can fill the windows, few are cut: mixed lengths, one in a third of all."""
    rng = random.Random(3)
    lengths = [rng.randrange(1, 4097) for _ in range(20_000)] + [700] * 10_000
    made = packing.plan(dict(Counter(lengths)))
    windows = sum(n for n, _ in made.sizes)
    cut = sum(times for times, c in zip(_times(made), made.cut) if c)
    assert windows == sum(n for n, s in made.sizes) and cut < 0.35 * windows


def _times(made):
    """How many sequences each entry serves."""
    starts = np.cumsum([0, *[n for n, _ in made.sizes]])
    return [made.sizes[int(np.searchsorted(starts, s, "right")) - 1][0] for s in made.sequence]


def test_encoder_equals_whole_texts():
    texts = [r[1] for r in awkward_rows() if r[1]] + ODD
    model = packing.words(PATH)
    for some in (pa.array(texts), pa.array(["a b", *texts, None]).slice(1)):
        ids, ends = model.encode(some)
        got = [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == [encoded(t or "") for t in some.to_pylist()] and len(ids) == ends[-1]
    assert all(len(c) <= packing.LONG_CHUNK for c in model.chunks.known)


def check(rows, pieces):
    """Every id in one piece, checksums of whole-text ids, gapless sequences without padding."""
    want = Counter()
    for d, t, *_ in rows:
        want[d, tuple(encoded(t or "") + [packing.END_ID])] += 1
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in by_sequence.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at == packing.CAPACITY or at.bit_count() == 1
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert sum(p.length for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())
    sums = Counter((d, len(ids), a, b, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
                   for (d, ids), n in want.items() for p in by_doc[d] if p.doc_tokens == len(ids)
                   for a, b in [(p.start, p.start + p.length)])
    assert {(p.doc_id, p.doc_tokens, p.start, p.start + p.length, p.ids_crc32) for p in pieces} <= set(sums)


def test_pieces_cover_all_ids(spark):
    rows = awkward_rows() + [(400 + i, t, "en", "s", 0) for i, t in enumerate(ODD)]
    done = packing.pack(clashing(documents(spark, rows)).repartition(4), PATH)
    pieces = done.pieces.collect()
    check(rows, pieces)
    assert done.pieces.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    of = {}
    for s in done.sequences().collect():
        ids = np.frombuffer(bytes(s.ids), "<u2")
        assert len(ids) == s.length
        of[s.sequence_id] = ids
    assert all(zlib.crc32(of[p.sequence_id][p.offset:p.offset + p.length].astype("<u4").tobytes()) == p.ids_crc32 for p in pieces)


def test_equal_lengths_are_cut_together(spark):
    """All documents of one length: windows need cuts, in one pattern for many windows."""
    rows = [(i, "tree " * 900, "en", "s", 0) for i in range(60)]
    pieces = packing.pack(documents(spark, rows), PATH).pieces.collect()
    check(rows, pieces)
    assert len(pieces) < 60 + 20


def test_empty_table_and_query(spark, tmp_path):
    assert packing.pack(documents(spark, []), PATH).pieces.collect() == []
    rows = [(1, "one two", "en", "s", 0), (2, None, "en", "s", 0), (2, "one two", "en", "s", 0), (None, "", "en", "s", 0)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_packing"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check(rows, got.collect())


def test_slices_by_bytes():
    batch = pa.RecordBatch.from_pydict({"x": ["a" * n for n in (1, 2, 3, 50, 0, 4)] + [None]})
    assert [p.num_rows for p in by_bytes(batch, 0, 6)] == [3, 1, 3]
    assert [p.num_rows for p in by_bytes(batch.slice(2), 0, 1)] == [1, 1, 1, 1, 1]
    assert list(by_bytes(batch.slice(0, 0), 0, 6)) == []
