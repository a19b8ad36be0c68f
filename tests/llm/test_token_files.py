import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

import corpus_pipeline as cp
from tagwise.llm import token_files as tf
from tagwise.llm.queries import QUERIES, tokenizer_path
from tests.llm.fixtures import awkward_rows, clashing, documents


@given(st.lists(st.integers(0, 1 << 40), max_size=700), st.integers(0, 50))
def test_elias_fano_round_trip(values, repeat):
    values = sorted(values + values[:1] * repeat)
    ef = tf.EliasFano(tf.ef_encode(np.array(values, np.uint64)))
    assert ef.all().tolist() == values
    assert [ef[i] for i in range(len(values))] == values


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(0).integers(1, 2000, 100_000))
    assert len(tf.ef_encode(values)) * 8 / len(values) < 2 + np.log2(values[-1] / len(values)) + 0.5


def whole(rows):
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(tokenizer_path())
    model.encode_special_tokens = True
    rows = sorted(((d is not None, d or 0, t or "") for d, t, *_ in rows))
    out, start = [], 0
    for some, d, t in rows:
        ids = np.array(model.encode(t, add_special_tokens=False).ids + [tf.END_ID], "<u4")
        out.append((d if some else None, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_equal_whole_encoding(spark):
    rows = awkward_rows()
    rows += [(400 + i, t, "en", "s", 0) for i, t in enumerate([
        "a  b   c\n\n d \n e", " lead", "trail ", "   ", " \n ", "it's  they'll <|endoftext|> done", "tab\t x \x85 y\xa0 z", "\x1c \x1d a \x1e b"])]
    got = tf.token_table(spark, clashing(documents(spark, rows)), tokenizer_path()).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == whole(rows)


def test_added_tokens_keep_their_ids(spark, tmp_path):
    """The query and the pipeline's stage give the ids of the tokenizer as loaded."""
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(tokenizer_path())
    assert model.encode("x <|endoftext|> y", add_special_tokens=False).ids == [87, 220, 50256, 331]
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|> ", "  <|endoftext|>\n \n b  c", "<|endoftext| > <|endoftext|", "plain text"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want, start = [], 0
    for d, t, *_ in rows:
        ids = np.array(model.encode(t, add_special_tokens=False).ids + [tf.END_ID], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op3_token_files"](spark, str(tmp_path)).collect())) == want
    assert sorted(map(tuple, cp.tokens(spark, documents(spark, rows), str(tmp_path)).collect())) == want


def test_empty_table(spark):
    assert tf.token_table(spark, documents(spark, []), tokenizer_path()).collect() == []


def test_random_access_in_a_shard(tmp_path):
    uri = f"file://{tmp_path}/one.bin"
    codes = [np.arange(n, dtype="<u2").tobytes() for n in [3, 0, 700, 1]]
    assert tf.write_shard(uri, np.dtype("<u2"), [None, 5, 5, 1 << 60], codes) == (4, 704)
    shard = tf.Shard(uri)
    assert [shard.doc_id(i) for i in range(4)] == [None, 5, 5, 1 << 60]
    assert [shard.ids(i).tolist() for i in range(4)] == [list(range(n)) for n in [3, 0, 700, 1]]
    assert [(d, s, len(x)) for d, s, x in shard] == [(None, 0, 3), (5, 3, 0), (5, 3, 700), (1 << 60, 703, 1)]


def test_other_files_are_refused(tmp_path):
    (tmp_path / "x").write_bytes(b"0" * 200)
    with pytest.raises(ValueError):
        tf.Shard(f"file://{tmp_path}/x")


def test_new_words_are_encoded_jointly_and_known_by_their_words():
    """Texts with odd spaces, added tokens and words that other white space surrounds give the whole
    encoding's ids, and a word behind a space is known without a copy that has the space."""
    from tokenizers import Tokenizer
    words = ["", "a", "Ġ", "Ġx", "naïve", "x\ny", "\n", "\t", "end\n", "\x85", " ", " z", "日本語", "don't", "12345", "...", "<|endoftext|>", "x<|endoftext|>y"]
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(0, 30, 400)] + ["", " ", "  ", "   ", " a", "a ", "w" * 300]
    texts += [" ".join(f"w{k}x{k * 7919}" for k in range(500))]
    model = Tokenizer.from_file(tokenizer_path())
    for added in (False, True):
        model.encode_special_tokens = not added
        enc = tf.Encoder(tokenizer_path(), added)
        want = [np.array(model.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes() for t in texts]
        assert enc.encode(texts) == want == enc.encode(texts)
        assert "w3x23757" in enc.spaced and " w3x23757" not in enc.known


def test_words_are_known_apart_from_their_marks_and_lines():
    """A word is encoded once, whatever marks or line break stand behind it."""
    from tokenizers import Tokenizer
    words, marks = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)], ["", ".", ",", "%%%", "###", "***", "&&&", ".\n", "'s"]
    texts = [" ".join(w + m for w in words) for m in marks]
    model = Tokenizer.from_file(tokenizer_path())
    for added in (False, True):
        enc = tf.Encoder(tokenizer_path(), added)
        assert enc.encode(texts) == [np.array(model.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes() for t in texts]
        assert len(enc.known) + len(enc.spaced) < 2 * len(words)


def test_pieces_give_the_ids_of_whole_texts():
    """White space of all kinds, letters and marks of all lengths in UTF-8, contractions and added tokens."""
    from tokenizers import Tokenizer
    spaces = [c for c in map(chr, range(0x3001)) if c.isspace()] + ["᠎", "​", "﻿"]
    others = ["a", "Z", "é", "日", "я", "ª", "́", "Ġ", "😀", "—", "’", "¿", "²", "٣", "\x00", "\x7f", "\x80", ".", "'", "'s", "'ll", "7", "%",
              "<|endoftext|>", "<|endoftext", "|>"]
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(pool, n)) for pool in (spaces + others, [" ", "\n", "a", "."], [*others, *[" "] * 20, *spaces])
             for n in rng.integers(0, 25, 1500)]
    model = Tokenizer.from_file(tokenizer_path())
    for added in (False, True):
        model.encode_special_tokens = not added
        enc = tf.Encoder(tokenizer_path(), added)
        want = [np.array(e.ids, enc.dtype).tobytes() for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        assert enc.encode(texts) == want
        assert enc.encode(pa.array(["x y", *texts], pa.large_string()).slice(1)) == want


def test_what_is_remembered_is_bounded_by_bytes(monkeypatch):
    """Long pieces are not kept, and words of every second time before the bound are forgotten."""
    monkeypatch.setattr(tf, "CACHE_BYTES", 40 * tf.PIECE_BYTES)
    enc = tf.Encoder(tokenizer_path())
    texts = [" ".join(f"q{k}z{j}" for j in range(30)) + " " + "long" * 500 for k in range(50)]
    fresh = [tf.Encoder(tokenizer_path()).encode([t])[0] for t in texts[:3]]
    assert [enc.encode([t])[0] for t in texts][:3] == fresh == [enc.encode([t])[0] for t in texts[:3]]
    kept = [w for known in (enc.known, enc.spaced, *enc.older) for w in known]
    assert 0 < len(kept) <= 2 * 32 and max(map(len, kept)) < 20
