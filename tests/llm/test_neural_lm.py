import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagwise.llm import neural_lm as lm
from tests.llm.fixtures import awkward_rows, clashing, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]


def base(rows):
    c = Counter(x for d, t, *_ in rows if d is None or d % 3 for x in tokens(t))
    n, v = sum(c.values()), len(c)
    return sorted(((d is None, d or 0, bool(d is not None and d % 3 == 0), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n,
                    round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for d, t, *_ in rows))


def held():
    return F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))


@pytest.mark.parametrize("block", [3_000_000, 500])
def test_base_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", block)
    monkeypatch.setattr(lm, "RANGE_TOKENS", 1000)
    rows = awkward_rows()
    got = lm.score(clashing(documents(spark, rows)).drop("held"), held()).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)) == base(rows)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_model_beats_the_base_on_held_out_texts(spark):
    """On the given documents. (On a few ten thousand tokens of uniformly drawn words the model
    only equals the base: each word is seen too rarely to learn its contexts.)"""
    from tagwise.llm.common import in_residue
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r for r in lm.score(docs, in_residue("doc_id", 7, 2)).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.1 * sum(r.n_tokens for r in got)


def test_probabilities_sum_to_one(spark):
    rows = awkward_rows()
    packed = lm.pack(documents(spark, rows), held())
    counts = lm.merged_counts(packed)
    names = lm.symbols(counts)
    (first, second), sums = lm.fit(packed, names).tables()
    for c1, c2 in ((names.n, names.n), (0, names.n), (5, 3), (names.n - 1, 0)):
        p = np.exp(first[c1].astype(float) + second[c2] - sums[c1, c2])
        assert abs(p.sum() - 1) < 1e-4
    seen = Counter(x for d, t, *_ in rows if d is None or d % 3 for x in tokens(t))
    assert names.total == sum(seen.values()) and names.distinct == len(seen)
    assert names.counts.sum() == names.total and names.rare[1].sum() + len(names.hashes) == names.distinct


def test_words_do_not_depend_on_pieces(monkeypatch):
    text = "Some WORDS, \t and\nmore of\x0bthem é\x1cx " * 40
    whole = lm.tokens_of(text.encode())
    monkeypatch.setattr(lm, "PIECE", 17)
    assert all((a == b).all() for a, b in zip(whole, lm.tokens_of(text.encode())))
    assert len(whole[0]) == len(tokens(text)) and len(set(whole[0].tolist())) == len(set(tokens(text)))


def test_contexts_stop_at_documents():
    one, two = lm._contexts(np.array([1, 2, 3, 4, 5, 6]), np.array([1, 3, 2]), 9)
    assert one.tolist() == [9, 9, 2, 3, 9, 5] and two.tolist() == [9, 9, 9, 2, 9, 9]


def test_empty_and_untrained(spark):
    assert lm.score(documents(spark, []), held()).collect() == []
    (r,) = lm.score(documents(spark, [(3, "all held out", "", "", 0)]), held()).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 4, 0, 0, 0.0)
    assert math.isfinite(r.score)
