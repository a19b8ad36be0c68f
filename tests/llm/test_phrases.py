import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagwise.llm import phrases
from tests.llm.fixtures import awkward_rows, clashing, documents


def words_by_piece(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
        yield [w for w in re.split(r"[\x20\x09]+", piece) if w]


def counted(rows, longest=5):
    f, n = {}, Counter()
    for _, t, lang, *_ in rows:
        lang = lang or "und"
        for w in words_by_piece(t):
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    return f, n


def brute(rows, least, top=2000):
    out = []
    f, totals = counted(rows)
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        gone = {p[i:j] for p, a in often.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                if (i, j) != (0, len(p)) and a >= often[p[i:j]]}
        scored = []
        for p, a in often.items():
            if p not in gone:
                score, k = min((1000 * a * totals[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, le, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, le, r, totals[lang], -s))
    return sorted(out)


def corpus(seed=5, n=160):
    """A passage in many rows, one phrase only in the rows of one language, one in a single long
    text, separators of all kinds, capitals and letters that are not ASCII."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["École", "THE", "of"]
    rows = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(1, 60))]
        if i % 3 == 0:
            w += "Half a league half a league onward".split()
        rows.append((i, "".join(x + rng.choice([" ", "  ", "\t", " ", ", ", ". ", "\n", " \x0b", "; "]) for x in w),
                     rng.choice(["en", "fr", None, "en"]), "s0"))
    rows.append((900, "only in one long text here. " * 300, "fr", "s1"))
    return [(d, t, lg, s, 0) for d, t, lg, s in rows] + awkward_rows()


@pytest.mark.parametrize("share", [8, 1000])
def test_equals_brute_force(spark, share):
    """With a sample that proposes much, and with one that is empty: passes close the rest."""
    rows = corpus()
    got = phrases.collocations(clashing(documents(spark, rows)).repartition(6), least=12, top=40, share=share)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 12, 40)


def test_frequent_phrases_with_a_full_filter(spark):
    """A filter of 256 bits is full: everything is counted, nothing is lost."""
    rows = corpus(7, 60)
    got = phrases.frequent(documents(spark, rows), least=8, filter_bits=8).collect()          # 2^8 bits
    f, n = counted(rows)
    want = {(lang, " ".join(p)): a for lang, c in f.items() for p, a in c.items() if a >= 8}
    assert {(r.lang, r.phrase): r["count"] for r in got} == want
    for r in got:
        p = tuple(r.phrase.split(" "))
        assert r.n == len(p) and r.total == n[r.lang]
        assert list(r.lefts) == [f[r.lang][p[:k]] for k in range(1, len(p))]
        assert list(r.rights) == [f[r.lang][p[k:]] for k in range(1, len(p))]


def test_failures_trigger_passes(spark):
    """Phrases that the sample lacks: one pass for all that hold them. A sample itself is closed
    word by word. Nothing is counted again once it is proposed."""
    texts = documents(spark, [(i, "a b c d e f", "en", "s", 0) for i in range(20)]).select(F.col("lang").alias("l"), F.col("text").alias("t"))
    found, passes = phrases._closed(texts, 10, 5, 20, texts.limit(0).selectExpr("0 n", "0L hash"))
    assert passes == 2 and found.where("n = 5").count() == 2 and found.where("n > 0").count() == 6 + 5 + 4 + 3 + 2
    level, passes = phrases._closed(texts, 10, 5, 20, None)
    assert passes == 6 and sorted(level.collect()) == sorted(found.collect())
    again, passes = phrases._closed(texts, 10, 5, 20, found)
    assert passes == 1 and sorted(again.collect()) == sorted(found.collect())


def test_flushes_and_long_pieces(spark, monkeypatch):
    rows = corpus(9, 50) + [(950, "x" * 5000 + " y" * 3000, "en", "s", 0)]
    for name, value in (("FLUSH_WORDS", 50), ("FLUSH_PHRASES", 60), ("SEGMENT", 700)):
        monkeypatch.setattr(phrases, name, value)
    assert len(list(phrases._segments([b"ab, " * 400, b"c" * 2000, b""]))) >= 3
    got = phrases.collocations(documents(spark, rows), least=9)
    assert sorted(map(tuple, got.collect())) == brute(rows, 9)


def test_scores_beyond_64_bits(spark):
    cases = [(10 ** 13, 9 * 10 ** 14, 10 ** 13 + 7, 10 ** 13 + 11), (123_456_789_012, 10 ** 15, 223_456_789_012, 10 ** 14 + 3), (100, 100, 100, 100), (7, 1000, 3000, 999)]
    df = spark.createDataFrame(cases, "a long, n long, l long, r long")
    got = [r[0] for r in df.select(phrases.floor_ratio(*[F.col(c) for c in "anlr"])).collect()]
    assert got == [1000 * a * n // (x * y) for a, n, x, y in cases]


def test_empty_table_and_few_words(spark):
    assert phrases.collocations(documents(spark, [])).collect() == []
    assert phrases.collocations(documents(spark, [(1, None, None, "s", 0), (2, "", "en", "s", 0), (3, "one", "en", "s", 0)])).collect() == []


def test_bits():
    bits = np.zeros(1 << 5, np.uint8)
    h = np.array([0, 1 << 56, (1 << 64) - 1], np.uint64)
    bits[0], bits[31] = 1, 128
    assert phrases.has_bit(bits, h).tolist() == [True, False, True]
