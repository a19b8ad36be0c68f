import re

import numpy as np
import pytest

from tagwise.llm import minhash
from tests.llm.fixtures import SCHEMA, awkward_rows, clashing, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, least=(85, 100)):
    """doc_id -> component by all pairs; rows that share an id are one node."""
    sets = [(r[0], word_sets(r[1])) for r in rows if r[0] is not None]
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if x and y and least[1] * both >= least[0] * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {d: find(d) for d in up}


def check(got, rows):
    want = brute(rows)
    assert len(got) == len(rows)
    sizes = sorted(((r[0] is None, r[0] or 0, len(word_sets(r[1]))) for r in rows))
    assert sorted((g.doc_id is None, g.doc_id or 0, g.n_shingles) for g in got) == sizes
    for g in got:
        assert g.component_id == (None if g.doc_id is None else want[g.doc_id])
        assert g.kept == (g.doc_id is None or want[g.doc_id] == g.doc_id)


def test_awkward_rows(spark):
    check(minhash.near_duplicates(clashing(documents(spark))).collect(), awkward_rows())


def test_one_id_with_two_texts(spark):
    """Both texts have neighbours of a similarity of 0.6 to 0.95 in several buckets; ids repeat
    as the smallest of a component, as a later one, with an empty text and with equal texts."""
    rng = np.random.default_rng(8)
    rows = []

    def family(name, ids, size=90):
        base = [f"{name}{i}" for i in range(size)]
        for n, d in enumerate(ids):
            some = list(base)
            for k in rng.integers(0, size, n % 5):
                some[k] = f"{name}x{d}-{k}"
            rows.append((d, " ".join(some), "en", "s", 0))

    family("a", [500, *range(520, 534), 7])
    family("b", [500, *range(540, 554), 7])
    family("c", [*range(560, 574), 500])
    family("d", [3, *range(580, 594)])
    family("e", [595, 3, *range(600, 612)], 60)
    family("f", [620, 621, 622], 40)
    rows += [(621, "", "en", "s", 0), (630, None, "en", "s", 0), (630, rows[-1][1], "en", "s", 0), (500, rows[0][1], "en", "s", 0),
             (640, "", "en", "s", 0), (640, None, "en", "s", 0)]
    check(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect(), rows)


def test_empty_table(spark):
    assert minhash.near_duplicates(documents(spark, [])).collect() == []


def test_chains_and_a_large_group(spark):
    """A group of near copies whose members are linked through others only, and one whose
    members resemble each other just below the threshold."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    rows, at = [], 0
    chain = list(words)
    for i in range(60):                         # each differs from the one before in one word
        chain[(7 * i) % 60] = f"c{i}"
        rows.append((at, " ".join(chain), "en", "s", 0))
        at += 1
    for i in range(80):
        some = [f"g{j}" for j in range(100)]
        for k in rng.integers(0, 100, 1 + i % 3):
            some[k] = f"x{i}-{k}"
        rows.append((at, " ".join(some), "en", "s", 0))
        at += 1
    check(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect(), rows)


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.9):
        found = []
        for _ in range(20):
            h = rng.integers(0, 1 << 63, 2000, np.uint64)
            n = int(round(1000 * 2 * share / (1 + share)))
            a, b = h[:1000], h[1000 - n:2000 - n]
            equal = np.ones(minhash.HASHES, bool)
            x, y = minhash.signature(a), minhash.signature(b)
            differ = np.zeros(minhash.WORDS, np.int64)
            for p in range(minhash.BITS):
                differ |= x[p * minhash.WORDS:(p + 1) * minhash.WORDS] ^ y[p * minhash.WORDS:(p + 1) * minhash.WORDS]
            found.append(minhash.corrected(1 - np.bitwise_count(differ.view(np.uint64)).sum() / len(equal)))
        assert abs(np.mean(found) - n / (2000 - n)) < 0.02


def test_small_sets_at_the_threshold_pass_the_estimate():
    """Pairs of 5 to 30 shingles just at 0.85 and at 0.80: none falls below its floor, and the
    estimate deviates as 1,024 independent draws do."""
    rng = np.random.default_rng(11)
    for union, both, least in ((7, 6, 0.85), (20, 17, 0.85), (5, 4, 0.8), (10, 8, 0.8), (30, 24, 0.8)):
        found = []
        for _ in range(300):
            h = minhash.mixed(rng.integers(0, 1 << 63, union, np.uint64))
            x, y = (minhash.signature(s).reshape(minhash.BITS, minhash.WORDS) for s in (h, h[:both]))
            unequal = np.bitwise_count(np.bitwise_or.reduce(x ^ y).view(np.uint64)).sum()
            found.append(minhash.corrected(1 - unequal / minhash.HASHES))
        equal = 0.25 + 0.75 * both / union
        assert np.std(found) < 1.2 * np.sqrt(equal * (1 - equal) / minhash.HASHES) / 0.75
        assert min(found) >= least - minhash.MARGIN


def test_shingles_do_not_depend_on_pieces():
    words = [f"word{i % 977}x{i}" for i in range((1 << 17) + 50)]
    whole = minhash.shingles(" ".join(words).encode())
    assert len(whole) == len(words) - 4
    assert len(np.intersect1d(whole, minhash.shingles(" ".join(words[(1 << 17) - 20:]).encode()))) == 66


@pytest.mark.parametrize("edges,want", [
    ([], {}), ([(1, 2), (2, 3), (7, 5)], {1: 1, 2: 1, 3: 1, 5: 5, 7: 5}),
    ([(100, i) for i in range(1, 60)], {i: 1 for i in [*range(1, 60), 100]}),
    ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)})])
def test_components(spark, edges, want):
    got = minhash.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == want
