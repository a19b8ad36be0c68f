import random
import re

import pytest

from tagwise.llm import decontam
from tests.llm.fixtures import awkward_rows, clashing, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, items, size=10):
    out = []
    for d, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            for i in range(max(1, len(v) - size + 1) if v else 0):
                g = v[i:i + size]
                for j in range(len(w) - len(g) + 1):
                    if w[j:j + len(g)] == g:
                        hit |= set(range(j, j + len(g)))
                        found.add(item)
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def items(rows):
    rng = random.Random(3)
    out = []
    for i in range(6):
        w = words(rows[i][1])
        out.append((i, " ".join(w[2:2 + rng.randrange(4, 30)])))
    long = words(next(t for d, t, *_ in rows if d == 305))
    return out + [(20, " ".join(long[500:540])), (21, None), (22, ""), (23, "!!"), (24, "ONE"), (25, "one"), (20, " ".join(long[500:540])),
                  (26, " ".join(words(rows[0][1])[-12:]).upper().replace(" ", ".\n"))]


def test_equals_brute_force(spark):
    rows = awkward_rows()
    own = items(rows)
    index = decontam.build_index(clashing(documents(spark, rows)))
    got = decontam.contamination(index, spark.createDataFrame(own, "item_id long, text string"))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in got.collect()), key=str)
    assert got == brute(rows, [x for x in own if x[1] is not None])
    assert sum(r[2] > 0 for r in got) > 5


@pytest.mark.parametrize("limit", [3, 40])
def test_items_in_parts(spark, monkeypatch, limit):
    """Benchmarks beyond the bound go to the tasks in parts, with the same result."""
    rows = awkward_rows()
    own = items(rows)
    index = decontam.build_index(documents(spark, rows))
    frame = spark.createDataFrame(own, "item_id long, text string")
    monkeypatch.setattr(decontam, "QUERY_WORDS", limit)
    got = decontam.contamination(index, frame)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in got.collect()), key=str)
    assert got == brute(rows, [x for x in own if x[1] is not None])


def test_small_segments(spark, monkeypatch):
    rows = awkward_rows()
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", 300)
    index = decontam.build_index(documents(spark, rows))
    assert decontam.documents_of(index).count() == len(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(decontam.build_index(documents(spark, [])), none).collect() == []
    got = decontam.contamination(decontam.build_index(documents(spark)), none).collect()
    assert len(got) == len(awkward_rows()) and not any(r.n_hit for r in got)


def test_proximity(spark):
    docs = [(1, "alpha x x beta x gamma", "", "", 0), (2, "alpha " + "x " * 40 + "beta gamma", "", "", 0), (3, "gamma beta", "", "", 0)]
    index = decontam.build_index(documents(spark, docs))
    item = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    assert {r.doc_id for r in decontam.proximity_matches(index, item, 6).collect()} == {1}
    assert {r.doc_id for r in decontam.proximity_matches(index, item, 60).collect()} == {1, 2}
    assert decontam.phrase_matches(index, item).count() == 0
