import re
from collections import defaultdict

import pytest

from tagwise.llm import line_spread
from tests.llm.fixtures import awkward_rows, clashing, documents

EDGES = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")


def brute(rows, least):
    sites = defaultdict(set)
    for _, t, _, s, _ in rows:
        for line in (t or "").split("\n"):
            if EDGES.sub("", line) and s is not None:
                sites[EDGES.sub("", line)].add(s)
    gone = {x for x, s in sites.items() if len(s) >= least}
    out = []
    for d, t, _, _, _ in rows:
        lines = [] if t is None else t.split("\n")
        bare = [EDGES.sub("", x) for x in lines]
        out.append((d, sum(b != "" for b in bare), sum(b in gone for b in bare), None if t is None else "\n".join(x for x, b in zip(lines, bare) if b not in gone)))
    return sorted(out, key=str)


def rows():
    own = awkward_rows()
    for i in range(30):
        own.append((600 + i, f"head\n  shared by all \nown line {i}\r\n\nshared by {i % 2}\nhead\n", "en", f"site{i % 10}", 0))
    own.append(own[-1])
    return own


@pytest.mark.parametrize("least", [1, 2, 5, 6, 11])
def test_equals_brute_force(spark, least):
    own = rows()
    got = line_spread.clean_lines(clashing(documents(spark, own)).drop("site"), least).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got), key=str) == brute(own, least)


def test_many_sites_near_the_threshold(spark):
    """Estimates near the threshold give way to exact counts."""
    least = 400
    lines = [(f"l{n}".encode(), f"s{i}") for n in (380, 399, 400, 401, 420, 900) for i in range(n)]
    got = line_spread.spread_lines(spark.createDataFrame(lines * 2, "line binary, site string"), least)
    assert {bytes(r.line).decode() for r in got.collect()} == {"l400", "l401", "l420", "l900"}


def test_empty_table(spark):
    assert line_spread.clean_lines(documents(spark, [])).collect() == []
