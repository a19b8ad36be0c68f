import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tagwise.llm import mixing
from tests.llm.fixtures import awkward_rows, clashing, documents


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(sizes, weights=(5, 2, 1), most=3):
    """The division by rounds, source by source."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(most * sizes[s]) for s in over}


def test_targets(spark):
    for sizes in ({"b": 100, "a": 10, None: 50, "c": 1}, {"x": 7}, {"a": 0, "b": 0}, {"a": 1, "b": 1000, "c": 1, "d": 1, "é": 5, "Z": 9}):
        rows = [(s, n) for s, n in sizes.items()]
        got = mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()
        want = targets(sizes)
        assert {r.source: round(r.target, 6) for r in got} == {s: round(t, 6) for s, t in want.items()}


def test_awkward_rows(spark):
    rows = awkward_rows()
    made = mixing.copies(clashing(documents(spark))).collect()
    assert len(made) == len(rows)
    assert Counter((r.doc_id, r.size, r.source) for r in made) == Counter((d, n_words(t), s) for d, t, _, s, _ in rows)
    assert all(0 <= r.copies <= 3 for r in made)
    again = mixing.copies(clashing(documents(spark)).repartition(7)).collect()
    assert sorted(map(str, made)) == sorted(map(str, again))


def test_whole_parts_and_words(spark):
    """Every document is taken floor or ceil of its wanted number of times, counts of a source
    are within one, and words near the target."""
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(20 + pmod(xxhash64(id), 400) as int))").alias("text"),
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, "cold").alias("source"))
    made = mixing.copies(docs).toPandas()
    made["source"] = made["source"].fillna("null")
    for _, g in made.groupby("source"):
        ratio = g.target.iloc[0] / g.source_size.iloc[0]
        assert g.source_size.iloc[0] == g["size"].sum()
        assert set(g.copies) <= {int(ratio), int(ratio) + 1}
        assert abs(g.copies.sum() - ratio * len(g)) < 1 + 1e-6
        assert abs((g.copies * g["size"]).sum() / g.target.iloc[0] - 1) < 0.02


def test_chances_are_kept(spark):
    """Over seeds, a document is taken as often as its fraction says."""
    docs = spark.createDataFrame([(i, "w " * (i + 1), "a" if i % 2 else "b") for i in range(40)], "doc_id long, text string, source string")
    n = defaultdict(int)
    for seed in range(12):
        for r in mixing.copies(docs, seed=seed).collect():
            n[r.source] += r.copies
    per = {r.source: r.target / r.source_size for r in mixing.copies(docs).collect()}
    for s, total in n.items():
        assert abs(total / (12 * 20) - per[s]) < 0.06


def test_mix_repeats_rows(spark):
    docs = clashing(documents(spark))
    want = Counter()
    for r in mixing.copies(docs).collect():
        want[(r.doc_id, r.source, r.size)] += r.copies
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = Counter((r.doc_id, r.source, n_words(r.text)) for r in mixed.collect())
    assert got == +want


def test_empty(spark):
    assert mixing.copies(documents(spark, [])).collect() == []
    assert mixing.mix(documents(spark, [])).collect() == []
    (r,) = mixing.copies(documents(spark, [(1, None, None, None, None)])).collect()
    assert (r.copies, r.target, r.size) == (0, 0.0, 0)
