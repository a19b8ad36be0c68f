import zlib
from collections import Counter

import numpy as np

import corpus_pipeline as cp
from tagwise.llm import mixing, token_files
from tagwise.llm.queries import ORACLES, QUERIES, tokenizer_path
from tests.llm.fixtures import SCHEMA, awkward_rows, clashing
from tests.llm.test_decontam import brute as passages
from tests.llm.test_minhash import brute as components


def write(spark, folder, rows, items):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def encoded(rows):
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(tokenizer_path())
    out, start = [], 0
    for d, t in rows:
        ids = np.array(model.encode(t, add_special_tokens=False).ids + [token_files.END_ID], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_run_equals_brute_force(spark, tmp_path):
    rows = awkward_rows()
    word = next(t for d, t, *_ in rows if d == 5).split()
    items = [(1, " ".join(word[1:14])), (2, None)]
    folder = write(spark, tmp_path, rows, items)
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "") and r[0] != 306]       # 306 is like no language
    once = {}
    for r in kept:
        once.setdefault((r[0], r[1] if r[0] is None else None), r)
    kept = list(once.values())
    own = components([r for r in kept if r[0] is not None])
    kept = [r for r in kept if r[0] is None or own[r[0]] == r[0]]
    hit = {d for d, _, n, _ in passages(kept, [x for x in items if x[1]]) if n}
    kept = [r for r in kept if r[0] not in hit]
    made = Counter({r.doc_id: r.copies for r in mixing.copies(spark.createDataFrame(kept, SCHEMA)).collect()})
    final = sorted(((r[0], r[1]) for r in kept for _ in range(made[r[0]])), key=lambda x: (x[0] is not None, x[0] or 0))
    got = sorted(map(tuple, cp.run(spark, folder).collect()), key=lambda r: r[1])
    assert hit == {5} and 10 < len(final) and got == encoded(final)


def test_stages_keep_the_columns(spark, tmp_path):
    folder = write(spark, tmp_path, awkward_rows(), [(1, "nothing in common")])
    docs = clashing(spark.read.parquet(f"{folder}/documents.parquet"))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert out.count() > 0


def test_near_copies_from_four_fifths_on(spark):
    """One changed word in 50 leaves 41 of 51 5-grams (0.804), in 45 leaves 36 of 46 (0.783)."""
    rows = []
    for at, n in ((1, 50), (11, 45)):
        words = [f"w{at}x{i}" for i in range(n)]
        rows.append((at, " ".join(words), "en", "s", 0))
        words[n // 2] = "other"
        rows.append((at + 1, " ".join(words), "en", "s", 0))
    want = components(rows, (80, 100))
    assert want == {1: 1, 2: 1, 11: 11, 12: 12} and components(rows) == {d: d for d in want}
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()) == [1, 11, 12]


def test_batches_are_bounded_by_bytes(spark):
    """By rows alone, all of these texts (16 MB) would be one batch."""
    import pyarrow as pa
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(400).coalesce(1).selectExpr("id AS doc_id", "repeat('some words ', 3700) AS text", "'en' AS lang", "'s' AS source", "0L AS n_chars")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    spark.conf.unset(name)
    cp.language(spark, docs, "")
    found = docs.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in found) == 400 and max(r.size for r in found) < 5 << 20
    spark.conf.set(name, "1m")                     # a session's own bound is left alone
    cp.language(spark, docs, "")
    assert spark.conf.get(name) == "1m"
    spark.conf.unset(name)


def test_near_duplicates_deals_texts_out_once(spark):
    """One shuffle by key serves the anti-join and the window."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = cp.near_duplicates(spark, spark.createDataFrame(awkward_rows(), SCHEMA), "")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(_key#") == 1


def test_empty_tables(spark, tmp_path):
    assert cp.run(spark, write(spark, tmp_path, [], [])).collect() == []


def test_registered():
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "decontaminate", "mix", "tokens"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
