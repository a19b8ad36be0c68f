"""Source discovery, layouts and the merged corpus on hand-made files."""

import os

import pytest
from pyspark.sql import functions as F

from tagwise.sources import files as fl

SCHEMA = "instruction string, intent string"


def plain_file(spark, folder, name, rows, schema):
    """One file, as the reference's own layout has it, not a directory of parts."""
    part = f"{folder}/_parts_{name}"
    df = spark.createDataFrame(rows, schema).coalesce(1)
    (df.write.parquet if name.endswith("parquet") else lambda p: fl.write_csv(df, p))(part)
    (one,) = [f for f in os.listdir(part) if f.startswith("part-")]
    os.rename(f"{part}/{one}", f"{folder}/{name}")


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_mixed_layouts(spark, tmp_path):
    d = str(tmp_path)
    plain_file(spark, d, "bitext_retail.parquet", [("a", "x")], "instruction string, intent string")
    plain_file(spark, d, "bitext_support.parquet", [("y", "b")], "label string, text string")
    plain_file(spark, d, "bitext_swapped.csv", [("z", 'c "quoted",\nline')], "Intent string, Instruction string")
    plain_file(spark, d, "bitext_retail.csv", [("shadowed", "x")], "instruction string, intent string")
    spark.createDataFrame([("e", 1, "w")], "utterance string, n int, category string").write.parquet(f"{d}/bitext_last.parquet")
    spark.createDataFrame([("f", "v", "own")], "text string, my_INTENT string, source string").write.parquet(f"{d}/bitext_tagged.parquet")
    plain_file(spark, d, "other.parquet", [("no", "no")], "instruction string, intent string")
    assert got(fl.read_sources(spark, d, SCHEMA)) == [
        ("a", "x", "bitext_retail"), ("b", "y", "bitext_support"), ('c "quoted",\nline', "z", "bitext_swapped"),
        ("e", "w", "bitext_last"), ("f", "v", "own")]


def test_equal_layouts_are_one_scan(spark, tmp_path):
    for i in range(4):
        spark.createDataFrame([(f"t{i}", "x")], SCHEMA).write.parquet(f"{tmp_path}/bitext_{i}.parquet")
    found = fl.discover_sources(spark, str(tmp_path))
    assert len(found["parquet"]) == 4 and len(fl.read_parquet_groups(spark, found["parquet"])) == 1


def test_unknown_header(spark, tmp_path):
    plain_file(spark, str(tmp_path), "bitext_a.csv", [("a", "x")], "question string, answer string")
    with pytest.raises(ValueError):
        fl.read_sources(spark, str(tmp_path), SCHEMA)


def test_csv_columns_by_name(spark, tmp_path):
    fl.write_csv(spark.createDataFrame([(1, "t")], "n int, text string"), f"{tmp_path}/one")
    df = fl.read_csv(spark, f"{tmp_path}/one", "text string, n int")
    assert df.columns == ["text", "n"] and got(df) == [("t", 1)]


def test_corpus_with_and_without_raw_sources(spark, tmp_path):
    d = str(tmp_path)
    mapped = lambda c: F.upper(c)
    with pytest.raises(FileNotFoundError):
        fl.read_corpus(spark, d, SCHEMA, mapped)
    spark.createDataFrame([("s", "Verbatim", "synthetic")], "text string, label string, source string").write.parquet(f"{d}/made.parquet")
    assert got(fl.read_corpus(spark, d, SCHEMA, mapped, f"{d}/made.parquet")) == [("s", "Verbatim", "synthetic")]
    plain_file(spark, d, "bitext_a.parquet", [("a", "x"), ("b", None), (None, "c")], SCHEMA)
    assert got(fl.read_corpus(spark, d, SCHEMA, mapped, f"{d}/made.parquet")) == [("a", "X", "bitext_a"), ("s", "Verbatim", "synthetic")]


def test_shared_folder_is_asked_for(spark, monkeypatch):
    """A session that is more than this process must name a shared folder."""
    from tagwise import session

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: Elsewhere.conf)})

    with pytest.raises(RuntimeError):
        session.checkpoint_root(Elsewhere)


def test_percentiles(spark):
    import numpy as np

    from tagwise.operators.ordered import percentiles
    values = [float(x) for x in np.random.default_rng(0).normal(size=501)] + [0.5] * 100
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = np.quantile(values, [0.0, 0.5, 0.95, 0.99, 1.0])
    assert np.allclose(percentiles(df, "v", [0.0, 0.5, 0.95, 0.99, 1.0]), want)
    assert percentiles(df.limit(0), "v", [0.5]) == [None]


def test_nearest_centroid(spark):
    from tagwise.operators import ml
    rows = [(1, [0.0, 0.0], 0), (2, [0.0, 2.0], 0), (3, [10.0, 0.0], 1), (4, [5.0, 0.5], 1)]
    df = spark.createDataFrame(rows, "vec_id int, v array<float>, label int")
    got = {r.vec_id: (r.pred_label, r.distance2) for r in ml.nearest_centroid(df, ml.centroids(df, "v", "label"), "v", "label").collect()}
    assert got == {1: (0, 1.0), 2: (0, 1.0), 3: (1, 6.3125), 4: (1, 6.3125)}


def test_erasure_touches_only_its_buckets(spark, tmp_path):
    from tagwise.operators import privacy as pv
    path = f"{tmp_path}/log"
    pv.write_capture_log(spark.createDataFrame([(f"k{i % 40}", i) for i in range(200)], "file_key string, n int"), path)
    before = {(f, os.path.getmtime(os.path.join(d, f))) for d, _, fs in os.walk(path) for f in fs if f.endswith("parquet")}
    touched = pv.erase_from_log(spark, path, spark.createDataFrame([("k3",), ("k7",), ("absent",)], "file_key string"))
    left = spark.read.parquet(path)
    assert {r.file_key for r in left.collect()} == {f"k{i}" for i in range(40)} - {"k3", "k7"} and left.count() == 190
    after = {(f, os.path.getmtime(os.path.join(d, f))) for d, _, fs in os.walk(path) for f in fs if f.endswith("parquet")}
    assert 1 <= len(touched) <= 3 and len(before - after) <= 3


def test_late_rows_are_counted(spark, tmp_path):
    """A row behind the watermark is dropped and counted."""
    from tagwise.streaming import common, windows
    rows = [(f"2024-01-0{d} 10:00:00", "WISMO") for d in (1, 2, 5, 6)]
    frames = [spark.createDataFrame([r], "t string, intent string").select(F.to_timestamp("t").alias("ts"), "intent") for r in rows + rows[:1]]
    for i, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for name in os.listdir(f"{tmp_path}/in"):
            if name.startswith("part-") and os.path.getmtime(f"{tmp_path}/in/{name}") > 1e9 + 100:
                os.utime(f"{tmp_path}/in/{name}", (1e9 + i, 1e9 + i))
    stream = common.file_stream(spark, f"{tmp_path}/in", frames[0].schema)
    assert windows.start_intent_windows(spark, stream, f"{tmp_path}/out") == 1
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.sum("n")).first()[0] == 3


def test_first_source_wins_from_files_to_corpus(spark, tmp_path):
    """Of equal texts the first in source order stays: Parquet before CSV, names in order, rows in
    order, the synthetic table last. Split sizes of the scans do not matter."""
    from tagwise.operators import curate as cu
    d = str(tmp_path)
    plain_file(spark, d, "bitext_b.parquet", [("Same words here", "x"), (" same words here", "y"), ("in b only now", "x")], "instruction string, intent string")
    plain_file(spark, d, "bitext_b-1.parquet", [("b", "Same words here"), ("b", "in two files now")], "label string, text string")
    plain_file(spark, d, "bitext_a.csv", [("csv", "In two files now"), ("csv", "only, in\ncsv here"), ("late", "only, in\ncsv here")], "Intent string, Instruction string")
    many = [(f"text number {i % 3000} here", f"l{i}") for i in range(9000)]
    spark.createDataFrame(many, "instruction string, intent string").coalesce(1).write.parquet(f"{d}/bitext_many.parquet")
    spark.createDataFrame([("only in made ones", "made", "syn"), ("in b only now", "made", "syn"), ("in b only now", "twice", "syn")],
                          "text string, label string, source string").coalesce(1).write.parquet(f"{d}/made.parquet")

    def corpus():
        return fl.read_corpus(spark, d, SCHEMA, lambda c: F.upper(c), f"{d}/made.parquet", ordered=True)

    def firsts():
        return {r.text_hash: (r.label, r.source) for r in cu.dedup_keep_first(corpus(), "source_order").collect()}

    got_first = firsts()
    by_text = {r.text.strip().lower(): got_first[r.text_hash] for r in cu.dedup_keep_first(corpus(), "source_order").collect()}
    assert by_text["same words here"] == ("X", "bitext_b") and by_text["in two files now"] == ("B", "bitext_b-1")
    assert by_text["only, in\ncsv here"] == ("CSV", "bitext_a") and by_text["in b only now"] == ("X", "bitext_b")
    assert by_text["only in made ones"] == ("made", "syn")
    assert all(by_text[f"text number {i} here"] == (f"L{i}", "bitext_many") for i in range(3000))
    sizes = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0", "spark.sql.shuffle.partitions": "3"}
    old = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        assert corpus().rdd.getNumPartitions() > 8 and firsts() == got_first
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_layouts_are_read_by_one_job(spark, tmp_path):
    d = str(tmp_path)
    for i in range(12):
        plain_file(spark, d, f"bitext_{i}.parquet", [("a", "x")], "instruction string, intent string" if i % 2 else "text string, label string")
        plain_file(spark, d, f"bitext_c{i}.csv", [("a", "x")], "Intent string, Instruction string" if i % 3 else "instruction string, intent string")
    found = fl.discover_sources(spark, d)
    tracker, group = spark.sparkContext.statusTracker(), "layouts-test"
    spark.sparkContext.setJobGroup(group, "")
    try:
        got_layouts = fl.layouts(spark, found["parquet"] + found["csv"])
        assert len(tracker.getJobIdsForGroup(group)) <= 2               # the map and its exchange
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert len(got_layouts) == 24 and len(set(got_layouts.values())) == 4
    assert len(fl.read_parquet_groups(spark, found["parquet"])) == 2 and len(fl.read_csv_groups(spark, found["csv"], SCHEMA)) == 2
