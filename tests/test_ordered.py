"""Skew-safe per-key lead / row_number equal the plain windows, with one hot key."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagwise.operators import ordered


def _data(spark):
    random.seed(3)
    rows = []
    for i in range(4000):
        key = "hot" if i % 3 else f"k{random.randint(0, 40)}"
        rows.append((key, random.randint(0, 500), i, random.random()))
    return spark.createDataFrame(rows, "key string, ts int, seq int, v double")


def test_next_in_key_equals_lead(spark):
    df = _data(spark)
    fast = {r["seq"]: (r["next_ts"], r["next_v"]) for r in
            ordered.next_in_key(df, "key", ["ts", "seq"], ["ts", "v"], parts=7).collect()}
    w = Window.partitionBy("key").orderBy("ts", "seq")
    plain = {r["seq"]: (r["a"], r["b"]) for r in
             df.select("seq", F.lead("ts").over(w).alias("a"), F.lead("v").over(w).alias("b")).collect()}
    assert fast == plain


def test_rank_in_key_equals_row_number(spark):
    df = _data(spark)
    fast = {r["seq"]: r["rank"] for r in ordered.rank_in_key(df, "key", ["ts", "seq"], parts=5).collect()}
    w = Window.partitionBy("key").orderBy("ts", "seq")
    plain = {r["seq"]: r["rn"] for r in df.select("seq", F.row_number().over(w).alias("rn")).collect()}
    assert fast == plain


def test_fill_forward_equals_last_ignore_nulls(spark):
    df = _data(spark).withColumn("v", F.when(F.col("seq") % 5 == 0, F.col("v")))
    fast = {r["seq"]: r["f"] for r in ordered.fill_forward(df, "key", ["ts", "seq"], "v", "f", parts=6).collect()}
    w = Window.partitionBy("key").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    plain = {r["seq"]: r["f"] for r in df.select("seq", F.last("v", ignorenulls=True).over(w).alias("f")).collect()}
    assert fast == plain


def test_asof_lookup_equals_interval_join_with_hot_key(spark):
    from tagwise.operators import asof
    random.seed(5)
    ev_rows, ch_rows = [], []
    for i in range(3000):
        key = "hot" if i % 3 else f"k{random.randint(0, 30)}"
        (ch_rows if i % 4 == 0 else ev_rows).append((key, random.randint(0, 300), i, random.random() < 0.5))
    ev = spark.createDataFrame([(k, t, s) for k, t, s, _ in ev_rows], "key string, ts int, eseq int")
    ch = spark.createDataFrame(ch_rows, "key string, ts int, seq int, flag boolean")
    for seq in ["eseq", None]:
        want = {r["eseq"]: r["flag"] for r in
                asof.asof_join(ev, asof.validity_intervals(ch, "key"), "key", "ts", ["flag"], event_seq=seq).collect()}
        got = {r["eseq"]: r["flag"] for r in
               asof.asof_lookup(ev, ch, "key", "ts", ["flag"], event_seq=seq, parts=5).collect()}
        assert got == want and len(got) == len(ev_rows)


def test_null_keys_are_kept(spark):
    from tagwise.operators import asof
    df = spark.createDataFrame([(None, 1, 1, 0.5), (None, 2, 2, None), ("a", 1, 3, 1.0)],
                               "key string, ts int, seq int, v double")
    got = {r["seq"]: r["v"] for r in ordered.fill_forward(df, "key", ["ts", "seq"], "v", parts=2).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 1.0}
    assert {r["seq"]: r["rank"] for r in ordered.rank_in_key(df, "key", ["ts", "seq"], parts=2).collect()} == \
        {1: 1, 2: 2, 3: 1}
    ev = spark.createDataFrame([(None, 5, 10), ("a", 5, 11)], "key string, ts int, eseq int")
    ch = spark.createDataFrame([(None, 1, 1, True), ("a", 1, 2, True)], "key string, ts int, seq int, flag boolean")
    got = {r["eseq"]: r["flag"] for r in asof.asof_lookup(ev, ch, "key", "ts", ["flag"], event_seq="eseq").collect()}
    assert got == {10: None, 11: True}


def test_asof_lookup_inner_drops_events_without_change(spark):
    from tagwise.operators import asof
    ev = spark.createDataFrame([("a", 1, 1), ("a", 5, 2), ("b", 5, 3)], "key string, ts int, eseq int")
    ch = spark.createDataFrame([("a", 3, 10, "x")], "key string, ts int, seq int, v string")
    left = {r["eseq"]: r["v"] for r in asof.asof_lookup(ev, ch, "key", "ts", ["v"]).collect()}
    inner = {r["eseq"]: r["v"] for r in asof.asof_lookup(ev, ch, "key", "ts", ["v"], how="inner").collect()}
    assert left == {1: None, 2: "x", 3: None} and inner == {2: "x"}
