"""Evaluation metrics (A13–A17, A28) and tagging rules."""

from pyspark.sql import functions as F

from tagwise import taxonomy as tx
from tagwise.operators import evaluate as ev
from tagwise.operators import naive_bayes as nb
from tagwise.operators import route as rt

PRED = [  # y_true, y_pred
    ("WISMO", "WISMO"), ("WISMO", "WISMO"), ("WISMO", "OTHER"),
    ("OTHER", "OTHER"), ("CANCEL_ORDER", "WISMO"),       # CANCEL never predicted
    ("OTHER", "BILLING_DISPUTE"),                          # BILLING never true
]


def _pred(spark):
    return spark.createDataFrame([(i, t, p, 0.9) for i, (t, p) in enumerate(PRED)],
                                 "id int, y_true string, y_pred string, confidence double")


def _expected():
    labels = sorted({t for t, _ in PRED} | {p for _, p in PRED})
    out = {}
    for lab in labels:
        tp = sum(1 for t, p in PRED if t == lab and p == lab)
        sup = sum(1 for t, _ in PRED if t == lab)
        prd = sum(1 for _, p in PRED if p == lab)
        p = tp / prd if prd else 0.0
        r = tp / sup if sup else 0.0
        f = 2 * p * r / (p + r) if p + r else 0.0
        out[lab] = (sup, prd, tp, p, r, f)
    return out


def test_class_report_zero_division(spark):
    rep = {r["label"]: r for r in ev.class_report(_pred(spark)).collect()}
    exp = _expected()
    assert set(rep) == set(exp)
    for lab, (sup, prd, tp, p, r, f) in exp.items():
        row = rep[lab]
        assert (row["support"], row["predicted"], row["tp"]) == (sup, prd, tp)
        assert row["precision"] == round(p, 4) and row["recall"] == round(r, 4) and row["f1"] == round(f, 4)
    assert rep["CANCEL_ORDER"]["f1"] == 0.0 and rep["BILLING_DISPUTE"]["precision"] == 0.0


def test_summary_macro_weighted(spark):
    s = ev.summary(_pred(spark)).first()
    exp = _expected()
    n = len(PRED)
    assert s["accuracy"] == round(sum(1 for t, p in PRED if t == p) / n, 4)
    assert s["f1_macro"] == round(sum(v[5] for v in exp.values()) / len(exp), 4)
    assert s["f1_weighted"] == round(sum(v[5] * v[0] for v in exp.values()) / n, 4)
    worst = min(exp.items(), key=lambda kv: (kv[1][5], kv[0]))[0]
    assert s["worst_label"] == worst
    assert s["release_gate_passed"] is False


def test_confusion_matrix_includes_zero_cells(spark):
    cm = ev.confusion_matrix(spark, _pred(spark)).collect()
    labels = {t for t, _ in PRED} | {p for _, p in PRED}
    assert len(cm) == len(labels) ** 2
    assert sum(r["n"] for r in cm) == len(PRED)


def test_threshold_sweep(spark):
    df = spark.createDataFrame([(0.5, True), (0.7, False), (0.96, True)], "confidence double, correct boolean")
    rows = {r["threshold"]: r for r in ev.threshold_sweep(df).collect()}
    assert rows[0.5]["tagged"] == 3 and rows[0.7]["tagged"] == 2 and rows[0.95]["tagged"] == 1
    assert rows[0.7]["precision"] == 0.5 and rows[0.95]["coverage"] == round(1 / 3, 4)


def test_threshold_is_strict_on_rounded_confidence(spark):
    df = spark.createDataFrame([(0.70, "WISMO"), (0.6999, "WISMO"), (0.75, "RETURN_REQUEST")],
                               "confidence double, intent_raw string")
    got = [(r["below_threshold"], r["intent"]) for r in nb.apply_threshold(df, 0.70).collect()]
    assert got == [(False, "WISMO"), (True, "OTHER"), (False, "RETURN_REQUEST")]


def test_tag_choice_enabled_gate(spark):
    rows = [("WISMO", False, None), ("WISMO", False, []), ("WISMO", False, ["RETURN_REQUEST"]),
            ("WISMO", True, None), ("PRODUCT_QUESTION", False, ["PRODUCT_QUESTION"])]
    df = spark.createDataFrame(rows, "intent string, below boolean, enabled array<string>")
    got = [r[0] for r in df.select(rt.choose_tag(F.col("intent"), F.col("below"), F.col("enabled"))).collect()]
    assert got == ["ei-wismo", "ei-wismo", tx.UNCLASSIFIED_TAG, tx.UNCLASSIFIED_TAG, "ei-product-q"]


def test_valid_intents_keeps_order_and_duplicates(spark):
    df = spark.createDataFrame([(["WISMO", "BOGUS", "OTHER", "WISMO"],)], "a array<string>")
    assert df.select(rt.valid_intents("a")).first()[0] == ["WISMO", "OTHER", "WISMO"]


def test_routing_rules(spark):
    df = spark.createDataFrame([("ei-wismo", "WISMO", 0.9), ("ei-damaged", "DAMAGED_ITEM", 0.9),
                                ("ei-wismo", "WISMO", 0.8)], "tag string, intent string, confidence double")
    got = [(r["team"], r["priority"], r["macro"], r["auto_reply"]) for r in rt.route(df).collect()]
    assert got == [("Fulfillment", None, "Tracking", True), (None, "Urgent", None, False),
                   ("Fulfillment", None, "Tracking", False)]
