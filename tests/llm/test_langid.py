from pyspark.sql import functions as F

from tagwise.llm import langid
from tests.llm.fixtures import awkward_rows, clashing, documents


def test_held_out_accuracy(spark):
    docs = documents(spark).withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    profiles = langid.train(docs.where("not held"))
    assert profiles.names == ["en", "fr"]
    got = docs.where("held and lang is not null and length(text) > 40 and text rlike ' '") \
        .withColumn("found", langid.predicted(profiles, F.col("text"))).collect()
    assert len(got) > 5 and all(r.found.lang == r.lang and 0 < r.found.score <= 1 for r in got)


def test_awkward_texts(spark):
    docs = clashing(documents(spark))
    profiles = langid.train(docs)
    got = docs.withColumn("found", langid.predicted(profiles, F.col("text"))).collect()
    assert len(got) == len(awkward_rows())
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.found.lang == langid.UNKNOWN) == (not letters)
        assert 0 <= r.found.score <= 1 and (letters or r.found.score == 0)


def test_nothing_learned(spark):
    profiles = langid.train(documents(spark, []))
    got = documents(spark).select(langid.predicted(profiles, F.col("text")).alias("f")).collect()
    assert {(r.f.lang, r.f.score) for r in got} == {(langid.UNKNOWN, 0.0)}


def test_distance_equals_the_definition():
    """Against n-grams as strings and ranks as dictionaries."""
    import collections
    import re

    def ranked(text, size):
        grams = collections.Counter()
        for w in re.findall(r"[a-zéè]+", text.lower()):
            grams.update(w)
            w = f"_{w}_"
            grams.update(w[i:i + 2] for i in range(len(w) - 1))
            grams.update(w[i:i + 3] for i in range(len(w) - 2))
        return grams

    texts = {"en": "the green tree and the old house under the hill " * 3, "fr": "le vieux café et la maison près du pré " * 3}
    size = 1000          # all n-grams, so ties do not choose among them
    counts = {k: langid.merged([langid.counted(c) for c in langid.ngrams(t)]) for k, t in texts.items()}
    for k, t in texts.items():
        assert sorted(counts[k][1].tolist()) == sorted(ranked(t, size).values())
    profiles = langid.Profiles.of({k: langid.top(*counts[k], size).tolist() for k in texts}, size)
    assert profiles.predict(texts["en"]) == ("en", 1.0)
    assert profiles.predict("the house and the tree")[0] == "en"
    assert profiles.predict("la maison et le pré")[0] == "fr"


def test_stretches(monkeypatch):
    text = "some words of a text, " * 50
    whole = langid.merged([langid.counted(c) for c in langid.ngrams(text)])
    monkeypatch.setattr(langid, "STRETCH", 37)
    parts = langid.merged([langid.counted(c) for c in langid.ngrams(text)])
    assert all((a == b).all() for a, b in zip(whole, parts))
