"""Small tables with the awkward rows that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = {"en": "the of and tree house river walks under green stone morning light".split(),
         "fr": "le la et arbre maison rivière marche sous vert pierre matin lumière".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(VOCAB[lang]) + str(rng.randrange(40)) for _ in range(n))


def awkward_rows(seed=1, n=40):
    """Rows of two languages and three sources (one holds most), near and exact copies,
    null, empty, blank and very long texts, a repeated row, null ids and labels."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = "fr" if i % 4 == 0 else "en"
        rows.append((i, prose(rng, lang, rng.randrange(3, 200)), lang, "s0" if i % 3 else f"s{i % 2 + 1}"))
    base = prose(rng, "en", 120).split()
    for i in range(8):
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"changed{i}"
        rows.append((100 + i, " ".join(copy), "en", "s0"))
    rows += [(200 + i, " ".join(base), "en", "s0") for i in range(5)]
    rows += [(300, None, "en", "s0"), (301, "", "en", "s1"), (302, " \t\n ", None, None), (303, "one", "en", None),
             (304, "1234 5678 !!", "en", "s1"), (305, prose(rng, "en", 30_000), "en", "s1"), (306, "x" * 50_000, None, "s0"),
             (None, "no id here at all", "en", "s0"), (None, None, None, None),
             (0, rows[0][1], rows[0][2], rows[0][3])]
    return [(d, t, lg, s, None if t is None else len(t)) for d, t, lg, s in rows]


def documents(spark, rows=None):
    return spark.createDataFrame(awkward_rows() if rows is None else rows, SCHEMA)


def clashing(df):
    """The same rows with further columns named like the operators' own."""
    from pyspark.sql import functions as F
    for name in ("k", "t", "id", "key", "size", "rank", "score", "row", "at", "line", "site", "pii", "held", "vector", "component_id", "copies", "_key"):
        df = df.withColumn(name, F.lit("clash"))
    return df
