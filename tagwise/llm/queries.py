"""Registered queries of the subpackage: one for each operator, over its whole table, and
the corpus pipeline. ``ORACLES`` has DuckDB SQL where SQL expresses the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwise.llm import alignment, decontam, langid, line_spread, minhash, mixing, neural_lm, packing, phrases, pii, secret_scan, token_files, topk
from tagwise.llm.common import in_residue, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return add


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabulary lies; the same on every executor."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_near_duplicates")
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at a similarity of 0.85 of their word 5-grams."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_pseudonyms")
def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by format-preserving pseudonyms."""
    done = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.EXAMPLE_KEY)
    count = [(F.size("pii") - F.size(F.array_remove("pii", k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return done.select("doc_id", F.size("pii").cast("long").alias("n_pii"), *count, "text")


@query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents written as Elias-Fano shards and read back."""
    return token_files.token_table(spark, table(spark, sf_dir, "documents"), tokenizer_path(), added_tokens=True)


@query("op4_language_model")
def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document by a log-bilinear model of six sevenths of them."""
    docs = table(spark, sf_dir, "documents")
    return neural_lm.score(docs, in_residue("doc_id", 7, 2))


@query("op5_secrets")
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: the base patterns and what the randomness battery adds."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    kinds = [*secret_scan.BASE, secret_scan.RANDOM]

    def listed(names: list[str]):
        def numbered(i: int):
            return F.transform(names[i], lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["stop"].alias("stop")))

        tagged = [numbered(i) for i in range(len(names))]
        label = F.array(*[F.lit(k) for k in names])
        return F.array_join(F.transform(F.array_sort(F.concat(*tagged)), lambda x: F.concat_ws(
            ":", F.get(label, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")

    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in secret_scan.BASE],
                        F.sha2(listed(kinds[:3]), 256).alias("base_sha256"), listed(kinds).alias("spans"),
                        F.size(secret_scan.RANDOM).cast("long").alias("n_random"))


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by rank-order profiles, learned from three quarters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang") \
        .withColumn("held_out", in_residue("doc_id", 4, 2))
    profiles = langid.train(docs.where(~F.col("held_out")))
    return docs.withColumn("found", langid.predicted(profiles, F.col("text"))) \
        .select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


@query("op7_source_mix")
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a 5:2:1 mix of the sources takes of every document."""
    made = mixing.copies(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


@query("op8_top_vectors", sql=f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % {topk.QUERY_STEP} = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= {topk.K}""")
def op8_top_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % topk.QUERY_STEP == 0)


@query("op9_line_spread", sql=rf"""
WITH l AS (SELECT doc_id, source, pos, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare
           FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                        generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL)),
gone AS (SELECT bare FROM l WHERE bare <> '' AND source IS NOT NULL GROUP BY bare HAVING count(DISTINCT source) >= {line_spread.LEAST_SITES}),
d AS (SELECT doc_id, count(*) FILTER (bare <> '') AS n_lines, count(*) FILTER (bare IN (SELECT bare FROM gone)) AS n_removed,
             md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (bare NOT IN (SELECT bare FROM gone)), '')) AS clean_md5
      FROM l GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, clean_md5
FROM documents LEFT JOIN d USING (doc_id)""")
def op9_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that eight or more sources carry."""
    done = line_spread.clean_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("clean_md5"))


@query("op10_decontamination", sql=r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, len(w[i:i + 9]) AS n, array_to_string(w[i:i + 9], ' ') AS gram
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
          FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d),
               (SELECT DISTINCT n FROM win) WHERE i + n - 1 <= len(w)),
hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN win USING (n, gram)),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
owners AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                  string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN owners USING (doc_id)""")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document, from the positional index of all of them."""
    index = decontam.build_index(table(spark, sf_dir, "documents"))
    found = decontam.contamination(index, table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two vocabularies aligned by bytes, with links counted over all documents."""
    docs = table(spark, sf_dir, "documents")
    return alignment.align(docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model")).documents


@query("op12_packing")
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens packed into sequences of 4096 by minimum bin slack."""
    done = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return done.pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op13_collocations", sql=rf"""
WITH p AS (SELECT coalesce(lang, '{phrases.UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(text,
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
          FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
                FROM w, (SELECT unnest(generate_series(1, {phrases.LONGEST})) AS k) WHERE len(w) >= k)),
total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM grams GROUP BY ALL HAVING count(*) >= {phrases.LEAST}),
kept AS (SELECT * FROM f WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM f AS g WHERE g.lang = f.lang AND g.k > f.k
           AND g.a >= f.a AND contains(' ' || g.phrase || ' ', ' ' || f.phrase || ' '))),
cut AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS s, unnest(generate_series(1, k - 1)) AS j FROM kept),
scored AS (SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, n, (1000 * c.a * n) // (l.a * r.a) AS score, j
           FROM cut AS c JOIN total USING (lang)
           JOIN f AS l ON l.lang = c.lang AND l.k = j AND l.phrase = array_to_string(s[1:j], ' ')
           JOIN f AS r ON r.lang = c.lang AND r.k = c.k - j AND r.phrase = array_to_string(s[j + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best QUALIFY rank <= {phrases.TOP}""")
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best-connected phrases, mined from all documents."""
    return phrases.collocations(table(spark, sf_dir, "documents"))
