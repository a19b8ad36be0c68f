"""File sources and sinks.

* Discovery lists a folder through the Hadoop FileSystem of the session (works for any
  cluster file system) and keeps one entry per stem, Parquet before CSV.
* Files that share a layout are read by **one** scan over all their paths; files of different
  layouts are read apart, brought to ``(text, label, source)`` and united by name, so no file
  is read with another one's schema. A layout is metadata: a Parquet footer, a CSV header. One
  job reads those of all paths, the driver gets a line for each.
* Rows know their place in the sources (:func:`source_order`), so that "the first one wins" holds
  from files to the curated corpus, however the files are split into tasks.
* CSV is bound by header name to an explicit schema (never ``inferSchema``), ``multiLine`` and
  RFC-4180 quote doubling, so texts with quotes and newlines round-trip; a header that the
  schema does not know is an error.
* Sinks are plain DataFrame writers: ``partitionBy`` for per-split layouts, a bucket of the
  key for per-user logs, ``mode("append")``; the output committer makes each write atomic.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def list_dir(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of ``path`` (driver-side metadata only)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return []
    return sorted(st.getPath().getName() for st in fs.listStatus(hpath))


FORMATS = ("parquet", "csv")           # in order of preference for equal stems


def discover_sources(spark: SparkSession, folder: str, prefix: str = "bitext_") -> dict[str, list[str]]:
    """S3: the paths of each format's entries in order of their names. Of the entries of one
    stem the preferred format's stays. Nothing found is an empty list for each format."""
    best: dict[str, str] = {}
    for stem, dot, ext in (name.rpartition(".") for name in list_dir(spark, folder)):
        if dot and stem.startswith(prefix) and ext in FORMATS:
            best[stem] = min(best.get(stem, ext), ext, key=FORMATS.index)
    return {f: [f"{folder}/{stem}.{f}" for stem in sorted(best) if best[stem] == f] for f in FORMATS}


def source_columns(columns: list[str]) -> tuple[str, str]:
    """S4 + S5: the columns that hold text and label, by name whatever the case. Text: ``text``,
    ``instruction``, else the first column. Label: ``label``, ``intent``, the first whose name
    contains 'intent', else the last column."""
    named = {c.lower(): c for c in reversed(columns)}
    text = next((named[n] for n in ("text", "instruction") if n in named), columns[0])
    alike = [c for c in columns if "intent" in c.lower()]
    label = next((named[n] for n in ("label", "intent") if n in named), (alike or columns[-1:])[0])
    return text, label


def normalised(df: DataFrame) -> DataFrame:
    """``(text, label, source)`` of a source read from files. The columns are found before
    anything is added; ``source`` is the frame's own, or the stem of the file or directory that
    the row came from (S6)."""
    text, label = source_columns(df.columns)
    own = [c for c in df.columns if c.lower() == "source" and c not in (text, label)]
    return df.select(F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label"),
                     (F.col(own[0]) if own else _stem()).alias("source"))


def _stem() -> Column:
    """Name of the file or directory that a row came from, without folder and ending."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)\.(?:parquet|csv)(?:/[^/]*)?$", 1)


#: Ranks of what :func:`read_corpus` reads, the synthetic table last.
PARQUET_RANK, CSV_RANK, SYNTHETIC_RANK = 0, 1, 2


def source_order(rank: int) -> Column:
    """A row's place among all rows of the sources: ``struct(rank, stem, file, row)``, ascending in
    the order of :func:`discover_sources` and of the rows in each file.

    A Parquet row has its number in the file. A multi-line CSV file is not split, so its rows
    follow each other in one task, and their running numbers there keep the file's order. Read
    it from the scan itself, before a filter or shuffle.
    """
    row = F.col("_metadata.row_index") if rank != CSV_RANK else F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.struct(F.lit(rank).alias("rank"), _stem().alias("stem"), F.col("_metadata.file_path").alias("file"), row.alias("row"))


def _layout_of(path: str) -> str:
    """Names and types of a Parquet file's columns, or a CSV file's header, as JSON; of a
    directory, those of its first file."""
    import csv
    import io

    from pyarrow import fs
    from pyarrow import parquet as pq
    where, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if where.get_file_info(at).type == fs.FileType.Directory:
        files = sorted(f.path for f in where.get_file_info(fs.FileSelector(at)) if f.is_file and not f.base_name.startswith(("_", ".")))
        if not files:
            return "[]"
        at = files[0]
    if path.rpartition(".")[2] == "parquet":
        schema = pq.read_schema(at, filesystem=where)
        return json.dumps([[f.name, str(f.type)] for f in schema])
    with where.open_input_stream(at) as stream:
        return json.dumps(next(csv.reader(io.TextIOWrapper(stream, "utf-8-sig", newline="")), []))


def layouts(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The layout of each path, read by one job over the paths: the driver gets one short line
    for each and opens no file. Only in a store that Arrow does not know, Spark's readers are
    asked, path by path."""
    def read(batches):
        import pyarrow as pa
        from pyarrow import fs
        for batch in batches:
            some, found = batch.column(0).to_pylist(), []
            for path in some:
                try:
                    if "://" in path:
                        fs.FileSystem.from_uri(path)
                except pa.ArrowInvalid:
                    found.append(None)
                else:
                    found.append(_layout_of(path))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(found, pa.string())], names=["path", "layout"])

    if not paths:
        return {}
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 1000), "path")
    found = {r.path: r.layout for r in listed.mapInArrow(read, "path string, layout string").collect()}
    for path in (p for p, layout in found.items() if layout is None):
        columns = spark.read.parquet(path).dtypes if path.endswith(".parquet") else spark.read.options(**CSV_OPTIONS).csv(path).columns
        found[path] = json.dumps(columns)
    return found


def _by_layout(spark: SparkSession, paths: list[str]) -> list[tuple[str, list[str]]]:
    """``(layout, paths)`` for each layout among the paths, in order of first occurrence."""
    found, groups = layouts(spark, paths), {}
    for path in paths:
        groups.setdefault(found[path], []).append(path)
    return list(groups.items())


def read_parquet_groups(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """One frame for each schema among the Parquet files."""
    return [spark.read.parquet(*some) for _, some in _by_layout(spark, paths)]


def read_csv_groups(spark: SparkSession, paths: list[str], schema: T.StructType | str) -> list[DataFrame]:
    """One frame for each header among the CSV files, its columns bound by name (whatever the
    case) to the fields of ``schema``. A header of an unknown name, or without one of the
    schema's, is an error."""
    fields = {f.name.lower(): f for f in (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields}
    frames = []
    for layout, some in _by_layout(spark, paths):
        header = json.loads(layout)
        if sorted(h.lower() for h in header) != sorted(fields):
            raise ValueError(f"the columns of {some[0]} are {list(header)}, expected {sorted(f.name for f in fields.values())}")
        bound = T.StructType([T.StructField(h, fields[h.lower()].dataType) for h in header])
        frames.append(spark.read.options(**CSV_OPTIONS).schema(bound).csv(some))
    return frames


def read_csv(spark: SparkSession, paths, schema: T.StructType | str) -> DataFrame:
    """Header CSV with explicit schema, bound by header name; quotes and newlines inside
    fields allowed. Columns come back in the schema's order and spelling."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    names = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).names
    frames = [f.select(*[F.col(n).alias(n) for n in names]) for f in read_csv_groups(spark, paths, schema)]
    return reduce(DataFrame.unionByName, frames)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV, RFC-4180 quoting, no whitespace trimming."""
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def read_sources(spark: SparkSession, folder: str, csv_schema: T.StructType | str, ordered: bool = False) -> DataFrame:
    """S3 + S4 + S5 + S6 + U1: every discovered source as ``(text, label, source)``, and with
    ``ordered`` each row's ``source_order``."""
    found = discover_sources(spark, folder)
    frames = [(PARQUET_RANK, f) for f in read_parquet_groups(spark, found["parquet"])] + \
        [(CSV_RANK, f) for f in read_csv_groups(spark, found["csv"], csv_schema)]
    if not frames:
        raise FileNotFoundError(f"no source files under {folder}")
    parts = [normalised(f).withColumn("source_order", source_order(rank)) if ordered else normalised(f) for rank, f in frames]
    return reduce(DataFrame.unionByName, parts)


def read_corpus(spark: SparkSession, folder: str, csv_schema: T.StructType | str, map_label: Callable[[str], Column],
                synthetic: str | None = None, ordered: bool = False) -> DataFrame:
    """S3: ``(text, label, source)`` with canonical labels: the raw sources' labels mapped, the
    synthetic table's taken as they are; with ``ordered`` also ``source_order``, the synthetic
    table last. Without raw sources the synthetic table is the corpus; without either there is
    none, which is an error."""
    found = discover_sources(spark, folder)
    frames, names = [], ["text", "label", "source", *(["source_order"] if ordered else [])]
    if any(found.values()):
        raw = read_sources(spark, folder, csv_schema, ordered).na.drop(subset=["text", "label"])
        frames.append(raw.withColumn("label", map_label("label")))
    if synthetic is not None:
        made = spark.read.parquet(synthetic)
        frames.append((made.withColumn("source_order", source_order(SYNTHETIC_RANK)) if ordered else made).select(*names))
    if not frames:
        raise FileNotFoundError(f"no source files under {folder} and no synthetic table")
    return reduce(DataFrame.unionByName, frames)


def read_json_config(spark: SparkSession, path: str) -> DataFrame:
    """A taxonomy config document -> one row with typed maps (no schema inference of
    map keys as struct fields)."""
    schema = ("labels array<string>, label_to_id map<string,int>, "
              "id_to_label map<string,string>, source_to_canonical map<string,string>")
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("c")).select("c.*")


def write_json_config(spark: SparkSession, path: str, config: dict) -> None:
    spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_partitioned(df: DataFrame, path: str, by: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by a column (split, label, source, user key)."""
    df.write.mode(mode).partitionBy(by).parquet(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append-only JSON-lines log."""
    df.write.mode("append").json(path)
