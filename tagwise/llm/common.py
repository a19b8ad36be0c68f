"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwise.session import materialize

#: White space that separates words: space, tab, line feed, vertical tab, form feed,
#: carriage return. ``bytes.split()`` splits on exactly these.
SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts lineage,
    survives lost executors, and is computed once however often it is used."""
    return materialize(df, name)


def slices(batch, rows: int = 500):
    """The batch in slices of so many rows: only one slice at a time is copied to Python."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def by_bytes(batch, column: int, limit: int):
    """The batch in slices whose texts or binaries in ``column`` have up to ``limit`` bytes, or one
    row if that has more."""
    import numpy as np
    import pyarrow.compute as pc
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, limit + (int(ends[at - 1]) if at else 0), "right")))
        yield batch.slice(at, stop - at)
        at = stop


def id_residue(col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % modulus


def in_residue(col: str, modulus: int, value: int) -> Column:
    """True for the rows whose id falls in residue ``value``; a null id does not."""
    return F.coalesce(id_residue(col, modulus) == value, F.lit(False))


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-space characters (see :data:`SPACE`); 0 for null."""
    trimmed = F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")
    return F.when(text.isNull() | (trimmed == ""), F.lit(0)) \
        .otherwise(F.size(F.split(trimmed, f"[{SPACE}]+"))).cast("long")


class Remembered:
    """Values of frequent keys, up to an estimated number of bytes. When it is full, keys that
    were not asked for again since it last was are dropped (all, if that drops too few); whether
    they were is noted in every fourth request."""

    def __init__(self, limit: int):
        self.limit, self.size, self.requests = limit, 0, 0
        self.known: dict = {}
        self.again: set = set()

    def look_up(self, keys) -> tuple[dict, list]:
        """The distinct keys with their values, None where unknown, and the unknown ones."""
        if self.size > self.limit:
            kept = {k: v for k, v in self.known.items() if k in self.again}
            if 2 * len(kept) > len(self.known):
                kept = {}
            self.size = self.size * len(kept) // len(self.known)
            self.known, self.again = kept, set()
        found = dict.fromkeys(keys)
        get, new = self.known.get, []
        for k in found:
            value = get(k)
            if value is None:
                new.append(k)
            else:
                found[k] = value
        self.requests += 1
        if self.requests % 4 == 0:
            self.again.update(found.keys() - new)
        return found, new

    def put(self, key, value, cost: int) -> None:
        self.known[key] = value
        self.size += cost
