"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is the ``PROFILE`` most frequent n-grams (1 to 3 letters, a word's edges
marked) in rank order. A document's own profile is compared with each language's by the
out-of-place distance: the sum over the document's n-grams of the difference in rank, or
``PROFILE`` for one the language's profile lacks. The nearest language wins, ties going to
the smaller name in code point order.

N-grams are exact integers (18 bits a letter plus the length), counted with numpy. A
letter is a character of Unicode category L, lower-cased where that is one character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagwise.llm.common import slices

PROFILE = 400
UNKNOWN = "und"
STRETCH = 1 << 20                  # characters, and n-grams, counted at once
FLUSH = 1 << 20                    # n-grams of a language held by a task before it sends them on
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> dense number of its lower-cased letter, 0 for all that is no letter."""
    if not _LETTERS:
        points = [i for i in range(0x110000) if chr(i).isalpha()]
        lower = [ord(c) if len(c := chr(i).lower()) == 1 else i for i in points]
        names, dense = np.unique(lower, return_inverse=True)
        table = np.zeros(0x110000, np.int64)
        table[points] = dense + 1
        _LETTERS.append(table)
    return _LETTERS[0]


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Every n-gram of the text's words, n from 1 to 3, as integers, in stretches of about
    :data:`STRETCH` characters cut between words (a longer word is cut, too); none without
    letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = 0
    while at < len(points):
        letters = _letters()[points[at:at + STRETCH]]
        if at + STRETCH < len(points) and not letters.all():
            letters = letters[:len(letters) - int(np.argmin(letters[::-1] != 0))]
        at += len(letters)
        found = _ngrams(letters)
        if len(found):
            yield found


def _ngrams(letters: np.ndarray) -> np.ndarray:
    a = np.zeros(len(letters) + 2, np.int64)
    a[1:-1] = letters
    a = a[np.concatenate([[True], (a[1:] != 0) | (a[:-1] != 0)])]       # one mark between words
    if len(a) < 3:
        return np.empty(0, np.int64)
    one = a[a != 0]
    two = (1 << 60) | (a[:-1] << 18) | a[1:]
    three = ((2 << 60) | (a[:-2] << 36) | (a[1:-1] << 18) | a[2:])[a[1:-1] != 0]
    return np.concatenate([one, two, three])


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes)))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of several counts."""
    if len(parts) == 1:
        return parts[0]
    codes, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.add.reduceat(n, first) if len(first) else n


def top(codes: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in rank order, ties by code."""
    return codes[np.argsort(-n, kind="stable")[:size]]


@dataclass
class Profiles:
    """Ranks of every profile's n-grams: ``ranks[i, j]`` of gram ``grams[i]`` in language
    ``names[j]``, ``size`` where it has none."""
    names: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int

    @staticmethod
    def of(ranked: dict[str, list[int]], size: int) -> Profiles:
        names = sorted(ranked)
        grams = np.unique(np.concatenate([np.empty(0, np.int64), *[np.array(ranked[x], np.int64) for x in names]]))
        ranks = np.full((len(grams), len(names)), size, np.int32)
        for j, x in enumerate(names):
            ranks[np.searchsorted(grams, ranked[x]), j] = np.arange(len(ranked[x]))
        return Profiles(names, grams, ranks, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, 1 - its distance as a share of the largest possible)."""
        if not text or not self.names:
            return UNKNOWN, 0.0
        parts = [counted(codes) for codes in ngrams(text)]
        if not parts:
            return UNKNOWN, 0.0
        mine = top(*merged(parts), self.size)
        at = np.minimum(np.searchsorted(self.grams, mine), len(self.grams) - 1)
        theirs = np.where((self.grams[at] == mine)[:, None], self.ranks[at], self.size)
        away = np.where(theirs == self.size, self.size, np.abs(theirs - np.arange(len(mine))[:, None])).sum(0)
        best = int(np.argmin(away))
        return self.names[best], 1.0 - float(away[best]) / (self.size * len(mine))


def train(docs: DataFrame, text: str = "text", label: str = "lang", size: int = PROFILE) -> Profiles:
    """Profiles of every label over the whole texts of all rows (rows with a null text or
    label have no part). Counts are merged within tasks and by a shuffle on (label, n-gram);
    what reaches the driver is ``size`` n-grams a label."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        fresh: dict[str, list[np.ndarray]] = {}
        size = 0

        def settle() -> Iterator[pa.RecordBatch]:
            for name, found in fresh.items():
                held[name] = merged([counted(np.concatenate(found)), *([held[name]] if name in held else [])])
                if len(held[name][0]) > FLUSH:
                    yield rows(name)
            fresh.clear()

        def rows(name: str) -> pa.RecordBatch:
            codes, n = held.pop(name)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())],
                                              names=["label", "gram", "n"])

        for batch in (part for whole in batches for part in slices(whole)):
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for found in ngrams(t):
                    fresh.setdefault(name, []).append(found)
                    size += len(found)
                    if size > STRETCH:
                        yield from settle()
                        size = 0
        yield from settle()
        for name in list(held):
            yield rows(name)

    grams = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(label, text) \
        .mapInArrow(count, "label string, gram long, n long")
    counts = grams.groupBy("label", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "gram"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= size).collect()
    ranked: dict[str, list[int]] = {}
    for r in sorted(best, key=lambda r: (r.label, r.rank)):
        ranked.setdefault(r.label, []).append(r.gram)
    return Profiles.of(ranked, size)


def predicted(profiles: Profiles, text: Column) -> Column:
    """``struct<lang, score>`` of each whole text. Null or letterless text is
    :data:`UNKNOWN` with score 0, as is every text if nothing was learned."""
    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang", "score"])
    return predict(text)
