"""Language identification by rank-order profiles of character n-grams.

A profile is the TOP most frequent n-grams (1 to 3 letters; every run of non-letters is one blank) of a language's
training texts, in order of rank. A text gets its own profile from its whole length; its distance to a language is the
sum over its n-grams of the difference between both ranks, TOP where the language lacks the n-gram (out of place).
The least distance wins; equal distances go to the language that sorts first.

Training takes a bounded sample: at most SAMPLE labelled texts of each language, the first by a hash of their ids.
Profiles are TOP rows a language, and the language names are as many as the labels have: that is what reaches the
workers. Prediction reads every row once and shuffles nothing.

Defined cases
    null text, or one without a letter: `und`, score 0.      null label: not learned from.
    no labelled text at all: every text is `und`.      repeated rows: each is judged (and learned from once for each).
    very long texts: whole, counted in pieces of a fixed size.       empty table: empty result.
    extra columns: ignored by `predict`, kept by `keep_known`.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.common import releasing

#: n-grams of a profile; labelled texts of each language at most; code points counted at once.
TOP, SAMPLE, PIECE = 400, 2_000, 1 << 20
#: More languages than this are refused, as every worker holds all profiles (3 KB each).
LANGUAGES = 10_000
_BITS = 21  # a code point


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else a blank."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    letters = [c for c in range(sys.maxunicode + 1) if chr(c).isalpha()]
    out[letters] = letters
    return out


def _codes(text: str) -> np.ndarray:
    """Letters and single blanks, one at either end; empty if there is no letter."""
    text = text.lower()
    points = _letters()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    blank = points == 32
    keep = ~(blank & np.concatenate([[True], blank[:-1]]))
    points = points[keep]
    if not len(points):
        return points
    end = [] if points[-1] == 32 else [32]
    points = np.concatenate([[32], points, end]).astype(np.int64)
    return points if len(points) > 2 else points[:0]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as integers, ascending, and how often each occurs."""
    points = _codes(text)
    if not len(points):
        return points, points
    kinds, counts = [], []
    for at in range(0, max(1, len(points) - 2), PIECE):
        p = points[at : at + PIECE + 2]  # pieces overlap by two, so each n-gram starts in one of them
        last = at + PIECE + 2 >= len(points)
        one, two, three = p, p[:-1] << _BITS | p[1:], p[:-2] << 2 * _BITS | p[1:-1] << _BITS | p[2:]
        if not last:
            one, two = one[:PIECE], two[:PIECE]
        one = one[one != 32]
        grams = np.sort(np.concatenate([one, two, three]))
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        kinds.append(grams[first])
        counts.append(np.diff(np.append(first, len(grams))))
    if len(kinds) == 1:
        return kinds[0], counts[0]
    grams, back = np.unique(np.concatenate(kinds), return_inverse=True)
    return grams, np.bincount(back, np.concatenate(counts)).astype(np.int64)


def _ranked(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The TOP most frequent n-grams, the most frequent first; ties by the n-gram."""
    if len(grams) > TOP:
        least = np.partition(counts, len(counts) - TOP)[len(counts) - TOP]
        some = counts >= least
        grams, counts = grams[some], counts[some]
    return grams[np.argsort(-counts, kind="stable")][:TOP]


def sample(labelled: DataFrame, id_col: str, lang_col: str, size: int) -> DataFrame:
    """At most `size` rows of each language, those with the least hash of their id."""
    labelled = labelled.where(F.col(lang_col).isNotNull())
    key = F.xxhash64(id_col).alias("__key")
    n = labelled.groupBy(F.col(lang_col).alias("__lang")).agg(F.count("*").alias("__n"))
    # Twice the share that is wanted, so that few rows are ranked; all of a small language.
    names = n.count()
    if names > LANGUAGES:
        raise ValueError(f"{names} languages; {LANGUAGES} at most")
    share = labelled.join(F.broadcast(n), F.col(lang_col) == F.col("__lang"))
    some = share.withColumn("__key", key).where(
        F.pmod("__key", F.lit(1 << 20)) < F.ceil(F.lit(2.0 * size + 100) / F.col("__n") * (1 << 20))
    )
    rank = F.row_number().over(Window.partitionBy("__lang").orderBy("__key", id_col))
    return some.withColumn("__rank", rank).where(F.col("__rank") <= size).drop("__n", "__lang", "__key", "__rank")


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = SAMPLE) -> list[tuple[str, np.ndarray]]:
    """(language, ranked n-grams) of each language, sorted by language."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for lang, text in zip(b["lang"], b["text"], strict=True):
                grams, counts = ngrams(text)
                rows.append(pd.DataFrame({"lang": lang, "gram": grams, "n": counts}))
            if rows:
                yield pd.concat(rows).groupby(["lang", "gram"], as_index=False)["n"].sum()

    rows = sample(labelled.select(id_col, text_col, lang_col), id_col, lang_col, size)
    rows = rows.select(F.col(lang_col).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
    grams = rows.mapInPandas(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = grams.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    found: dict[str, list[int]] = {}
    for r in best.where(F.col("rank") <= TOP).orderBy("lang", "rank").select("lang", "gram").collect():
        found.setdefault(r.lang, []).append(r.gram)
    return [(k, np.array(v, np.int64)) for k, v in sorted(found.items())]


class Profiles:
    def __init__(self, trained: list[tuple[str, np.ndarray]]):
        self.langs = [k for k, _ in trained]
        self.grams = np.unique(np.concatenate([v for _, v in trained])) if trained else np.zeros(0, np.int64)
        # Column i: rank in language i, TOP if missing; the last row stands for n-grams that no language has.
        self.ranks = np.full((len(self.grams) + 1, len(trained)), -1, np.int32)
        for i, (_, v) in enumerate(trained):
            self.ranks[np.searchsorted(self.grams, v), i] = np.arange(len(v))

    def judge(self, text: str | None) -> tuple[str, float]:
        """The nearest language and a score: 1 at distance 0, 0 if all n-grams are out of place."""
        ranked = _ranked(*ngrams(text or ""))
        if not len(ranked) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.grams, ranked)
        at[at == len(self.grams)] = 0
        at[self.grams[at] != ranked] = len(self.grams)
        theirs = self.ranks[at]
        apart = np.where(theirs < 0, TOP, np.abs(theirs - np.arange(len(ranked))[:, None]))
        total = apart.sum(axis=0)
        best = int(total.argmin())
        return self.langs[best], float(1 - total[best] / (TOP * len(ranked)))


def predict(docs: DataFrame, trained: list[tuple[str, np.ndarray]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(trained)
        for b in batches:
            found = [profiles.judge(t.as_py()) for t in b.column(1)]
            cols = [b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score"])

    schema = f"doc_id {dict(docs.dtypes)[id_col]}, lang_pred string, score double"
    return docs.select(id_col, text_col).mapInArrow(releasing(run), schema)


def keep_known(docs: DataFrame, trained: list[tuple[str, np.ndarray]], least_score: float, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose language is known with at least `least_score`."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(trained)
        at = names.index(text_col)
        for b in batches:
            found = [profiles.judge(t.as_py()) for t in b.column(at)]
            yield b.filter(pa.array([x[0] != "und" and x[1] >= least_score for x in found], pa.bool_()))

    return docs.mapInArrow(releasing(run), docs.schema)


def held_out(id_col: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))
