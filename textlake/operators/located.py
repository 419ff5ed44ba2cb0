"""Where the pieces of a text stand in it, when their offsets are lost: matching lines, put in order.

A document's lines and paragraphs meet in one row. Lines that are whole paragraphs are found by their text; if these leave a line
without a place, all lines are looked for at every place of the paragraphs by their first characters, and compared in full there. A
line that stands in several places fits several times; the longest chain of lines that rises in both chunks and document decides
between them, and of equally long ones that with the most whole paragraphs.

Defined cases
    null content or paragraph: nothing in it.     lines of fewer than `least` characters (white space aside): not looked for.
    a chunk none of whose lines is in the chain: its first line's first place (`single`), else -1 (`none`).
    repeated chunks or paragraphs of one number: one document's rows must have numbers of their own.   a document: one row of one task.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators.rowwise import by_row


def rising_chain(at: np.ndarray) -> np.ndarray:
    """Rows of a longest strictly rising subsequence of `at`."""
    ends: list[int] = []
    rows: list[int] = []
    back = np.full(len(at), -1)
    for row, x in enumerate(at.tolist()):
        k = bisect_left(ends, x)
        back[row] = rows[k - 1] if k else -1
        if k == len(ends):
            ends.append(x)
            rows.append(row)
        else:
            ends[k], rows[k] = x, row
    chain, row = [], rows[-1] if rows else -1
    while row >= 0:
        chain.append(row)
        row = int(back[row])
    return np.array(chain[::-1], np.int64)


def surest_chain(at: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Rows of a longest strictly rising subsequence of `at`; of several, one with the most rows that are `whole`."""
    values = np.unique(at)
    place = np.searchsorted(values, at) + 1
    best = [(0, 0, -1)] * (len(values) + 1)  # a Fenwick tree of (length, whole rows, row) by value
    back = np.full(len(at), -1)
    last = (0, 0, -1)
    for row, (k, sure) in enumerate(zip(place.tolist(), whole.tolist(), strict=True)):
        i, found = k - 1, (0, 0, -1)
        while i:
            found = max(found, best[i])
            i -= i & -i
        back[row] = found[2]
        own = (found[0] + 1, found[1] + int(sure), row)
        last = max(last, own)
        while k <= len(values):
            best[k] = max(best[k], own)
            k += k & -k
    chain, row = [], last[2]
    while row >= 0:
        chain.append(row)
        row = int(back[row])
    return np.array(chain[::-1], np.int64)


def _chained(met: list[tuple[int, int, int, int, bool]]) -> list[tuple[int, int, int, int, bool]]:
    """Of meetings (seq, line, para, at, whole) those in the chain."""
    met = sorted(met, key=lambda m: (m[0], m[1], -m[2], -m[3]))  # a line is used once at most
    spot = np.array([m[2] << 32 | m[3] for m in met], np.int64)
    sure = np.array([m[4] for m in met], bool)
    chain = rising_chain(spot) if sure.all() else surest_chain(spot, sure)
    return [met[i] for i in chain.tolist()]


def places(lines: list[tuple[int, int, str]], paras: list[tuple[int, str]], least: int) -> tuple[dict[int, int], dict[int, int]]:
    """({seq: para} by the chain, {seq: para} of first places) for a document's lines (seq, line, text) and paragraphs (para, text)."""
    lines = [x for x in lines if len(x[2]) >= least]
    if not lines:
        return {}, {}
    equal: dict[str, list[int]] = {}
    for para, text in paras:
        equal.setdefault(text, []).append(para)
    met = [(seq, line, para, 0, True) for seq, line, own in lines for para in equal.get(own, [])]
    chain = _chained(met) if met else []
    if len(chain) < len(lines):  # no chain is longer or surer than one in which every line is a whole paragraph
        begins: dict[str, list[tuple[int, int, str]]] = {}
        for x in lines:
            begins.setdefault(x[2][:least], []).append(x)
        for para, text in paras:
            for at in range(len(text) - least + 1):
                for seq, line, own in begins.get(text[at : at + least], ()):
                    if text.startswith(own, at) and (at or len(own) < len(text)):
                        met.append((seq, line, para, at, False))
        chain = _chained(met) if met else []
    first = lambda rows: {m[0]: m[2] for m in sorted(rows, key=lambda m: (m[1], m[2]), reverse=True)}
    return first(chain), first(met)


def in_order(chunks: DataFrame, paras: DataFrame, least: int = 6, heading: str | None = None) -> DataFrame:
    """(doc_id, seq, para, method) for chunks (doc_id, seq, content) and paragraphs (doc_id, para, paragraph). Lines that `heading` fits
    are left out."""
    kind = dict(chunks.dtypes)
    lines = chunks.select("doc_id", "seq", F.posexplode_outer(F.split("content", "\n")).alias("line", "text"))
    own = T.without_space(F.col("text")) if heading is None else F.when(~F.col("text").rlike(heading), T.without_space(F.col("text")))
    lines = lines.groupBy("doc_id").agg(F.collect_list(F.struct("seq", F.coalesce("line", F.lit(0)).alias("line"), F.coalesce(own, F.lit("")).alias("own"))).alias("lines"))
    whole = paras.select("doc_id", F.col("para").cast("int").alias("para"), T.without_space(F.col("paragraph")).alias("whole")).where(F.length("whole") >= least)
    whole = whole.groupBy("doc_id").agg(F.collect_list(F.struct("para", "whole")).alias("paras"))

    def found(doc_id, own: list[dict], paragraphs: list[dict] | None):
        chain, first = places([(x["seq"], x["line"], x["own"]) for x in own], [(x["para"], x["whole"]) for x in paragraphs or []], least)
        for seq in dict.fromkeys(x["seq"] for x in own):
            yield doc_id, seq, chain.get(seq, first.get(seq, -1)), "chain" if seq in chain else "single" if seq in first else "none"

    return by_row(lines.join(whole, "doc_id", "left"), found, {"doc_id": kind["doc_id"], "seq": kind["seq"], "para": "int", "method": "string"})
