"""Text comparison: candidate pairs, span repair, citation repair. Shared strings and differences are in `alignments`, dictionary
scans in `patterns`.

Pairs and candidates are found by joins; the sequential part of each pair or document is a small function in Arrow
batches.
"""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.operators.corpus import shared_ngrams
from textlake.operators.patterns import occurrences
from textlake.operators.rowwise import by_row


def candidate_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, n: int = 8) -> DataFrame:
    """(left_id, right_id) of texts that share a string of n words."""
    return shared_ngrams(left, right, n, left_id, right_id).select(left_id, right_id)


# --- spans ---------------------------------------------------------------------------------------------------------


def _compact(text: str) -> tuple[str, list[int]]:
    """Text without white space, and where each of its characters stood."""
    at = [i for i, c in enumerate(text) if not c.isspace()]
    return "".join(text[i] for i in at), at


def locate_span(text: str, entity: str, start: int, end: int, around: int = 50) -> tuple[int, int, str, str]:
    """(start, end, level, confidence) of an entity whose claimed place may be off: there, near, anywhere, without white
    space, alike; else (-1, -1, not_found, none)."""
    if not text or not entity:
        return -1, -1, "not_found", "none"
    if 0 <= start < end <= len(text) and text[start:end] == entity:
        return start, end, "exact", "high"
    low = max(0, start - around)
    near = text.find(entity, low, max(low, start) + around + len(entity))
    if start >= 0 and near >= 0:
        return near, near + len(entity), "window", "medium"
    anywhere = text.find(entity)
    if anywhere >= 0:
        return anywhere, anywhere + len(entity), "global", "low"
    solid, places = _compact(text)
    wanted = _compact(entity)[0]
    hit = solid.find(wanted) if wanted else -1
    if hit >= 0:
        return places[hit], places[hit + len(wanted) - 1] + 1, "compact", "low"
    if len(entity) >= 3:
        best, at = 0.0, -1
        for i in range(len(text) - len(entity) + 1):
            ratio = difflib.SequenceMatcher(None, text[i : i + len(entity)], entity, autojunk=False).ratio()
            if ratio > best:
                best, at = ratio, i
        if best >= 0.7:
            return at, at + len(entity), "fuzzy", "low"
    return -1, -1, "not_found", "none"


def repair_spans(spans: DataFrame) -> DataFrame:
    """Rows (id, text, entity, start, end) to (id, entity, start, end, level, confidence)."""

    def run(i, text, entity, start, end):
        yield (i, entity, *locate_span(text or "", entity or "", start, end))

    rows = spans.select(F.col("id").cast("bigint"), "text", "entity", F.col("start").cast("int"), F.col("end").cast("int"))
    return by_row(rows, run, {"id": "bigint", "entity": "string", "start": "int", "end": "int", "level": "string", "confidence": "string"})


#: A quote of 4 to 300 characters and the label that follows it.
CITATION = r"“([^“”]{4,300})”\s*\[([^\]]+)\]"


def repair_citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, quote, label, action, new_label) for each quoted citation of answers (id, text): keep if the label's text in `evidence` (label,
    text) holds the quote, letters and digits alone; relabel to the first label whose text does; else mark, or strip an unknown
    label. All quotes are sought in all texts in one pass."""
    solid = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(CITATION), 1).alias("quote"), F.regexp_extract_all("text", F.lit(CITATION), 2).alias("label"))
    quotes = answers.select("id", F.posexplode(found).alias("place", "c")).select("id", "place", "c.quote", "c.label", solid("c.quote").alias("entry"))
    held = occurrences(evidence.select("label", solid("text").alias("text")), quotes, ("label",)).select("entry", "label").distinct()
    best = held.groupBy("entry").agg(F.min("label").alias("best"))
    rows = quotes.join(best, "entry", "left").join(held.withColumn("own", F.lit(True)), ["entry", "label"], "left")
    rows = rows.join(evidence.select("label").distinct().withColumn("known", F.lit(True)), "label", "left")
    action = F.when(F.col("own"), "keep").when(F.col("best").isNotNull(), "relabel").when(F.col("known"), "mark").otherwise("strip")
    new = F.when(F.col("own"), F.col("label")).when(F.col("best").isNotNull(), F.col("best")).when(F.col("known"), F.col("label"))
    return rows.select("id", "quote", "label", action.alias("action"), new.alias("new_label"))
