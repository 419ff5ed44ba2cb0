"""Chunking: sentences, length packing, merging by similarity, break-seeking windows, and the checks of chunk tables.

Each document is cut by itself, in Arrow batches; a document is never spread over tasks, and no two meet.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.operators.rowwise import by_row

# Marks that end a sentence, pairs inside which they don't, and quotes that open and close in turn.
ENDS = "。！？"
PAIRS = {"“": "”", "‘": "’", "（": "）", "【": "】", "《": "》", "(": ")", "[": "]", "{": "}"}
STRAIGHT = "\"'"
#: For texts in Latin script, where a straight quote may be an apostrophe (`straight=False`).
LATIN_ENDS = ENDS + "!?.\n"


def split_sentences(text: str, ends: str = ENDS, straight: bool = True) -> list[str]:
    """Cut after end marks that stand outside all pairs; closing marks that follow stay with the sentence."""
    closing, turning = "".join(PAIRS.values()), STRAIGHT if straight else ""
    cuts, waited, turned = [0], [], set()
    for m in re.finditer("[" + re.escape(ends + "".join(PAIRS) + closing + turning) + "]", text):
        c = m[0]
        if m.start() < cuts[-1]:
            continue
        if c in PAIRS or c in turning and c not in turned:
            turned.add(c)
            waited.append(PAIRS.get(c, c))
        elif c in closing or c in turning:
            turned.discard(c)
            if waited and waited[-1] == c:
                waited.pop()
        elif not waited:
            end = m.end()
            while end < len(text) and text[end] in closing:
                end += 1
            cuts.append(end)
    pieces = [text[a:z].strip() for a, z in zip(cuts, [*cuts[1:], len(text)], strict=True)]
    return [p for p in pieces if p]


def cut_long(text: str, most: int) -> list[str]:
    """Pieces of `most` characters or less: cut after the last end mark (else a semicolon or line end) beyond 60 %."""
    out = []
    while len(text) > most:
        low, cut = int(most * 0.6), -1
        for mark in ("。", ".", "！", "!", "？", "?", "；", ";", "\n"):
            cut = text.rfind(mark, low, most)
            if cut >= 0:
                break
        cut = cut + 1 if cut >= 0 else most
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text] if text else out


def pack(units: list[str], most: int, least: int, joiner: str = " ") -> list[str]:
    """Units in order, as many to a chunk as fit; a last chunk below `least` joins the one before."""
    out: list[str] = []
    for u in (p for x in units for p in cut_long(x, most)):
        if out and len(out[-1]) + len(joiner) + len(u) <= most:
            out[-1] += joiner + u
        else:
            out.append(u)
    if len(out) > 1 and len(out[-1]) < least:
        tail = out.pop()
        out[-1] += joiner + tail
    return out


class _Slots(dict):
    """Where a pair of characters is counted: its place for minus, or `size` beyond that for plus."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, pair: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        h = zlib.crc32(pair.lower().encode())
        self[pair] = at = h % self.size + (self.size if h >> 16 & 1 else 0)
        return at


_SLOTS: dict[int, _Slots] = {}


def hashed_embedding(text: str, size: int = 64) -> np.ndarray:
    """A stand-in for an embedding model: signed counts of hashed character pairs, of unit length."""
    slots = _SLOTS.setdefault(size, _Slots(size))
    count = np.bincount(np.fromiter(map(slots.__getitem__, map(str.__add__, text, text[1:])), np.int64, max(len(text) - 1, 0)), minlength=2 * size)
    v = (count[size:] - count[:size]).astype(float)
    n = math.sqrt(v @ v)
    return v / n if n else v


def merge_similar(units: list[str], threshold: float, most: int, least: int, embed: Callable[[str], np.ndarray] = hashed_embedding, joiner: str = "\n") -> list[str]:
    """Each unit joins the open chunk while it fits and its vector is near the chunk's mean vector (or the chunk is short)."""
    out: list[str] = []
    total, n, size = np.zeros(0), 0, 0
    parts: list[str] = []
    for u in units:
        v = embed(u)
        if parts:
            if size + len(joiner) + len(u) <= most and (size < least or _near(total / n, v) >= threshold):
                parts.append(u)
                total, n, size = total + v, n + 1, size + len(joiner) + len(u)
                continue
            out.append(joiner.join(parts))
        parts, total, n, size = [u], v, 1, len(u)
    return [*out, joiner.join(parts)] if parts else out


def _near(x: np.ndarray, y: np.ndarray) -> float:
    size = math.sqrt(x @ x) * math.sqrt(y @ y)
    return float(x @ y / size) if size else 0.0


def window(text: str, size: int = 500, search: int = 100, least: int = 60) -> list[str]:
    """Windows of about `size` characters that end at the nearest best break within `search`: a sentence end, then a comma,
    then anywhere; a last one below `least` joins the one before."""
    out, at = [], 0
    while len(text) - at > size + search:
        low, high, cut = at + size - search, at + size + search, -1
        for marks in ("。！？.!?\n", "；，;,"):
            found = [m.end() for m in re.finditer(f"[{re.escape(marks)}]", text[low:high])]
            if found:
                cut = low + min(found, key=lambda e: (abs(e - search), e))
                break
        cut = cut if cut > at else at + size
        out.append(text[at:cut])
        at = cut
    if text[at:]:
        out.append(text[at:])
    if len(out) > 1 and len(out[-1]) < least:
        tail = out.pop()
        out[-1] += tail
    return out


def chunk(docs: DataFrame, cut: Callable[[str], list[str]], genre: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, seq, chunk_id, content, chars) by any cutter."""

    def run(i, text: str | None):
        return ((i, s, f"primary_{genre}_{i}_{s:05d}", c, len(c)) for s, c in enumerate(cut(text or "")))

    columns = {"doc_id": "bigint", "seq": "int", "chunk_id": "string", "content": "string", "chars": "int"}
    return by_row(docs.select(F.col(id_col).cast("bigint"), text_col), run, columns)


def violations(chunks: DataFrame) -> DataFrame:
    """(chunk_id, rule) for each broken rule of a chunk table."""
    rules = {
        "empty content": F.coalesce(F.trim("content"), F.lit("")) == "",
        "bad id": ~F.coalesce(F.col("chunk_id").rlike(r"^(primary|research)_[a-z_]+_[^_]+_\d{5}$"), F.lit(False)),
        "length differs": F.length("content") != F.col("chars"),
        "negative position": F.col("seq") < 0,
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    each = chunks.select("chunk_id", F.explode(broken).alias("rule"))
    twice = chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("chunk_id", F.lit("repeated id").alias("rule"))
    return each.unionByName(twice)


# What every chunk's metadata must say, what strategies ask for beyond that, and which strategies number sentences.
REQUIRED = ["chunk_id", "chapter_number", "chapter_title", "dynasty", "genre", "source_type", "strategy", "paragraph_index", "paragraph_range", "sentence_range", "char_start", "char_end", "structural_unit", "source_file"]
BY_STRATEGY = {"structural_act": ["qupai_name", "act_index", "context_prefix_length"], "structural_scene": ["scene_index", "context_prefix_length"], "tanci_scene_window": ["context_prefix_length"]}
SENTENCE_LEVEL = ["sentence_semantic_merge", "structural_chapter_merge", "structural_act", "structural_scene", "tanci_scene_window"]


def metadata_errors(chunks: DataFrame, files: Mapping[str, str], col: str = "meta") -> DataFrame:
    """(chunk_id, rule) for each rule that a chunk's metadata, a JSON object, breaks: fields missing, ids repeated or malformed, chapters
    that are no text, files of another source type (`files`: type to file), ends before starts, prefixes of another length, negative
    paragraphs where paragraphs count, and fields that a strategy asks for. Text that is no JSON misses every field."""
    rows = chunks.select(F.try_parse_json(col).alias("v"))
    of = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    has = lambda name: of(name, "variant").isNotNull()
    expected = F.create_map(*[F.lit(x) for kv in files.items() for x in kv])[of("source_type", "string")] if files else F.lit(None).cast("string")
    start, end = of("char_start", "bigint"), of("char_end", "bigint")
    prefix, size = F.coalesce(of("context_prefix", "string"), F.lit("")), F.coalesce(of("context_prefix_length", "bigint"), F.lit(-1))
    strategy = F.coalesce(of("strategy", "string"), F.lit(""))
    rules = {f"missing field {f}": ~has(f) for f in REQUIRED}
    rules |= {
        "bad id": (of("chunk_id", "string") != "") & ~of("chunk_id", "string").rlike(r"^(primary|research)_[a-z_]+_[^_]+_\d{5}$"),
        "chapter is no text": has("chapter_number") & ~F.schema_of_variant(of("chapter_number", "variant")).isin("STRING", "VOID"),
        "file of another source": (of("source_file", "string") != "") & (of("source_file", "string") != expected),
        "end before start": (start > 0) & (end > 0) & (start >= end),
        "prefix of another length": (size >= 0) & (size != F.length(prefix)),
        "negative paragraph": (F.coalesce(of("paragraph_index", "bigint"), F.lit(-1)) < 0) & ~strategy.isin(*SENTENCE_LEVEL),
    }
    rules |= {f"missing field {f} of {s}": (strategy == s) & ~has(f) for s, fields in BY_STRATEGY.items() for f in fields}
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    own = of("chunk_id", "string").alias("chunk_id")
    each = rows.select(own, F.explode(broken).alias("rule"))
    twice = rows.select(own).where("chunk_id <> ''").groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1")
    return each.unionByName(twice.select("chunk_id", F.lit("repeated id").alias("rule")))


def parse_chunk_id(chunk_id) -> tuple:
    """(source type, genre, chapter, seq) columns; genres may contain underscores."""
    pattern = r"^(primary|research)_(.+)_([^_]+)_(\d{5})$"
    return tuple(F.regexp_extract(chunk_id, pattern, i) for i in range(1, 5))
