"""Workbooks and word-processor documents as tables. Files come through Spark's own binary source, one row a file, from wherever
Spark can read; each is parsed in the task that has it. A file that can't be parsed is a row with its error, never a failed job.

Two layouts of workbooks are known by their first row: places (columns 地点名 and 序号; the text in a column named 文本内容) and tokens
(counts of tokens, matches and words, and the text, by name or by the letters A to D).

Defined cases
    a damaged file, or one without a known layout: one row with `error` and nothing else.    a file of no bytes: no row, as Spark's
    source leaves it out.      numbers that can't be read: 0.
    rows without text (places), or without text and counts (tokens): left out.    texts: trimmed, `summary` their first 300 characters.
    a workbook: its first sheet.      no files: an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree
from zipfile import ZipFile

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names in the Office Open XML formats.
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# The headings of the two layouts.
PLACE, NUMBER, TEXT, TOKENS, MATCHES, WORDS = "地点名", "序号", "文本内容", "切词", "匹配词", "字数"

_SHEET_ROWS = "path string, row int, tokens bigint, matches bigint, words bigint, text string, error string"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def workbook_rows(data: bytes) -> list[list[str]]:
    """The cells of the first sheet as strings; cells that are missing are empty."""
    book = ZipFile(BytesIO(data))
    names = set(book.namelist())
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
    first = next(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"))
    target = next(r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")) if r.get("Id") == first.get(_REL))
    path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    rows = []
    for row in ElementTree.fromstring(book.read(path)).iter(f"{_SHEET}row"):
        cells: list[str] = []
        for cell in row.iter(f"{_SHEET}c"):
            at = _column(cell.get("r", "")) if cell.get("r") else len(cells)
            cells += [""] * (at + 1 - len(cells))
            value = cell.find(f"{_SHEET}v")
            if cell.get("t") == "s" and value is not None:
                cells[at] = shared[int(value.text)]
            elif cell.get("t") == "inlineStr":
                cells[at] = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
            else:
                cells[at] = (value.text or "") if value is not None else ""
        rows.append(cells)
    return rows


def _whole(cell: str) -> int:
    """The whole number that a cell begins with; 0 for others."""
    found = re.match(r"\s*([+-]?\d+)", cell)
    return int(found[1]) if found else 0


def layout(header: list[str]) -> dict[str, int] | None:
    """Which column holds what; null for an unknown layout."""
    named = [h.strip() for h in header]
    if PLACE in named and NUMBER in named:
        text = next((i for i, h in enumerate(named) if TEXT in h), None)
        return None if text is None else {"text": text}
    found = {}
    for name, mark, letter in (("tokens", TOKENS, "A"), ("matches", MATCHES, "B"), ("words", WORDS, "C"), ("text", TEXT, "D")):
        at = next((i for i, h in enumerate(named) if (mark in h and not (mark == TOKENS and MATCHES in h)) or h == letter), None)
        if at is not None:
            found[name] = at
    return found if {"tokens", "matches", "text"} <= set(found) else None


def records(rows: list[list[str]]) -> list[tuple[int, int, int, int, str]]:
    """(row, tokens, matches, words, text) of a sheet in one of the layouts."""
    at = layout(rows[0]) if rows else None
    if at is None:
        raise ValueError("no known layout")
    out = []
    cell = lambda row, name: row[at[name]] if name in at and at[name] < len(row) else ""
    for n, row in enumerate(rows[1:], 1):
        text = cell(row, "text").strip()
        if "tokens" not in at:
            if text:
                out.append((n, 0, 1, len(text), text))
            continue
        counts = [_whole(cell(row, k)) for k in ("tokens", "matches", "words")]
        if text or counts[0] or counts[1]:
            out.append((n, *counts, text))
    return out


def document_text(data: bytes) -> str:
    """The paragraphs of a document, parted by empty lines."""
    body = ElementTree.fromstring(ZipFile(BytesIO(data)).read("word/document.xml"))
    marks = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}
    return "\n\n".join("".join(e.text or "" if e.tag == f"{_WORD}t" else marks.get(e.tag, "") for e in p.iter()) for p in body.iter(f"{_WORD}p"))


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "content")


def read_workbooks(spark: SparkSession, folder: str, cut: int = 300) -> DataFrame:
    """(path, row, tokens, matches, words, text, summary, error) of all workbooks below a folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _SHEET_ROWS.split(", ")]
        for b in batches:
            for path, data in zip(b["path"], b["content"], strict=True):
                try:
                    rows = [(path, *r, None) for r in records(workbook_rows(data))]
                except Exception as e:  # whatever is wrong with a file is its row's error
                    rows = [(path, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200])]
                yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in names[1:5]})

    return _files(spark, folder, "*.xlsx").mapInPandas(run, _SHEET_ROWS).withColumn("summary", F.substring("text", 1, cut))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text, error) of plain texts and documents below a folder; of files of one name the plain text is taken."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, data in zip(b["path"], b["content"], strict=True):
                try:
                    out.append((path, data.decode("utf-8-sig") if path.endswith(".txt") else document_text(data), None))
                except Exception as e:  # whatever is wrong with a file is its row's error
                    out.append((path, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    files = _files(spark, folder, "*.{txt,docx}").withColumn("stem", F.regexp_replace("path", r"\.(txt|docx)$", ""))
    plain = files.where(F.col("path").endswith(".txt")).select(F.col("stem").alias("other"))
    files = files.join(plain, (F.col("stem") == F.col("other")) & F.col("path").endswith(".docx"), "left_anti")
    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def load_text(spark: SparkSession, stem: str) -> DataFrame:
    """(path, text, error) of one source by its path without ending: `.txt` before `.docx`; an error if neither is there."""
    folder, name = stem.rsplit("/", 1)
    try:
        found = read_documents(spark, folder).where(F.regexp_replace("path", r"\.(txt|docx)$", "").endswith(f"/{name}"))
    except AnalysisException as e:
        raise FileNotFoundError(stem) from e
    if found.isEmpty():
        raise FileNotFoundError(stem)
    return found


def places(rows: DataFrame, names: DataFrame, other: str = "") -> DataFrame:
    """`rows` with `place`: the first (by `rank`) of the names (table: part, place, rank) whose part is in the file's name."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    files = rows.select("path").distinct().select("path", stem.alias("stem"))
    best = files.join(names, F.col("stem").contains(F.col("part"))).groupBy("path").agg(F.min(F.struct("rank", "place")).alias("b"))
    return rows.join(best, "path", "left").withColumn("place", F.coalesce("b.place", F.lit(other))).drop("b")
