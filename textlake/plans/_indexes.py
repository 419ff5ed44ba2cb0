"""Stored indexes of the test tables: built once for a table's files, then read by every query of the session."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from textlake.operators.postings import Index
from textlake.sources.files import shared_folder

_BUILT: dict[tuple[str, str], Index] = {}


def _files(rows: DataFrame) -> str:
    """A digest of a table's files: paths, sizes, times of change."""
    found = rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()
    return hashlib.sha256(repr(sorted(map(tuple, found))).encode()).hexdigest()


def index_of(spark: SparkSession, source: DataFrame, name: str, tokens: Column, ids: Sequence[str], keep: Sequence[str] = (), rows: DataFrame | None = None) -> Index:
    """The index `name` of a table as its files are now, or of `rows` that are made from it; `tokens` are an expression over the
    columns, `keep` some of them."""
    at = spark.sparkContext.applicationId, f"{name} {_files(source)}"
    if at not in _BUILT:
        index = Index(spark, shared_folder(spark), ids)
        index.append(source if rows is None else rows, tokens, keep)
        _BUILT[at] = index
    return _BUILT[at]
