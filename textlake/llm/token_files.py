"""Token files: texts are encoded, ordered by doc_id and stored as one wavelet matrix per shard.

`write` ranges the texts over partitions by doc_id; each partition emits shards of about SHARD_TOKENS ids, so a task
holds one shard at a time. A shard is a row of a zstd-compressed Parquet folder, written by Spark wherever the folder
is: part and seq (shards in this order are in doc_id order), n_docs, n_tokens, payload (documents' ids and lengths,
then the matrix of wavelet.py, which can be queried without decoding). `read_documents` reads the shards back.

Defined cases
    null or empty text: only the end id.       null doc_id: before all others.      repeated rows: each is stored,
    equal doc_ids in order of a hash of the text.      empty table: no shards, no rows.       extra columns: ignored.
    a text longer than a shard: one larger shard.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlake.llm.bpe import byte_symbols
from textlake.llm.characters import unsettled
from textlake.llm.common import releasing
from textlake.llm.wavelet import WaveletMatrix, build

SHARD_TOKENS, LONG = 1 << 19, 10_000
SHARDS = "part int, seq int, n_docs bigint, n_tokens bigint, payload binary"
#: Fixed value: how byte-level files cut a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """The ids that the tokenizers library gives for one byte-level file; with `special` false, special tokens' strings are
    plain text.

    The library takes about 1,000 CPU seconds for 1 GB. Where the file's ids are the ranks of its merges, texts of settled
    characters are merged by tiktoken over the file's own vocabulary, a quarter of the time for the same ids; all other texts
    and files go to the library itself, and so do texts with LONG white-space characters in a row, for which tiktoken's cutter
    tracks back until its stack is full.
    """

    def __init__(self, path: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        self.width = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length(), *[i.bit_length() for i in added])
        self.kind = np.dtype("<u2" if self.width <= 16 else "<u4")
        self.code = "H" if self.width <= 16 else "I"
        self.tokenizer.encode_special_tokens = not special
        self.special = [t.content for t in added.values()] if special else []
        self.long = re.compile(rf"\s{{{LONG}}}").search
        self.merged, self.unsettled = _merger(path), unsettled(False)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian integers of `kind`."""
        plain = self.merged and (text.isascii() or not self.unsettled(text)) and not any(s in text for s in self.special)
        plain = plain and not (len(text) >= LONG and self.long(text))
        ids = self.merged(text) if plain else self.tokenizer.encode(text, add_special_tokens=False).ids
        return array(self.code, ids).tobytes()


def _merger(path: str) -> Callable[[str], list[int]] | None:
    """tiktoken's encoder over a file's vocabulary; None if the file is of another kind."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    cut = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    vocab = model["vocab"]
    pairs = [p if isinstance(p, (list, tuple)) else p.split(" ") for p in model.get("merges", [])]
    ranked = model.get("type") == "BPE" and not model.get("ignore_merges") and all(vocab["".join(p)] == 256 + i for i, p in enumerate(pairs))
    if spec.get("normalizer") is not None or not cut or not ranked or len(vocab) != 256 + len(pairs):
        return None
    import tiktoken

    value = {s: b for b, s in enumerate(byte_symbols())}
    ranks = {bytes(value[c] for c in s): i for s, i in vocab.items()}
    return tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, width: int) -> bytes:
    null = np.array([d is None for d in doc_ids], np.uint8)
    own = np.array([d or 0 for d in doc_ids], "<i8")
    return struct.pack("<Q", len(own)) + own.tobytes() + np.array(lengths, "<i8").tobytes() + null.tobytes() + build(ids, width)


class Shard:
    """A payload: documents' ids and lengths, and the wavelet matrix of their token ids."""

    def __init__(self, payload: bytes):
        (n,) = struct.unpack_from("<Q", payload, 0)
        null = np.frombuffer(payload, np.uint8, n, 8 + 16 * n)
        self.doc_ids = [None if z else int(d) for d, z in zip(np.frombuffer(payload, "<i8", n, 8), null, strict=True)]
        self.lengths = np.frombuffer(payload, "<i8", n, 8 + 8 * n)
        self.tokens = WaveletMatrix(payload[8 + 17 * n :])


def write(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Encode all texts, append `end_id` to each, and write the shards below `path`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        if end_id.bit_length() > coder.width:
            raise ValueError("the end id is larger than any id of the file")
        end, size = np.array([end_id], coder.kind).tobytes(), coder.kind.itemsize
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held: list[bytes] = []

        def shard() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), coder.kind)
            row = [[part], [seq], [len(doc_ids)], [len(ids)], [_pack(doc_ids, lengths, ids, coder.width)]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], [c.split()[0] for c in SHARDS.split(", ")])

        total = 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held += [x := coder.encode(t.as_py() or ""), end]
                doc_ids.append(d)
                lengths.append(len(x) // size + 1)
                total += lengths[-1]
                if total >= shard_tokens:
                    yield shard()
                    seq, total = seq + 1, 0
                    doc_ids.clear(), lengths.clear(), held.clear()
        if doc_ids:
            yield shard()
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("spread", F.xxhash64("text"))  # null or equal ids are not one task's
    rows = rows.repartitionByRange("doc_id", "spread").sortWithinPartitions("doc_id", "spread").select("doc_id", "text")
    rows.mapInArrow(releasing(run), SHARDS).write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                shard = Shard(payload.as_py())
                ids = shard.tokens.decode().astype("<u4")
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(shard.doc_ids, pa.int64()),
                     pa.array(starts), pa.array(shard.lengths), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    shards = read_shards(spark, path)
    schema = "part int, seq int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"
    found = shards.select("part", "seq", "payload").mapInArrow(run, schema)
    # Offsets: within parts, then over parts; parts are as many as the writer's partitions.
    sizes = shards.select("part", "seq", "n_tokens")
    within = sizes.select(
        "part", "seq", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("inner")
    )
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("outer"))
    offsets = within.join(parts, "part").select("part", "seq", (F.col("inner") + F.col("outer")).alias("offset"))
    return found.join(offsets, ["part", "seq"]).select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def occurrences(spark: SparkSession, path: str, token: int, limit_per_shard: int | None = None) -> DataFrame:
    """Where a token occurs, from the matrices alone: part, seq, count, positions array<bigint> within the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                m = Shard(payload.as_py()).tokens
                n = m.count(token)
                at = [m.select(token, k) for k in range(n if limit_per_shard is None else min(n, limit_per_shard))]
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, seq, n, at), kinds, strict=True)], ["part", "seq", "n", "positions"])

    return read_shards(spark, path).select("part", "seq", "payload").mapInArrow(run, "part int, seq int, n bigint, positions array<bigint>")
