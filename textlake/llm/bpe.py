"""BPE encoding and decoding over a tokenizers-library JSON file.

`Bpe.merge` is the encoder proper: the symbols of a word form a doubly linked list, a heap holds the candidate merges by
(rank, position), and an entry whose symbols have changed since it was pushed is stale and skipped. Decoding
concatenates vocabulary strings. Texts are cut into pieces which never touch, so a piece's ids are remembered in a
cache of fixed size; an unseen piece of any length takes O(n log n).

The vocabulary file is read by each Python worker from `path`, which is a parameter; ids are never sent to the driver.

Defined cases
    null or empty text: no ids, an empty decoded text.        null doc_id: passed through.
    repeated rows: each is encoded.      empty table: empty result.       extra columns: ignored by `encode`.
    very long texts: whole; memory is a few times the text's size.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.characters import unsettled
from textlake.llm.common import release, releasing

#: Remembered pieces of each of a worker's two caches (about 0.25 KB each, 16 MB in all); when the young one is full, it becomes
#: the old. Most other pieces occur once, so larger caches save no time.
CACHE_PIECES = 1 << 15
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level BPE: printable Latin-1 bytes stand for themselves, the others
    are numbered from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Bpe:
    """The model of one file: NFC, white space and lower-case normaliser, regular-expression pieces, byte symbols."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for at, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            self.rank[self.vocab[left], self.vocab[right]] = at
            self.merged.append(self.vocab[left + right])
        # The file's own normaliser and cutter, for texts with characters that Unicode versions treat differently. They need no
        # vocabulary: the library would hold it beside this one.
        bare = {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None, "decoder": None}
        library = Tokenizer.from_str(json.dumps(spec | bare))
        self.normalized, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.unsettled = unsettled(True)
        normalizers = {n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])}
        if normalizers != {"NFC", "Replace", "Lowercase"}:
            raise ValueError("this encoder takes files with an NFC, white-space and lower-case normaliser")
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.blank_free = regex.compile(f"[^{_WHITE}]+").findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.byte = {s: b for b, s in enumerate(byte_symbols())}
        self.inner = [self.vocab[s] for s in byte_symbols()]
        self.final = [self.vocab[s + self.suffix] for s in byte_symbols()]
        self.joiner = " " if spec.get("decoder") is None else ""  # without a decoder, tokens are joined by spaces
        self.by_name = {str(i): s for i, s in self.token.items()}
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def merge(self, data: bytes) -> list[int]:
        """The ids of one piece, given as its bytes."""
        ids = [self.inner[b] for b in data]
        ids[-1] = self.final[data[-1]]
        n = len(ids)
        rank, merged = self.rank.get, self.merged
        bits = n.bit_length()
        heap = []
        for i, pair in enumerate(pairwise(ids)):
            if (r := rank(pair)) is not None:
                heap.append(r << bits | i)
        if not heap:
            return ids
        heapify(heap)
        after, before, low = list(range(1, n + 1)), list(range(-1, n - 1)), (1 << bits) - 1
        while heap:
            r = heappop(heap)
            i = r & low
            r >>= bits
            j = after[i]
            if j >= n or ids[i] < 0 or rank((ids[i], ids[j])) != r:
                continue  # stale: one of its symbols has been merged since
            made = ids[i] = merged[r]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank((made, ids[k]))) is not None:
                    heappush(heap, r << bits | i)
            h = before[i]
            if h >= 0 and (r := rank((ids[h], made))) is not None:
                heappush(heap, r << bits | h)
        return [x for x in ids if x >= 0]

    def normalize(self, text: str) -> str:
        """What the file's normaliser makes of a text of settled characters, but for white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # each character is lower-cased by itself: no final sigma
                text = text.replace("Σ", "σ")
        return text.lower()

    def _chunks(self, text: str) -> list[str]:
        """The pieces' surroundings: a piece never crosses white space."""
        if not text.isascii() and self.unsettled(text):
            return self.normalized(text).split(" ")
        text = self.normalize(text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split takes these for white space, the files don't
            return self.blank_free(text)
        return text.split()

    def _pieces(self, chunk: str) -> list[bytes]:
        if not chunk.isascii() and self.unsettled(chunk):
            return [bytes(map(self.byte.__getitem__, symbols)) for symbols, _ in self.cut(chunk)]
        return [p.encode() for p in self.pieces(chunk)]

    def _learn(self, chunk: str) -> str:
        """The ids of a chunk that the young cache lacks, as decimals joined by spaces."""
        found = self.old.get(chunk)
        if found is None:
            found = " ".join([str(i) for p in self._pieces(chunk) for i in self.merge(p)])
        if len(chunk) <= 64:
            if len(self.young) >= CACHE_PIECES:
                self.old, self.young = self.young, {}
            self.young[chunk] = found
        return found

    def names(self, text: str) -> str:
        """The ids of a text, as decimals joined by spaces."""
        out: list[str] = []
        special = self.split_special(text) if self.split_special and any(s in text for s in self.special) else [text]
        for at, span in enumerate(special):
            if at % 2:
                out.append(str(self.special[span]))
                continue
            for c in self._chunks(span):
                found = self.young.get(c)
                if found is None:
                    found = self._learn(c)
                if found:
                    out.append(found)
        return " ".join(out)

    def forget(self) -> None:
        """Empty the caches, at a task's end."""
        self.young, self.old = {}, {}

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.names(text).split()))

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings, concatenated with the file's joiner; unknown ids are skipped."""
        return self.joiner.join([self.token[i] for i in ids if i in self.token])


@lru_cache(maxsize=2)
def model(path: str) -> Bpe:
    bpe = Bpe(path)
    release()  # of the parsed file
    return bpe


#: Ids in one output batch, about; a longer text is a batch of its own.
BATCH_IDS = 1 << 17


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids array<int> and, with `decoded`, the decoded text."""
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens bigint, ids array<int>" + ", decoded string" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for b in batches:
            at, ids, ends, texts = 0, array("i"), [0], []
            for k in range(b.num_rows):
                each = bpe.names(b.column(1)[k].as_py() or "").split()
                ids.extend(map(int, each))
                ends.append(len(ids))
                texts.append(bpe.joiner.join([bpe.by_name[x] for x in each]) if decoded else None)
                if len(ids) >= BATCH_IDS or k == b.num_rows - 1:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32)))
                    cols = [b.column(0).slice(at, k + 1 - at), pa.array(np.diff(ends).astype(np.int64)), lists]
                    names = ["doc_id", "n_tokens", "ids"]
                    if decoded:
                        cols, names = [*cols, pa.array(texts, pa.string())], [*names, "decoded"]
                    yield pa.RecordBatch.from_arrays(cols, names)
                    at, ids, ends, texts = k + 1, array("i"), [0], []
        bpe.forget()

    return docs.select(id_col, text_col).mapInArrow(releasing(run), schema)


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, and the SHA-256 of `encode`'s ids (decimal, joined by one space) and decoded text.

    The same ids as `encode`'s, hashed in the worker so that token lists needn't leave it.
    """
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for b in batches:
            n, ids, decoded = [], [], []
            for t in b.column(1):
                names = bpe.names(t.as_py() or "")
                each = names.split()
                n.append(len(each))
                ids.append(sha256(names.encode()).hexdigest())
                decoded.append(sha256(bpe.joiner.join([bpe.by_name[x] for x in each]).encode()).hexdigest())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    return docs.select(id_col, text_col).mapInArrow(releasing(run), schema)


def decoded_text(ids: Column, vocabulary: Column) -> Column:
    """Decode in Spark: look each id up in a map column and concatenate."""
    return F.array_join(F.transform(ids, lambda i: F.try_element_at(vocabulary, i)), "")
