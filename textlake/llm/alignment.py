"""Cross-tokenizer alignment: the minimal groups of tokens in which two tokenizers cover the same bytes, the links of overlapping
tokens, and how many documents hold each linked pair of ids.

Tokens of both sides are the nodes of a bipartite graph with an edge where byte ranges overlap. Of two tokens that overlap, the
one that starts later (the second side's, if both start together) starts inside the other, so each edge is the pointer of one
node to the node of the other side that covers its start: a forest, the unions of a union-find. Following pointers to the
roots (path compression by doubling) names each node's component, and components are the minimal groups: they end where
both sides end a token.

1. `aligned` encodes whole texts, checks that both sides' bytes are those of the text, and stores ids and groups.
2. `pair_counts` counts, per id pair, the documents that hold it linked: each task adds up its documents first, then the tables
   are summed by Spark.
3. `scored` gives each document the sums over its links. The pairs of most documents are broadcast, at most COMMON of them
   (a bound by construction); the links of all other pairs are joined with the counts by shuffle.

Defined cases
    null or empty text, or one whose joined bytes differ on either side (normalised characters, U+2581): no tokens, all zero,
    groups ''.   special tokens' strings: plain text.    null or repeated doc_id, repeated rows: each row is a document.
    very long texts: whole.     empty table: empty result.       extra columns: ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.bpe import byte_symbols
from textlake.llm.common import releasing, stored
from textlake.llm.token_files import Encoder

#: Pairs that are broadcast at most (9 MB); bytes of text handled at once; pairs that a task holds before it hands them on.
COMMON, SLICE, HELD = 1 << 19, 1 << 20, 1 << 20
_ALIGNED = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, a binary, b binary"


class Tokenizers:
    """A byte-level file of the tokenizers library (A, over a space and the text) and a sentencepiece file (B, over the text, to which
    it adds the space), with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = Encoder(path_a, special=False)
        value = {s: i for i, s in enumerate(byte_symbols())}
        vocab = self.a.tokenizer.get_vocab(with_added_tokens=True)
        bytes_a = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            bytes_a[i] = bytes(map(value.__getitem__, s)) if all(c in value for c in s) else s.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(s[3:5], 16)]) if byte else s.replace("▁", " ").encode() for s, byte in pieces]
        self.bytes = [bytes_a, bytes_b]
        self.lengths = [np.array(list(map(len, x)), np.int64) for x in self.bytes]
        self.kinds = ["<u2" if len(x) <= 1 << 16 else "<u4" for x in self.bytes]
        size = max(map(len, self.bytes))
        self.size, self.names = size, np.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(size)])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Both sides' ids of each text; none where the bytes differ."""
        none, out = np.zeros(0, np.int64), []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            data = b" " + text.encode()
            a = np.frombuffer(self.a.encode(" " + text), self.a.kind).astype(np.int64) if text else none
            same = bool(text) and all(b"".join(map(t.__getitem__, ids)) == data for t, ids in zip(self.bytes, (a.tolist(), b), strict=True))
            out.append((a, np.array(b, np.int64)) if same else (none, none))
        return out


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


class Graph:
    """The overlap graph of two sequences of token lengths that cover the same bytes: node i is token i of A, node n + j is token j of
    B. Several documents may follow each other, as each begins where both sides begin a token."""

    def __init__(self, length_a: np.ndarray, length_b: np.ndarray):
        n, m = len(length_a), len(length_b)
        start_a, start_b = np.cumsum(length_a) - length_a, np.cumsum(length_b) - length_b
        over_a = np.repeat(np.arange(m, dtype=np.int32), length_b)[start_a].astype(np.int64)  # the token of B that covers its start
        over_b = np.repeat(np.arange(n, dtype=np.int32), length_a)[start_b].astype(np.int64)
        self.first = start_b[over_a] == start_a  # tokens of A that begin a group
        later = np.flatnonzero(~self.first)
        self.link_a = np.concatenate([later, over_b])
        self.link_b = np.concatenate([over_a[later], np.arange(m)])
        parent = np.concatenate([np.where(self.first, np.arange(n), n + over_a), over_b])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        group = (np.cumsum(self.first) - 1)[parent]
        self.group_a, self.group_b, self.groups = group[:n], group[n:], int(self.first.sum())

    def order(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of A's and B's tokens group by group, A's before B's; and which are the last of their side in their group."""
        n, m = (np.bincount(g, minlength=self.groups) for g in (self.group_a, self.group_b))
        place_a = np.arange(len(self.group_a)) + (np.cumsum(m) - m)[self.group_a]
        place_b = np.arange(len(self.group_b)) + np.cumsum(n)[self.group_b]
        return place_a, place_b, np.diff(self.group_a, append=-1) != 0, np.diff(self.group_b, append=-1) != 0


def _described(model: Tokenizers, found: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int, int, str]]:
    """(tokens of A, of B, groups, links, digest of the groups) of each document."""
    a, b = (np.concatenate([f[i] for f in found]) for i in range(2))
    if not len(a):
        return [(0, 0, 0, 0, "")] * len(found)
    graph = Graph(model.lengths[0][a], model.lengths[1][b])
    place_a, place_b, last_a, last_b = graph.order()
    code = np.empty(len(a) + len(b), np.int64)
    code[place_a] = a + model.size * last_a
    code[place_b] = b + 2 * model.size * last_b
    out, at_a, at = [], 0, 0
    for x, y in found:
        if not len(x):
            out.append((0, 0, 0, 0, ""))
            continue
        groups = int(graph.first[at_a : at_a + len(x)].sum())
        line = model.names[code[at : at + len(x) + len(y)]].tobytes().replace(b"\0", b"")[:-1]
        out.append((len(x), len(y), groups, len(x) - groups + len(y), sha256(line).hexdigest()))
        at_a, at = at_a + len(x), at + len(x) + len(y)
    return out


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE bytes, or of one larger row."""
    at = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= SLICE or i == len(sizes) - 1:
            yield at, i + 1
            at, held = i + 1, 0


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored table with a row per document: its numbers, the digest of its groups, and its ids on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, row = tokenizers(path_a, path_b), TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(1)
            for at, end in _slices(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()):
                found = model.encode([t or "" for t in texts.slice(at, end - at).to_pylist()])
                numbers = list(zip(*_described(model, found), strict=True))
                ids = [pa.array([f[i].astype(model.kinds[i]).tobytes() for f in found], pa.binary()) for i in range(2)]
                cols = [pa.array(np.arange(row, row + end - at)), batch.column(0).slice(at, end - at)]
                cols += [pa.array(x, pa.int64()) for x in numbers[:4]] + [pa.array(numbers[4], pa.string()), *ids]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _ALIGNED.split(", ")])
                row += end - at

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(releasing(run), _ALIGNED), "aligned", compression="zstd")


def _linked(model: Tokenizers, batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Ranges of a batch's rows and, per row, its distinct linked id pairs (a << 32 | b) and how often each is linked.
    The last two columns are the ids of both sides."""
    raw = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
    for at, end in _slices([4 * n for n in pa.compute.binary_length(raw[0]).to_pylist()]):
        ids = [[np.frombuffer(x.as_buffer(), kind).astype(np.int64) for x in col.slice(at, end - at)] for col, kind in zip(raw, model.kinds, strict=True)]
        a, b = (np.concatenate(x) for x in ids)
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * (end - at)
        if len(a):
            graph = Graph(model.lengths[0][a], model.lengths[1][b])
            of = np.repeat(np.arange(end - at), [len(x) for x in ids[0]])[graph.link_a]
            by = np.argsort(of, kind="stable")
            key = (a[graph.link_a] << 32 | b[graph.link_b])[by]
            ends = np.cumsum(np.bincount(of, minlength=end - at))
            pairs = [np.unique(key[z - n : z], return_counts=True) for n, z in zip(np.diff(ends, prepend=0).tolist(), ends.tolist(), strict=True)]
        yield at, end, pairs


def pair_counts(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A stored table (pair, count, best): the documents that hold an id pair linked, and whether no pair of its A id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizers(path_a, path_b)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def summed(held: list[np.ndarray]) -> None:
            nonlocal keys, counts
            own, n = np.unique(np.concatenate(held), return_counts=True)
            every, back = np.unique(np.concatenate([keys, own]), return_inverse=True)
            keys, counts = every, np.bincount(back, np.concatenate([counts, n]), len(every)).astype(np.int64)

        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for _, _, pairs in _linked(model, batch):
                held += [p for p, _ in pairs]
                size += sum(len(p) for p, _ in pairs)
                if size >= HELD:
                    summed(held)
                    held, size = [], 0
                if len(keys) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "count"])
                    keys, counts = keys[:0], counts[:0]
        if held:
            summed(held)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "count"])

    found = rows.where("n_links > 0").select("a", "b").mapInArrow(releasing(run), "pair bigint, count bigint")
    found = stored(found.groupBy("pair").agg(F.sum("count").alias("count")), "counted")
    a = F.shiftright("pair", 32).alias("a_id")
    most = found.groupBy(a).agg(F.max("count").alias("most"))
    return stored(found.withColumn("a_id", a).join(most, "a_id").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")


def _common(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, count, best) of the pairs of most documents, sorted by pair: all above a count that at most `limit` pairs reach."""
    level = F.floor(F.log2("count") * 8)
    n, least = 0, None
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():  # 512 levels at most
        n += r.n
        if n > limit:
            break
        least = r.level
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    top = counts.where(level >= least).toArrow()
    by = np.argsort(top["pair"].to_numpy())
    return tuple(top[c].to_numpy()[by] for c in ("pair", "count", "best"))


def scored(rows: DataFrame, counts: DataFrame, path_a: str, path_b: str, common: int = COMMON) -> DataFrame:
    """`rows` with n_best (links whose pair is one of its A id's most frequent) and count_sum (over links)."""
    known = rows.sparkSession.sparkContext.broadcast(_common(counts, common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (pair, count, best) = tokenizers(path_a, path_b), known.value
        for batch in batches:
            for at, end, pairs in _linked(model, batch):
                n_best, total, rest = [], [], []
                for keys, uses in pairs:
                    place = np.minimum(np.searchsorted(pair, keys), max(0, len(pair) - 1))
                    hit = pair[place] == keys if len(pair) else np.zeros(len(keys), bool)
                    total.append(int((count[place[hit]] * uses[hit]).sum()))
                    n_best.append(int(uses[hit][best[place[hit]]].sum()))
                    rest.append([{"pair": int(k), "uses": int(u)} for k, u in zip(keys[~hit], uses[~hit], strict=True)])
                kind = pa.list_(pa.struct([("pair", pa.int64()), ("uses", pa.int64())]))
                cols = [batch.column(0).slice(at, end - at), pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), pa.array(rest, kind)]
                yield pa.RecordBatch.from_arrays(cols, ["row", "n_best", "count_sum", "rest"])

    schema = "row bigint, n_best bigint, count_sum bigint, rest array<struct<pair:bigint,uses:bigint>>"
    sums = stored(rows.select("row", "a", "b").mapInArrow(releasing(run), schema), "sums")
    rest = sums.select("row", F.explode("rest").alias("r")).select("row", "r.pair", "r.uses").join(counts, "pair")
    rest = rest.select("row", F.when(F.col("best"), F.col("uses")).otherwise(0).alias("n_best"), (F.col("count") * F.col("uses")).alias("count_sum"))
    sums = sums.select("row", "n_best", "count_sum").unionByName(rest)
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("a", "b").join(sums, "row")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = aligned(docs, path_a, path_b, id_col, text_col)
    out = scored(rows, pair_counts(rows, path_a, path_b), path_a, path_b, common)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
