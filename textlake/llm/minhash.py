"""MinHash near-dedup by a signature-coordinate inverted join.

A text's set of word shingles gets a signature of COORDINATES least hashes; two sets agree in a coordinate with a chance of
their Jaccard similarity. Each (coordinate, value) pair is an element with a posting list of the sets that have it.

* Equal sets are one class, so copies never multiply.
* Elements of a single class can't collide and are left out. A set can only have MATCHES collisions with another if it keeps
  that many elements; the others take no part any more.
* Prefix merging: in the order from rare to frequent elements, two sets with MATCHES elements in common share one among the
  first size - MATCHES + 1 of each. Only these are posted; the long lists are skipped, and whether a pair has enough collisions
  is counted on the two signatures.
* A list of more than CHUNK sets is cut, and each pair of its chunks is a group of its own. Groups emit what connects their
  members (a star or a tree), never all pairs.
* Sets that such pairs connect make a cluster. Within a cluster (pairs of chunks of it, if it is large) links are confirmed on the
  full sets, walking from each text to all those not yet reached, so that a family of near copies costs one walk, and no link that
  joins two groups is missed.

A pair at the similarity is overlooked if it has fewer than MATCHES collisions of COORDINATES (`oversight`; 9e-12 at 0.85), and
shingles are compared by 64-bit hashes; sets, by 128 bits.

Defined cases
    null, empty or blank text: no shingles, n_shingles 0, linked with nothing, component_id its own id.   fewer words than a
    shingle: the whole sequence is the one shingle.     null doc_id: linked like any other, never a least id, never kept.
    a component without an id: component_id null.       repeated rows: each is reported.        repeated ids with other texts: each
    text is linked for itself.    very long texts: whole.      empty table: empty result.     extra columns: ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import attach, releasing, stored
from textlake.llm.components import components
from textlake.llm.shingles import by_group, chunked, confirmed, digest_of, lookup, shingle_set, star, walk

COORDINATES, MATCHES = 64, 32
#: Sets of one group of a posting list; shingles hashed, pairs compared at once; groups up to SMALL sets are compared pair by pair.
CHUNK, PIECE, PAIRS, SMALL = 4096, 2048, 1 << 16, 32
#: Bits of the filter for elements that several classes have: 16 MB, whatever their number; more elements only let more through.
FILTER = 1 << 27


def oversight(similarity: float, coordinates: int = COORDINATES, matches: int = MATCHES) -> float:
    """The chance that a pair of this similarity has fewer collisions than `matches`."""
    return sum(comb(coordinates, i) * similarity**i * (1 - similarity) ** (coordinates - i) for i in range(matches))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    """A factor (odd) and a summand for each coordinate."""
    with np.errstate(over="ignore"):
        x = _mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n] | np.uint64(1), x[n:]


def signature(hashes: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The least of each coordinate's hash over a set of hashes."""
    factor, summand = _constants(coordinates)
    best = np.full(coordinates, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), PIECE):
            x = hashes[at : at + PIECE, None] * factor + summand
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            np.minimum(best, x.min(axis=0), out=best)
    return best


# --- signatures and classes ----------------------------------------------------------------------------------------


def signatures(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, at, n_shingles, digest of the set (null for the empty set), signature, and 16 bits of each coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, long, short = [], [], [], []
            for t in b.column(2):
                own = shingle_set(t.as_py(), k)
                least = signature(own) if len(own) else None
                n.append(len(own))
                digest.append(digest_of(own) if len(own) else None)
                long.append(None if least is None else least.astype("<u8").tobytes())
                short.append(None if least is None else least.astype("<u2").tobytes())
            cols = [pa.array(n, pa.int64()), *[pa.array(x, pa.binary()) for x in (digest, long, short)]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "at", "n_shingles", "digest", "signature", "short"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), lookup(id_col, text_col).alias("at"), F.col(text_col).alias("text"))
    return rows.mapInArrow(releasing(run), "doc_id bigint, at bigint, n_shingles bigint, digest binary, signature binary, short binary")


def _elements(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, element) of a batch's signatures, the last column."""
    _, summand = _constants(COORDINATES)
    values = np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in b.column(b.num_columns - 1)]).reshape(b.num_rows, -1)
    return np.repeat(np.arange(b.num_rows), values.shape[1]), (values ^ summand).view(np.int64).ravel()


def posted(classes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(node, element): the prefixes, without elements that only one class has posted. `classes`: node, signature."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_elements(b)[1])], ["element"])

    shared = classes.select("signature").mapInArrow(releasing(every), "element bigint").groupBy("element").agg(F.count("*").alias("uses"))
    shared = stored(shared.where("uses > 1"), "elements")
    at = F.pmod("element", F.lit(FILTER)).cast("bigint") + 1  # Spark numbers bits and rows from 1
    bits = shared.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))
    table = np.zeros(FILTER // 8, np.uint8)
    for r in bits.collect():  # a bound by FILTER: 4,096 rows of 4 KB
        table[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bitmap, np.uint8)
    held = classes.sparkSession.sparkContext.broadcast(table)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, element = _elements(b)
                place = element & FILTER - 1
                own = (held.value[place >> 3] >> (place & 7) & 1).astype(bool)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[own])), pa.array(element[own])], ["node", "element"])

    some = classes.select("node", "signature").mapInArrow(releasing(likely), "node bigint, element bigint")
    some = attach(some, shared.select("element", "uses", F.col("uses").alias("weight")), "element", "weight").where("uses is not null")
    kept = some.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("uses", "element"))).alias("own"))  # COORDINATES entries at most
    kept = kept.where(F.size("own") >= matches).select("node", F.explode(F.slice("own", F.lit(1), F.size("own") - (matches - 1))).alias("e"))
    kept = stored(kept.select("node", F.col("e.element").alias("element")), "prefixes")
    lists = kept.groupBy("element").agg(F.count("*").alias("uses"))
    lists = stored(lists.where("uses > 1").select("element", "uses", F.ceil(F.col("uses") / CHUNK).cast("int").alias("parts")), "lists")
    return attach(kept, lists, "element", "uses").where("parts is not null")


# --- groups --------------------------------------------------------------------------------------------------------


def _colliding(matches: int, least: float) -> Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Edges that connect the sets of each group with enough collisions, of sizes that the similarity allows."""

    def link(table: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node, size = table["node"].to_numpy(), table["n_shingles"].to_numpy()
        sig = np.concatenate([np.frombuffer(x.as_buffer(), "<u2") for x in table["short"]]).reshape(len(node), -1)
        ends = np.append(starts[1:], len(node))

        def near(x: np.ndarray | int, y: np.ndarray) -> np.ndarray:
            fit = np.minimum(size[x], size[y]) >= least * np.maximum(size[x], size[y]) - 1e-6
            return fit & (np.count_nonzero(sig[x] == sig[y], axis=1) >= matches)

        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        count = ends - starts
        small = np.flatnonzero((count > 1) & (count <= SMALL))
        after = np.concatenate([np.arange(n - 1, -1, -1) for n in count[small]]) if len(small) else np.zeros(0, np.int64)
        first = np.concatenate([np.arange(starts[g], ends[g]) for g in small]) if len(small) else np.zeros(0, np.int64)
        left = np.repeat(first, after)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)
        for at in range(0, len(left), PAIRS):
            x, y = left[at : at + PAIRS], right[at : at + PAIRS]
            hit = near(x, y)
            a.append(node[x[hit]])
            b.append(node[y[hit]])
        for g in np.flatnonzero(count > SMALL):
            for x, y in walk(np.arange(starts[g], ends[g]), near):
                a.append(np.full(len(y), node[x]))
                b.append(node[y])
        return star(np.concatenate(a), np.concatenate(b))

    return link


# --- the operator --------------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, k: int = 3, part: int = 85, whole: int = 100, matches: int = MATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least id that links reach, its own included), kept. Two texts are linked if
    the intersection of their sets of k-word shingles is at least part / whole of the union."""
    marks = stored(signatures(docs, k, id_col, text_col), "signatures")
    classes = marks.where("n_shingles > 0").groupBy("digest", "signature", "short", "n_shingles")
    classes = classes.agg(F.min("doc_id").alias("least"), F.min("at").alias("at"), F.count("*").alias("uses"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # settled once it is written

    rows = posted(classes, matches).join(classes.select("node", "n_shingles", "short"), "node")
    link = by_group("element", _colliding(matches, part / whole), lambda b: b.num_rows)
    edges = stored(chunked(rows, "element").mapInArrow(link, "a bigint, b bigint").distinct(), "candidates")
    found = stored(confirmed(docs, classes, components(edges), k, part, whole, id_col, text_col), "links")

    nodes = classes.select("node", "digest", "least", "uses").join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    nodes = stored(attach(nodes, groups, "root", "size").select("digest", "component_id", "uses"), "members")
    out = attach(marks.select("doc_id", "n_shingles", "digest"), nodes, "digest", "uses")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
