"""Sets of word shingles, groups that meet in a task, and the exact confirmation of near copies within clusters.

`confirmed` takes clusters (nodes that may be similar, directly or by way of others) and gives links between nodes whose full sets
are similar enough, so many that they connect exactly what all such pairs connect: it walks from each text to all those
not yet reached, so that a family of near copies costs one walk. A large cluster is cut into chunks, and each pair of chunks is
a group of its own. Shingles are compared by 64-bit hashes, sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import attach, build_filter, own_prefix, probe_filter, releasing, stored

#: Shingles and sets of one group of a cluster; rows gathered before groups are compared.
CLUSTER, CROWD, GATHER = 1 << 20, 8192, 1 << 14


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle, repeats included; words are runs without ASCII white space, A-Z lower-cased."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode().lower().split()  # bytes: ASCII only
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    if len(found) <= k:
        return np.array([xxh64_intdigest(line, 42)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(found) - k + 1].tolist()
    return np.array([xxh64_intdigest(line[a:z], 42) for a, z in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)


def digest_of(shingles: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(shingles.astype("<u8").tobytes())


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles."""
    return np.unique(shingle_hashes(text, k))


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For linked nodes, (node, least node that it is linked to by any path), without the least nodes themselves."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = back[: len(a)], back[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label != label[label]).any():
            label = label[label]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def lookup(id_col: str, text_col: str) -> Column:
    """A value by which a row is found again: its id, else a hash of its text."""
    return F.coalesce(F.col(id_col).cast("bigint"), F.xxhash64(text_col))


# --- groups of a partition -------------------------------------------------------------------------------------------


def chunked(rows: DataFrame, key: str) -> DataFrame:
    """`rows` (node, key, parts and others) with o and p: the pairs of chunks of its key that a row belongs to, as partitions
    sorted by (key, o, p). With one part there is one group; else each two parts are a group."""
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.where("parts = 1 or own <> other")
    rows = rows.withColumns({"o": F.least("own", "other"), "p": F.greatest("own", "other")}).drop("own", "other", "parts")
    return rows.repartition(key, "o", "p").sortWithinPartitions(key, "o", "p")


def by_group(key: str, link: Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray]], weight: Callable[[pa.RecordBatch], int]) -> Callable:
    """For mapInArrow: `link(table, starts of groups)` on runs of whole groups, as edges (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        held = 0

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal kept, held
            whole = pa.Table.from_batches(kept).combine_chunks()
            of = np.column_stack([whole[n].to_numpy() for n in (key, "o", "p")])
            new = np.concatenate([[True], (np.diff(of, axis=0) != 0).any(axis=1)])
            starts = np.flatnonzero(new)
            cut = len(whole) if last else int(starts[-1])  # the last group may go on
            kept = whole.slice(cut).to_batches() if cut < len(whole) else []
            held = 0
            if cut:
                a, b = link(whole.slice(0, cut), starts[starts < cut])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:
            if b.num_rows:
                kept.append(b)
                held += weight(b)
                if held >= GATHER:
                    yield from settle(False)
        if kept:
            yield from settle(True)

    return releasing(run)


# --- confirmation --------------------------------------------------------------------------------------------------


def walk(members: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(member, those newly reached from it), over all members: each meets only what has not been reached."""
    rest = members
    while len(rest):
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            x = reached.pop()
            hit = near(x, rest)
            if hit.any():
                yield x, rest[hit]
                reached += rest[hit].tolist()
                rest = rest[~hit]


def similar(part: int, whole: int) -> Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Edges that connect the sets of each group whose intersection is `part` of `whole` of their union or more."""

    def link(table: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node = table["node"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in table["shingles"]]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first, end in zip(starts.tolist(), [*starts[1:].tolist(), len(node)], strict=True):
            if end - first > 1:
                for x, y in family(sets[first:end], part, whole):
                    a.append(np.full(len(y), node[first + x]))
                    b.append(node[first + y])
        a, b = np.concatenate(a), np.concatenate(b)
        own = a != b  # a node may have come twice, by rows of one id
        return np.minimum(a, b)[own], np.maximum(a, b)[own]

    return link


def family(sets: list[np.ndarray], part: int, whole: int) -> Iterator[tuple[int, np.ndarray]]:
    """`walk` over sets; intersections are counted by marking the one set's values among all values of the group."""
    size = np.array([len(s) for s in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    own = [flat[z - n : z] for n, z in zip(size, ends, strict=True)]
    mark = np.zeros(len(values), bool)
    rest, kept = np.arange(len(sets)), flat
    state = {"rest": rest, "flat": kept}

    def near(x: int, others: np.ndarray) -> np.ndarray:
        if len(others) != len(state["rest"]):  # the values of those that are left, in order
            left = np.isin(state["rest"], others, assume_unique=True)
            state["flat"] = state["flat"][np.repeat(left, size[state["rest"]])]
            state["rest"] = others
        mark[own[x]] = True
        n = size[others]
        common = np.add.reduceat(mark[state["flat"]], np.cumsum(n) - n, dtype=np.int64)
        mark[own[x]] = False
        return whole * common >= part * (n + size[x] - common)

    yield from walk(rest, near)


def confirmed(docs: DataFrame, classes: DataFrame, clusters: DataFrame, k: int, part: int, whole: int, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between the nodes of each cluster (node, root) that connect those similar by their full sets."""
    members = clusters.join(classes.select("node", "at", "digest", "n_shingles"), "node").where("n_shingles > 0")
    members = stored(members, "clustered")
    wanted = build_filter(members, F.xxhash64("at"))
    p = own_prefix(docs)
    rows = docs.select(F.col(text_col).alias("text"), lookup(id_col, text_col).alias("at"))
    rows = probe_filter(rows, F.xxhash64("at"), wanted, p + "hit").where(p + "hit")
    rows = rows.join(members.select("at", "node", "root", "digest"), "at").select("node", "root", "digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), k) for t in b.column(3)]
            same = [digest_of(s) == d.as_py() for s, d in zip(sets, b.column(2), strict=True)]  # an id may come with several texts
            cols = [b.column(0), b.column(1), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["node", "root", "shingles"]).filter(pa.array(same, pa.bool_()))

    sets = rows.mapInArrow(releasing(run), "node bigint, root bigint, shingles binary")
    sizes = members.groupBy("root").agg(F.sum("n_shingles").alias("weight"), F.count("*").alias("uses"))
    parts = F.greatest(F.ceil(F.col("weight") / CLUSTER), F.ceil(F.col("uses") / CROWD)).cast("int")
    sets = attach(sets, stored(sizes.select("root", parts.alias("parts"), "uses"), "sizes"), "root", "uses")
    link = by_group("root", similar(part, whole), lambda b: 1 + b.nbytes // 512)
    return chunked(sets, "root").mapInArrow(link, "a bigint, b bigint")
