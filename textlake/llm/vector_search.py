"""Approximate nearest neighbours: an HNSW graph per shard (hnsw.py), shard results merged.

Vectors are made distinct first: a vector that many rows share is one node with the smallest of its rows (as many as an
answer can need), so that copies neither crowd the graph nor meet in one task. Nodes are dealt to bands of like length (a
factor of BAND), because a graph over inner products loses short vectors beside very long ones, and within a band over shards
of about SHARD vectors by a hash. Each shard's graph is one row of flat arrays in a Parquet folder. Tasks read a shard's row
once and then the blocks of queries (BLOCK vectors) that are dealt to it; the best of all shards are ranked by exact inner
products in double precision, ties to the smaller id.

Defined cases
    null, zero or empty vectors, and those with a null or non-finite component: no part, as candidate or query.
    null id: no part.       repeated ids: each row is a candidate, and a query, of its own; a query leaves out its own row.
    vectors of another length than the query's: not compared.      fewer candidates than asked for: all of them.
    empty table: empty result.       extra columns: ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm import hnsw
from textlake.llm.common import releasing, stored

#: Vectors of a shard; queries of a block; copies of an index row at least, so that few shards still use many tasks; blocks of
#: a copy at most (16 MB of queries at 64 components); the lengths of a band differ by this factor.
SHARD, BLOCK, SPREAD, BLOCKS, BAND = 16_384, 512, 32, 64, 8.0
_MEMBERS = "array<struct<vec_id:bigint,copy:int>>"


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, copy, vector array<double>); `copy` numbers the rows of one id from 0."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0.0)
    rows = rows.select(F.col(id_col).alias("vec_id"), v.alias("vector")).where(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())
    copy = F.row_number().over(Window.partitionBy("vec_id").orderBy("vector")) - 1
    return rows.select("vec_id", copy.alias("copy"), "vector")


def _band(vector: Column) -> Column:
    """Vectors of one band have greatest components, and so lengths, of one magnitude."""
    return F.floor(F.log(F.array_max(F.transform(vector, F.abs))) / F.log(F.lit(BAND))).cast("int")


def build_index(rows: DataFrame, k: int, shard_size: int = SHARD) -> DataFrame:
    """(dim, band, shard, graph, vectors, members) for rows (vec_id, copy, vector): a stored table with one row per shard.
    `members` holds, for each node, its k + 1 smallest rows: an answer of k that leaves out the query's own needs no more."""
    smallest = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id", "copy"))
    nodes = rows.withColumn("place", smallest).where(F.col("place") <= k + 1)
    nodes = nodes.groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("vec_id", "copy"))).alias("members"))
    nodes = stored(nodes.withColumns({"dim": F.size("vector"), "band": _band(F.col("vector"))}), "nodes")
    sizes = nodes.groupBy("dim", "band").agg(F.ceil(F.count("*") / shard_size).cast("int").alias("shards"))
    nodes = nodes.join(F.broadcast(sizes), ["dim", "band"])  # a row per length of vectors and band: 700 bands at most
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        vectors = np.array(table["vector"].combine_chunks().flatten()).reshape(len(table), -1)
        members = table["members"].combine_chunks()
        first = np.array([x[0]["vec_id"].as_py() for x in members])
        order = np.random.default_rng(0).permutation(np.argsort(first, kind="stable"))  # the same graph each time
        graph = hnsw.build(vectors[order])
        own = [[table[c][0].as_py()] for c in ("dim", "band", "shard")]
        return pa.table({
            "dim": pa.array(own[0], pa.int32()), "band": pa.array(own[1], pa.int32()), "shard": pa.array(own[2], pa.int32()),
            "graph": pa.array([graph.to_bytes()], pa.binary()), "vectors": pa.array([vectors[order].astype("<f8").tobytes()], pa.binary()),
            "members": pa.array([members.take(pa.array(order)).to_pylist()], pa.list_(members.type)),
        })

    schema = f"dim int, band int, shard int, graph binary, vectors binary, members array<{_MEMBERS}>"
    return stored(nodes.select("dim", "band", "shard", "vector", "members").groupBy("dim", "band", "shard").applyInArrow(build, schema), "index")


def search(index: DataFrame, queries: DataFrame, k: int, ef: int = hnsw.SEARCH) -> DataFrame:
    """(query_id, copy, rank, vec_id, score): the k nearest found of each query (vec_id, copy, vector), its own row left out."""
    place = ["dim", "band", "shard"]
    shards = index.select(*place)
    blocks = max(1, -(-queries.count() // BLOCK))
    spread = max(1, -(-SPREAD // max(1, shards.count())), -(-blocks // BLOCKS))
    block = F.pmod(F.xxhash64("vec_id", "copy"), F.lit(blocks)).cast("int")
    asked = queries.withColumns({"dim": F.size("vector"), "block": block})
    asked = asked.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "copy", "vector")).alias("queries"))
    asked = stored(asked.withColumn("part", (F.col("block") % spread).cast("int")), "queries").join(shards, "dim")
    copies = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    # A shard's row comes before its blocks of queries.
    rows = copies.select(*place, "part", F.lit(-1).alias("block"), "graph", "vectors", "members")
    rows = rows.unionByName(asked.select(*place, "part", "block", "queries"), allowMissingColumns=True)
    rows = rows.repartition(*place, "part").sortWithinPartitions(*place, "part", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                if col["block"][i].as_py() < 0:
                    shard = _Shard(*(col[n][i] for n in ("graph", "vectors", "members")), col["dim"][i].as_py())
                elif shard is not None:
                    yield shard.answers(col["queries"][i].values, k, ef)

    rows = rows.select("dim", "block", "graph", "vectors", "members", "queries")
    found = rows.mapInArrow(releasing(run), "query_id bigint, copy int, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "copy", "rank", "vec_id", "score")


class _Shard:
    def __init__(self, graph: pa.Scalar, vectors: pa.Scalar, members: pa.Scalar, dim: int):
        self.vectors = np.frombuffer(vectors.as_buffer(), "<f8").reshape(-1, dim)
        self.graph = hnsw.Graph.from_bytes(graph.as_py(), self.vectors)
        lists = members.values
        self.start = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = lists.flatten()
        self.ids, self.copies = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("vec_id", "copy"))

    def answers(self, asked: pa.StructArray, k: int, ef: int) -> pa.RecordBatch:
        own, copy = (asked.field(n).to_numpy(zero_copy_only=False) for n in ("vec_id", "copy"))
        queries = np.array(asked.field("vector").flatten()).reshape(len(own), -1)
        near, _ = self.graph.search(queries, max(ef, 2 * k))
        out: list[list[np.ndarray]] = [[], [], [], []]
        for q in range(len(own)):
            nodes = near[q][near[q] >= 0]
            with np.errstate(over="ignore", invalid="ignore"):
                scores = self.vectors[nodes] @ queries[q]
            n = self.start[nodes + 1] - self.start[nodes]
            at = np.repeat(self.start[nodes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            ids, scores = self.ids[at], np.repeat(scores, n)
            others = (ids != own[q]) | (self.copies[at] != copy[q])
            ids, scores = ids[others], scores[others]
            top = np.lexsort((ids, -scores))[:k]
            for col, x in zip(out, (np.full(len(top), own[q]), np.full(len(top), copy[q]), ids[top], scores[top]), strict=True):
                col.append(x)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        cols = [pa.array(np.concatenate(x), t) for x, t in zip(out, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(cols, ["query_id", "copy", "vec_id", "score"])


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_size: int = SHARD) -> DataFrame:
    """The k nearest rows of each row for which `is_query` (over column vec_id) holds."""
    vectors = stored(usable(rows, id_col, vector_col), "vectors")
    return search(build_index(vectors, k, shard_size), vectors.where(is_query), k)
