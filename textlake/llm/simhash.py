"""SimHash near-dedup with a multi-index over fingerprint segments.

A fingerprint of 64 bits is cut into segments. If two differ in at most `distance` bits, then in some segment they
differ in at most distance // segments bits; with 2 * segments - 1 >= distance that is one bit at most. So every
fingerprint is entered in the table of each segment under the segment's value, and visits the values of the Hamming ball
around its own that are less than its own (of two values in each other's balls, exactly one visits the other). Matches are
verified by complete distances.

* Equal fingerprints are one node, so copies never multiply.
* Visits to values that no fingerprint has are left out by an exact bitmap of the values: 2^width bits a segment, a
  bound by the fingerprint's format.
* A crowded value is split into chunks of its table and of its visitors; each pair of chunks is a group of its own.
* A task compares arrays and emits, for what it has linked, one edge per node (a star or a forest), never all pairs of a group.

`deduplicate` judges by shingle sets: fingerprints only find clusters of candidates there, within which links are confirmed by
the Jaccard similarity of the full sets.

Fingerprints are made in Arrow batches (the hash is XXH64 over UTF-8 shingles); everything else is joins.

Defined cases
    null, empty or blank text: no words, fingerprint zero, linked like any other.     fewer words than a shingle: the whole
    sequence is the shingle.      null doc_id: takes part in `near_duplicates`, never the least id; `deduplicate` keeps such rows.
    repeated rows: each is reported; in `deduplicate` rows of one id stay or go together.      very long texts: whole, hashed in
    pieces.      empty table: empty result.     extra columns: ignored by `near_duplicates`, kept by `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.common import attach, build_filter, own_prefix, probe_filter, releasing, stored
from textlake.llm.components import components
from textlake.llm.shingles import by_group, chunked, confirmed, digest_of, shingle_hashes, shingle_set, star

#: Table rows of one group; hashes counted at once; candidate pairs compared at once; bits of a parity.
CHUNK, PIECE, PAIRS, MOST_BITS = 4096, 1 << 16, 1 << 21, 1 << 16


# --- fingerprints --------------------------------------------------------------------------------------------------


def vote(hashes: np.ndarray) -> int:
    """Each bit is set if it is set in over half of the hashes; as a signed integer."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PIECE):
        bits = np.unpackbits(hashes[at : at + PIECE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Other hashes of the same values (a 64-bit finaliser with another offset)."""
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def fingerprints(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fp (bigint) of its k-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [vote(shingle_hashes(t.as_py(), k)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(releasing(run), f"doc_id {dict(docs.dtypes)[id_col]}, fp bigint")


def parity(shingles: np.ndarray) -> bytes:
    """A bit or two for each shingle of a set: whether an odd number of them falls on it. Two such differ in no more bits than the
    sets differ in shingles. The longer one is folded to the shorter one's length (`_differ`)."""
    bits = min(max(64, 1 << max(len(shingles) - 1, 0).bit_length()), MOST_BITS)
    at = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(at.astype(np.uint8), bitorder="little").tobytes()


def _differ(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """In how many bits a parity differs from each row of `others` (words of 64 bits)."""
    while one.shape[-1] > others.shape[-1]:
        one = one[: one.shape[-1] // 2] ^ one[one.shape[-1] // 2 :]
    while others.shape[-1] > one.shape[-1]:
        others = others[..., : others.shape[-1] // 2] ^ others[..., others.shape[-1] // 2 :]
    return np.bitwise_count(one ^ others).sum(axis=-1, dtype=np.int64)


SKETCH, LEAST = ["s0", "s1", "s2", "s3"], ["m0", "m1", "m2", "m3"]


def sketches(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row, of its distinct k-word shingles: doc_id, n_shingles, digest, parity, s0 to s3 (256 bits) and m0 to m3 (the least of
    four hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), k) for t in b.column(1)]
            rows = []
            for own in sets:
                mixed = [_mixed(own, i) for i in range(4)]
                rows.append([*map(vote, mixed), *[int(x.min(initial=_FULL).view(np.int64)) for x in mixed]])
            cols = np.array(rows, np.int64).reshape(-1, len(names)).T
            first = [b.column(0), pa.array([len(x) for x in sets], pa.int64())]
            first += [pa.array([f(x) for x in sets], pa.binary()) for f in (digest_of, parity)]
            yield pa.RecordBatch.from_arrays([*first, *[pa.array(c) for c in cols]], ["doc_id", "n_shingles", "digest", "parity", *names])

    names = SKETCH + LEAST
    schema = ", ".join([f"doc_id {dict(docs.dtypes)[id_col]}, n_shingles bigint, digest binary, parity binary", *[f"{c} bigint" for c in names]])
    return docs.select(id_col, text_col).mapInArrow(releasing(run), schema)


# --- multi-index ---------------------------------------------------------------------------------------------------


_FULL = np.uint64((1 << 64) - 1)


def _cuts(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    at = [64 * i // segments for i in range(segments + 1)]
    return [(a, z - a) for a, z in zip(at, at[1:], strict=False)]


def _values(fp: np.ndarray, cuts: list[tuple[int, int]]) -> list[np.ndarray]:
    return [(fp >> np.uint64(a) & np.uint64((1 << w) - 1)).astype(np.int64) | s << 40 for s, (a, w) in enumerate(cuts)]


class _Values:
    """An exact bitmap of the segment values that occur; Spark numbers bits and rows from 1."""

    def __init__(self, rows: list, cuts: list[tuple[int, int]]):
        self.base = np.concatenate([[0], np.cumsum([1 << w for _, w in cuts])])
        self.bits = np.zeros((int(self.base[-1]) // 32768 + 1) * 4096, np.uint8)  # a row has 32,768 bits
        for r in rows:
            self.bits[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bitmap, np.uint8)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = self.base[keys >> 40] + (keys & (1 << 40) - 1)
        return (self.bits[at >> 3] >> (at & 7) & 1).astype(bool)


def _pairs(rows: dict[str, np.ndarray], cols: list[str], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, places) of the pairs within the groups of `rows` (sorted by group) that differ in at most `most` bits of `cols`
    together, some at a time; with a column `root`, only pairs of different roots."""
    group = np.flatnonzero(np.concatenate([[True], (np.diff(rows["key"]) != 0) | (np.diff(rows["o"]) != 0) | (np.diff(rows["p"]) != 0)]))
    of = np.repeat(np.arange(len(group)), np.diff(np.append(group, len(rows["key"]))))
    table, visit = np.flatnonzero(rows["kind"] == 0), np.flatnonzero(rows["kind"] == 1)
    size = np.bincount(of[table], minlength=len(group))
    first = np.cumsum(size) - size
    visit = visit[size[of[visit]] > 0]
    upto = np.cumsum(size[of[visit]])
    at = 0
    while at < len(visit):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        some = visit[at:end]
        n = size[of[some]]
        left = np.repeat(some, n)
        right = table[np.repeat(first[of[some]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        if "root" in rows:
            other = rows["root"][left] != rows["root"][right]
            left, right = left[other], right[other]
        total = np.zeros(len(left), np.int32)
        for c in cols:
            total += np.bitwise_count(rows[c][left] ^ rows[c][right])
            near = total <= most
            left, right, total = left[near], right[near], total[near]
        yield left, right
        at = end


def _linked(rows: dict[str, np.ndarray], cols: list[str], most: int) -> list[np.ndarray]:
    """Links within the groups of `rows`, as stars."""
    found = [star(rows["node"][left], rows["node"][right]) for left, right in _pairs(rows, cols, most)]
    none = np.zeros(0, np.int64)
    return list(star(*(np.concatenate([none, *(x[i] for x in found)]) for i in range(2))))


def links(nodes: DataFrame, distance: int, segments: int) -> DataFrame:
    """Edges (a, b) that connect exactly the nodes whose fingerprints differ in at most `distance` bits. `nodes`: node bigint
    (unique), fp bigint."""
    if segments < 3 or not 0 <= distance <= 2 * segments - 1:
        raise ValueError("3 segments at least, a distance of 2 * segments - 1 at most")
    return _met(nodes, ["fp"], segments, 1, distance)


def _balls(width: int, radius: int) -> list[tuple[int, int]]:
    """(highest bit, mask) of the ways to change 1 to `radius` bits of a value."""
    ways = (c for r in range(1, radius + 1) for c in combinations(range(width), r))
    return [(c[-1], sum(1 << i for i in c)) for c in ways]


def _met(nodes: DataFrame, cols: list[str], segments: int, radius: int, most: int) -> DataFrame:
    """Edges (a, b) that connect the nodes that are at most `radius` bits apart in a segment of one of the fingerprints `cols` and at
    most `most` in all of them; the tables of all these are united. With a column `root`, only nodes of different roots."""
    spark, cuts, voted = nodes.sparkSession, _cuts(segments) * len(cols), list(cols)
    carried = voted + [c for c in nodes.columns if c == "root"]
    nodes = nodes.select("node", *carried)
    balls = {w: _balls(w, radius) for _, w in cuts}

    def valued(b: pa.RecordBatch) -> list[np.ndarray]:
        each = [_values(b.column(1 + i).to_numpy().view(np.uint64), cuts[:segments]) for i in range(len(voted))]
        return [keys + (i * segments << 40) for i, own in enumerate(each) for keys in own]

    base = np.concatenate([[0], np.cumsum([1 << w for _, w in cuts])]).tolist()

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, keys in enumerate(valued(b)):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(base[s] + 1 + (keys & (1 << 40) - 1))], ["key", "bit"])

    crowd = stored(nodes.mapInArrow(entries, "key bigint, bit bigint").groupBy("key", "bit").agg(F.count("*").alias("n")), "values")
    bitmap = crowd.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))
    present = spark.sparkContext.broadcast(_Values(bitmap.collect(), cuts))  # 2^width bits a segment: 1 MB for each fingerprint of three

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "kind", "node", *carried]
        for b in batches:
            for s, keys in enumerate(valued(b)):
                parts = [(keys, np.arange(len(keys)), 0), (keys, np.arange(len(keys)), 1)]
                for bit, mask in balls[cuts[s][1]]:
                    own = np.flatnonzero(keys >> bit & 1)  # the value visited is the lesser one
                    to = keys[own] ^ mask
                    held = present.value.holds(to)
                    parts.append((to[held], own[held], 1))
                take = pa.array(np.concatenate([p[1] for p in parts]))
                kind = np.concatenate([np.full(len(p[0]), p[2], np.int8) for p in parts])
                cols = [pa.array(np.concatenate([p[0] for p in parts])), pa.array(kind), *[b.column(i).take(take) for i in range(1 + len(carried))]]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = ", ".join(["key bigint, kind tinyint, node bigint", *[f"{c} bigint" for c in carried]])
    rows = nodes.mapInArrow(visits, schema)
    crowded = crowd.where(F.col("n") > CHUNK).select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts"), "n")
    rows = attach(rows, crowded, "key", "n")
    parts = F.coalesce("parts", F.lit(1))
    own, every = F.pmod(F.xxhash64("node"), parts).cast("int"), F.explode(F.sequence(F.lit(0), parts - 1))
    rows = rows.withColumn("own", own).withColumn("every", every).drop("parts")
    table = F.col("kind") == 0
    rows = rows.withColumn("o", F.when(table, F.col("own")).otherwise(F.col("every")))
    rows = rows.withColumn("p", F.when(table, F.col("every")).otherwise(F.col("own"))).drop("own", "every")
    rows = rows.repartition("key", "o", "p").sortWithinPartitions("key", "o", "p")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        count = 0

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal kept, count
            whole = pa.Table.from_batches(kept).combine_chunks()
            cols = {n: whole[n].to_numpy() for n in whole.column_names}
            cut = len(whole)
            if not last:  # the last group may go on in the next batch
                same = np.ones(len(whole), bool)
                for n in ("key", "o", "p"):
                    same &= cols[n] == cols[n][-1]
                cut = int(np.argmax(same))
            kept = whole.slice(cut).to_batches() if cut < len(whole) else []
            count = len(whole) - cut
            if cut:
                part = {n: c[:cut] for n, c in cols.items()}
                for n in carried:
                    if n != "root":
                        part[n] = part[n].view(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _linked(part, voted, most)], ["a", "b"])

        for b in batches:
            kept.append(b)
            count += b.num_rows
            if count >= 1 << 19:
                yield from settle(False)
        if kept:
            yield from settle(True)

    return rows.mapInArrow(releasing(compare), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, k: int = 5, distance: int = 4, segments: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, fp, component_id (the least doc_id that links reach, itself included)."""
    marks = stored(fingerprints(docs, k, id_col, text_col), "fingerprints")
    nodes = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes.select(F.col("fp").alias("node"), "fp"), distance, segments))
    nodes = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    nodes = stored(attach(nodes, groups, "root", "size").select("fp", "component_id", "n"), "members")
    return attach(marks, nodes, "fp", "n").select("doc_id", "fp", "component_id")


# --- dedup of a corpus ---------------------------------------------------------------------------------------------

#: A Jaccard similarity J of shingle sets is a cosine of about 2J / (1 + J): at 0.8, an angle of 27 degrees, or 39 of 256
#: sketch bits, give or take 6: APART leaves three standard deviations. Each of four fingerprints has SEGMENTS segments, which
#: meet within RADIUS bits: if each bit differs for itself, 99.5 % of the pairs at 0.8 meet in one of the twelve.
PART, WHOLE, SEGMENTS, RADIUS, APART = 80, 100, 3, 2, 58


def near_links(docs: DataFrame, k: int = 5, part: int = PART, whole: int = WHOLE, id_col: str = "doc_id", text_col: str = "text", segments: int = SEGMENTS, radius: int = RADIUS, apart: int = APART) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(marks, classes, links): sketches of rows with an id; one class per set of k-word shingles (node: its least id, uses: its
    rows); and links (a, b) between nodes that connect those whose sets have a similarity of part / whole.

    Only a text that has the least of one of four hashes in common with another (as 99.8 % of the pairs at 0.8 have) can be
    similar to it, so only these take part. Each is a candidate for the least text that shares a hash with it, which puts most of
    a group of copies together at the cost of four candidates a text; the multi-index then looks for near sketches of
    different groups only. What candidates connect is a cluster, in which all pairs are judged by their full sets (`confirmed`): no
    number of candidates is kept or dropped. Similar pairs that this overlooks and no link connects are found by `missed`.
    """
    marks = stored(sketches(docs, k, id_col, text_col).where("doc_id is not null"), "sketches")
    classes = marks.groupBy("digest", "n_shingles", "parity", *SKETCH, *LEAST).agg(F.min("doc_id").cast("bigint").alias("node"), F.count("*").alias("uses"))
    classes = stored(classes.withColumn("at", F.col("node")), "classes")  # an id may come with several texts: such a node is entered once for each
    tagged = F.explode(F.array(*[F.xxhash64(F.lit(i), m) for i, m in enumerate(LEAST)])).alias("value")
    each = classes.where("n_shingles > 0").select("node", *SKETCH, tagged)
    shared = each.groupBy("value").agg(F.min(F.struct("node", *SKETCH)).alias("centre"), F.count("*").alias("times"))
    met = attach(each, stored(shared.where("times > 1"), "shared"), "value", "times").where("centre is not null")
    far = sum((F.bit_count(F.col(c).bitwiseXOR(F.col("centre")[c])) for c in SKETCH), F.lit(0))
    met = stored(met.select("node", *SKETCH, F.col("centre.node").alias("centre"), far.alias("apart")), "met")
    stars = met.where((F.col("apart") <= apart) & (F.col("centre") != F.col("node"))).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    stars = stored(stars, "stars")
    some = met.select("node", *SKETCH).distinct().join(components(stars), "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = stored(_met(stored(some, "candidates"), SKETCH, segments, radius, apart).where("a <> b").distinct(), "found")
    clusters = components(stars.unionByName(found))
    linked = stored(confirmed(docs, classes, clusters, k, part, whole, id_col, text_col), "links")
    rest = components(missed(docs, classes, linked, k, part, whole, id_col, text_col))
    more = confirmed(docs, classes, rest, k, part, whole, id_col, text_col)
    return marks, classes, linked.unionByName(stored(more, "more links"))


def least_common(size: int, part: int, whole: int) -> int:
    """How many shingles a set of `size` has at least in common with one that is similar to it."""
    return -(-size * part // whole)


def missed(docs: DataFrame, classes: DataFrame, linked: DataFrame, k: int, part: int, whole: int, id_col: str, text_col: str) -> DataFrame:
    """Edges (a, b) between classes that `linked` does not connect, among them all that are similar: an exact prefix join.

    Of two similar sets each has at least part / whole of its shingles in the other, so in any one order of all shingles the sets have
    one in common among their first size - least_common + 1. Shingles that are frequent in a bounded sample come last in the order,
    which sets how many candidates there are, not which similar ones are found.

    What two prefixes share bounds what the sets share: of the two, the one that ends first holds all that is common so far, and only
    what follows it can be added. Pairs that this allows must also have parities that differ in few enough bits. The pairs of
    a shingle with more than FEW postings are never rows: they are looked at within tasks, by place, size and parity.
    """
    roots = components(linked)
    nodes = classes.where("n_shingles > 0").select("node", "n_shingles", _short("digest").alias("d")).join(roots, "node", "left")
    nodes = nodes.withColumn("root", F.coalesce("root", "node"))
    common = docs.sparkSession.sparkContext.broadcast(_frequent(docs, k, id_col, text_col))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, times = common.value
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for t in b.column(0):
                own = shingle_set(t.as_py(), k)
                if len(own):
                    at = np.minimum(np.searchsorted(values, own), max(len(values) - 1, 0))
                    often = np.where(values[at] == own, times[at], 0) if len(values) else np.zeros(len(own), np.int64)
                    first = np.lexsort((own, often))[: len(own) - least_common(len(own), part, whole) + 1]
                    d = int.from_bytes(digest_of(own)[:8], "big", signed=True)
                    place = np.minimum(np.arange(len(first)), (1 << PLACE) - 1)
                    out[0].append(own[first].view(np.int64) >> PLACE << PLACE | place)
                    out[1].append(np.full(len(first), d))
                    out[2].append(np.where(often[first] > 0, 1 + d % 64, 0).astype(np.int8))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["post", "d", "spread"])

    posted = docs.where(F.col(id_col).isNotNull()).select(text_col).mapInArrow(releasing(prefixes), "post bigint, d bigint, spread tinyint")
    posted = posted.withColumn("shingle", F.shiftright("post", PLACE))
    over = Window.partitionBy("shingle", "spread")  # one shuffle; most postings are alone and go here
    several = posted.withColumns({"lo": F.min("d").over(over), "hi": F.max("d").over(over)}).where("spread > 0 or lo <> hi")
    rows = stored(several.select("post", "shingle", "d"), "several").distinct()
    place = F.col("post").bitwiseAND((1 << PLACE) - 1).alias("place")
    rows = stored(rows.join(nodes, "d").select("shingle", "node", "root", "n_shingles", place), "postings")
    apart = rows.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("times")).where("lo <> hi")
    rows = stored(rows.join(apart.select("shingle", "times"), "shingle"), "apart")
    few = rows.where(F.col("times") <= FEW).select("shingle", F.col("node").alias("a"), F.col("root").alias("q"), F.col("n_shingles").alias("n"), F.col("place").alias("i"))
    other = few.select("shingle", F.col("a").alias("b"), F.col("q").alias("r"), F.col("n").alias("m"), F.col("i").alias("j"))
    needed = (F.col("n") + F.col("m")) * part
    allows = lambda most: most * (whole + part) >= needed
    # a shingle that is common at places i and j: at most the lesser of these before it are common, and of those from it on as many as the shorter rest
    most = F.least("i", "j") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    pairs = few.join(other, "shingle").where((F.col("a") < F.col("b")) & (F.col("q") != F.col("r")) & allows(most) & allows(F.least("n", "m")))
    pairs = pairs.groupBy("a", "b", "n", "m").agg(F.count("*").alias("c"), F.min("i").alias("i"), F.min("j").alias("j"))
    after = F.floor((F.greatest("n", "m") * part + whole - 1) / whole) - 1  # beyond the prefix
    pairs = pairs.where(allows(F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))) & allows(F.col("c") + after))
    marked = classes.select("node", "n_shingles", "parity")
    for node, size in (("a", "n"), ("b", "m")):
        pairs = pairs.join(marked.select(F.col("node").alias(node), F.col("n_shingles").alias(size), F.col("parity").alias(f"parity_{node}")), [node, size])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [[np.frombuffer(x.as_buffer(), "<u8") for x in b[c]] for c in ("parity_a", "parity_b")]
            far = np.array([_differ(x, y) for x, y in zip(*words, strict=True)], np.int64)
            size = b["n"].to_numpy() + b["m"].to_numpy()
            yield b.select(["a", "b"]).filter(pa.array(far * (whole + part) <= size * (whole - part)))

    pairs = pairs.mapInArrow(alike, "a bigint, b bigint")
    many = rows.where(F.col("times") > FEW).withColumn("parts", F.ceil(F.col("times") / CHUNK).cast("int")).join(marked, ["node", "n_shingles"])
    many = chunked(many.select("shingle", "node", "root", "n_shingles", "place", "parity", "parts"), "shingle")
    crowds = many.mapInArrow(by_group("shingle", _alike(part, whole), lambda b: 1 + b.nbytes // 512), "a bigint, b bigint")
    return stored(pairs.unionByName(crowds).distinct(), "missed")


def _alike(part: int, whole: int) -> Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Edges that connect the sets of each group that may be similar by their sizes, their places of the group's shingle and their parities."""

    def link(table: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first, end in zip(starts.tolist(), [*starts[1:].tolist(), len(table)], strict=True):
            own = table.slice(first, end - first).sort_by("n_shingles")
            node, root, n, place = (own[c].to_numpy() for c in ("node", "root", "n_shingles", "place"))
            words = [np.frombuffer(x.as_buffer(), "<u8") for x in own["parity"]]  # not shorter from row to row
            cuts = [0, *(np.flatnonzero(np.diff([len(w) for w in words])) + 1).tolist(), len(words)]
            bits = [(x, z, np.stack(words[x:z])) for x, z in zip(cuts, cuts[1:], strict=False)]
            ends = np.searchsorted(n * part, n * whole, side="right")
            found = []
            for x in range(len(node)):
                to = np.arange(x + 1, ends[x])
                most = np.minimum(place[x], place[to]) + np.minimum(n[x] - place[x], n[to] - place[to])
                to = to[(root[to] != root[x]) & (most * (whole + part) >= (n[x] + n[to]) * part)]
                for low, high, block in bits:
                    near = to[(to >= low) & (to < high)]
                    if len(near):
                        near = near[_differ(words[x], block[near - low]) * (whole + part) <= (n[x] + n[near]) * (whole - part)]
                        found.append((np.full(len(near), node[x]), node[near]))
            if found:
                x, y = star(*map(np.concatenate, zip(*found, strict=True)))
                a.append(x)
                b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        return np.minimum(a, b), np.maximum(a, b)

    return link


#: Postings of one shingle that are paired by a join, instead of within tasks; texts that are looked at for frequent shingles, and these.
FEW, SEEN, FREQUENT = 256, 16384, 1 << 17
#: Low bits of a posting that hold its place in the prefix (the last one stands for all beyond); the others are the shingle's high bits.
PLACE = 16


def _short(digest: str) -> Column:
    return F.conv(F.hex(F.substring(digest, 1, 8)), 16, -10).cast("bigint")


def _frequent(docs: DataFrame, k: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of at most FREQUENT shingles that several of SEEN texts have, in the order of the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), k).view(np.int64))], ["shingle"])

    some = docs.where(F.col(id_col).isNotNull()).select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(SEEN)
    seen = docs.join(F.broadcast(some.distinct()), id_col).select(text_col)
    times = seen.mapInArrow(releasing(run), "shingle bigint").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    found = times.orderBy(F.desc("n"), "shingle").limit(FREQUENT).collect()
    values, counts = np.array([r.shingle for r in found], np.int64).view(np.uint64), np.array([r.n for r in found], np.int64)
    order = np.argsort(values)
    return values[order], counts[order]


def deduplicate(docs: DataFrame, k: int = 5, part: int = PART, whole: int = WHOLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs`, all columns, without those that have a near copy with a smaller id in their group: texts that a chain of links
    of at least the similarity connects."""
    marks, classes, found = near_links(docs, k, part, whole, id_col, text_col)
    nodes = classes.select("node", "digest", "uses").join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = nodes.groupBy("root").agg(F.min("node").alias("stays"), F.count("*").alias("size"))
    members = attach(nodes, groups, "root", "size").select("digest", "stays", "uses")
    found = attach(marks.select("doc_id", "digest"), stored(members, "members"), "digest", "uses")
    gone = stored(found.where("doc_id <> stays").select("doc_id").distinct(), "gone")
    return without(docs, gone, id_col)


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`docs` without the ids of `gone` (doc_id). Only rows that a filter of fixed size takes for hits are moved."""
    p = own_prefix(docs)
    seen = build_filter(gone, F.xxhash64("doc_id"))
    tagged = probe_filter(docs, F.xxhash64(id_col), seen, p + "hit")
    hits = tagged.where(p + "hit").select(*docs.columns)
    hits = hits.join(gone.select(F.col("doc_id").alias(p + "gone")), F.col(id_col) == F.col(p + "gone"), "left_anti")
    return tagged.where(f"not {p}hit").select(*docs.columns).unionByName(hits)
