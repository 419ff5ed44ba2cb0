"""Suffix-array dedup: every byte that a WINDOW-byte string covers which also starts in a document with a smaller id.

The suffixes that matter are those that may share their first WINDOW bytes with one in another document. They are found
exactly, by content: each window is dealt to its *anchor*, the GRAM-byte string in it with the least hash, so equal
windows have equal anchors; consecutive windows with one anchor are a *segment*.

1. Anchors (one hash per document and anchor, sorted and packed by each task) are counted over all tasks. Those in two
   documents or more set a bit in a filter of fixed size. Windows of other anchors repeat nowhere and are done.
2. Segments of repeated anchors go, once for each task, content and anchor, to the group of their anchor. There the
   difference cover algorithm of difference_cover.py sorts the group's suffixes; comparing adjacent prefixes tells which
   windows are equal, and the least document of each. Per distinct segment: its least document and, for that document,
   the windows that a smaller one has.
3. Occurrences of segments are joined with these, gathered by document, and the bytes are cut.

Anchors with more than CROWD segments in all (several in one document count each) are cut to single windows, each keyed
by its own bytes: copies of one window are combined by each task, so neither a common line nor its many surroundings meet
in one place. Below that, an anchor whose distinct segments are too long for one suffix array has its windows grouped by
their bytes instead. The filters saturate on a very large corpus, which costs speed only.

Defined cases
    null or empty text: no bytes.       texts shorter than a window: kept.         null doc_id: after all other ids.
    repeated doc_ids: equal ids are no smaller ids, so such rows don't cut each other; every row is reported.
    very long texts: whole, in pieces of windows.     empty table: empty result.      extra columns: ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm import difference_cover
from textlake.llm.common import attach, stored

#: Bytes of a repeat; bytes of an anchor; windows of a piece of a long text.
WINDOW, GRAM, PIECE = 50, 16, 1 << 22
#: Bits of each filter (16 MB); segments from which on an anchor is crowded; groups of anchors per input partition.
FILTER_BITS, CROWD, GROUPS = 1 << 27, 1 << 17, 8
#: Segments that a task holds before it hands them on; bytes of text that are sorted together; windows compared at once
#: where a text is too long to be sorted.
HELD, SORTED, COMPARED = 150_000, 1 << 17, 1 << 18
_LAST = (1 << 63) - 1  # stands for a null doc_id
_U = np.uint64
_ODD = 0x9E3779B97F4A7C15


# --- windows and anchors -------------------------------------------------------------------------------------------


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-byte string."""
    h, size = data.astype(_U) + _U(1), 1
    with np.errstate(over="ignore"):
        while size * 2 <= k:
            h = h[:-size] * _U(pow(_ODD, size, 1 << 64)) + h[size:]
            size *= 2
        if size < k:
            h = h[: len(h) - (k - size)] * _U(0xD6E8FEB86659FD93) + h[k - size :]
        h = (h ^ h >> _U(32)) * _U(0xBF58476D1CE4E5B9)
        return h ^ h >> _U(29)


def segments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows) of each run of windows with one anchor; all windows are in one."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes, firsts, counts = [], [], []
    span = WINDOW - GRAM + 1
    for at in range(0, n, PIECE):
        h = _grams(data[at : at + min(PIECE, n - at) + WINDOW - 1], GRAM)
        key = (h >> _U(24) << _U(24)) | np.arange(len(h), dtype=_U)  # equal hashes: the first one
        size = 1
        while size * 2 <= span:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < span:
            key = np.minimum(key[: len(key) - (span - size)], key[span - size :])
        best = (key & _U((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
        hashes.append(h[best[first]])
        firsts.append(first + at)
        counts.append(np.diff(np.append(first, len(best))))
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(counts)


def _bytes_of(row: pa.Scalar) -> np.ndarray:
    buffer = row.as_buffer()
    return np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)


def _group(h: np.ndarray, groups: int) -> np.ndarray:
    return (h >> _U(40)).astype(np.int64) % groups


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays of one call, compressed together."""
    parts = []
    for a in arrays.values():
        parts += [np.array([len(a.tobytes())], "<i8").tobytes(), a.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpack(data: bytes, *kinds: type | str) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    for kind in kinds:
        (size,) = np.frombuffer(raw, "<i8", 1, at)
        out.append(np.frombuffer(raw[at + 8 : at + 8 + int(size)], kind))
        at += 8 + int(size)
    return out


def _planes(x: np.ndarray) -> np.ndarray:
    """The bytes of sorted integers' differences, plane by plane, which compress well."""
    return np.ascontiguousarray(np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, x.itemsize).T)


def _unplanes(b: np.ndarray, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    with np.errstate(over="ignore"):
        return np.cumsum(np.ascontiguousarray(b.reshape(size, -1).T).view(kind).ravel(), dtype=kind)


# --- step 1: repeated anchors --------------------------------------------------------------------------------------


def _anchor_counts(rows: DataFrame, groups: int) -> DataFrame:
    """(grp, packed): per task and group, sorted anchor hashes, how many documents have each, and its segments in these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        more: list[tuple[np.ndarray, np.ndarray]] = []  # anchors that a document has again
        size = 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            c = n.copy()
            np.add.at(c, np.searchsorted(h, np.concatenate([x for x, _ in more])), np.concatenate([x for _, x in more]))
            g = _group(h, groups)
            order = np.argsort(g, kind="stable")
            h, g = h[order], g[order]
            n, c = (np.minimum(x[order], (1 << 32) - 1).astype("<u4") for x in (n, c))
            first = np.flatnonzero(np.concatenate([[True], np.diff(g) != 0]))
            ends = np.append(first[1:], len(g))
            packed = [_pack(h=_planes(h[a:z]), n=n[a:z], c=c[a:z]) for a, z in zip(first, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(g[first].astype(np.int32)), pa.array(packed, pa.binary())], ["grp", "packed"])

        for b in batches:
            for t in b.column(0):
                h, n = np.unique(segments(_bytes_of(t))[0], return_counts=True)
                held.append(h)
                again = n > 1
                more.append((h[again], n[again] - 1))
                size += len(h)
            if size >= 8 * HELD:
                yield out()
                held, more, size = [], [], 0
        if size:
            yield out()

    return rows.select("text").mapInArrow(run, "grp int, packed binary")


def _filters(counts: DataFrame, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the anchors in two documents or more, and of those with more than CROWD segments."""
    crowd, bits = CROWD, FILTER_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(group: list[bytes]) -> pa.RecordBatch:
            parts = [_unpack(p, np.uint8, "<u4", "<u4") for p in group]
            h = np.concatenate([_unplanes(p[0], _U) for p in parts])
            n, c = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (1, 2))
            order = np.argsort(h, kind="stable")
            h, n, c = h[order], n[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            some = np.add.reduceat(n, first) > 1
            many = np.tile(np.add.reduceat(c, first)[some] > crowd, 2)
            h = h[first][some]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(_bits(h, bits))), pa.array(many)], ["bit", "crowded"])

        grp, group = None, []
        for b in batches:
            for g, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if g != grp and group:
                    yield out(group)
                    group = []
                grp = g
                group.append(p)
        if group:
            yield out(group)

    found = counts.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "bit bigint, crowded boolean")
    found = stored(found.distinct(), "bits")
    return _bitmap(found, bits), _bitmap(found.where("crowded"), bits)


def _bitmap(rows: DataFrame, bits: int) -> np.ndarray:
    """The bits of column `bit` as an array. What reaches the driver is 4 KB for each 32,768 of `bits`, at most."""
    at, out = F.col("bit") + 1, np.zeros(bits // 8, np.uint8)  # Spark numbers bits from 1
    parts = rows.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))
    for r in parts.collect():
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bitmap, np.uint8)
    return out


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash in a filter."""
    return (h % _U(bits)).astype(np.int64), (h // _U(bits) % _U(bits)).astype(np.int64)


def _holds(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    one, two = _bits(h, len(bitmap) * 8)
    return (bitmap[one >> 3] >> (one & 7) & bitmap[two >> 3] >> (two & 7) & 1).astype(bool)


class _Candidates:
    """Segments of one text whose anchor is repeated; those of crowded anchors as single windows."""

    def __init__(self, data: np.ndarray, repeated: np.ndarray, crowded: np.ndarray):
        h, first, n = segments(data)
        some = _holds(repeated, h)
        h, first, n = h[some], first[some], n[some]
        many = _holds(crowded, h)
        if many.any():
            from xxhash import xxh3_64_intdigest

            single = np.repeat(first[many], n[many]) + _within(n[many])
            raw = data.tobytes()
            own = np.array([xxh3_64_intdigest(raw[s : s + WINDOW]) for s in single.tolist()], _U)
            h, first = np.concatenate([h[~many], own]), np.concatenate([first[~many], single])
            n = np.concatenate([n[~many], np.ones(len(single), np.int64)])
        self.anchor, self.first, self.n = h, first, n
        raw = data.tobytes()
        self.text = [raw[a : a + c + WINDOW - 1] for a, c in zip(first.tolist(), n.tolist(), strict=True)]

    def keys(self) -> np.ndarray:
        """A hash of each segment's bytes."""
        from xxhash import xxh3_64_intdigest

        return np.array([xxh3_64_intdigest(t) for t in self.text], _U)


def _within(n: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each of n, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


# --- step 2: segments ----------------------------------------------------------------------------------------------


def _segment_groups(rows: DataFrame, filters, groups: int) -> DataFrame:
    """(grp, packed): per task and group, distinct segments in order of anchor, each with its least document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            texts = list(held)
            docs, uses, h = (np.array([v[i] for v in held.values()], k) for i, k in enumerate((np.int64, np.int64, _U)))
            g = _group(h, groups)
            order = np.lexsort((h, g))
            docs, uses, h, g = docs[order], uses[order], h[order], g[order]
            first = np.flatnonzero(np.concatenate([[True], np.diff(g) != 0]))
            packed = []
            for a, z in zip(first.tolist(), np.append(first[1:], len(g)).tolist(), strict=True):
                own = [texts[i] for i in order[a:z].tolist()]
                sizes = np.array([len(t) for t in own], np.uint8)
                packed.append(_pack(h=_planes(h[a:z]), d=_planes(docs[a:z]), c=uses[a:z].astype("<u4"), n=sizes, t=np.frombuffer(b"".join(own), np.uint8)))
            return pa.RecordBatch.from_arrays([pa.array(g[first].astype(np.int32)), pa.array(packed, pa.binary())], ["grp", "packed"])

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = _Candidates(_bytes_of(t), *filters.value)
                for text, h in zip(c.text, c.anchor.tolist(), strict=True):
                    found = held.get(text)
                    if found is None:
                        held[text] = [d, 1, h]
                    else:
                        found[1] += 1
                        if d < found[0]:
                            found[0] = d
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return rows.select("doc", "text").mapInArrow(run, "grp int, packed binary")


def _equal_windows(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """As `equal_prefixes`, for a text of any length and in no special order: windows are dealt by a hash of their bytes, and
    each part is sorted by the bytes themselves."""
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    part = (_grams(text, length)[starts] % _U(len(starts) // COMPARED + 1)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    starts, edges = starts[by], np.flatnonzero(np.diff(part[by])) + 1
    orders, groups, at = [], [], 0
    for own in np.split(starts, edges):
        words = np.zeros((len(own), -(-length // 8) * 8), np.uint8)
        words[:, :length] = windows[own]
        words = words.view(_U)
        order = np.lexsort(words.T)
        words = words[order]
        new = np.concatenate([[0], (words[1:] != words[:-1]).any(axis=1)])
        orders.append(own[order])
        groups.append(np.cumsum(new) + at)
        at = int(groups[-1][-1]) + 1
    return np.concatenate(orders), np.concatenate(groups)


def _settle(h: np.ndarray, doc: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """For distinct segments sorted by anchor: a bit per window which a smaller document than the segment's least has."""
    masks = np.zeros(len(texts), np.int64)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(first, len(h)))
    several = np.flatnonzero(np.repeat(size, size) > 1)
    lengths = np.array([len(texts[i]) for i in several.tolist()], np.int64)
    ends = np.cumsum(lengths + 1)
    at = 0
    while at < len(several):  # whole anchors, about SORTED bytes at a time
        z = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SORTED, side="right")))
        while z < len(several) and h[several[z]] == h[several[z - 1]]:
            z += 1
        some = several[at:z]
        text = np.frombuffer(b"\xff".join([texts[i] for i in some.tolist()]) + b"\xff", np.uint8)  # no byte of UTF-8
        begin = np.cumsum(lengths[at:z] + 1) - lengths[at:z] - 1
        n = lengths[at:z] - WINDOW + 1
        of, offset = np.repeat(np.arange(len(some)), n), _within(n)
        starts = begin[of] + offset
        equal = difference_cover.equal_prefixes if len(text) <= difference_cover.MOST else _equal_windows
        order, group = equal(text, starts, WINDOW)
        owner = np.searchsorted(begin, order, side="right") - 1
        least = np.full(int(group[-1]) + 1, _LAST, np.int64)
        np.minimum.at(least, group, doc[some[owner]])
        hit = least[group] < doc[some[owner]]
        np.bitwise_or.at(masks, some[owner[hit]], np.int64(1) << (order[hit] - begin[owner[hit]]))
        at = z
    return masks


def _resolve(packed: DataFrame) -> DataFrame:
    """(key, least, mask, uses) of each distinct segment."""
    from xxhash import xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(group: list[bytes]) -> pa.RecordBatch:
            held: dict[bytes, list[int]] = {}
            for p in group:
                h, d, c, n, t = _unpack(p, np.uint8, np.uint8, "<u4", np.uint8, np.uint8)
                raw, ends = t.tobytes(), np.cumsum(n.astype(np.int64))
                rows = zip(_unplanes(h, _U).tolist(), _unplanes(d, np.int64).tolist(), c.tolist(), (ends - n).tolist(), ends.tolist(), strict=True)
                for own, doc, uses, a, z in rows:
                    text = raw[a:z]
                    found = held.get(text)
                    if found is None:
                        held[text] = [doc, uses, own]
                    else:
                        found[0], found[1] = min(doc, found[0]), found[1] + uses
            texts = list(held)
            doc, uses, h = (np.array([v[i] for v in held.values()], k) for i, k in enumerate((np.int64, np.int64, _U)))
            order = np.argsort(h, kind="stable")
            texts, doc, uses, h = [texts[i] for i in order.tolist()], doc[order], uses[order], h[order]
            masks = _settle(h, doc, texts)
            keys = np.array([xxh3_64_intdigest(t) for t in texts], _U).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(doc), pa.array(masks), pa.array(uses)], ["key", "least", "mask", "uses"])

        grp, group = None, []
        for b in batches:
            for g, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if g != grp and group:
                    yield out(group)
                    group = []
                grp = g
                group.append(p)
        if group:
            yield out(group)

    return packed.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "key bigint, least bigint, mask bigint, uses bigint")


# --- step 3: occurrences and cutting -------------------------------------------------------------------------------


def _useful(found: DataFrame) -> np.ndarray:
    """A filter of the segments that cut anything: in several places, or with windows that a smaller document has."""
    bits = FILTER_BITS
    keys = found.where("uses > 1 or mask <> 0").select("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_bits(b.column(0).to_numpy().view(_U), bits)))], ["bit"])

    return _bitmap(keys.mapInArrow(run, "bit bigint"), bits)


def _occurrences(rows: DataFrame, filters, useful) -> DataFrame:
    """(doc, row, first, n, key) of each segment that may cut something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for d, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                c = _Candidates(_bytes_of(t), *filters.value)
                key = c.keys()
                some = _holds(useful.value, key)
                first, n, key = c.first[some], c.n[some], key[some].view(np.int64)
                for col, x in zip(out, (np.full(len(key), d), np.full(len(key), r), first, n, key), strict=True):
                    col.append(x)
            cols = [pa.array(np.concatenate(x).astype(np.int64)) if x else pa.array([], pa.int64()) for x in out]
            yield pa.RecordBatch.from_arrays([*cols[:3], cols[3].cast(pa.int32()), cols[4]], ["doc", "row", "first", "n", "key"])

    return rows.select("doc", "row", "text").mapInArrow(run, "doc bigint, row bigint, first bigint, n int, key bigint")


def covered(size: int, first: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which bytes the windows cover that `bits` names from `first` on."""
    starts = np.zeros(size + 1, np.int32)
    for k in range(WINDOW):
        on = first[bits >> k & 1 == 1] + k
        if len(on):
            starts[on] = 1
        elif not (bits >> k).any():
            break
    count = np.concatenate([[0], np.cumsum(starts[:size])])
    return count[1:] - count[np.maximum(np.arange(size) - WINDOW + 1, 0)] > 0


def _cut(joined: DataFrame, id_type: str, texts: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, spans in zip(b.column(1), b.column(2), strict=True):
                data = _bytes_of(t)
                if spans.is_valid and len(spans.values):
                    first, bits = (spans.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
                    gone = covered(len(data), first, bits)
                    runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
                    kept = data[~gone].tobytes()
                else:
                    runs, kept = 0, data.tobytes()
                rows.append((len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept if texts else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    return joined.select("doc_id", "text", "spans").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with `texts`, the bytes kept (cuts needn't be
    at whole characters)."""
    spark = docs.sparkSession
    text: Column = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    doc = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST))
    rows = docs.select(F.col(id_col).alias("doc_id"), doc.alias("doc"), text.alias("text"))
    # Rows are told apart by their ids, or, where ids are repeated, by a hash of the text as well.
    repeated = not rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    rows = rows.withColumn("row", F.xxhash64("text") if repeated else F.lit(0).cast("bigint"))
    groups = GROUPS * max(1, docs.rdd.getNumPartitions())
    filters = spark.sparkContext.broadcast(_filters(_anchor_counts(rows, groups), groups))
    found = stored(_resolve(_segment_groups(rows, filters, groups)), "segments")
    uses = _occurrences(rows, filters, spark.sparkContext.broadcast(_useful(found)))
    spans = attach(uses, found, "key", "uses")
    whole = F.expr("shiftleft(1L, n) - 1")
    bits = F.when(F.col("doc") > F.col("least"), whole).when(F.col("doc") == F.col("least"), F.col("mask")).otherwise(0)
    spans = spans.select("doc", "row", "first", bits.alias("bits")).where("bits <> 0").groupBy("doc", "row").agg(F.collect_list(F.struct("first", "bits")).alias("spans"))
    return _cut(rows.join(spans, ["doc", "row"], "left"), dict(docs.dtypes)[id_col], texts)
