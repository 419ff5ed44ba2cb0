"""Many patterns at once: an Aho-Corasick automaton, built in tasks from a table of entries and shipped as flat arrays.

An automaton is a trie with failure links: sorted keys (state, character) with the state that follows, for each state the state of
its longest proper suffix, the entry that ends there, and the next suffix state at which an entry ends. All texts of a batch
run through it together: their characters stand in one row, which is cut into lanes that are read side by side, one step a
character; a lane begins `longest - 1` characters early, so that no match is lost at a cut.

Entries are dealt to automata by their first characters, about PART characters each. One automaton is broadcast (a bound by
construction); of several, each is a row of a stored table which meets all texts in tasks of its own. Overlaps are resolved per
text: longer matches first, then by entry, then by place; places that are taken stay taken.

Defined cases
    null or empty text or entry, null id: no matches; rows with a null id are scanned.      repeated entries: one.
    repeated rows: each is scanned.     letters: compared as they are; fold both sides before if case should not matter.
    very long texts: whole.     empty tables: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.sources.files import stored

#: Characters of an automaton (about 20 bytes each); characters of a lane; characters that run together; salts of a part's texts.
PART, LANE, TOGETHER, SALTS = 4_000_000, 512, 1 << 20, 64
_SHIFT, _BREAK = 21, 0x110000
_MATCHES = "entry string, start int, end int"


class Automaton:
    """States are numbered from 0, the root; `entries` are distinct and sorted."""

    def __init__(self, entries: list[str]):
        self.entries = entries
        step: dict[int, int] = {}
        out, depth = [-1], [0]
        for at, entry in enumerate(entries):
            state = 0
            for c in entry:
                key = state << _SHIFT | ord(c)
                to = step.get(key)
                if to is None:
                    to = step[key] = len(out)
                    out.append(-1)
                    depth.append(depth[state] + 1)
                state = to
            out[state] = at
        self.keys = np.fromiter(step.keys(), np.int64, len(step))
        self.to = np.fromiter(step.values(), np.int32, len(step))
        order = np.argsort(self.keys)
        self.keys, self.to = self.keys[order], self.to[order]
        self.out = np.array(out, np.int32)
        self._prepare()
        self.fail = np.zeros(len(out), np.int32)
        self.link = np.zeros(len(out), np.int32)
        levels = np.array(depth, np.int32)[self.to]
        for level in range(1, int(levels.max(initial=0)) + 1):  # a state's suffix is less deep
            at = np.flatnonzero(levels == level)
            state, parent, c = self.to[at], (self.keys[at] >> _SHIFT).astype(np.int32), self.keys[at] & (1 << _SHIFT) - 1
            if level > 1:
                self.fail[state] = self.follow(self.fail[parent], c)
            suffix = self.fail[state]
            self.link[state] = np.where(self.out[suffix] >= 0, suffix, self.link[suffix])

    def _prepare(self) -> None:
        self.longest = max(map(len, self.entries), default=1)
        self.root = np.zeros(_BREAK + 1, np.int32)
        first = self.keys < 1 << _SHIFT
        self.root[self.keys[first]] = self.to[first]

    def to_bytes(self) -> bytes:
        import io

        held = io.BytesIO()
        text = "".join(self.entries)
        np.savez(held, keys=self.keys, to=self.to, out=self.out, fail=self.fail, link=self.link, sizes=np.array(list(map(len, self.entries)), np.int32), text=np.frombuffer(text.encode("utf-32-le"), "<u4"))
        return held.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Automaton:
        import io

        held = np.load(io.BytesIO(data))
        self = cls.__new__(cls)
        self.keys, self.to, self.out, self.fail, self.link = (held[n] for n in ("keys", "to", "out", "fail", "link"))
        text, ends = held["text"].tobytes().decode("utf-32-le"), np.cumsum(held["sizes"]).tolist()
        self.entries = [text[a:z] for a, z in zip([0, *ends], ends, strict=False)]
        self._prepare()
        return self

    def follow(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states after one character each: the longest suffix that goes on with it."""
        state = state.copy()
        out = np.where(state == 0, self.root[c], 0)
        open_ = np.flatnonzero(state)
        while len(open_):
            key = state[open_].astype(np.int64) << _SHIFT | c[open_]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            out[open_[hit]] = self.to[place[hit]]
            open_ = open_[~hit]
            state[open_] = self.fail[state[open_]]
            at_root = state[open_] == 0
            out[open_[at_root]] = self.root[c[open_[at_root]]]
            open_ = open_[~at_root]
        return out

    def matches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, entry, start) of all occurrences, overlapping ones too."""
        none = np.zeros(0, np.int64)
        codes = np.concatenate([np.append(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64), _BREAK) for t in texts]) if texts else none
        if not len(codes) or not len(self.keys):
            return none, none, none
        lanes = -(-len(codes) // LANE)
        warm = self.longest - 1
        grid = np.full(warm + lanes * LANE, _BREAK, np.int64)
        grid[warm : warm + len(codes)] = codes
        first = np.arange(lanes) * LANE
        state, ends, states = np.zeros(lanes, np.int32), [none], [none]
        for t in range(warm + LANE):
            state = self.follow(state, grid[first + t])
            if t >= warm:
                hit = np.flatnonzero((self.out[state] >= 0) | (self.link[state] > 0))
                if len(hit):
                    ends.append(first[hit] + (t - warm))
                    states.append(state[hit].astype(np.int64))
        end, state = np.concatenate(ends), np.concatenate(states)
        found_end, found = [none], [none]
        while len(end):
            own = self.out[state] >= 0
            found_end.append(end[own])
            found.append(self.out[state[own]].astype(np.int64))
            state = self.link[state].astype(np.int64)
            end, state = end[state > 0], state[state > 0]
        end, entry = np.concatenate(found_end), np.concatenate(found)
        begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
        of = np.searchsorted(begins, end, side="right") - 1
        size = np.array(list(map(len, self.entries)))[entry]
        return of, entry, end + 1 - size - begins[of]


def longest_first(found: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Of a text's occurrences (entry, start), those that stay."""
    if not found:
        return []
    taken = bytearray(max(s + len(e) for e, s in found))
    out = []
    for entry, start in sorted(found, key=lambda x: (-len(x[0]), x)):
        if taken.find(1, start, start + len(entry)) < 0:
            taken[start : start + len(entry)] = b"\1" * len(entry)
            out.append((entry, start))
    return out


def automata(entries: DataFrame, col: str = "entry", part: int = PART) -> DataFrame:
    """(part, parts, automaton binary): a stored table with one row per automaton over the distinct entries."""
    own = entries.select(F.col(col).alias("entry")).where("entry is not null and entry <> ''").distinct()
    own = stored(own)
    total = own.agg(F.coalesce(F.sum(F.length("entry")), F.lit(0))).first()[0]
    parts = max(1, -(-total // part))

    def build(table: pa.Table) -> pa.Table:
        made = Automaton(sorted(table["entry"].to_pylist()))
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "automaton": pa.array([made.to_bytes()], pa.binary())})

    dealt = own.withColumn("part", F.pmod(F.xxhash64(F.substring("entry", 1, 2)), F.lit(parts)).cast("int"))
    return stored(dealt.groupBy("part").applyInArrow(build, "part int, automaton binary"))


def _run(made: Automaton, uids: list, texts: list, resolve: bool) -> pa.RecordBatch:
    of, entry, start = made.matches([t or "" for t in texts])
    names = [made.entries[e] for e in entry.tolist()]
    if resolve:
        each: dict[int, list] = {}
        for t, e, s in zip(of.tolist(), names, start.tolist(), strict=True):
            each.setdefault(t, []).append((e, s))
        kept = [(t, e, s) for t, found in each.items() for e, s in longest_first(found)]
        of, names, start = np.array([k[0] for k in kept], np.int64), [k[1] for k in kept], np.array([k[2] for k in kept], np.int64)
    ends = start + np.array(list(map(len, names)), np.int64)
    cols = [pa.array(uids).take(pa.array(of)), pa.array(names, pa.string()), pa.array(start, pa.int32()), pa.array(ends, pa.int32())]
    return pa.RecordBatch.from_arrays(cols, ["uid", "entry", "start", "end"])


def _pieces(uids: list, texts: list) -> Iterator[tuple[list, list]]:
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= TOGETHER or i == len(texts) - 1:
            yield uids[at : i + 1], texts[at : i + 1]
            at, held = i + 1, 0


def _scanned(rows: DataFrame, made: DataFrame, resolve: bool) -> DataFrame:
    """(uid, entry, start, end) of rows (uid bigint, text)."""
    spark = rows.sparkSession
    parts = [r.part for r in made.select("part").orderBy("part").limit(1025).collect()]
    schema = f"uid bigint, {_MATCHES}"
    if len(parts) <= 1:
        known = spark.sparkContext.broadcast(made.first().automaton if parts else None)

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Automaton.from_bytes(known.value) if known.value else Automaton([])
            for b in batches:
                for uids, texts in _pieces(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    yield _run(own, uids, texts, resolve)

        return rows.select("uid", "text").mapInArrow(one, schema)
    # An automaton's row comes before its texts; each part's texts are dealt to SALTS tasks.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    heads = made.select("part", salts, F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("uid"), F.lit(None).cast("string").alias("text"), "automaton")
    every = made.select("part").distinct()
    body = rows.select("uid", "text").join(F.broadcast(every))  # as many rows as automata, each of PART characters
    body = body.select("part", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("kind"), "uid", "text", F.lit(None).cast("binary").alias("automaton"))
    dealt = heads.unionByName(body).repartition("part", "salt").sortWithinPartitions("part", "salt", "kind")

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Automaton([])
        for b in batches:
            kind, at = b.column(0).to_numpy(), 0
            for cut in [*np.flatnonzero(kind == 0).tolist(), b.num_rows]:
                for uids, texts in _pieces(b.column(1).slice(at, cut - at).to_pylist(), b.column(2).slice(at, cut - at).to_pylist()):
                    yield _run(own, uids, texts, False)
                if cut < b.num_rows:
                    own = Automaton.from_bytes(b.column(3)[cut].as_py())
                at = cut + 1

    found = dealt.select("kind", "uid", "text", "automaton").mapInArrow(many, schema)
    if not resolve:
        return found

    def settle(table: pa.Table) -> pa.Table:
        kept = longest_first(list(zip(table["entry"].to_pylist(), table["start"].to_pylist(), strict=True)))
        cols = [[table["uid"][0].as_py()] * len(kept), [e for e, _ in kept], [s for _, s in kept], [s + len(e) for e, s in kept]]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["uid", "entry", "start", "end"])

    return found.groupBy("uid").applyInArrow(settle, schema)  # a text's matches


def _matched(docs: DataFrame, entries: DataFrame, ids: list[str], text_col: str, col: str, part: int, resolve: bool) -> DataFrame:
    rows = stored(docs.select(*ids, F.col(text_col).alias("text")).withColumn("uid", F.monotonically_increasing_id()))  # settled once written
    found = _scanned(rows, automata(entries, col, part), resolve)
    if ids == ["uid"]:
        return found
    return found.join(rows.select("uid", *ids), "uid").select(*ids, "entry", "start", "end")


def occurrences(docs: DataFrame, entries: DataFrame, ids: tuple[str, ...] = ("doc_id",), text_col: str = "text", col: str = "entry", part: int = PART) -> DataFrame:
    """(ids, entry, start, end) of every occurrence of every entry, overlapping ones too."""
    return _matched(docs, entries, list(ids), text_col, col, part, False)


def scan(docs: DataFrame, entries: DataFrame, ids: tuple[str, ...] = ("doc_id",), text_col: str = "text", col: str = "entry", part: int = PART) -> DataFrame:
    """(ids, entry, start, end) of entries in texts, longer ones first; places that are taken stay taken."""
    return _matched(docs, entries, list(ids), text_col, col, part, True)


def longest_names(docs: DataFrame, aliases: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, name): the canonical name of the longest alias (table: alias, name) in each text, of equal lengths the first in the
    alphabet; null if there is none."""
    found = occurrences(docs, aliases, (id_col,), text_col, "alias").groupBy(id_col).agg(F.min(F.struct((-F.length("entry")).alias("size"), "entry")).alias("best"))
    names = aliases.groupBy("alias").agg(F.min("name").alias("name"))
    found = found.join(names, F.col("best.entry") == F.col("alias")).select(id_col, "name")
    return docs.select(id_col).join(found, id_col, "left")


def missing_synonyms(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words array<string>): the members of each group (table: grp, place, word) of which a text has one, without those
    that it has, in order of group and place."""
    has = occurrences(docs, groups, (id_col,), text_col, "word").select(id_col, F.col("entry").alias("word")).distinct()
    met = has.join(groups, "word").groupBy(id_col, "grp").agg(F.collect_set("word").alias("own"))
    rest = met.join(groups, "grp").where(~F.array_contains("own", F.col("word")))
    words = F.transform(F.sort_array(F.collect_list(F.struct("grp", "place", "word"))), lambda x: x["word"])
    found = rest.groupBy(id_col).agg(words.alias("words"))
    return docs.select(id_col).join(found, id_col, "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
