import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlake.llm import exact_dedup, simhash
from textlake.llm import shingles as sets_of
from textlake.llm.common import attach, build_filter, probe_filter
from textlake.llm.components import components

DOCS = "doc_id long, text string, source string, digest string, keep_id int"


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    long = "wort " * 200_000
    rows = [(1, "a", "s", "x", 1), (2, "a", "s", "x", 1), (3, "", "s", "x", 1), (4, None, "s", "x", 1), (5, "b", None, None, None)]
    rows += [(6, long, "s", "x", 1), (7, long, "s", "x", 1), (None, "a", "s", "x", 1), (None, "z", "s", "x", 1), (2, "a", "s", "x", 1), (8, "A", "s", "x", 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_exact_groups(docs):
    found = exact_dedup.find_duplicates(docs)
    want = [(1, 2, 4, False), (2, 2, 4, True), (2, 2, 4, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 7, 2, False), (7, 7, 2, True)]
    want += [(8, 8, 1, True), (None, 2, 4, False), (None, None, 1, True)]
    assert rows_of(found, "doc_id", "keep_id", "group_size", "kept") == sorted(want, key=repr)


def test_exact_collisions_are_settled_by_bytes(docs):
    weak = lambda text: F.substring(exact_dedup.sha256(text), 1, 0)  # noqa: E731  every text has the same digest
    found = exact_dedup.find_duplicates(docs, keep="smallest", digest=weak)
    true = exact_dedup.find_duplicates(docs, keep="smallest")
    cols = ("doc_id", "keep_id", "group_size", "kept")
    assert rows_of(found, *cols) == rows_of(true, *cols)


def test_exact_deduplicate_keeps_columns(docs):
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted([r.doc_id for r in out.collect()], key=repr) == sorted([1, 3, 5, 6, 8, None], key=repr)


def test_exact_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.find_duplicates(empty).count() == 0
    assert exact_dedup.deduplicate(empty).count() == 0


def test_index_levels(spark):
    index = exact_dedup.DigestIndex(spark)
    for at in range(5):
        batch = spark.createDataFrame([(i + 10 * at, str(i % 4)) for i in range(10)] + [(100 + at, f"only {at}")], "doc_id long, text string")
        index.flush(batch.select("doc_id", exact_dedup.sha256(F.col("text")).alias("digest")))
        assert [len(x) for x in index.levels] == [[1], [2], [3], [0, 1], [1, 1]][at]
    want = [(0, 15), (1, 15), (2, 10), (3, 10), (100, 1), (101, 1), (102, 1), (103, 1), (104, 1)]
    assert sorted((r.keep_id, r.n) for r in index.compact().collect()) == want
    assert sum(map(len, index.levels)) == 1
    some = index.entries().first().digest
    assert index.lookup(bytes(some)).count() == 1


def test_exact_clashing_names_and_collisions(spark):
    rows = [(i % 7 if i % 5 else None, "abc"[i % 3] * (1 + i % 2), i, "x") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __hit long, __key string").withColumn("__bucket", F.lit(1))
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(r.text for r in out.collect()) == sorted({r[1] for r in rows})
    weak = lambda text: F.unhex(F.lpad(F.hex(F.length(text)), 8, "0"))  # noqa: E731: texts of one length collide
    found = exact_dedup.find_duplicates(docs, keep="smallest", digest=weak).collect()
    size = {t: sum(r[1] == t for r in rows) for _, t, *_ in rows}
    assert len(found) == 60 and sorted(r.group_size for r in found) == sorted(size[t] for _, t, *_ in rows)


def test_filter_and_attach(spark):
    keys = spark.range(0, 1000, 3).withColumnRenamed("id", "k")
    seen = build_filter(keys, F.xxhash64("k"))
    flags = probe_filter(spark.range(1000), F.xxhash64("id"), seen, "hit").collect()
    assert all(r.hit for r in flags if r.id % 3 == 0) and sum(r.hit for r in flags) < 340
    left = spark.createDataFrame([(i, i % 7 if i % 3 else None) for i in range(60)], "v long, k long")
    right = spark.createDataFrame([(k, f"t{k}", 8) for k in range(5)], "k long, t string, w long")
    got = rows_of(attach(left, right, "k", "w"), "v", "k", "t")
    want = [(i, i % 7 if i % 3 else None, f"t{i % 7}" if i % 3 and i % 7 < 5 else None) for i in range(60)]
    assert got == sorted(want, key=repr)


def union_find(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(3)
    pairs = {
        "path": [(i, i + 1) for i in range(70)],
        "star": [(0, i) for i in range(1, 70)] + [(5, 5)],
        "random": [(rng.randrange(120), rng.randrange(120)) for _ in range(70)],
        "none": [],
    }[kind]
    found = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    nodes = {x for p in pairs for x in p if p[0] != p[1]}
    want = union_find(pairs, nodes)
    assert {r.node for r in found} == nodes
    root = {r.node: r.root for r in found}
    assert all((root[a] == root[b]) == (want[a] == want[b]) for a in nodes for b in nodes)


@pytest.mark.parametrize(("distance", "segments", "chunk"), [(4, 3, 4096), (4, 3, 4), (9, 5, 4096), (9, 5, 16), (1, 3, 4096)])
def test_links_against_all_pairs(spark, monkeypatch, distance, segments, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(distance * chunk)
    fps = [0, (1 << 64) - 1]
    for _ in range(30):
        own = rng.getrandbits(64)
        fps += [own] + [own ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 2 * distance))) for _ in range(6)]
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    edges = simhash.links(spark.createDataFrame([(f, f) for f in fps], "node long, fp long"), distance, segments).collect()
    near = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance]
    assert union_find([(r.a, r.b) for r in edges], fps) == union_find(near, fps)
    assert len(near) > 20


def test_simhash_against_definition(spark):
    import re

    from xxhash import xxh64_intdigest

    rng = random.Random(5)
    words = ["the", "Über", "x", "ÄB", "of", "lorem", "ipsum", "a b", "dolor\x0bsit", "\x1cw"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(60)] + ["", None, "  \t", "one two three", "x " * 5000]
    texts += [t.replace("lorem", "LOREM") + "\n" if t else t for t in texts[:20]]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3]), (None, "q")], "doc_id long, text string")

    def fingerprint(t):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x20\x09-\x0d]+", lower)
        h = [xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    fps = {i: fingerprint(t) for i, t in enumerate(texts)}
    want = union_find([(a, b) for a in fps for b in fps if (fps[a] ^ fps[b]).bit_count() <= 4], list(fps))
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs, k=4).collect() if r.doc_id is not None}
    assert got == {i: (fps[i], want[i]) for i in fps}
    assert simhash.near_duplicates(docs.limit(0), k=4).count() == 0


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(3000)]
    rows, group, at = [], {}, 0
    for g in range(40):
        base = rng.choices(vocabulary, k=300)
        for _ in range(rng.choice([1, 1, 3])):
            text = list(base)
            for _ in range(0 if at == 0 else rng.randint(0, 3)):
                text[rng.randrange(300)] = rng.choice(vocabulary)
            rows.append((at, " ".join(text), "t", at))
            group[at], at = g, at + 1
    docs = spark.createDataFrame([*rows, (None, rows[0][1], "t", 0)], "doc_id long, text string, fp string, __hit int")
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns
    first = {min(d for d in group if group[d] == g) for g in group.values()}
    assert {r.doc_id for r in out.collect()} == first | {None}
    assert simhash.deduplicate(docs.limit(0)).count() == 0


def test_long_texts_are_hashed_whole():
    words = [f"w{i}" for i in range(simhash.PIECE + 500)]
    hashes = simhash.shingle_hashes(" ".join(words), 4)
    whole = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    assert simhash.vote(hashes) & (1 << 64) - 1 == sum(1 << b for b in range(64) if whole[b] * 2 > len(hashes))


def test_a_repeated_passage_does_not_hide_a_copy(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(2000)]
    rows = []
    for i in range(20):
        text = rng.choices(words, k=300)
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text + text[100:110] * 30))]
    line = " ".join(rng.choices(words, k=10))
    rows += [(100 + i, " ".join([*rng.choices(words, k=100), *[line] * 40])) for i in range(10)]
    out = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in out.collect()} == {2 * i for i in range(20)} | {100 + i for i in range(10)}


def test_copies_with_a_passage_more_or_less_go(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    rows = []
    for i in range(60):
        text, passage = rng.choices(words, k=300), rng.choices(words, k=48)
        copy = [text + passage, text[:255], text[:150] + passage + text[150:], passage + text][i % 4]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
    out = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in out.collect()} == {2 * i for i in range(60)}


def shingles(text):
    w = text.split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_links_against_all_pairs(spark, monkeypatch):
    """Texts at every similarity around the threshold, by scattered and by contiguous edits, and one large group of copies."""
    monkeypatch.setattr(sets_of, "CROWD", 40)
    rng = random.Random(13)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    texts = []
    for i in range(70):
        base = rng.choices(words, k=rng.randint(60, 400))
        copy = list(base)
        if i % 2:
            for _ in range(rng.randint(1, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
        else:
            copy += rng.choices(words, k=rng.randint(1, len(base) // 3))
        texts += [base, copy]
    hub = rng.choices(words, k=200)
    for _ in range(60):
        copy = list(hub)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(200)] = rng.choice(words)
        texts.append(copy)
    texts = [" ".join(t) for t in texts]
    sets = list(map(shingles, texts))
    near = [(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert len(near) > 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, _, found = simhash.near_links(docs)
    found = [(r.a, r.b) for r in found.collect()]
    assert set(found) <= set(near)  # nothing below the threshold is linked
    got, want = union_find(found, range(len(texts))), union_find(near, range(len(texts)))
    assert sum(got[a] == got[b] for a, b in near) >= 0.98 * len(near)
    assert all(want[x] == want[got[x]] for x in got)


def test_near_links_leave_out_no_similar_pair(spark):
    rows = []
    for i in range(500):  # 50 of 62 shingles in common: 0.806
        own = [f"w{i}x{j}" for j in range(60)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[:54] + [f"v{i}x{j}" for j in range(6)]))]
        rows.append((10_000 + i, " ".join(own[:50] + [f"u{i}x{j}" for j in range(10)])))  # 46 of 66: not similar
    links = simhash.near_links(spark.createDataFrame(rows, "doc_id long, text string"), 5)[2]
    root = {r.node: r.root for r in components(links).collect()}
    assert [i for i in range(500) if 2 * i not in root or root[2 * i] != root.get(2 * i + 1)] == []
    assert not any(10_000 + i in root for i in range(500))


def test_postings_of_one_text_are_not_stored(spark, monkeypatch):
    """Of the prefixes only those shingles are kept that come in several texts; pairs that their places rule out are no candidates."""
    words = [f"w{i}" for i in range(4000)]
    rows = [(i, " ".join(words[i * 100 : i * 100 + 60])) for i in range(20)]
    base = words[3000:3200]
    rows += [(50, " ".join(base)), (51, " ".join([*base[:190], "x", *base[191:]])), (60, " ".join([*words[3300:3500], *base[:30]]))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept, plain = {}, simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, name, **o: kept.setdefault(name, plain(df, name, **o)))
    marks = simhash.sketches(d, 5)
    classes = marks.withColumns({"node": F.col("doc_id"), "at": F.col("doc_id"), "uses": F.lit(1).cast("bigint")})
    none = spark.createDataFrame([], "a bigint, b bigint")
    found = simhash.missed(d, classes, none, 5, 80, 100, "doc_id", "text")
    assert {tuple(r) for r in found.collect()} == {(50, 51)}
    assert all(t.count() <= 150 for t in kept.values())  # 366 shingles are in prefixes


@pytest.mark.parametrize("few", [256, 3])
def test_a_common_passage_makes_no_cluster(spark, monkeypatch, few):
    """Long texts that share a passage, in prefixes too, are no candidates; similar ones among them all are, however many share a shingle."""
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "CHUNK", 4)
    passage = [f"p{j}" for j in range(40)]
    rows = []
    for i in range(20):
        own = [f"w{i}x{j}" for j in range(400 + i)]
        rows += [(2 * i, " ".join(own + passage)), (2 * i + 1, " ".join(own[:380] + [f"v{i}x{j}" for j in range(20)] + passage))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = simhash.sketches(d, 5)
    classes = marks.withColumns({"node": F.col("doc_id"), "at": F.col("doc_id"), "uses": F.lit(1).cast("bigint")})
    none = spark.createDataFrame([], "a bigint, b bigint")
    found = simhash.missed(d, classes, none, 5, 80, 100, "doc_id", "text")
    assert {tuple(r) for r in found.collect()} == {(2 * i, 2 * i + 1) for i in range(20)}


def test_parities_never_differ_more_than_sets():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n, m, common = (int(x) for x in rng.integers(1, 900, 3))
        both = rng.integers(0, 1 << 63, n + m + common, dtype=np.uint64)
        a, b = np.unique(both[: n + common]), np.unique(both[n:])
        x, y = (np.frombuffer(simhash.parity(s), "<u8") for s in (a, b))
        assert simhash._differ(x, y[None])[0] == simhash._differ(y, x) <= len(np.setxor1d(a, b))
    assert len(simhash.parity(np.zeros(0, np.uint64))) == 8
