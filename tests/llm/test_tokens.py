import hashlib
import random
import subprocess
import sys
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textlake.llm import bpe, token_files
from textlake.llm.wavelet import WaveletMatrix, build

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def texts(seed, special):
    rng = random.Random(seed)
    marks = "aàÀéΣσ'slt d<|>\x1c\x1d ́ͅİıＡ０９٣中ʰ̈ªſK\n\t\x85\xa0\x00😀"
    out = ["", "   ", f"A{special}b {special}{special}", "ΑΣ ΣΑΣ İstanbul ǅ", "don't I'LL 'sx it's 12³ ½", "a" * 20_000, "word " * 40_000, "\n\n x \n"]
    return out + ["".join(rng.choices(marks, k=40)) for _ in range(400)]


def test_bpe_equals_the_library():
    lib, own = Tokenizer.from_file(WORD), bpe.Bpe(WORD)
    for t in texts(1, "<|endoftext|>"):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_caches_do_not_change_results(monkeypatch):
    whole = bpe.Bpe(WORD)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    small = bpe.Bpe(WORD)
    for t in texts(2, "<|startoftext|>")[8:80] * 2:
        assert small.names(t) == whole.names(t)


def test_bpe_caches_stay_small():
    own = bpe.Bpe(WORD)
    tracemalloc.start()
    try:
        for k in range(0, 150_000, 1000):
            own.names(" ".join(f"q{i:x}" for i in range(k, k + 1000)))
        assert tracemalloc.get_traced_memory()[1] < 18e6
    finally:
        tracemalloc.stop()


def test_bpe_holds_one_vocabulary():
    own = bpe.Bpe(WORD)
    assert own.cut("it's")[0][0] == "it" and own.normalized("ÀΣ\t b") == "àσ b"
    code = (
        "import re, pyarrow, numpy, regex, tokenizers, pyspark.sql; from textlake.llm import bpe\n"
        "held = lambda: int(re.search(r'RssAnon:\\s+(\\d+)', open('/proc/self/status').read())[1])\n"
        f"before = held(); bpe.model({WORD!r}); print(held() - before)"
    )
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 40_000


def test_merge_skips_stale_entries_on_long_words():
    own, lib = bpe.Bpe(WORD), Tokenizer.from_file(WORD)
    rng = random.Random(3)
    for n in (1, 2, 3, 50, 3000):
        word = "".join(rng.choices("etaoin", k=n))
        assert own.encode(word) == lib.encode(word, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(texts(4, "<|endoftext|>")[:60])]
    rows += [(1000, None, "x", 0), (None, "null id", "x", 0), (5, rows[5][1], "x", 5), (5, "other text of five", "x", 5)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start long").repartition(3)


def test_bpe_rows(docs, monkeypatch):
    lib = Tokenizer.from_file(WORD)
    want, digests = [], []
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), ids, back))
        digests.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.encode(docs, WORD).collect()), key=repr) == sorted(want, key=repr)
    assert sorted(map(tuple, bpe.digest(docs, WORD).collect()), key=repr) == sorted(digests, key=repr)
    assert bpe.encode(docs, WORD, decoded=False).columns == ["doc_id", "n_tokens", "ids"]
    assert bpe.encode(docs.limit(0), WORD).count() == bpe.digest(docs.limit(0), WORD).count() == 0


@pytest.mark.parametrize(("n", "width"), [(0, 16), (1, 16), (5, 3), (513, 16), (3000, 17), (1024, 4)])
def test_wavelet_matrix(n, width):
    ids = np.random.default_rng(n).integers(0, min(1 << width, 60_000), n)
    m = WaveletMatrix(build(ids, width))
    assert (m.decode() == ids).all()
    for i in range(0, n, max(1, n // 25)):
        v = int(ids[i])
        assert m.access(i) == v
        assert m.rank(v, i) == (ids[:i] == v).sum()
        assert m.occurrences(v) == np.flatnonzero(ids == v).tolist()
    assert m.count(1 << width) == 0
    with pytest.raises(IndexError):
        m.access(n)


@pytest.mark.parametrize("shard", [1 << 21, 500])
def test_token_files_round_trip(spark, docs, tmp_path, shard):
    path = str(tmp_path / "shards")
    token_files.write(docs, path, BYTE, shard_tokens=shard)
    lib = Tokenizer.from_file(BYTE)
    start, want, every = 0, [], []
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.h)
    for r in sorted(docs.withColumn("h", F.xxhash64("text")).collect(), key=key):
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        every += ids
    got = sorted(map(tuple, token_files.read_documents(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    token = max(set(every), key=every.count)
    assert sum(r.n for r in token_files.occurrences(spark, path, token).collect()) == every.count(token)
    assert token_files.read_shards(spark, path).count() >= (3 if shard == 500 else 1)


def test_token_files_empty(spark, docs, tmp_path):
    token_files.write(docs.limit(0), str(tmp_path / "none"), BYTE)
    assert token_files.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_encoder_equals_the_library():
    lib, own = Tokenizer.from_file(BYTE), token_files.Encoder(BYTE)
    for t in texts(6, "<|endoftext|>"):
        assert np.frombuffer(own.encode(t), own.kind).tolist() == lib.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 1_200_000 + "x", "a\t\n" * 400_000, "x" * 300_000, "é" * 100_000, "word " * 400_000], ids=["blanks", "white", "letters", "accents", "words"])
def test_long_texts_of_one_kind_are_encoded_as_by_the_library(text):
    coder = token_files.encoder(BYTE)
    assert np.frombuffer(coder.encode(text), coder.kind).tolist() == Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids
