import os
from collections import Counter, defaultdict
from hashlib import sha256

import pytest

from textlake.llm import alignment
from textlake.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def symbols():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in own}
    table |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    return table


def spans(tokens):
    at = 0
    for i, t in tokens:
        yield i, at, at + len(t)
        at += len(t)


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(A)
    a_model.encode_special_tokens = True
    b_model, byte = sentencepiece.SentencePieceProcessor(model_file=B), symbols()
    docs = []
    for _, text in rows:
        a = b = []
        if text:
            data = (" " + text).encode()
            a = [(i, bytes(byte[c] for c in a_model.id_to_token(i))) for i in a_model.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()) for i in b_model.encode(text)]
            if b"".join(t for _, t in a) != data or b"".join(t for _, t in b) != data:
                a = b = []
        a, b = list(spans(a)), list(spans(b))
        links, j0 = [], 0
        for x, (_, s, z) in enumerate(a):
            while j0 < len(b) and b[j0][2] <= s:
                j0 += 1
            links += [(x, y) for y in range(j0, min(len(b), j0 + z - s + 1)) if b[y][1] < z and b[y][2] > s]
        docs.append((a, b, links))
    counts = Counter(p for a, b, links in docs for p in {(a[x][0], b[y][0]) for x, y in links})
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = []
    for (d, _), (a, b, links) in zip(rows, docs, strict=True):
        cuts = sorted({z for _, _, z in a} & {z for _, _, z in b})
        groups = []
        for s, z in zip([0, *cuts], cuts, strict=False):
            groups.append("|".join(",".join(str(i) for i, x, y in side if x >= s and y <= z) for side in (a, b)))
        n = [counts[a[x][0], b[y][0]] for x, y in links]
        hits = sum(counts[a[x][0], b[y][0]] == best[a[x][0]] for x, y in links)
        out.append((d, len(a), len(b), len(groups), len(links), hits, sum(n), sha256(";".join(groups).encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


STRANGE = [
    None, "", " ", "  ", "x", "<|endoftext|> and </s> <s> <unk> <0x41>", "a▁b", "naïve café 日本語 😀👩‍👩‍👧 ﬁ ①", "tab\tline\nnew\r\n  two  spaces ", "a b　c​d",
    "\x00\x01 zero", "aaaa" * 300, "é é", "İstanbul ß ſ", "123456789 1,234.56", "﻿mark", " leading", "trailing ", "Ελληνικά русский العربية हिन्दी", "͸ \U0001fae8 unassigned",
]


@pytest.mark.parametrize("common", [alignment.COMMON, 200, 0])
def test_alignment_equals_a_naive_one(spark, common):
    folder = "/root/testdata/sf0.001/documents.parquet"
    own = [r.text for r in spark.read.parquet(folder).orderBy("doc_id").limit(60).collect()] if os.path.exists(folder) else []
    rows = list(enumerate(STRANGE + own)) + [(3, "again again"), (None, "no id"), (None, "no id")]
    table = spark.createDataFrame([(d, t, 5, b"") for d, t in rows], "doc_id long, text string, row int, a binary").repartition(3)
    got = sorted([tuple(r) for r in alignment.align(table, A, B, common=common).collect()], key=repr)
    assert got == brute(rows)


def test_small_slices(spark, monkeypatch):
    rows = [(i, "some words and more words " * (i % 7)) for i in range(40)]
    model = alignment.tokenizers(A, B)
    monkeypatch.setattr(alignment, "SLICE", 10)
    assert list(alignment._slices([3, 4, 5, 20, 1])) == [(0, 3), (3, 4), (4, 5)]
    found = model.encode([t for _, t in rows])
    one = [alignment._described(model, [f])[0] for f in found]
    assert alignment._described(model, found) == one


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
