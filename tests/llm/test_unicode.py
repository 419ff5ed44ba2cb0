import random
import sys
import unicodedata

import pytest
from tokenizers import Tokenizer

from textlake.llm.bpe import Bpe
from textlake.llm.queries import tokenizer_path
from textlake.llm.token_files import Encoder


@pytest.fixture(scope="module")
def coders():
    own = Bpe(tokenizer_path("word_bpe_49k.json")), Encoder(tokenizer_path("byte_bpe_50k.json"))
    libraries = [Tokenizer.from_file(tokenizer_path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")]
    for t in libraries:
        t.no_truncation()
        t.no_padding()
    return own, libraries


def check(coders, texts):
    (bpe, encoder), (words, byte) = coders
    assert [t for t in texts if bpe.encode(t) != words.encode(t, add_special_tokens=False).ids] == []
    assert [t for t in texts if encoder.encode(t) != encoder_bytes(encoder, byte.encode(t, add_special_tokens=False).ids)] == []


def encoder_bytes(encoder, ids):
    from array import array

    return array(encoder.code, ids).tobytes()


def test_all_code_points(coders):
    (bpe, encoder), _ = coders
    kinds = {}
    for at in range(sys.maxunicode + 1):
        if not 0xD800 <= at < 0xE000:
            c = chr(at)
            kinds.setdefault((bool(bpe.unsettled(c)), bool(encoder.unsettled(c))), []).append(c)
    assert len(kinds) >= 3
    for own in kinds.values():
        check(coders, [" ".join(f"a{c}B {c}{c} 1{c}" for c in own[i : i + 500]) for i in range(0, len(own), 500)])


def test_marks_in_any_order(coders):
    rng = random.Random(2)
    marks = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    check(coders, ["".join(rng.choice("aeKΣ가각ᄀ") + "".join(rng.choices(marks, k=rng.randint(1, 6))) for _ in range(40)) for _ in range(300)])


def test_odd_texts(coders):
    rng = random.Random(3)
    alphabet = "ab'\" \n\t\r.,<|>endoftext12é  \x1c\x85’sdll一Σς_²Ᲊ"
    check(coders, ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(2000)] + ["x<|endoftext|>y<|startoftext|>", "a" * 5000, ""])
