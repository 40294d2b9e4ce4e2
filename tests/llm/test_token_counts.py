import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from docintake.llm.token_counts import TokenCounter, prepared, token_counts, whole_tokens
from tests.llm.fixtures import TEXTS, documents, given

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(prepared(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def wanted(library, texts):
    return [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def odd_texts():
    r = random.Random(3)
    letters = "aeinrst AEIO  éàñß\n\n\t.,;12345'st漢字🙂½² \x1c\x85　\U00020000\U0001d518\U00010940࢏"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(4000)]
    texts += ["".join(chr(r.choice([r.randint(1, 0xD7FF), r.randint(0xE000, 0x10FFFF)])) for _ in range(60)) for _ in range(1000)]
    special = ["<|endoftext|>", "<|endoftext|><|endoftext|>", "a <|endoftext|> b", "<|endoftext", "|>", "don't<|endoftext|>'s"]
    return texts + special + [" " * k + "x" for k in range(30)]


def test_counts_are_those_of_the_library(counter, library):
    texts = odd_texts() + [t or "" for _, t in TEXTS + given()]
    assert [counter.count(t) for t in texts] == wanted(library, texts)


def test_every_code_point(counter, library):
    texts = ["".join(chr(c) + "a " for c in range(at, at + 256) if not 0xD800 <= c < 0xE000) for at in range(0, 0x30000, 256)]
    assert [counter.count(t) for t in texts] == wanted(library, texts)


def test_long_texts_and_full_tables(library, monkeypatch):
    monkeypatch.setattr("docintake.llm.token_counts.KNOWN", 3)
    small = TokenCounter(prepared(PATH))
    texts = ["ordinary wörds, 🙂 and <|endoftext|> others\n" * 30_000, "x" * 50_000, " " * 50_000, "zq" * 5]
    assert [small.count(t) for t in texts] == wanted(library, texts)


def test_proof_is_by_the_model(library):
    proven = whole_tokens(library)
    assert len(set(proven)) == len(proven) > 40_000
    for text in random.Random(1).sample(proven, 5000):
        if len(library.pre_tokenizer.pre_tokenize_str(text)) == 1:
            assert len(library.encode(text, add_special_tokens=False).ids) == 1


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        prepared(P.path("word_bpe_49k.json"))


def test_rows(spark, library):
    got = sorted(map(tuple, token_counts(documents(spark), PATH, limit=9).collect()), key=str)
    texts = [t or "" for _, t in TEXTS]
    want = [(i, len(t.encode()), n, n > 9) for (i, _), t, n in zip(TEXTS, texts, wanted(library, texts), strict=True)]
    assert got == sorted(want, key=str)
    empty = token_counts(documents(spark, []), PATH)
    assert empty.collect() == []
    assert empty.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
