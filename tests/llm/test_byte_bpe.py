import hashlib
import random
from array import array

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from docintake.llm.byte_bpe import ByteCodec, encoded, read_ranks, round_trip, tokenizer_json

from tests.llm.fixtures import TEXTS, documents, given

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return ByteCodec(tokenizer_json(read_ranks(RANKS), P.PATTERN))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def odd_texts():
    r = random.Random(5)
    letters = "aeinrst AEIO  éàñß\n\n\t.,;12345'st漢字🙂½² \x1c "
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(6000)] + [" " * k + "x" for k in range(30)]


def test_ids_are_those_of_the_rank_file(codec, library):
    texts = odd_texts() + [t or "" for _, t in TEXTS + given()]
    got = codec.encode_rows(pa.array(texts))
    assert len(got) == len(texts)
    for text, ids in zip(texts, got):
        assert ids.tolist() == library.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


def test_pieces_and_offsets(codec):
    text = "漢字 🙂 naïve 𝔘nicode"
    ids, offsets = codec.ids_and_offsets(text)
    assert "".join(codec.decode_pieces(ids)) == text
    assert "" in codec.decode_pieces(ids)  # a character cut over several tokens
    assert all(text[a:b] for a, b in offsets)
    assert offsets[-1][1] == len(text)


def touched(codec, text, ids):
    """The characters whose bytes each token holds, counted byte by byte."""
    of_byte = [n for n, c in enumerate(text) for _ in c.encode()]
    at, places = 0, []
    for i in ids:
        size = len(codec.table[i])
        places.append((of_byte[at], of_byte[at + size - 1] + 1))
        at += size
    return places


def test_offsets_are_the_characters_of_the_bytes(codec):
    for text in odd_texts()[::7] + [t or "" for _, t in TEXTS + given()]:
        ids, offsets = codec.ids_and_offsets(text)
        assert offsets == touched(codec, text, ids), text


def test_ids_outside_the_vocabulary_are_errors(codec):
    assert codec.decode([]) == b""
    for wrong in (-1, len(codec.table)):
        with pytest.raises(IndexError):
            codec.decode([0, wrong])


def test_encoded_rows_hold_ids_and_offsets(spark, codec):
    got = sorted((r.doc_id, r.ids, list(zip(r.starts, r.ends))) for r in encoded(documents(spark), RANKS, P.PATTERN).collect() if r.doc_id is not None)
    want = []
    for i, t in TEXTS:
        ids, offsets = codec.ids_and_offsets(t or "")
        if i is not None:
            want.append((i, ids, offsets))
    assert got == sorted(want)
    assert encoded(documents(spark, []), RANKS, P.PATTERN).collect() == []


def test_query_rows(spark, library):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in round_trip(documents(spark), RANKS, P.PATTERN).collect()}
    want = set()
    for i, t in TEXTS:
        ids = library.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    assert round_trip(documents(spark, []), RANKS, P.PATTERN).collect() == []
    for r in encoded(documents(spark), RANKS, P.PATTERN).collect():
        assert len(r.ids) == len(r.starts) == len(r.ends)
