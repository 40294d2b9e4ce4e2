import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from docintake.llm import packing
from docintake.llm.packing import Bins, best_fit_sequences, improve, pack

from tests.llm.fixtures import TEXTS, documents, given

PATH = P.path("word_bpe_49k.json")


def brute_pieces(rows):
    tokenizer = Tokenizer.from_file(PATH)
    out = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            out.append((i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def check_layout(rows):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences)


def test_pieces_and_layout(spark):
    rows = TEXTS + given()
    got = best_fit_sequences(documents(spark, rows).repartition(3), PATH).collect()
    want = brute_pieces(rows)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    least = -(-sum(w[3] for w in want) // 2048)
    assert check_layout(got) <= least + 1


def test_groups_meet_in_a_second_packing(spark, monkeypatch):
    from docintake.llm import packing

    rows = [(i, "word") for i in range(600)]
    pieces = packing.kept(packing.token_pieces(documents(spark, rows), PATH), "p")
    got = packing.packed(pieces, group=50).collect()
    assert len(got) == 600 and check_layout(got) <= 2


def test_search_empties_sequences():
    # best fit alone needs three sequences; exchanges bring them to two
    lengths = [6, 5, 3, 2, 2, 2]
    assert sum(lengths) == 20
    assert len(pack(lengths, 10)) == 2
    r = random.Random(1)
    for _ in range(60):
        sizes = [r.randint(1, 100) for _ in range(r.randint(1, 60))]
        bins = Bins(sizes, 100)
        bins.best_fit()
        before = sum((100 - f) ** 2 for f, i in zip(bins.free, bins.items) if i), sum(map(bool, bins.items))
        improve(bins)
        after = sum((100 - f) ** 2 for f, i in zip(bins.free, bins.items) if i), sum(map(bool, bins.items))
        assert after[0] >= before[0] and after[1] <= before[1]
        assert sorted(i for items in bins.items for i in items) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in items) <= 100 for items in bins.items)


def test_empty_table(spark):
    assert best_fit_sequences(documents(spark, []), PATH).collect() == []


def test_plain_words_go_to_the_merge_model(monkeypatch, tmp_path):
    words = ["a", "the", "zqxjkvb", "abcdefghijklmnopqrstuvwxyz" * 3, "tokenization", "stra\xdfe", "l\xe9t\xe9", "it's", "Up", "x1", "cat"]
    library = Tokenizer.from_file(PATH)
    wanted = [np.array(library.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    runs, whole = [], packing.joined
    monkeypatch.setattr(packing, "joined", lambda tokenizer, texts, *more: runs.append(texts) or whole(tokenizer, texts, *more))
    assert packing.WordTokenizer(PATH).many(words) == wanted
    # only words with other letters are encoded in runs
    assert runs == [["stra\xdfe", "l\xe9t\xe9"]]
    # a special string that looks like a word comes before the merge model
    library.add_special_tokens(["cat"])
    library.save(str(tmp_path / "more.json"))
    assert not packing.WordTokenizer(str(tmp_path / "more.json")).plain
