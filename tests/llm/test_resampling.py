import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docintake.llm import resampling
from docintake.llm.resampling import InternTable, drawn, grams_of
from tests.llm.fixtures import TEXTS, documents, given


def features(text, longest):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(crc(f) for _, t in docs for f in features(t, longest)[1])
    t = Counter(crc(f) for x in target for f in features(x, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        words, own = features(x, longest)
        weight = sum(gain[crc(f)] for f in own)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], r[1]))
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        r.append(rank)
    return sorted((tuple(r[:4]) + (r[5] if len(r) > 5 else None,) for r in rows), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def target():
    return [t for _, t in given()[::17]]


@pytest.mark.parametrize("longest", [1, 2])
def test_against_brute_force(spark, target, longest, monkeypatch):
    docs = given() + TEXTS
    wanted = spark.createDataFrame([(1, t, "x") for t in target], "item_id long, text string, doc_id string")
    got = rows_of(drawn(documents(spark, docs), wanted, longest=longest))
    assert got == brute(docs, target, longest=longest)
    assert sum(r[4] is not None for r in got) > 5


def test_ties_and_repeated_rows(spark):
    docs = [(n // 3, "same words here again and again " * 5) for n in range(90)] + [(None, "other words " * 12)] * 3 + [(4, None), (4, "")]
    wanted = spark.createDataFrame([("same words",), (None,), ("",)], "text string")
    got = rows_of(drawn(documents(spark, docs), wanted, percent=50))
    assert got == brute(docs, ["same words", None, ""], percent=50)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert drawn(documents(spark, []), none).collect() == []
    assert rows_of(drawn(documents(spark), none, percent=100)) == brute(TEXTS, [], percent=100)


def test_table_grows_and_keeps_equal_hashes_apart(monkeypatch):
    r = random.Random(2)
    grams = [str(r.randint(0, 900)).encode() for _ in range(5000)]
    want = Counter(grams)
    for digest in (None, lambda g: len(g), lambda g: 7):
        if digest:
            monkeypatch.setattr(resampling.xxhash, "xxh64_intdigest", digest)
        table = InternTable(10_000, slots=16)
        slots = table.intern(grams)
        of = dict(zip(grams, slots.tolist(), strict=True))
        assert len(set(of.values())) == len(of) == len(want)
        assert [of[g] for g in grams] == slots.tolist()
        for g, slot in of.items():
            assert (table.count[slot], table.bucket[slot]) == (want[g], zlib.crc32(g) % 10_000)
        assert table.count.sum() == len(grams)


def test_words_of_a_block():
    texts = [t or "" for _, t in TEXTS]
    grams, sizes, words = grams_of(pa.array(texts), 2)
    want = [features(t, 2) for t in texts]
    assert words.tolist() == [len(w) for w, _ in want]
    assert sizes.tolist() == [len(f) for _, f in want]
    assert [g.decode() for g in grams] == [f for _, own in want for f in own]
    assert np.array_equal(np.cumsum(sizes)[-1:], [len(grams)])
