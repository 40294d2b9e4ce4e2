import random

import corpus_pipeline
import pytest

from tests.llm.fixtures import TEXTS, documents, given
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_packing import brute_pieces, check_layout
from tests.llm.test_secrets import brute_base
from tests.llm.test_simhash import brute_classes, brute_print

STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    own = [(i, t) for i, t in given() if i < 120]
    near = []
    for i, t in own[:10]:
        words = t.split(" ")
        words[r.randrange(len(words))] = "token=abcdefgh123"
        near.append((500 + i, " ".join(words)))
    hard = [(i + 800, t) for i, t in TEXTS if i and i not in (8, 9, 15, 17)]  # words as Python cuts them, one text an id
    return own + near + hard


def plain(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_names_and_order():
    assert list(STAGE) == ["language_id", "line_dedup", "simhash_near_dedup", "secret_scan", "best_fit_packing"]


def test_stages_equal_brute_force(spark, rows):
    docs = documents(spark, rows).cache()
    kept = STAGE["language_id"](spark, docs, "")
    names = {i for i, _ in plain(kept)}
    # documents with words in the one language learned stay
    assert names == {i for i, t in rows if any(c.isalpha() for c in t or "")}

    lines = STAGE["line_dedup"](spark, docs, "")
    assert plain(lines) == sorted(((i, None if t is None else left) for (i, t), (_, left, _) in zip(rows, brute_lines(rows))), key=str)

    first = STAGE["simhash_near_dedup"](spark, docs, "")
    classes = brute_classes([brute_print(t) for _, t in rows])
    least = {}
    for i, t in rows:
        c = classes[brute_print(t)]
        least[c] = min(i, least.get(c, i))
    assert {i for i, _ in plain(first)} == set(least.values())

    clean = STAGE["secret_scan"](spark, docs, "")
    for i, t in plain(clean):
        assert not brute_base(t or "") and len(plain(clean)) == len(rows)

    packed = STAGE["best_fit_packing"](spark, docs, "").collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(brute_pieces(rows))
    check_layout(packed)
    for df in (kept, lines, first, clean):
        assert df.columns == docs.columns


def test_run_is_the_stages_in_turn(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.kept(stage(spark, docs, folder), "test")
    want = {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in docs.collect()}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in got} == want
    assert len({r.doc_id for r in got}) > 150
    check_layout(got)


def test_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark, []), "").collect() == []
