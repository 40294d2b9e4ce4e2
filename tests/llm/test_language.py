import itertools
import zlib

import numpy as np
import pytest

from docintake.llm.language import CHAIN, language_spans, languages, learned, marginals, with_language

from tests.llm.fixtures import TEXTS, documents

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def model(corpus):
    return learned(corpus)


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(3)
    scores, start, step = rng.normal(size=(2, 4, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    lengths = np.array([4, 3])
    got, expected = marginals(scores, lengths, start, step)
    moves = np.zeros((3, 3))
    for c, n in enumerate(lengths):
        want, total = np.zeros((n, 3)), 0.0
        own = np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            weight = np.exp(start[path[0]] + sum(scores[c, t, y] for t, y in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:])))
            total += weight
            for t, y in enumerate(path):
                want[t, y] += weight
            for a, b in zip(path, path[1:]):
                own[a, b] += weight
        np.testing.assert_allclose(got[c, :n], want / total)
        moves += own / total
    np.testing.assert_allclose(expected, moves)


def test_held_out_accuracy(corpus):
    truth = {r.doc_id: r.lang for r in corpus.collect()}
    got = languages(corpus).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) > 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_switched_text_is_labelled_word_by_word(corpus, model):
    rows = corpus.where("lang in ('en', 'de') and n_chars > 800").orderBy("doc_id").collect()
    one, two = (next(r.text for r in rows if r.lang == lang) for lang in ("en", "de"))
    cut = one[:400].rsplit(" ", 1)[0]
    spans = language_spans(model, cut + " " + two[:400])
    named = ["?"] * (len(cut) + 401)
    for start, end, lang in spans:
        named[start:end] = [lang] * (end - start)
    assert named[: len(cut)].count("en") > 0.85 * len(cut)
    assert named[len(cut) + 1 :].count("de") > 0.85 * 400
    assert model.step.diagonal().min() > (model.step - 99 * np.eye(len(model.labels))).max()


def test_hard_rows(spark, corpus):
    rows = [(i, t) for i, t in TEXTS] + [(900, "½ ² ³"), (901, "12 34 -- ??"), (902, "the and " * (3 * CHAIN))]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in languages(docs).collect()}
    assert len(languages(docs).collect()) == len(rows)
    assert [got[i].lang_pred for i in (3, 4, 5, 900, 901)] == ["und"] * 5
    assert got[902].lang_pred == "en" and got[None].held_out is False
    assert languages(documents(spark, [])).collect() == []
    bare = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in languages(bare).collect()] == [("und", 0.0)]


def test_stage_keeps_clean_documents(spark, corpus):
    left = with_language(corpus)
    assert left.columns == corpus.columns
    assert left.count() > 0.99 * corpus.count()
    assert with_language(documents(spark, [(1, "the and of"), (2, "..."), (3, None)])).count() == 1


def test_stage_keeps_texts_of_several_languages(spark, corpus):
    rows = corpus.where("n_chars > 800").orderBy("doc_id").collect()
    texts = [next(r.text for r in rows if r.lang == lang)[:400] for lang in ("en", "de", "fr")]
    mixed = corpus.limit(0).unionByName(spark.createDataFrame([(-1, " ".join(texts), None)], "doc_id long, text string, lang string"), allowMissingColumns=True)
    assert [r.doc_id for r in with_language(corpus.unionByName(mixed)).where("doc_id < 0").collect()] == [-1]
    bare = spark.createDataFrame([(1, "some words", None), (2, "12 ...", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in with_language(bare).collect()] == [1]
