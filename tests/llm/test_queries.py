"""The registered queries on a given folder: their columns, whole tables, and rows against brute force."""

import hashlib
import struct

import pytest

from docintake.llm import ORACLE, QUERIES
from docintake.llm.byte_bpe import read_ranks
from tests.llm.fixtures import given
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_packing import brute_pieces, check_layout
from tests.llm.test_secrets import brute_base
from tests.llm.test_simhash import brute_classes, brute_print

FOLDER = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_line_dedup": {"doc_id": "bigint", "text": "string", "n_lines": "bigint", "n_removed": "bigint"},
    "op2_best_fit_packing": {
        "doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint",
    },
    "op3_chat_preferences": {"pair_id": "bigint", "section": "string", "turn": "bigint", "role": "string", "text": "string"},
    "op4_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op6_secret_scan": {
        "doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string",
    },
    "op7_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op8_multiset_hash": {
        "doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string",
        "near_edited": "double", "near_next": "double",
    },
    "op9_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op10_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op11_importance_resampling": {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"},
    "op12_centroid_clustering": {
        "vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string",
    },
    "op13_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
}


@pytest.fixture(scope="module")
def results(spark):
    found = {}

    def run(name):
        if name not in found:
            df = QUERIES[name](spark, FOLDER)
            found[name] = dict(df.dtypes), df.collect()
        return found[name]

    return run


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(results, name):
    kinds, rows = results(name)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    if name not in ("op2_best_fit_packing", "op3_chat_preferences"):
        key = next(c for c in COLUMNS[name] if c.endswith("_id"))
        ids = [r[key] for r in rows]
        assert len(ids) == len(set(ids)) >= 50
        if key == "doc_id":
            assert set(ids) == {i for i, _ in given()}


def test_all_are_registered():
    assert sorted(QUERIES) == sorted(COLUMNS)


def test_line_dedup(results):
    _, rows = results("op1_line_dedup")
    assert sorted((r.doc_id, r.text, r.n_removed) for r in rows) == sorted(brute_lines(given()))


def test_packing(results):
    _, rows = results("op2_best_fit_packing")
    want = brute_pieces(given())
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert check_layout(rows) <= -(-sum(w[3] for w in want) // 2048) + 1


def test_secrets(results):
    _, rows = results("op6_secret_scan")
    texts = dict(given())
    for r in rows:
        text = ",".join(f"{k}:{s}:{e}" for s, _, k, e in brute_base(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_byte_bpe(results):
    import public_tokenizers as P
    import tiktoken

    ranks = read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = dict(given())
    _, rows = results("op7_byte_bpe")
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_simhash(results):
    _, rows = results("op9_simhash")
    prints = {i: brute_print(t) for i, t in given()}
    classes = brute_classes(list(prints.values()))
    least = {}
    for i, p in prints.items():
        least[classes[p]] = min(i, least.get(classes[p], i))
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{p:016x}", least[classes[p]]) for i, p in prints.items()}


def test_token_counts(results):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    _, rows = results("op13_token_counts")
    texts = dict(given())
    for r in rows:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_centroid_clustering"])
def test_sql(results, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS FROM '{FOLDER}/{table}.parquet'")
    columns = ", ".join(COLUMNS[name])
    want = con.sql(f"SELECT {columns} FROM ({ORACLE[name]})").fetchall()
    _, rows = results(name)
    assert sorted((tuple(r[c] for c in COLUMNS[name]) for r in rows), key=str) == sorted(want, key=str)
