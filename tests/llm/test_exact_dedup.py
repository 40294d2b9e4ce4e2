import hashlib
import re
from collections import Counter

from docintake.llm.exact_dedup import exact_copies, without_copies

from tests.llm.fixtures import TEXTS, documents, given


def brute(rows):
    normal = [re.sub(r"[ \x09-\x0D]+", " ", t or "") for _, t in rows]
    ids, sizes = {}, Counter(normal)
    for (i, _), t in zip(rows, normal):
        ids[t] = min((x for x in (ids.get(t), i) if x is not None), default=None)
    return [(i, ids[t], sizes[t], hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, normal)]


def key(row):
    return tuple(str(x) for x in row)


def test_equals_brute_force(spark):
    rows = TEXTS + [(i + 1000, t) for i, t in given()] + [(i + 9000, "hot") for i in range(400)]
    got = exact_copies(documents(spark, rows).repartition(7)).collect()
    want = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({w[3] for w in want})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_empty_table_and_columns(spark):
    assert exact_copies(documents(spark, [])).collect() == []
    rows = [(1, "a b"), (2, "a\nb"), (3, "c")]
    left = without_copies(documents(spark, rows))
    assert left.columns == documents(spark, rows).columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 3]
