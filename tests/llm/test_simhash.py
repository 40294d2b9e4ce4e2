import random

import xxhash

from docintake.llm.components import components
from docintake.llm.simhash import answered, fingerprint_of, forest_links, near_copies, near_links, without_near_copies

from tests.llm.fixtures import TEXTS, documents, given


def brute_print(text):
    data = bytearray((text or "").encode())
    for i, b in enumerate(data):
        if 65 <= b <= 90:
            data[i] = b + 32
    words = [w for w in bytes(data).replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(values, radius=3):
    root = {v: v for v in values}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    values = sorted(set(values))
    for n, a in enumerate(values):
        for b in values[:n]:
            if (a ^ b).bit_count() <= radius:
                root[max(up(a), up(b))] = min(up(a), up(b))
    return {v: up(v) for v in values}


def test_equals_brute_force(spark):
    r = random.Random(2)
    rows = TEXTS + [(i + 1000, t) for i, t in given()]
    for i, (_, t) in enumerate(given()[:40]):
        words = t.split()
        words[r.randrange(len(words))] = "changed"
        rows.append((5000 + i, " ".join(words)))
    got = near_copies(documents(spark, rows).repartition(5)).collect()
    prints = [brute_print(t) for _, t in rows]
    classes = brute_classes(prints)
    least = {}
    for (i, _), p in zip(rows, prints):
        least[classes[p]] = min((x for x in (least.get(classes[p]), i) if x is not None), default=None)
    want = sorted(((i, f"{p:016x}", least[classes[p]]) for (i, _), p in zip(rows, prints)), key=str)
    assert sorted(((x.doc_id, x.fingerprint, x.component_id) for x in got), key=str) == want


def test_large_shards_are_cut_and_lose_no_link(spark):
    r = random.Random(3)
    values = {0}
    for _ in range(300):  # a crowd within few bits, and strangers
        v = 0
        for _ in range(r.randint(0, 5)):
            v |= 1 << r.randrange(64)
        values |= {v, r.getrandbits(64)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = near_links(spark.createDataFrame(signed, "print long"), tree=20)
    roots = {x.node % (1 << 64): x.root % (1 << 64) for x in components(links).collect()}
    got = {}
    for v in values:
        got.setdefault(roots.get(v, v), set()).add(v)
    want = {}
    for v, c in brute_classes(values).items():
        want.setdefault(c, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_forest_of_a_group_has_one_link_less_than_members():
    assert len(forest_links(list(range(8)), [], 3)) == 7
    assert forest_links([], [], 3) == []


def test_long_text_in_blocks():
    text = " ".join(str(i % 977) for i in range(150_000))
    assert fingerprint_of(text) == brute_print(text)


def test_empty_table_and_columns(spark):
    assert near_copies(documents(spark, [])).collect() == []
    rows = [(7, "a b c d e"), (3, "A b  c d e"), (9, "other words in here now")]
    left = without_near_copies(documents(spark, rows))
    assert left.columns == documents(spark, rows).columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 9]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 499), (500, 500)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 499: 499, 500: 499}


def test_a_text_of_a_third_of_all_rows_is_as_many_keys_as_parts(spark):
    rows = [(i, "one and the same text of many rows" if i % 3 == 0 else f"text {i} of words {i * i} here {i * 7}") for i in range(3000)]
    docs = documents(spark, rows).repartition(12)
    got = {r.doc_id: r for r in near_copies(docs).collect()}
    classes = brute_classes({brute_print(t) for _, t in rows})
    least = {}
    for i, t in rows:
        c = classes[brute_print(t)]
        least[c] = min(least.get(c, i), i)
    assert {i: r.component_id for i, r in got.items()} == {i: least[classes[brute_print(t)]] for i, t in rows}
    prints = spark.range(0, 3000, 1, 12).selectExpr("id % 3 = 0 as hot", "id as doc_id", "spark_partition_id() as part")
    prints = prints.selectExpr("doc_id", "part", "if(hot, 0L, doc_id) as print")
    answer = prints.select("print").distinct().selectExpr("print", "print as component_id")
    rows = answered(prints, answer)
    assert sorted((r.doc_id, r.component_id) for r in rows.collect()) == [(i, i if i % 3 else 0) for i in range(3000)]
    assert prints.where("print = 0").select("part", "print").distinct().count() == 12
