import hashlib
import random

import pyspark.sql.functions as F
import xxhash

from docintake.llm.multiset_hash import edits, insert, likeness, printed, remove, vector

from tests.llm.fixtures import TEXTS, documents, given


def hash64(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def blocks(line):
    import re

    return re.findall(r"[^ \t\n\x0b\f\r]+(?:[ \t\x0b\f\r]+[^ \t\n\x0b\f\r]+){0,3}", line)


def brute_vector(text):
    lanes = [0] * 68
    for line in text.split("\n"):
        a = hash64(line.encode())
        lanes[0] += a & 0xFFFFFFFF
        lanes[1] += a >> 32
        for b in blocks(line):
            h = hash64(b.encode())
            for j in range(64):
                lanes[4 + j] += 1 if h >> j & 1 else -1
    return [x % (1 << 32) if i < 4 else x % (1 << 16) for i, x in enumerate(lanes)]


def brute_likeness(a, b):
    signed = lambda x: (x + 32768) % 65536 - 32768
    x, y = ([signed(v) for v in w[4:]] for w in (a, b))
    apart = sum(signed(p - q) ** 2 for p, q in zip(x, y))
    size = sum(p * p for p in x) + sum(q * q for q in y)
    if a == b:
        return 1.0
    return max(0.0, 1 - apart / size) if size else 0.0


def test_vectors(spark):
    rows = TEXTS + given()[:60]
    df = spark.createDataFrame([(i, t or "") for i, (_, t) in enumerate(rows)], "i int, text string")
    for r in df.select("i", "text", vector(F.col("text")).alias("v")).collect():
        want = brute_vector(r.text)
        assert r.v[:2] == want[:2] and r.v[4:] == want[4:], r.text


def test_paragraph_order_and_changes(spark):
    df = spark.createDataFrame([("a b c\nd e\nf", "f\na b c\nd e", "a b c\nf", "d e")], "t string, u string, v string, p string")
    vec = lambda c: vector(F.col(c))
    row = df.select(
        (vec("t") == vec("u")).alias("same"),
        (insert(vec("v"), vec("p")) == vec("t")).alias("put"),
        (remove(vec("t"), vec("p")) == vec("v")).alias("taken"),
        (vec("t") == vec("v")).alias("other"),
    ).first()
    assert (row.same, row.put, row.taken, row.other) == (True, True, True, False)


def test_equals_brute_force(spark):
    rows = [(i, t) for i, t in TEXTS if i is not None and i != 15] + [(i + 1000, t) for i, t in given()]
    got = {r.doc_id: r for r in edits(documents(spark, rows).repartition(4)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    near = []
    for n, (i, t) in enumerate(order):
        t, u = t or "", order[(n + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + u[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = brute_vector(t), brute_vector(edited), brute_vector(u)
        hexed = lambda v: "".join(f"{x:04x}" for x in v[4:])
        assert r.fingerprint[32:] == hexed(a) and r.edited_fingerprint[32:] == hexed(b)
        assert r.edited_fingerprint[:16] == f"{b[0]:08x}{b[1]:08x}"
        assert abs(r.near_edited - brute_likeness(a, b)) < 1e-9 and abs(r.near_next - brute_likeness(a, c)) < 1e-9
        if len(t) > 300 and t.split() and len(set(t.split())) > 9:
            near.append((r.near_edited, r.near_next))
    assert sum(a > b for a, b in near) > 0.97 * len(near)
    assert sum(a for a, _ in near) / len(near) > 0.5 > 0.2 > sum(b for _, b in near) / len(near)


def test_repeated_rows_nulls_and_single_rows(spark):
    rows = [(5, "aaabbbccc"), (5, "aaabbbccc"), (4, "xyzxyz"), (None, None), (None, "nul")]
    got = edits(documents(spark, rows)).collect()
    assert len(got) == 5
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(r.edited_sha256 for r in got if r.doc_id == 5) == sorted([sha("aaabbbaaa"), sha("aaabbbxyz")])
    alone = edits(documents(spark, [(1, "abcdef")])).collect()
    assert [(r.edited_sha256, r.near_next) for r in alone] == [(sha("abcdab"), 1.0)]
    assert edits(documents(spark, [])).collect() == []


def test_equal_texts_have_equal_fingerprints(spark):
    r = random.Random(1)
    text = "\n".join(" ".join(r.choice("abcdef") * 3 for _ in range(20)) for _ in range(30))
    got = edits(documents(spark, [(1, text), (2, "other"), (3, text)])).collect()
    prints = {x.doc_id: x.fingerprint for x in got}
    assert prints[1] == prints[3] != prints[2]


def test_likeness_of_nothing(spark):
    row = spark.createDataFrame([("", " ")], "a string, b string").select(
        likeness(vector(F.col("a")), vector(F.col("a"))).alias("same"), likeness(vector(F.col("a")), vector(F.col("b"))).alias("other"), printed(vector(F.col("a"))).alias("p")
    ).first()
    assert (row.same, row.other, len(row.p)) == (1.0, 0.0, 288)
