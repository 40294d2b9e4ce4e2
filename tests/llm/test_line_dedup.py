import random

from pyspark.sql import functions as F

from docintake.llm import line_dedup
from docintake.llm.line_dedup import repeated_lines, without_repeated_lines

from tests.llm.fixtures import TEXTS, documents, given


def brute(rows):
    """Per row the text left and the number of lines removed; rows of one id and text are judged together."""
    order = sorted({(i is None, i or 0, t or "") for i, t in rows})
    seen, result = [], {}
    for none, i, t in order:
        left, gone = [], 0
        for line in t.split("\n"):
            words = frozenset(line.lower().split())
            if words and any(9 * len(words & s) >= 4 * (len(words) + len(s)) for s in seen):
                gone += 1
            else:
                left.append(line)
            if words:
                seen.append(words)
        result[None if none else i, t] = ("\n".join(left), gone)
    return [(i, *result[i, t or ""]) for i, t in rows]


def variants(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    lines = [[r.choice(vocabulary) for _ in range(r.randint(1, 40))] for _ in range(n)]
    rows = []
    for i in range(n):
        own = []
        for _ in range(r.randint(0, 8)):
            line = list(r.choice(lines))
            for _ in range(r.choice([0, 0, 1, 2, 5, 9])):
                line[r.randrange(len(line))] = r.choice(vocabulary)
            if r.random() < 0.3:
                r.shuffle(line)
            own.append(" ".join(line))
        rows.append((i, "\n".join(own)))
    return rows


def key(row):
    return tuple(str(x) for x in row)


def test_equals_brute_force(spark):
    plain = [(i, t) for i, t in TEXTS if i not in (15, 8, 9)]  # one text per id, as order among equal ids is by hash; and words as Python cuts them
    for rows in (plain + [(i + 1000, t) for i, t in given()[:120]], variants(1), variants(2, 150)):
        got = repeated_lines(documents(spark, rows).repartition(5)).collect()
        assert sorted(((r.doc_id, r.text, r.n_removed) for r in got), key=key) == sorted(brute(rows), key=key)


def test_crowd_of_variants(spark):
    r = random.Random(4)
    base = [f"word{k}" for k in range(50)]
    rows = []
    for i in range(300):
        line = list(base)
        for _ in range(r.randint(0, 7)):
            line[r.randrange(50)] = f"other{r.randrange(2000)}"
        rows.append((i, " ".join(line)))
    got = repeated_lines(documents(spark, rows)).collect()
    assert sorted(((x.doc_id, x.text, x.n_removed) for x in got), key=key) == sorted(brute(rows), key=key)


def test_sizes_around_the_longer_signature(spark):
    r = random.Random(7)
    rows = []
    for i in range(40):
        base = [f"w{r.randrange(900)}" for _ in range(r.randint(52, 90))]
        for k in range(6):
            line = [w for w in base if r.random() > 0.03 * k] + [f"new{r.randrange(5000)}" for _ in range(r.randint(0, 3 * k))]
            r.shuffle(line)
            rows.append((6 * i + k, " ".join(line)))
    r.shuffle(rows)
    got = repeated_lines(documents(spark, rows)).collect()
    want = brute(rows)
    assert sorted(((x.doc_id, x.text, x.n_removed) for x in got), key=key) == sorted(want, key=key)
    assert 40 < sum(n for _, _, n in want) < 200


def test_words_are_cut_once(spark, monkeypatch):
    cuts = []
    words_of = line_dedup.words_of
    monkeypatch.setattr(line_dedup, "words_of", lambda text: cuts.append(text) or words_of(text))
    lines = line_dedup.lines_of(documents(spark, variants(3)), "doc_id", "text")
    assert lines.count() > 0 and len(cuts) == 1


def test_tokens_are_sorted_as_primitive_numbers(spark):
    lines = line_dedup.hashed_lines(documents(spark, variants(5)), "doc_id", "text")
    found = lines.select("words", line_dedup.tokens(F.col("words"), line_dedup.rarity(lines)).alias("tokens"))
    assert not found.schema["tokens"].dataType.containsNull  # with nulls Spark sorts boxed numbers by a comparator
    rows = found.collect()
    low = lambda values: sorted(v & ((1 << 56) - 1) for v in values)
    assert rows and all(list(r.tokens) == sorted(r.tokens) and low(r.tokens) == low(r.words) for r in rows)


def test_closed_sets_meet_open_ones_only(spark):
    r = random.Random(9)
    rows, opens = [], {}
    for family in range(12):
        base = [family * 1000 + k for k in range(r.choice([9, 20, 45, 80]))]
        for _ in range(12):
            words = {w if r.random() > 0.06 else r.randrange(20000, 90000) for w in base[r.randint(0, 3) :]}
            # larger numbers first: any order will do
            rows.append((len(rows), sorted(words, reverse=True)))
            opens[len(opens)] = r.random() < 0.5
    given_sets = []
    for i, words in rows:
        n, bits, more = len(words), 0, 0
        for w in words:
            bits ^= 1 << (w & 63)
            more ^= ((w >> 6) & 1) << (w & 63) if n > line_dedup.LONG else 0
        signed = [b - (1 << 64) if b >> 63 else b for b in (bits, more)]
        given_sets.append((i, n, *signed, words[: n - (4 * n + 4) // 5 + 1], opens[i]))
    sets = spark.createDataFrame(given_sets, "id long, n int, bits long, more long, prefix array<int>, open boolean")
    found = [frozenset((x.x, x.y)) for x in line_dedup.prefix_pairs(sets).collect()]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i)]
    shared = {(i, j): len(set(rows[i][1]) & set(rows[j][1])) for i, j in pairs}
    similar = {frozenset(p) for p in pairs if 9 * shared[p] >= 4 * (len(rows[p[0]][1]) + len(rows[p[1]][1]))}
    want = {p for p in similar if any(opens[i] for i in p)}
    assert len(found) == len(set(found)) and all(any(opens[i] for i in p) for p in found)
    assert want <= set(found) and 100 < len(want) < len(similar)


def test_whole_rows_stay(spark):
    rows = [(1, "a b c d e\n\nsame line here"), (2, "Same LINE here\nnew"), (3, None), (4, ""), (5, "same line here"), (5, "same line here"), (None, "new")]
    docs = documents(spark, rows)
    left = without_repeated_lines(docs)
    assert left.columns == docs.columns
    got = sorted(((x.doc_id, x.text, x.n_chars) for x in left.collect()), key=key)
    want = [(1, "a b c d e\n\nsame line here", 25), (2, "new", 3), (3, None, None), (4, "", 0), (5, "", 0), (5, "", 0), (None, "", 0)]
    assert got == sorted(want, key=key)


def test_empty_table(spark):
    assert repeated_lines(documents(spark, [])).collect() == []
    assert without_repeated_lines(documents(spark, [])).collect() == []
