from collections import defaultdict

import duckdb
import pytest

from docintake.llm.preference import PLACE, SALTS, beside, formatted, preferences, turns_of
from docintake.llm.queries import ORACLE

import pyspark.sql.functions as F

KIND = "conv_id long, turn long, role string, text string, pair string, side string"


def talks(spark, rows):
    return spark.createDataFrame([(*r, "p", "s") for r in rows], KIND)


SHARED = [
    (1, 0, "user", "Hi"), (1, 1, "assistant", "Hello <|user|>"), (1, 2, "user", "More"), (1, 3, "assistant", "A"),
    (2, 0, "user", "Hi"), (2, 1, "assistant", "Hello <|user|>"), (2, 2, "user", "More"), (2, 3, "assistant", "B"), (2, 4, "user", "ok"),
    (3, 0, "user", "Alone"), (3, 1, "assistant", "Z"),
]


def test_longest_common_prefix(spark):
    got = defaultdict(list)
    for r in sorted(preferences(talks(spark, SHARED)).collect(), key=lambda r: (r.pair_id, r.section, r.turn)):
        got[r.pair_id, r.section].append((r.turn, r.text, r.loss_from, r.loss_to))
    assert [t for t, *_ in got[1, "prompt"]] == [0, 1, 2]
    assert got[1, "prompt"][1] == (1, "<|assistant|>\nHello < |user|><|end|>\n", 0, 0)
    assert got[1, "chosen"] == [(3, "<|assistant|>\nA<|end|>\n", 14, 23)]
    assert got[1, "rejected"] == [(3, "<|assistant|>\nB<|end|>\n", 14, 23), (4, "<|user|>\nok<|end|>\n", 0, 0)]
    # the next conversation opens otherwise: its last answer is grafted on
    assert [len(got[2, s]) for s in ("chosen", "rejected")] == [2, 2] and [len(got[3, s]) for s in ("chosen", "rejected")] == [1, 1]


@pytest.mark.parametrize("seed", range(3))
def test_equals_sql(spark, seed):
    import random

    r = random.Random(seed)
    rows = []
    for conv in range(40):
        for turn in range(r.randint(1, 7)):
            rows.append((conv, turn + r.randint(0, 1) * (turn > 3), r.choice(["user", "assistant", "system"]), r.choice(["a", "b", "", "<|x"]) if r.random() < 0.9 else None))
    rows += rows[:15]
    table = talks(spark, rows)
    conversations = table.toPandas()  # noqa: F841  read by name below
    want = duckdb.sql(ORACLE["op3_chat_preferences"]).fetchall()
    got = [tuple(x) for x in preferences(table).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_given_tables_equal_sql(spark):
    folder = "/root/testdata/sf0.001"
    conversations = spark.read.parquet(f"{folder}/conversations.parquet")
    got = [tuple(x) for x in preferences(conversations).collect()]
    want = duckdb.sql(f"with conversations as (from '{folder}/conversations.parquet'), {ORACLE['op3_chat_preferences'].strip()[5:]}").fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)


def test_given_sides(spark):
    rows = talks(spark, SHARED[:9])
    sides = turns_of(rows).select(F.lit(7).alias("pair"), F.when(F.col("conv.conv_id") == 1, "chosen").otherwise("rejected").alias("side"), "turn", "role", "digest", "text")
    got = formatted(sides).groupBy("section").count().collect()
    assert {r.section: r["count"] for r in got} == {"prompt": 3, "chosen": 1, "rejected": 2}


def test_hard_rows(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", "x"), (5, 0, "user", "only user"), (5, 0, "user", "only user"), (6, 0, "assistant", "y" * 100_000)]
    got = preferences(talks(spark, rows)).collect()
    assert {r.pair_id for r in got} == {None, 5, 6}
    assert {r.section for r in got if r.pair_id == 5} == {"prompt"}
    assert preferences(talks(spark, [])).collect() == []
    one = preferences(talks(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "a")])).collect()
    assert {r.section for r in one} == {"prompt"}


def test_one_conversation_of_most_rows(spark):
    # two conversations of 3,000 turns that part at turn 2,500, beside short ones
    long = [(c, n, ("user", "assistant")[n % 2], f"turn {n}{' of two' if c == 2 and n == 2501 else ''}") for c in (1, 2) for n in range(3000)]
    short = [(c, n, ("user", "assistant")[n % 2], f"said {c} {n}") for c in range(3, 40) for n in range(4)]
    got = defaultdict(list)
    for r in preferences(talks(spark, long + short)).collect():
        got[r.pair_id, r.section].append(r.turn)
    assert sorted(got[1, "prompt"]) == list(range(2501))
    assert sorted(got[1, "chosen"]) == sorted(got[1, "rejected"]) == list(range(2501, 3000))
    for c in range(3, 40):
        assert sorted(got[c, "prompt"]) == [0, 1, 2] and got[c, "chosen"] == [3]


def test_a_conversation_is_spread_over_the_salts(spark):
    turns = turns_of(talks(spark, [(1, n, "user", f"turn {n}") for n in range(2000)]))
    known = spark.range(1).selectExpr("1L as of", "'x' as found")
    rows = beside(turns, known, F.col("conv.conv_id") == F.col("of"))
    assert rows.count() == 2000 and "__salt" not in rows.columns
    salts = turns.select(F.pmod(F.xxhash64(*PLACE), F.lit(SALTS)).alias("s")).distinct().count()
    assert salts == SALTS
