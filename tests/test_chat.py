import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docintake.operators import catalog, chat, quality, selection
from docintake.session import send_by_value
from docintake.sources import generations, model, split_csv, tables
from docintake.streaming import stats

send_by_value(__name__)

TURNS = "conv_id long, turn long, role string, text string"


def talk(spark, *texts, conv=1):
    return spark.createDataFrame(
        [(conv, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)], TURNS
    )


def test_routes(spark):
    rows = spark.createDataFrame([(1, "Bây giờ là mấy giờ?"), (2, "  \n"), (3, "ai giỏi nhất"), (4, None)], "i int, question string")
    got = {r["i"]: (r["status"], r["route"]) for r in chat.routed(rows, spark.range(1)).collect()}
    assert got == {1: ("ok", "clock"), 2: ("empty_question", "none"), 3: ("ok", "model"), 4: ("empty_question", "none")}
    got = {r["i"]: r["status"] for r in chat.routed(rows, spark.range(0)).collect()}
    assert got[1] == "empty_dataset"


def test_clock(column):
    got = column([dt.datetime(2024, 1, 2, 3, 4, 5)], chat.clock_answer(F.col("c")), "timestamp")
    assert got[0].startswith("Bây giờ là 2024-01-02")


def test_context_sees_nine_turns_before(spark):
    rows = chat.context_frame(talk(spark, *[f"m{i}" for i in range(12)])).orderBy("turn").collect()
    assert [m["content"] for m in rows[11]["context"]] == [f"m{i}" for i in range(2, 11)]
    assert rows[0]["context"] == []


def test_exchanges(spark):
    texts = [f"m{i}" for i in range(14)]
    texts[3] = ""
    rows = {r["turn"]: r["context"] for r in chat.exchange_frame(talk(spark, *texts)).collect()}
    assert sorted(rows) == [0, 2, 4, 6, 8, 10, 12]
    assert [m["content"] for m in rows[12]] == ["m2", "m4", "m5", "m6", "m7", "m8", "m9", "m10", "m11"]


def test_transcript(spark):
    rows = chat.transcript_sections(talk(spark, "hi", "yes")).orderBy("section").collect()
    assert rows[0]["body"] == "# Lịch sử Chat\n\nTổng số tin nhắn: 2\n\n---\n\n"
    assert rows[2]["body"] == "## Tin nhắn 2 - 🤖 AI\n**Thời gian:** \n\nyes\n\n---\n\n"


def log(spark, n):
    return spark.range(n).select(F.col("id").alias("pos"))


def test_retention(spark):
    assert chat.retained(log(spark, 1000)).count() == 1000
    kept = chat.retained(log(spark, 1001))
    assert kept.count() == 800 and kept.agg(F.min("pos")).first()[0] == 201
    session = lambda n: chat.retained(log(spark, n), high=500, low=400, before_append=True)
    assert session(501).count() == 501
    assert session(502).count() == 401


def entries(spark, rows):
    return spark.createDataFrame(rows, "pos long, timestamp string, question_length long, answer_length long, question_type string")


def test_statistics(spark):
    rows = entries(spark, [(1, "a", 0, 1, "search"), (2, "c", 0, 0, None), (3, "b", 1, 0, "search"), (4, "a", 0, 0, "x")])
    got = chat.chat_stats(rows).first()
    assert got["total_chats"] == 4 and got["question_types"] == {"search": 2, "general": 1, "x": 1}
    assert (got["average_question"], got["average_answer"], got["last_chat"]) == (0.3, 0.3, "a")
    got = chat.chat_stats(rows.limit(0)).first()
    assert (got["total_chats"], got["question_types"], got["average_question"], got["last_chat"]) == (0, {}, 0.0, None)


def test_log_files(spark, tmp_path):
    good, bad = tmp_path / "log.json", tmp_path / "bad.json"
    good.write_text('[{"timestamp": "2024-01-01T00:00:00Z", "question": "q", "answer": "a", "question_length": 1,'
                    ' "answer_length": 1}, {"timestamp": "2024-01-02T00:00:00Z", "question": "r", "answer": "b",'
                    ' "question_length": 3, "answer_length": 2, "question_type": "search"}]')
    bad.write_text("corrupted")
    rows = tables.import_chat_log(spark, str(good))
    assert chat.chat_stats(rows).first()["question_types"] == {"general": 1, "search": 1}
    empty = tables.import_chat_log(spark, str(bad))
    assert chat.chat_stats(empty).first()["total_chats"] == 0
    folder = str(tmp_path / "log")
    tables.append_retained(empty, folder)
    tables.append_retained(rows, folder)
    assert tables.read_log(spark, folder).count() == 2
    tables.append_retained(rows.withColumn("pos", F.col("pos") + 2), folder, high=3, low=2)
    assert sorted(r["pos"] for r in tables.read_log(spark, folder).collect()) == [2, 3]


def test_corrupt_logs_give_no_entries(spark, tmp_path):
    good = '[{"question": "q", "answer": "a"}]'
    for n, text in enumerate([good, good + " x", "[" + good, "", "null", "{}", "[]"]):
        (tmp_path / f"{n}.json").write_text(text)
        assert tables.import_chat_log(spark, str(tmp_path / f"{n}.json")).count() == (n == 0)
    nothing = tables.import_chat_log(spark, str(tmp_path / "missing.json"))
    assert chat.chat_stats(nothing).first()["total_chats"] == 0


def some_log(spark, first, last):
    rows = [(p, None, "q", "a", p, 1, "x" if p % 2 else None) for p in range(first, last)]
    return spark.createDataFrame(rows, tables.LOG)


def positions(spark, folder):
    return sorted(r["pos"] for r in tables.read_log(spark, folder).collect())


@pytest.mark.parametrize("dies", ["write", "point"])
def test_append_that_dies_leaves_the_old_log(spark, tmp_path, monkeypatch, dies):
    folder = str(tmp_path / "log")
    tables.append_retained(some_log(spark, 0, 4), folder, high=5, low=3)

    def killed(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as broken:
        # before anything is written, and between the rows and the pointer
        broken.setattr(generations, "place" if dies == "write" else "point", killed)
        if dies == "write":
            broken.setattr(generations, "read", lambda spark, folder, table, schema: spark.createDataFrame([], schema))
        with pytest.raises(KeyboardInterrupt):
            tables.append_retained(some_log(spark, 4, 8), folder, high=5, low=3)
    assert positions(spark, folder) == [0, 1, 2, 3]
    tables.append_retained(some_log(spark, 4, 8), folder, high=5, low=3)
    assert positions(spark, folder) == [5, 6, 7]
    for n in range(3):
        tables.append_retained(some_log(spark, 8 + n, 9 + n), folder, high=5, low=3)
    assert positions(spark, folder) == [8, 9, 10]
    assert len(generations.numbers(spark, folder)) == 2  # the last one and the one before


def test_capped_statistics_equal_those_of_the_log(spark, tmp_path):
    box, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    run = stats.capped_round(out, 9, 5)
    at = 0
    for number, size in enumerate([3, 0, 5, 4, 30, 1, 2]):
        new = some_log(spark, at, at + size)
        at += size
        if number == 3:
            run(new, number)  # a round that is repeated counts once
        run(new, number)
        want = stats.running_sums(tables.read_log(spark, out)).collect()
        assert sorted(map(tuple, generations.read(spark, out, "sums", stats.SUMS).collect())) == sorted(map(tuple, want))
    some_log(spark, 0, 12).coalesce(1).write.parquet(box)
    stream = spark.readStream.schema(tables.LOG).parquet(box)
    other = str(tmp_path / "other")
    assert stats.capped_stats_stream(stream, other, offsets, 9, 5, once=True).awaitTermination(120)
    assert positions(spark, other) == [7, 8, 9, 10, 11]
    assert sum(r["chats"] for r in stats.read_means(spark, other).collect()) == 5


def test_last_lines(spark):
    rows = spark.createDataFrame([(i, f"t{i}", None if i == 3 else "WARN", f"m{i}") for i in range(5)], "i int, timestamp string, level string, message string")
    got = chat.last_lines(rows, 2, [F.col("i").desc()]).collect()
    assert sorted(r["line"] for r in got) == ["[t3] INFO: m3", "[t4] WARN: m4"]


def test_running_statistics_equal_batch(spark, tmp_path):
    schema = "question_type string, question_length long, answer_length long"
    first = spark.createDataFrame([("a", 1, 2), (None, 3, 4)], schema)
    second = spark.createDataFrame([("a", 2, 2), ("b", 7, 0)], schema)
    box, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(box)
        query = stats.stats_stream(spark.readStream.schema(schema).parquet(box), out, offsets, once=True)
        assert query.awaitTermination(120)
    want = stats.means(stats.running_sums(first.union(second))).collect()
    assert sorted(stats.read_means(spark, out).collect()) == sorted(want)


# --- records as files, picks -------------------------------------------------


def test_record_csv(spark, tmp_path):
    folder = str(tmp_path / "csv")
    values = ['a\nb\r\nc', 'say "x", y', "NA", "", "back\\slash", " pad ", "é"]
    rows = spark.createDataFrame([tuple([v] * 11) for v in values], tables.RECORDS)
    assert tables.save_records(rows, folder) == len(values)
    got = [r[0] for r in tables.read_csv(spark, folder).collect()]
    assert sorted(got) == sorted(values)
    empty = str(tmp_path / "none")
    assert tables.save_records(rows.limit(0), empty) == 0
    assert not (tmp_path / "none").exists()


def odd_cells():
    r = random.Random(6)
    bits = ["a", "b c", '"', "\n", "\r\n", ",", "é", "\n\n", '""', " ", "x" * 40]
    return [tuple("".join(r.choice(bits) for _ in range(r.randint(0, 9))) for _ in range(3)) for _ in range(400)]


@pytest.mark.parametrize("size", ["300", "64m"])
def test_large_csv_is_read_in_splits(spark, tmp_path, size):
    folder = str(tmp_path / "csv")
    cells = odd_cells() + [("long", "\n".join('say "x"' for _ in range(200)), "end"), ("", "", "")]
    schema = "`Họ tên` string, b string, c string"
    rows = spark.createDataFrame(cells, schema)
    rows.coalesce(1).write.options(**tables.CSV, quoteAll="true").csv(folder)
    rows.limit(0).coalesce(1).write.mode("append").options(**tables.CSV, quoteAll="true").csv(folder)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    open_cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = split_csv.split_lines(spark, folder)
        splits = lines.select("file", "block").distinct().count()
        assert splits > 20 if size == "300" else splits <= 10
        got = sorted(map(tuple, split_csv.read_split_csv(spark, folder, rows.schema).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", open_cost)
    assert got == sorted(cells)
    assert got == sorted(map(tuple, tables.read_csv(spark, folder, rows.schema).collect()))


def test_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('﻿a,b\n"1\n2",NA\n', encoding="utf-8")
    row = tables.read_csv(spark, str(path), spark.createDataFrame([], "a string, b string").schema).first()
    assert (row["a"], row["b"]) == ("1\n2", "NA")


def test_top_sources(spark):
    rows = spark.createDataFrame([(i, f"s{i}") for i in range(9)] + [(0, "s8")], "n int, source string")
    order = [F.col("n").desc(), F.col("source")]
    pick = lambda text: [
        (r["source"], r["n"])
        for r in selection.top_sources(spark.createDataFrame([(text,)], "response string"), rows, "source", order)
        .orderBy("place")
        .collect()
    ]
    assert pick('["s3", "a", "s8"]') == [("s3", 3), ("a", None), ("s8", 8)]
    for bad in ("[]", "no json", '{"a": 1}', None):
        assert pick(bad) == [(f"s{n}", n) for n in (8, 7, 6, 5, 4)]


def test_top_sources_of_many_answers(spark):
    rows = spark.createDataFrame([(i, f"s{i}") for i in range(9)], "n int, name string")
    told = spark.createDataFrame([(1, '["s1", null, "s2"]'), (2, ""), (3, '```json\n["zz"]\n```'), (4, None)], "k int, response string")
    got = selection.top_sources(told, rows, "name", [F.col("n").asc()], n=2, keys=["k"]).select("k", "place", "source", "n")
    want = [(1, 1, "s1", 1), (1, 2, "s2", 2), (2, 1, "s0", 0), (2, 2, "s1", 1), (3, 1, "zz", None), (4, 1, "s0", 0), (4, 2, "s1", 1)]
    assert sorted(map(tuple, got.collect())) == want
    assert selection.top_sources(told, rows.limit(0), "name", [F.col("n").asc()], keys=["k"]).count() == 3
