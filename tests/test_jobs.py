import datetime as dt

import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docintake.operators import intake
from docintake.plans import jobs
from docintake.sources import messages, state
from docintake.sources.progress import Progress, read_progress
from docintake.streaming import intake as rounds
from docintake.streaming.intake import LANDED, PROCESSED, read_rounds
from tests.test_intake import docx

MESSAGE = """From: a@b.c\r
Date: {date}\r
Subject: {subject}\r
MIME-Version: 1.0\r
Content-Type: multipart/mixed; boundary="x"\r
\r
--x\r
Content-Type: text/plain\r
\r
body\r
--x\r
Content-Type: application/pdf\r
Content-Disposition: attachment; filename="{name}"\r
Content-Transfer-Encoding: base64\r
\r
JVBERg==\r
--x--\r
"""


def put(box, uid, subject, name, day=20):
    text = MESSAGE.format(date=f"Wed, {day} Sep 2023 10:15:00 -0400", subject=subject, name=name)
    (box / f"{uid}.eml").write_bytes(text.encode())


def test_fetch_in_rounds(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    args = (spark, str(box), str(tmp_path / "landing"), str(tmp_path / "mark"))
    names = lambda rows: sorted((r["safe_name"], r["uid"]) for r in rows.collect())
    put(box, 1, "my CV", "cv.pdf")
    put(box, 2, "Lunch", "menu.pdf")
    first = jobs.fetch_box(*args)
    assert names(first) == [("cv.pdf", 1)]
    assert first.first()["sent_iso"] == "2023-09-20T10:15:00-04:00"
    put(box, 3, "resume", "cv.pdf")
    put(box, 4, "resume", "b?.pdf")
    put(box, 5, "resume", "late.pdf", day=25)
    assert names(jobs.fetch_box(*args, before=dt.date(2023, 9, 20))) == [("b_.pdf", 4)]
    assert names(jobs.fetch_box(*args)) == [("late.pdf", 5)]
    assert names(jobs.fetch_box(*args, ignore_mark=True)) == []
    assert read_rounds(spark, args[2], LANDED).count() == 3


def test_mark_stays_when_it_is_ignored(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    args = (spark, str(box), str(tmp_path / "landing"), str(tmp_path / "mark"))
    state.write_mark(spark.createDataFrame([(5,)], "mark long"), args[3])
    put(box, 2, "CV", "old.pdf")
    assert jobs.fetch_box(*args).count() == 0
    assert jobs.fetch_box(*args, ignore_mark=True).count() == 1
    assert state.read_mark(spark, args[3]) == 5


def test_old_files_are_not_opened(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    args = (spark, str(box), str(tmp_path / "landing"), str(tmp_path / "mark"))
    put(box, 1, "CV", "one.pdf")
    assert jobs.fetch_box(*args).count() == 1
    # opening a file above this length is an error
    (box / "1.eml").write_bytes(b"x" * 5000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "2000")
    try:
        put(box, 2, "CV", "two.pdf")
        assert jobs.fetch_box(*args).first()["safe_name"] == "two.pdf"
        with pytest.raises((PySparkException, Py4JError)):
            jobs.fetch_box(*args, ignore_mark=True)
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    plan = intake.after_mark(messages.scan(spark, str(box)), 2)
    assert "file_path" in plan._jdf.queryExecution().executedPlan().toString()
    assert [r["uid"] for r in messages.scan(spark, str(box)).select("uid").orderBy("uid").collect()] == [1, 2]


def test_stream_of_message_files(spark, tmp_path):
    box, landing, failed, offsets = (str(tmp_path / n) for n in ("box", "landing", "failed", "offsets"))
    (tmp_path / "box" / "uid=4").mkdir(parents=True)
    put(tmp_path / "box", 1, "CV", "old.pdf")
    put(tmp_path / "box", 2, "CV", "two.pdf")
    (tmp_path / "box" / "3.eml").write_bytes(b"\n")
    put(tmp_path / "box" / "uid=4", 99, "CV", "four.pdf")
    run = lambda: rounds.box_stream(messages.watch(spark, box), landing, failed, offsets, mark=1, once=True).awaitTermination(120)
    assert run()
    names = lambda: sorted((r["safe_name"], r["uid"], r["round"]) for r in read_rounds(spark, landing, LANDED).collect())
    assert names() == [("four.pdf", 4, 0), ("two.pdf", 2, 0)]
    assert [(r["uid"], r["error"]) for r in read_rounds(spark, failed, rounds.FAILED).collect()] == [(3, messages.NO_MESSAGE)]
    put(tmp_path / "box", 5, "CV", "two.pdf")
    put(tmp_path / "box", 6, "CV", "six.pdf")
    assert run()
    assert names() == [("four.pdf", 4, 0), ("six.pdf", 6, 1), ("two.pdf", 2, 0)]


def test_latest_names_within_the_watermark(spark, tmp_path):
    landing, offsets, box = (str(tmp_path / n) for n in ("landing", "offsets", "box"))
    schema = "safe_name string, uid long, part_no long, obvious boolean, sent_iso string, sent timestamp"
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    files = [
        [("a", 1, 1, True, "x", at(0)), ("b", 2, 1, True, "x", at(5))],
        [("a", 9, 1, True, "x", at(8)), ("a", 3, 1, True, "late", at(2)), ("c", 4, 1, False, "x", at(9)), ("c", 4, 2, False, "x", at(9))],
        [("a", 20, 1, True, "x", at(60)), ("d", 21, 1, True, "x", at(61))],
        [("b", 30, 1, True, "too late", at(6)), ("", 31, 1, True, "x", at(1000))],
    ]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(box)
        names = rounds.latest_names(spark.readStream.schema(schema).parquet(box), "sent", "10 seconds")
        assert rounds.latest_names_stream(names, landing, offsets, once=True).awaitTermination(120)
    got = sorted((r["safe_name"], r["uid"], r["part_no"]) for r in read_rounds(spark, landing, rounds.NAMED).collect())
    assert got == [("a", 9, 1), ("b", 2, 1), ("c", 4, 1), ("d", 21, 1)]


def test_progress_of_a_run(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    put(box, 1, "CV", "one.pdf")
    put(box, 2, "lunch", "menu.pdf")
    (box / "3.eml").write_bytes(b"\n")
    for run in ("first", "second"):
        steps = Progress(spark, str(tmp_path / "progress"), run)
        jobs.fetch_box(spark, str(box), str(tmp_path / "landing"), str(tmp_path / "mark"), progress=steps)
    got = sorted((r["run"], r["no"], r["step"], r["rows"], r["failed"]) for r in read_progress(spark, str(tmp_path / "progress")).collect())
    first = [("first", 1, "parsed", 3, 1), ("first", 2, "kept", 1, 0), ("first", 3, "landed", 1, 0)]
    assert got == first + [("second", n, s, 0, 0) for n, s in ((1, "parsed"), (2, "kept"), (3, "landed"))]


def test_fetch_to_records(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    landing, sent, handled = (str(tmp_path / n) for n in ("landing", "sent", "handled"))
    args = (spark, str(box), landing, str(tmp_path / "mark"))
    put(box, 1, "CV", "one.pdf")
    put(box, 2, "nothing", "two.pdf")
    assert jobs.fetch_box(*args, processed=handled, sent=sent).count() == 1
    put(box, 3, "CV", "three.pdf", day=21)
    assert jobs.fetch_box(*args, processed=handled, sent=sent, ignore_mark=True).count() == 1
    assert sorted((r["uid"], r["kept"]) for r in read_rounds(spark, handled, PROCESSED).collect()) == [(1, True), (2, False), (3, True)]
    got = jobs.process_landed(spark, landing, sent, readers={".pdf": lambda payload: "Tên: " + payload.decode()}).collect()
    assert [(r["Nguồn"], r["Họ tên"], r["Thời gian nhận"]) for r in got] == [
        ("three.pdf", "%PDF", "2:15 pm 21/9/2023"),
        ("one.pdf", "%PDF", "2:15 pm 20/9/2023"),
    ]


def test_process_folder(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.docx").write_bytes(docx(["Họ tên: An", "Email: an@test.com"]))
    (folder / "b.docx").write_bytes(docx(["Họ tên: Bo"]))
    (folder / "c.pdf").write_bytes(b"%PDF")
    (folder / "d.txt").write_bytes(b"x")
    sent = tmp_path / "sent.json"
    sent.write_text('{"a.docx": "2023-09-20T12:00:00Z", "b.docx": "2023-10-01T00:00:00Z"}')
    rows = jobs.process_folder(spark, str(folder), str(sent)).collect()
    assert [(r["Nguồn"], r["Họ tên"], r["Thời gian nhận"]) for r in rows] == [
        ("b.docx", "Bo", "12:00 am 1/10/2023"),
        ("a.docx", "An", "12:00 pm 20/9/2023"),
        ("c.pdf", "", ""),
    ]
    end = F.lit(dt.datetime(2023, 9, 21, tzinfo=dt.timezone.utc))
    assert [r["Nguồn"] for r in jobs.process_folder(spark, str(folder), str(sent), end=end).collect()] == ["a.docx"]
    schema = "safe_name string, sent_iso string"
    new = spark.createDataFrame([("b.docx", "2023-09-20T10:15:00Z")], schema)
    rows = jobs.process_folder(spark, str(folder), str(sent), fetched=new, only=new).collect()
    assert [(r["Nguồn"], r["Thời gian nhận"]) for r in rows] == [("b.docx", "10:15 am 20/9/2023")]
    nothing = spark.createDataFrame([], schema)
    assert jobs.process_folder(spark, str(folder), only=nothing).count() == 3
    assert jobs.process_file(spark, str(folder / "a.docx")).first()["email"] == "an@test.com"
    assert jobs.process_file(spark, str(folder / "c.pdf")).count() == 0


def test_questions_and_answers(spark):
    table = spark.createDataFrame([("An", "an.pdf"), ("Bo", "bo.pdf")], "`Họ tên` string, `Nguồn` string")
    questions = spark.createDataFrame([(1, " hôm nay? "), (2, "ai?"), (3, " ")], "id int, question string")
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    got = {r["id"]: (r["route"], r["answer"]) for r in jobs.routed_questions(questions, table, at).collect()}
    assert got == {1: ("clock", "Bây giờ là 2024-01-02 03:04:05"), 2: ("model", None), 3: ("none", None)}
    told = spark.createDataFrame([(2, "#An\n\n\n\n- Bo: see an.pdf")], "id int, answer string")
    files = spark.createDataFrame([("an.pdf", "[an]")], "file string, link string")
    done = jobs.finished_answers(told, table, files).first()["answer"]
    assert done == "# An ([an])\n• Bo (bo.pdf): see [an]"
