import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docintake import session
from docintake.operators import intake, ordering, records
from docintake.sources import attachments, messages, state
from docintake.streaming import intake as stream

MAIL = "uid long, subject string, body string, sent_iso string, parts array<struct<part_no:long,filename:string,content:binary>>"


def mail(spark, *rows):
    return spark.createDataFrame(
        [(u, s, b, f"2024-01-{u:02d}T00:00:00Z", [(i, n, n.encode()) for i, n in enumerate(names, 1)]) for u, s, b, names in rows],
        MAIL,
    )


def kept(rows):
    return intake.kept_parts(intake.judged_parts(rows))


def test_keep_rule(spark):
    rows = mail(
        spark,
        (1, "Profile", "body", ["profile.pdf"]),
        (2, "CV Nguyen", "", ["cv.pdf"]),
        (3, "hi", "my ReSuMe", ["a.pdf", "b.txt"]),
        (4, "hi", "body", ["x.pdf", "My CV.docx", "vitae.doc"]),
        (5, "curriculum vitae", "", []),
    )
    got = sorted((r["uid"], r["safe_name"]) for r in kept(rows).collect())
    assert got == [(2, "cv.pdf"), (3, "a.pdf"), (4, "My CV.docx")]
    seen = {r["uid"]: r["kept"] for r in intake.processed_rows(intake.judged_parts(rows)).collect()}
    assert seen == {1: False, 2: True, 3: True, 4: True, 5: True}


def test_obvious_names_come_first(spark):
    rows = mail(spark, (1, "cv", "", ["a.pdf", "resume.pdf", "b.pdf", "cv.pdf"]))
    got = [(r["filename"], r["priority"]) for r in kept(rows).orderBy("priority").collect()]
    assert got == [("resume.pdf", 1), ("cv.pdf", 2), ("a.pdf", 3), ("b.pdf", 4)]


def test_first_wins(spark):
    rows = mail(spark, (5, "cv", "", ["x(1).pdf"]), (9, "cv", "", ["x?1?.pdf", "x 1.pdf"]), (7, "cv", "", ["old.pdf"]))
    landed = spark.createDataFrame([("old.pdf",)], "safe_name string")
    new = intake.to_land(kept(rows), landed)
    assert sorted((r["safe_name"], r["uid"], r["part_no"]) for r in new.collect()) == [("x 1.pdf", 9, 2), ("x_1_.pdf", 9, 1)]
    content = intake.with_content(new, rows).collect()
    assert {r["safe_name"]: bytes(r["content"]) for r in content}["x_1_.pdf"] == b"x?1?.pdf"


def test_payloads_that_cannot_be_read_are_skipped(spark):
    rows = spark.createDataFrame([(1, "cv", "", "", [(1, "a.pdf", None), (2, "b.pdf", b"x")])], MAIL)
    new = intake.to_land(kept(rows), spark.createDataFrame([], "safe_name string"))
    assert [r["safe_name"] for r in intake.with_content(new, rows).collect()] == ["b.pdf"]


def test_an_unreadable_copy_does_not_win(spark):
    rows = spark.createDataFrame([(9, "cv", "", "", [(1, "a.pdf", None)]), (5, "cv", "", "", [(1, "a.pdf", b"x")])], MAIL)
    new = intake.to_land(kept(rows), spark.createDataFrame([], "safe_name string"))
    assert [(r["safe_name"], r["uid"]) for r in intake.with_content(new, rows).collect()] == [("a.pdf", 5)]
    assert intake.run_counters(intake.judged_parts(rows), new).first()["files_landed"] == 1


def test_names_in_folders_stay_apart(spark):
    rows = mail(spark, (1, "cv", "", ["a/x.pdf", "b/x.pdf", "cv/y.pdf"]), (2, "hi", "", ["cv/z.pdf", "z.pdf"]))
    new = intake.to_land(kept(rows), spark.createDataFrame([], "safe_name string"))
    assert sorted(r["safe_name"] for r in new.collect()) == ["a_x.pdf", "b_x.pdf", "cv_y.pdf", "cv_z.pdf"]


def test_message_filters(spark):
    rows = spark.createDataFrame(
        [(i, i % 2 == 0, dt.date(2024, 1, i)) for i in range(1, 11)], "uid long, seen boolean, day date"
    )
    uids = lambda d: sorted(r["uid"] for r in d.collect())
    assert uids(intake.unseen(rows)) == [1, 3, 5, 7, 9]
    assert uids(intake.unseen(rows, rows.where("uid > 3"))) == [1, 2, 3]
    assert uids(intake.in_window(rows, F.col("day"), dt.date(2024, 1, 3), dt.date(2024, 1, 5))) == [3, 4, 5]
    assert uids(intake.in_window(rows, F.col("day"))) == list(range(1, 11))
    assert uids(intake.after_mark(rows, 8)) == [9, 10]
    assert uids(intake.after_mark(rows, 0)) == list(range(1, 11))
    assert uids(intake.after_mark(rows, 8, ignore=True)) == list(range(1, 11))
    assert uids(intake.recent(rows, 3)) == [8, 9, 10]
    batches = {r["uid"]: r["batch"] for r in intake.numbered_batches(rows, 4).collect()}
    assert batches == {u: (10 - u) // 4 for u in range(1, 11)}


def test_mark_never_goes_back(spark):
    ids = lambda *u: spark.createDataFrame([(x,) for x in u], "uid long")
    mark = lambda *m: spark.createDataFrame([(x,) for x in m], "mark string")
    value = lambda s, f: intake.advance_mark(s, f).first()["mark"]
    assert value(mark("7"), ids(3, 9)) == 9
    assert value(mark("20"), ids(3, 9)) == 20
    assert value(mark("bad"), ids(3)) == 3
    assert value(mark(), ids()) == 0


def test_mark_file(spark, tmp_path):
    path = str(tmp_path / "mark")
    assert state.read_mark(spark, path) == 0
    state.write_mark(spark.createDataFrame([(12,)], "mark long"), path)
    assert state.read_mark(spark, path) == 12
    state.reset_mark(spark, path)
    assert state.read_mark(spark, path) == 0


def test_sent_time_file(spark, tmp_path):
    good, bad, other = tmp_path / "a.json", tmp_path / "b.json", tmp_path / "c.json"
    good.write_text('{\n "a.pdf": "2024-01-01T00:00:00Z", "b.pdf": null}')
    bad.write_text("{broken")
    other.write_text("[1]")
    rows = state.import_sent_times(spark, str(good)).collect()
    assert {r["safe_name"]: r["sent_iso"] for r in rows} == {"a.pdf": "2024-01-01T00:00:00Z", "b.pdf": ""}
    assert state.import_sent_times(spark, str(bad)).count() == 0
    assert state.import_sent_times(spark, str(other)).count() == 0


def test_upsert(spark):
    schema = "safe_name string, sent_iso string, seq long"
    old = spark.createDataFrame([("a", "1", 9), ("b", "1", 9)], schema)
    new = spark.createDataFrame([("a", "2", 1), ("a", None, 2), ("c", "3", 1)], schema)
    got = {r["safe_name"]: r["sent_iso"] for r in intake.upsert(old, new, "safe_name", "sent_iso", "seq").collect()}
    assert got == {"a": "", "b": "1", "c": "3"}


def test_fallback(spark):
    some, none = spark.range(3), spark.range(0)
    assert intake.left_or_right(some, spark.range(9)).count() == 3
    assert intake.left_or_right(none, spark.range(9)).count() == 9


def test_sent_times_and_range(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "safe_name string")
    schema = "safe_name string, sent_iso string"
    stored = spark.createDataFrame([("a", "2023-09-20T12:00:00Z"), ("b", "2023-10-01T00:00:00Z"), ("d", "bad")], schema)
    fetched = spark.createDataFrame([("b", "2023-09-21T06:59:59+07:00")], schema)
    rows = records.with_sent_time(files, "safe_name", stored, fetched)
    got = {r["safe_name"]: r["sent_iso"] for r in rows.collect()}
    assert got == {"a": "2023-09-20T12:00:00Z", "b": "2023-09-21T06:59:59+07:00", "c": "", "d": "bad"}
    at = lambda *x: F.lit(dt.datetime(*x, tzinfo=dt.timezone.utc))
    names = lambda d: sorted(r["safe_name"] for r in d.collect())
    assert names(records.in_time_range(rows)) == ["a", "b", "c", "d"]
    assert names(records.in_time_range(rows, start=at(2023, 9, 20, 12))) == ["a", "b"]
    assert names(records.in_time_range(rows, start=at(2023, 9, 19), end=at(2023, 9, 20, 12))) == []
    assert names(records.in_time_range(rows, start=at(2023, 9, 19), end=at(2023, 9, 20, 13))) == ["a"]


def test_newest_first_by_instant(spark):
    rows = spark.createDataFrame(
        [("b.pdf", "2025-01-02T01:00:00+00:00"), ("a.pdf", "2025-01-01T23:00:00-05:00"), ("c.pdf", ""), ("b0.pdf", None)],
        "name string, sent_iso string",
    )
    ranked = records.ranked_records(rows.withColumn("info", records.text.blank_info()), "name")
    assert ranked.columns[:11] == records.RECORD_COLUMNS
    assert [r["Nguồn"] for r in ranked.orderBy("rank").collect()] == ["a.pdf", "b.pdf", "b0.pdf", "c.pdf"]


# --- order-dependent operators under skew ------------------------------------


@pytest.mark.parametrize("bits", [1, 2, 5, 16])
def test_positions_and_frames_over_segments(spark, bits):
    """Gaps, hashed values, a huge key and a null key: the same as a plain window."""
    rng = random.Random(bits)
    rows = [(k, t) for k, n in (("hot", 90), ("b", 3), (None, 7)) for t in rng.sample(range(-50, 400), n)]
    rows += [("wide", rng.randrange(2**62)) for _ in range(20)]
    table = spark.createDataFrame(rows, "k string, t long")
    placed = ordering.running_total(table, [F.col("t")], ["k"], out="pos", total="n")
    framed = ordering.previous_rows(placed, ["k"], "pos", 1, F.col("t"), "before", bits=bits)
    by_key = {}
    for k, t in sorted(rows, key=lambda r: r[1]):
        by_key.setdefault(k, []).append(t)
    got = {(r["k"], r["t"]): (r["pos"], r["n"], r["before"]) for r in framed.collect()}
    want = {
        (k, t): (i + 1, len(ts), ts[i - 1 : i] if i else []) for k, ts in by_key.items() for i, t in enumerate(ts)
    }
    assert got == want


def test_longer_frames(spark):
    table = spark.range(1, 101).withColumnRenamed("id", "pos")
    framed = ordering.previous_rows(table, [], "pos", 9, F.col("pos"), "before", bits=4)
    got = {r["pos"]: r["before"] for r in framed.collect()}
    assert got == {p: list(range(max(1, p - 9), p)) for p in range(1, 101)}


def test_global_position(spark):
    rng = random.Random(3)
    values = [(None if i % 3 else rng.randrange(50), f"s{i:04d}") for i in range(700)]
    table = spark.createDataFrame(values, "t int, s string").repartition(7)
    got = ordering.global_position(table, [F.col("t").desc_nulls_last(), F.col("s")]).collect()
    want = sorted(values, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r["t"], r["s"]) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got) == list(range(1, 701))


# --- files -------------------------------------------------------------------

PLAIN = b"""From: a@b.c\r
Date: Wed, 20 Sep 2023 10:15:00 -0400\r
Subject: =?utf-8?q?H=E1=BB=93_s=C6=A1?=\r
MIME-Version: 1.0\r
Content-Type: multipart/mixed; boundary="x"\r
\r
--x\r
Content-Type: text/plain; charset=utf-8\r
Content-Transfer-Encoding: base64\r
\r
Y2jDoG8=\r
--x\r
Content-Type: text/plain\r
\r
 more\r
--x\r
Content-Type: application/pdf\r
Content-Disposition: attachment; filename="cv.pdf"\r
Content-Transfer-Encoding: base64\r
\r
JVBERg==\r
--x--\r
"""


def test_message_files(spark, tmp_path):
    (tmp_path / "7.eml").write_bytes(PLAIN)
    (tmp_path / "8.eml").write_bytes(b"Subject: plain\r\n\r\nbody\r\n")
    (tmp_path / "9.txt").write_bytes(b"no message")
    rows = {r["uid"]: r for r in messages.parse(messages.scan(spark, str(tmp_path))).collect()}
    assert sorted(rows) == [7, 8]
    assert rows[7]["subject"] == "Hồ sơ"
    assert rows[7]["body"].replace("\r\n", "") == "chào more"
    assert [(p["filename"], bytes(p["content"])) for p in rows[7]["parts"]] == [("cv.pdf", b"%PDF")]
    assert rows[7]["sent_iso"] == "2023-09-20T10:15:00-04:00"
    assert rows[8]["parts"] == [] and rows[8]["body"].strip() == "body" and rows[8]["sent_iso"] == ""


def docx(paragraphs):
    import io
    import zipfile

    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    inner = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{inner}{table}</w:body></w:document>')
    return out.getvalue()


def test_attachment_files(spark, tmp_path):
    (tmp_path / "a.DOCX").write_bytes(docx(["Họ tên: An", "Tuổi: 30"]))
    (tmp_path / "bad.docx").write_bytes(b"not a zip")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.txt").write_bytes(b"x")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "d.docx").write_bytes(docx(["no"]))
    files = attachments.scan(spark, str(tmp_path))
    listed = attachments.listing(files)
    assert sorted(r["safe_name"] for r in listed.collect()) == ["a.DOCX", "b.pdf", "bad.docx"]
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    texts = {r["path"].rsplit("/", 1)[1]: r for r in attachments.with_text(files).collect()}
    assert texts["a.DOCX"]["text"] == "Họ tên: An\nTuổi: 30" and texts["a.DOCX"]["error"] is None
    assert texts["bad.docx"]["text"] == "" and "BadZipFile" in texts["bad.docx"]["error"]
    assert texts["b.pdf"]["text"] == "" and texts["b.pdf"]["error"]


def test_landing_area(spark, tmp_path):
    folder = str(tmp_path / "landing")
    rows = spark.createDataFrame([("a.pdf", b"1"), ("b.pdf", b"2")], "safe_name string, content binary")
    attachments.land(rows, folder)
    attachments.land(rows.limit(1), folder)
    assert attachments.purge(spark, folder) == 3
    assert spark.read.parquet(folder).count() == 0


# --- streams -----------------------------------------------------------------

MAIL_SCHEMA = T._parse_datatype_string(MAIL)


def run_rounds(spark, tmp_path, rules=stream.Rules()):
    source = spark.readStream.schema(MAIL_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream.intake_stream(
        source, str(tmp_path / "landed"), str(tmp_path / "offsets"), rules, str(tmp_path / "counters"), once=True
    )
    assert query.awaitTermination(120)
    return query


def test_stream_lands_each_name_once(spark, tmp_path):
    box = str(tmp_path / "in")
    mail(spark, (1, "cv", "", ["a.pdf", "b.pdf"])).coalesce(1).write.mode("append").parquet(box)
    run_rounds(spark, tmp_path)
    mail(spark, (2, "cv", "", ["a.pdf", "c.pdf"]), (3, "cv", "", ["c.pdf"])).coalesce(1).write.mode("append").parquet(box)
    query = run_rounds(spark, tmp_path)
    landed = stream.read_rounds(spark, str(tmp_path / "landed"), stream.LANDED)
    got = sorted((r["safe_name"], r["uid"], r["round"]) for r in landed.collect())
    assert got == [("a.pdf", 1, 0), ("b.pdf", 1, 0), ("c.pdf", 3, 1)]
    counted = spark.read.parquet(str(tmp_path / "counters")).where("round = 1").first()
    assert tuple(counted)[:4] == (2, 2, 3, 1)
    assert query.lastProgress["numInputRows"] >= 2
    # nothing new: no further round
    again = run_rounds(spark, tmp_path)
    assert again.lastProgress is None or again.lastProgress["numInputRows"] == 0
    # a repeated round replaces its own rows
    stream.land_round(str(tmp_path / "landed"), stream.Rules())(mail(spark, (3, "cv", "", ["c.pdf"])), 1)
    landed = stream.read_rounds(spark, str(tmp_path / "landed"), stream.LANDED)
    assert sorted((r["safe_name"], r["uid"]) for r in landed.collect()) == [("a.pdf", 1), ("b.pdf", 1), ("c.pdf", 3)]


def test_sent_time_rounds(spark, tmp_path):
    folder = str(tmp_path / "sent")
    write = stream.sent_time_round(folder)
    schema = "safe_name string, sent_iso string, uid long"
    assert stream.current_sent_times(spark, folder).count() == 0
    write(spark.createDataFrame([("a", "1", 5), ("b", "1", 6)], schema), 0)
    write(spark.createDataFrame([("a", "2", 1), ("a", None, 2)], schema), 1)
    got = {r["safe_name"]: r["sent_iso"] for r in stream.current_sent_times(spark, folder).collect()}
    assert got == {"a": "", "b": "1"}


def test_message_files_are_few_folders_and_few_tasks(spark, tmp_path):
    box, landing, failed, offsets = (str(tmp_path / n) for n in ("box", "landing", "failed", "offsets"))
    whole = 'Subject: a cv\nContent-Type: application/pdf\nContent-Disposition: attachment; filename="{}.pdf"\n\nx'
    texts = [(n, whole.format(n) if n % 7 else "") for n in range(300)] + [(8, whole.format("other")), (5000, None), (None, "lost")]
    tasks = session.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    old = spark.conf.get(session.LISTING_TASKS)
    try:
        spark.conf.set(session.LISTING_TASKS, "10000")
        messages.put_files(spark.createDataFrame(texts, "uid int, value string"), box)
        arriving = messages.watch(spark, box, names="part-*", per_round=1_000)
        assert int(spark.conf.get(session.LISTING_TASKS)) == tasks
        stream.box_stream(arriving, landing, failed, offsets, once=True).awaitTermination()
        spark.conf.set(session.LISTING_TASKS, "1")
        assert messages.scan(spark, box, "part-*").count() == 301
        assert spark.conf.get(session.LISTING_TASKS) == "1"
    finally:
        spark.conf.set(session.LISTING_TASKS, old)
    assert sorted(p.name for p in (tmp_path / "box").iterdir()) == ["0", "1"]
    landed = stream.read_rounds(spark, landing, stream.LANDED)
    # a row of an id that is there already is the rest of its file
    assert {(r["uid"], r["safe_name"][-4:]) for r in landed.collect()} == {(n, ".pdf") for n in range(300) if n % 7}
    bad = stream.read_rounds(spark, failed, stream.FAILED)
    assert {r["uid"] for r in bad.collect()} == {*range(0, 300, 7), 5000}
    # at most a file for each task of the round, though each of its 301 files was read
    assert len(list((tmp_path / "landing").glob("round=0/*.parquet"))) <= tasks
