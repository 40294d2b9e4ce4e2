import os

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException

from docintake.sources import generations, messages
from docintake.streaming import intake as rounds
from docintake.streaming.intake import FAILED, LANDED, read_rounds

MESSAGE = 'Subject: {}\nContent-Type: application/pdf\nContent-Disposition: attachment; filename="{}"\n\nx'


def put(path, name, age=0, subject="CV"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(MESSAGE.format(subject, name))
    os.utime(path, (1_700_000_000 - age, 1_700_000_000 - age))


@pytest.fixture
def box(spark, tmp_path):
    """Run the stream over the box to its end; gives what landed and what failed, by round."""
    (tmp_path / "box").mkdir()

    def run(per_round=100, folder="box", raw=None, **more):
        at = {n: str(tmp_path / n) for n in ("landing", "failed", "checkpoint")}
        raw = messages.watch(spark, str(tmp_path / folder), per_round=per_round) if raw is None else raw
        assert rounds.box_stream(raw, **at, once=True, **more).awaitTermination(300)
        landed, bad = read_rounds(spark, at["landing"], LANDED), read_rounds(spark, at["failed"], FAILED)
        return [sorted(map(tuple, x.collect())) for x in (landed.select("round", "uid", "safe_name"), bad.select("round", "uid"))]

    return run


def test_files_of_a_box_are_not_listed_in_the_driver(spark, tmp_path, box):
    for uid in range(400):
        put(tmp_path / "box" / str(uid % 7) / f"{uid}.eml", f"{uid}.pdf")
    listed = spark._jvm.org.apache.spark.metrics.source.HiveCatalogMetrics.METRIC_FILES_DISCOVERED()
    before = listed.getCount()
    landed, _ = box(per_round=1_000)
    # the tables of a round are, by Spark
    assert listed.getCount() - before < 200
    assert landed == [(0, uid, f"{uid}.pdf") for uid in range(400)]


def test_rounds_take_older_files_first_and_each_file_once(tmp_path, box):
    for uid in range(1, 6):
        put(tmp_path / "box" / "deep" / f"at {uid}" / f"{uid}.eml", f"{uid}.pdf", age=uid)
    put(tmp_path / "box" / "6.eml", "5.pdf")  # newest, but the name has landed by then
    put(tmp_path / "box" / "uid=7" / "9.eml", "7.pdf", subject="lunch")
    for hidden in (".10.eml", "_11.eml", "_old/12.eml", ".new/13.eml", "14.eml._COPYING_", "15.txt", "16.EML"):
        put(tmp_path / "box" / hidden, "hidden.pdf", age=9)
    (tmp_path / "box" / "17.eml").write_bytes(b"")
    (tmp_path / "box" / "18.eml").write_bytes(b"\n")
    os.utime(tmp_path / "box" / "18.eml", (1_600_000_000, 1_600_000_000))
    first = ([(0, 5, "5.pdf"), (1, 3, "3.pdf"), (1, 4, "4.pdf"), (2, 1, "1.pdf"), (2, 2, "2.pdf")], [(0, 18)])
    assert box(per_round=2) == [*first]
    assert box() == [*first]
    put(tmp_path / "box" / "19.eml", "19.pdf", age=10**9)
    put(tmp_path / "box" / "1.eml", "1.pdf")
    # nine files, the empty one too, were rounds 0 to 4
    assert box() == [[*first[0], (5, 19, "19.pdf")], first[1]]


def test_one_round_a_tick_unless_all_is_asked_for(spark, tmp_path):
    for uid in range(5):
        put(tmp_path / "box" / f"{uid}.eml", f"{uid}.pdf", age=uid)
    at = [str(tmp_path / n) for n in ("landing", "failed", "checkpoint")]
    tick = rounds.box_rounds(messages.watch(spark, str(tmp_path / "box"), per_round=3), *at, rounds.Rules())
    for number, uids in enumerate([{2, 3, 4}, {0, 1, 2, 3, 4}, {0, 1, 2, 3, 4}]):
        tick(spark.range(1), number)
        assert {r["uid"] for r in read_rounds(spark, at[0], LANDED).collect()} == uids
    assert generations.numbers(spark, f"{at[2]}/rounds") == [2]


def test_a_round_that_died_is_repeated(spark, tmp_path, box, monkeypatch):
    put(tmp_path / "box" / "1.eml", "1.pdf")
    (tmp_path / "box" / "2.eml").write_bytes(b"\n")

    def dies(*_):
        raise RuntimeError("died")

    with monkeypatch.context() as patch:
        patch.setattr(generations, "point_on", dies)
        with pytest.raises(StreamingQueryException):
            box()
    put(tmp_path / "box" / "3.eml", "3.pdf")
    assert box() == [[(0, 1, "1.pdf"), (0, 3, "3.pdf")], [(0, 2)]]


def test_files_up_to_the_mark_and_too_long_ones(spark, tmp_path, box):
    put(tmp_path / "box" / "1.eml", "1.pdf")
    (tmp_path / "box" / "1.eml").write_bytes(b"x" * 5000)
    put(tmp_path / "box" / "2.eml", "2.pdf")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "2000")
    try:
        assert box(mark=1) == [[(0, 2, "2.pdf")], []]
        (tmp_path / "box" / "3.eml").write_bytes(b"x" * 5000)
        with pytest.raises(StreamingQueryException):
            box(mark=1)
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_spark_lists_where_tasks_cannot_and_where_it_began(spark, tmp_path, box):
    put(tmp_path / "box" / "1.eml", "1.pdf")
    assert not messages.watch(spark, str(tmp_path / "bo[xy]")).in_tasks()
    assert box(folder="bo[xy]") == [[(0, 1, "1.pdf")], []]
    put(tmp_path / "box" / "2.eml", "2.pdf")
    assert messages.watch(spark, str(tmp_path / "box")).in_tasks()
    assert box() == [[(0, 1, "1.pdf"), (1, 2, "2.pdf")], []]
    assert not (tmp_path / "checkpoint" / "seen").exists()


def test_the_content_of_files_comes_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(messages, "PIECE", 10)
    for n, size in enumerate([4, 4, 4, 30, 0, 1]):
        (tmp_path / str(n)).write_bytes(b"x" * size)
    batch = pd.DataFrame({"path": [f"file:{tmp_path}/{n}" for n in range(6)]})
    pieces = [list(map(len, piece["content"])) for piece in messages._opener(f"file:{tmp_path}", 100)(iter([batch]))]
    assert pieces == [[4, 4, 4], [30], [0, 1]]
