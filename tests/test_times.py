import datetime as dt

from pyspark.sql import functions as F

from docintake.functions import times

C = F.col("c")


def test_display(column):
    cases = {
        "": "",
        "bad": "bad",
        None: "",
        "2023-09-20T00:05:00-04:00": "4:05 am 20/9/2023",
        "2023-09-20T10:15:00Z": "10:15 am 20/9/2023",
        "2023-09-20T12:00:00Z": "12:00 pm 20/9/2023",
        "2025-07-04T12:00:00+07:00": "5:00 am 4/7/2025",
        "2025-01-02": "12:00 am 2/1/2025",
        "2025-02-30T10:00:00Z": "2025-02-30T10:00:00Z",
        "2025": "2025",
    }
    assert column(list(cases), times.format_sent_time(C)) == list(cases.values())


def test_display_follows_the_session_zone(spark, column):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Ho_Chi_Minh")
    try:
        assert column(["2023-09-20T10:15:00Z"], times.format_sent_time(C)) == ["5:15 pm 20/9/2023"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_mail_date_keeps_its_offset(column):
    cases = {
        "20-Sep-2023 10:20:00 -0400": "2023-09-20T10:20:00-04:00",
        "Wed, 20 Sep 2023 10:15:00 -0400": "2023-09-20T10:15:00-04:00",
        " 3-Jan-2024 01:02:03 +0530": "2024-01-03T01:02:03+05:30",
        "3 January 2024 01:02 GMT": "2024-01-03T01:02:00+00:00",
        "Mon, 5 Feb 2024 23:59:59 +0000 (UTC)": "2024-02-05T23:59:59+00:00",
        "31-Feb-2024 10:00:00 +0000": None,
        "20-Xxx-2023 10:20:00 -0400": None,
        "20-anf-2023 10:20:00 -0400": None,
        "20-Sep-2023 10:20:00 XYZ": None,
        "": None,
        None: None,
    }
    assert column(list(cases), times.mail_date_iso(C)) == list(cases.values())


def test_server_date_goes_before_header(spark):
    rows = spark.createDataFrame(
        [
            (1, "20-Sep-2023 10:20:00 -0400", "Wed, 20 Sep 2023 10:15:00 -0400"),
            (2, None, "Wed, 20 Sep 2023 10:15:00 -0400"),
            (3, "bad", "bad"),
        ],
        "i int, server string, header string",
    )
    got = rows.orderBy("i").select(times.sent_iso(F.col("server"), F.col("header")).alias("x")).collect()
    assert [r["x"] for r in got] == ["2023-09-20T10:20:00-04:00", "2023-09-20T10:15:00-04:00", ""]


def test_bounds(spark, column):
    assert column(["04/07/2025", "4/7/2025", "31/02/2025", "x"], times.parse_day(C)) == [
        dt.date(2025, 7, 4),
        dt.date(2025, 7, 4),
        None,
        None,
    ]
    assert column(["2025-07-04"], times.parse_day(C, "yyyy-MM-dd")) == [dt.date(2025, 7, 4)]
    start, stop = times.day_bounds(C, C)
    shown = F.concat_ws("|", F.date_format(start, "yyyy-MM-dd HH:mm"), F.date_format(stop, "yyyy-MM-dd HH:mm"))
    assert column(["31/12/2024"], shown) == ["2024-12-31 00:00|2025-01-01 00:00"]
