"""Queries that run a stream to its end and read its result."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docintake.operators import intake as parts
from docintake.plans.chat import CHUNKS, HIGH, LOW, SQL_LOG, chat_log, sql_capped
from docintake.plans.registry import Tables, query
from docintake.plans.roles import PAGE_KEYWORDS, PAGE_SUFFIXES, PAGE_WORDS, SQL_PARTS, iso_text, mailbox
from docintake.session import shared_folder
from docintake.sources import generations, messages
from docintake.sources.progress import Progress, read_progress
from docintake.streaming import intake, stats

RULES = intake.Rules(PAGE_KEYWORDS, PAGE_SUFFIXES, PAGE_WORDS)


def _arriving(t: Tables, rows: DataFrame, files: int, order: str) -> DataFrame:
    """A table as a stream of files that arrive over several rounds."""
    folder = shared_folder(t.spark, "arriving")
    rows.repartitionByRange(files, order).write.parquet(folder)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(folder)


def _mail(t: Tables) -> DataFrame:
    return mailbox(t.pages).withColumn("sent_iso", iso_text(F.timestamp_seconds(F.col("uid") + F.lit(1704067200))))


def _landed(t: Tables, messages: DataFrame) -> DataFrame:
    landing, checkpoint = shared_folder(t.spark, "landing"), shared_folder(t.spark, "offsets")
    intake.intake_stream(messages, landing, checkpoint, RULES, once=True).awaitTermination()
    return intake.read_rounds(t.spark, landing, intake.LANDED)


@query(
    "stream_land_once",
    sql=f"with {SQL_PARTS} select safe_name, 1::bigint as times from kept group by safe_name",
)
def q_stream_land_once(t: Tables):
    landed = _landed(t, _arriving(t, _mail(t), 4, "uid"))
    return landed.groupBy("safe_name").agg(F.count(F.lit(1)).alias("times"))


@query(
    "stream_intake",
    sql=f"""
    with {SQL_PARTS}
    select safe_name, uid, part_no, obvious, md5(link) as content_md5,
           strftime(timestamp '2024-01-01' + to_seconds(uid), '%Y-%m-%dT%H:%M:%S') || 'Z' as sent_iso
    from kept qualify row_number() over (partition by safe_name order by uid desc, obvious desc, part_no) = 1
    """,
)
def q_stream_intake(t: Tables):
    landed = _landed(t, _arriving(t, _mail(t), 2, "uid"))
    return landed.select(
        "safe_name", "uid", "part_no", "obvious", F.md5("content").alias("content_md5"), "sent_iso"
    )


@query(
    "stream_chat_stats",
    sql=f"""
    select question_type, count(*) as chats, round(sum(question_length) / count(*), 1) as average_question,
           round(sum(answer_length) / count(*), 1) as average_answer
    from ({SQL_LOG}) group by question_type
    """,
)
def q_stream_chat_stats(t: Tables):
    folder, checkpoint = shared_folder(t.spark, "sums"), shared_folder(t.spark, "offsets")
    log = _arriving(t, chat_log(t), 4, "pos")
    stats.stats_stream(log, folder, checkpoint, once=True).awaitTermination()
    return stats.read_means(t.spark, folder)


# --- raw message files -------------------------------------------------------


def _coded(text):
    """A header text as one encoded word."""
    return F.concat(F.lit("=?utf-8?B?"), F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"\s", ""), F.lit("?="))


def _message_texts(t: Tables) -> DataFrame:
    """Pages as raw messages ``uid, value``; every 25th is an empty file."""
    mail = mailbox(t.pages)
    date = F.date_format(F.timestamp_seconds(F.col("uid") + F.lit(1704067200)), "EEE, d MMM yyyy HH:mm:ss")
    head = F.concat(
        F.lit("Date: "), date, F.lit(" +0000\nSubject: "), _coded(F.col("subject")),
        F.lit('\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="=cut="\n\n--=cut=\n'),
        F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), "body", F.lit("\n"),
    )
    target = F.regexp_extract_all("body", F.lit('href="([^"]+)"'), F.lit(1))
    files = F.zip_with(
        "parts", target, lambda p, link: F.concat(
            F.lit('--=cut=\nContent-Type: application/octet-stream\nContent-Disposition: attachment; filename="'), _coded(p["filename"]),
            F.lit('"\nContent-Transfer-Encoding: base64\n\n'), F.base64(F.encode(link, "UTF-8")), F.lit("\n"),
        ),
    )
    whole = F.concat(head, F.array_join(files, ""), F.lit("--=cut=--"))
    return mail.select("uid", F.when(F.col("uid") % 25 == 0, F.lit("")).otherwise(whole).alias("value"))


SQL_BOX = f"""
    {SQL_PARTS},
    first as (
        select * from found where uid % 25 <> 0
        qualify row_number() over (partition by safe_name order by uid % 2, uid desc, obvious desc, part_no) = 1
    )
"""


@query(
    "stream_messages",
    sql=f"""
    with {SQL_BOX}
    select uid, safe_name, part_no + 1 as part_no, obvious, md5(link) as content_md5,
           strftime(timestamp '2024-01-01' + to_seconds(uid), '%Y-%m-%dT%H:%M:%S') || '+00:00' as sent_iso, null as error
    from first
    union all
    select page_id, null, null, null, null, null, 'no message' from pages where page_id % 25 = 0
    """,
)
def q_stream_messages(t: Tables):
    """Raw message files that arrive in two rounds, one file a message; some are no messages."""
    box, landing, failed, offsets = (shared_folder(t.spark, n) for n in ("box", "landing", "failed", "offsets"))
    raw = _message_texts(t)
    for half in (0, 1):
        messages.put_files(raw.where(F.col("uid") % 2 == half), box)
        arriving = messages.watch(t.spark, box, names="part-*", per_round=1_000_000)
        intake.box_stream(arriving, landing, failed, offsets, RULES, once=True).awaitTermination()
    landed = intake.read_rounds(t.spark, landing, intake.LANDED)
    bad = intake.read_rounds(t.spark, failed, intake.FAILED)
    shown = landed.select("uid", "safe_name", "part_no", "obvious", F.md5("content").alias("content_md5"), "sent_iso", F.lit(None).cast("string").alias("error"))
    return shown.unionByName(bad.select("uid", "error"), allowMissingColumns=True)


DELAY = 31


@query(
    "stream_land_latest",
    sql=f"""
    with {SQL_PARTS},
    gaps as (
        select *, coalesce(uid * 3 - lag(uid * 3) over (partition by safe_name order by uid) > {DELAY}, false) as new from kept
    ),
    sessions as (select *, sum(new::int) over (partition by safe_name order by uid) as session from gaps)
    select safe_name, uid, part_no, obvious, strftime(timestamp '2024-01-01' + to_seconds(uid * 3), '%Y-%m-%dT%H:%M:%S') || 'Z' as sent_iso
    from sessions where session = 0
    qualify row_number() over (partition by safe_name order by uid desc, obvious desc, part_no) = 1
    """,
)
def q_stream_land_latest(t: Tables):
    """Names that repeat and come out of order: state is bounded by the watermark, and the newest copy within it wins."""
    sent = F.timestamp_seconds(F.col("uid") * 3 + F.lit(1704067200))
    mail = mailbox(t.pages).withColumn("sent_iso", iso_text(sent))
    found = parts.kept_parts(parts.judged_parts(mail, PAGE_KEYWORDS, PAGE_SUFFIXES, PAGE_WORDS), "sent_iso")
    found = found.select("safe_name", "uid", "part_no", "obvious", "sent_iso", sent.alias("sent"))
    arriving, landing, offsets = (shared_folder(t.spark, n) for n in ("arriving", "landing", "offsets"))
    # neighbours change places, by less than the delay
    order = F.col("uid") + (F.col("uid") % 5) * 2
    rounds = 3
    size = F.lit(t.pages.agg(F.coalesce(F.max("page_id"), F.lit(0))).first()[0] // rounds + 1)
    for n in range(rounds + 1):
        if n < rounds:
            late = n + 1 < rounds
            mine = (order / size).cast("int") == n if late else (order / size).cast("int") >= n
            rows = found.where(mine)
        else:
            # a row of much later time closes what is still open
            rows = found.limit(1).select(F.lit("").alias("safe_name"), *[F.col(c) for c in found.columns[1:-1]], F.lit("2034-01-01").cast("timestamp").alias("sent"))
        rows.write.mode("append").parquet(arriving)
        stream = t.spark.readStream.schema(found.schema).parquet(arriving)
        names = intake.latest_names(stream, "sent", f"{DELAY} seconds")
        intake.latest_names_stream(names, landing, offsets, once=True).awaitTermination()
    return intake.read_rounds(t.spark, landing, intake.NAMED).drop("round")


@query(
    "stream_capped_stats",
    sql="with "
    + sql_capped(CHUNKS, HIGH, LOW)
    + " union all ".join(
        f"""
    select {n} as round, question_type, count(*) as chats, round(sum(question_length) / count(*), 1) as average_question,
           round(sum(answer_length) / count(*), 1) as average_answer
    from log{n} group by question_type
    """
        for n in range(CHUNKS)
    ),
)
def q_stream_capped_stats(t: Tables):
    """Totals of a streamed log that is trimmed, after each of its rounds."""
    arriving, folder, offsets = (shared_folder(t.spark, n) for n in ("arriving", "capped", "offsets"))
    log = chat_log(t)
    seen = []
    for n in range(CHUNKS):
        log.where(F.shiftright("pos", 16) % CHUNKS == n).coalesce(1).write.mode("append").parquet(arriving)
        stream = t.spark.readStream.schema(log.schema).parquet(arriving)
        stats.capped_stats_stream(stream, folder, offsets, HIGH, LOW, once=True).awaitTermination()
        sums = generations.read(t.spark, folder, "sums", stats.SUMS).collect()  # a row a class
        totals = t.spark.createDataFrame(sums, stats.SUMS)
        seen.append(stats.means(totals).select(F.lit(n).alias("round"), "*"))
    return seen[0].unionByName(seen[1]).unionByName(seen[2]).unionByName(seen[3])


@query(
    "progress_rows",
    sql=f"""
    with {SQL_PARTS}
    select 'pages' as run, 1 as no, 'messages' as step, count(*) as rows, 0 as failed from pages
    union all
    select 'pages', 2, 'judged', count(*), count_if(not kw) from messages
    union all
    select 'pages', 3, 'kept', count(*), count_if(not obvious) from kept
    union all
    select 'labels', 1, 'read', count(*), count_if(quality = 0) from labels
    """,
)
def q_progress_rows(t: Tables):
    """The steps of two runs, counted while their rows pass."""
    folder = shared_folder(t.spark, "progress")
    steps = Progress(t.spark, folder, "pages")
    mail = steps.step("messages", _mail(t))
    judged = parts.judged_parts(mail, PAGE_KEYWORDS, PAGE_SUFFIXES, PAGE_WORDS)
    judged = steps.step("judged", judged, ~F.col("kw"))
    steps.step("kept", parts.kept_parts(judged), ~F.col("obvious")).write.format("noop").mode("overwrite").save()
    steps.write()
    other = Progress(t.spark, folder, "labels")
    other.step("read", t.labels, F.col("quality") == 0).write.format("noop").mode("overwrite").save()
    other.write()
    return read_progress(t.spark, folder)
