"""The three jobs end to end: fetch messages, process files, answer questions."""

from collections.abc import Callable, Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docintake.fixed_values import COL_SOURCE, DEFAULT_KEYWORDS, TIME_PHRASES
from docintake.functions import answers, text, times
from docintake.operators import chat, intake, mentions, records
from docintake.operators.ordering import global_position
from docintake.session import written
from docintake.sources import attachments, messages, model, state
from docintake.sources.progress import Progress
from docintake.streaming import intake as rounds


def no_times(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "safe_name string, sent_iso string")


def records_of(
    files: DataFrame,
    stored: DataFrame,
    fetched: DataFrame | None = None,
    start: Column | None = None,
    end: Column | None = None,
    readers: Mapping[str, attachments.Reader] = attachments.DOCX_ONLY,
    client_factory: Callable[[], model.Client] | None = None,
    responses: str | None = None,
) -> DataFrame:
    """Records of files (``path, safe_name, length, modificationTime, content``), newest first.

    Times are joined and filtered before any text is taken out of a file.
    With a model client its answers are first written to ``responses``.
    """
    timed = records.with_sent_time(files, "safe_name", stored, fetched)
    timed = records.in_time_range(timed, start=start, end=end)
    texts = attachments.with_text(timed, "sent_iso", readers=readers).withColumn("doc_id", F.xxhash64("path"))
    found = model.extract_with(texts, client_factory, responses)
    named = records.to_records(found, "path", keep=["sent_iso"])
    return named.orderBy(*records.newest_first(F.col("sent_iso"), F.col(COL_SOURCE))).drop("sent_iso")


def process_folder(
    spark: SparkSession,
    folder: str,
    sent_times: str | None = None,
    fetched: DataFrame | None = None,
    only: DataFrame | None = None,
    **how,
) -> DataFrame:
    """Records of the document files of a folder.

    ``only`` limits the run to the file names of this fetch; when it is empty
    all files are processed.  ``how`` are the parameters of :func:`records_of`.
    """
    files = attachments.scan(spark, folder).withColumn("safe_name", text.base_name(F.col("path")))
    if only is not None:
        files = intake.left_or_right(files.join(only.select("safe_name"), "safe_name", "left_semi"), files)
    stored = state.import_sent_times(spark, sent_times) if sent_times else no_times(spark)
    return records_of(files, stored, fetched, **how)


def process_landed(spark: SparkSession, landing: str, sent: str | None = None, **how) -> DataFrame:
    """Records straight from the landing table.

    The time a file landed with goes before the kept rounds of sent times.
    """
    landed = rounds.read_rounds(spark, landing, rounds.LANDED)
    files = landed.select(
        F.col("safe_name").alias("path"),
        "safe_name",
        F.octet_length("content").cast("long").alias("length"),
        F.lit(None).cast("timestamp").alias("modificationTime"),
        "content",
    )
    stored = rounds.current_sent_times(spark, sent) if sent else no_times(spark)
    return records_of(files, stored, landed.where(F.col("sent_iso") != ""), **how)


def process_file(
    spark: SparkSession, path: str, readers: Mapping[str, attachments.Reader] = attachments.DOCX_ONLY
) -> DataFrame:
    """The nine fields of one file; no row when it has no text."""
    one = attachments.with_text(spark.read.format("binaryFile").load(path), readers=readers)
    return records.with_regex_info(one.where(~text.is_blank(F.col("text")))).select("info.*")


def fetch_box(
    spark: SparkSession,
    box: str,
    landing: str,
    mark: str,
    keywords: Sequence[str] = tuple(DEFAULT_KEYWORDS),
    since: date | None = None,
    before: date | None = None,
    ignore_mark: bool = False,
    processed: str | None = None,
    sent: str | None = None,
    progress: Progress | None = None,
) -> DataFrame:
    """One incremental fetch from a folder of message files; gives the rows just landed.

    Only files above the mark are opened, and every message is parsed once,
    into the shared folder.  ``progress`` counts what each step handles.  ``processed`` is a
    folder for the ids of handled messages, which are not fetched again;
    ``sent`` one for the sent times of landed files.  The rows land before the
    marks move, so a run that dies in between is repeated and lands nothing
    twice.  The mark only passes messages that were fetched, and never goes
    back.
    """
    stored = state.read_mark(spark, mark)
    raw = intake.after_mark(messages.scan(spark, box), 0 if ignore_mark else stored)
    steps = progress or Progress(spark, "", "")
    parsed = written(steps.step("parsed", messages.parse(raw), F.col("error").isNotNull()), "messages")
    wanted = intake.in_window(parsed, times.parse_iso(F.col("sent_iso")), since, before)
    if processed:
        wanted = intake.unseen(wanted, rounds.read_rounds(spark, processed, rounds.PROCESSED))
    landed = rounds.read_rounds(spark, landing, rounds.LANDED)
    number = (landed.agg(F.max("round")).first()[0] or 0) + 1
    if processed:
        handled = rounds.read_rounds(spark, processed, rounds.PROCESSED)
        number = max(number, (handled.agg(F.max("round")).first()[0] or 0) + 1)
    judged = intake.judged_parts(wanted, list(keywords))
    kept = written(steps.step("kept", intake.kept_parts(judged, "sent_iso")), "kept-parts")
    new = intake.to_land(kept, intake.known_names(kept, landed), "sent_iso")
    rounds.write_round(steps.step("landed", intake.with_content(new, wanted).select(rounds.LANDED.fieldNames())), landing, number)
    this_round = rounds.read_rounds(spark, landing, rounds.LANDED).where(F.col("round") == number)
    if sent:
        rounds.sent_time_round(sent)(this_round, number)
    fetched = written(intake.processed_rows(judged), "handled")
    if processed:
        rounds.write_round(fetched, processed, number)
    if progress:
        progress.write()
    state.write_mark(intake.advance_mark(spark.createDataFrame([(str(stored),)], "mark string"), fetched), mark)
    return this_round


def routed_questions(
    questions: DataFrame, table: DataFrame, asked_at: Column, phrases: Sequence[str] = tuple(TIME_PHRASES)
) -> DataFrame:
    """Questions with ``status``, ``route`` and the answer of those that need no model."""
    routed = chat.routed(questions.withColumn("question", text.strip(F.col("question"))), table, list(phrases))
    return routed.withColumn("answer", F.when(F.col("route") == "clock", chat.clock_answer(asked_at)))


def finished_answers(told: DataFrame, table: DataFrame, files: DataFrame) -> DataFrame:
    """Model answers (``id, answer``) cleaned, with file and name links.

    ``table`` is the record table, ranked or not, ``files`` has ``file, link``.
    """
    placed = table if "rank" in table.columns else global_position(table, [F.col(COL_SOURCE)])
    names = placed.select(F.col("rank").alias("pos"), F.col("Họ tên").alias("name"), F.col(COL_SOURCE).alias("file"))
    clean = answers.clean_answers(told)
    return mentions.link_names(mentions.link_files(clean, files), names, files)
