"""Incremental intake as a stream: each round lands what is new, once.

The checkpoint of the query is the high-water mark; a replay is a new
checkpoint.  A round writes its rows into a folder of its own and replaces it
when the round is repeated after a failure, so every name is landed once.
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docintake.fixed_values import DEFAULT_KEYWORDS, DOCUMENT_SUFFIXES, OBVIOUS_NAME_WORDS, POLL_SECONDS
from docintake.operators import intake
from docintake.operators.ordering import global_position
from docintake.session import TASKS_A_CORE, remove, shared_folder, written
from docintake.sources import generations, messages

LANDED = T.StructType(
    [
        T.StructField("safe_name", T.StringType()),
        T.StructField("uid", T.LongType()),
        T.StructField("part_no", T.LongType()),
        T.StructField("obvious", T.BooleanType()),
        T.StructField("sent_iso", T.StringType()),
        T.StructField("content", T.BinaryType()),
    ]
)


PROCESSED = T.StructType([T.StructField("uid", T.LongType()), T.StructField("kept", T.BooleanType())])


@dataclass(frozen=True)
class Rules:
    """What a round keeps."""

    keywords: Sequence[str] = tuple(DEFAULT_KEYWORDS)
    suffixes: Sequence[str] = tuple(DOCUMENT_SUFFIXES)
    words: Sequence[str] = tuple(OBVIOUS_NAME_WORDS)


def read_rounds(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All rows written by the rounds so far; none before the first round."""
    with_round = T.StructType([*schema, T.StructField("round", T.LongType())])
    try:
        return spark.read.schema(with_round).parquet(folder)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], with_round)


def write_round(rows: DataFrame, folder: str, number: int) -> None:
    """Write or replace the rows of one round."""
    rows.write.mode("overwrite").parquet(f"{folder}/round={number}")


def land_round(folder: str, rules: Rules, counters: str | None = None) -> Callable[[DataFrame, int], None]:
    """One round: judge, keep the best part per name, drop landed names, write.

    The narrow rows of the kept parts are used twice and written meanwhile;
    the messages with their payloads are not.  ``counters`` is a folder for
    one row of counts per round.
    """

    def run(arrived: DataFrame, number: int) -> None:
        spark = arrived.sparkSession
        landed = read_rounds(spark, folder, LANDED).where(F.col("round") < number)
        judged = intake.judged_parts(arrived, rules.keywords, rules.suffixes, rules.words)
        kept = written(intake.kept_parts(judged, "sent_iso"), "kept-parts")
        new = intake.to_land(kept, intake.known_names(kept, landed), "sent_iso")
        write_round(intake.with_content(new, arrived).select(LANDED.fieldNames()), folder, number)
        if counters:
            this_round = read_rounds(spark, folder, LANDED).where(F.col("round") == number)
            write_round(intake.run_counters(judged, this_round), counters, number)

    return run


def intake_stream(
    arriving: DataFrame,
    landing: str,
    checkpoint: str,
    rules: Rules = Rules(),
    counters: str | None = None,
    once: bool = False,
    seconds: int = POLL_SECONDS,
) -> StreamingQuery:
    """Start the watch loop over a streaming table of messages (with ``sent_iso``).

    ``once`` handles everything that is there in rounds and stops.
    """
    trigger = {"availableNow": True} if once else {"processingTime": f"{seconds} seconds"}
    return (
        arriving.writeStream.foreachBatch(land_round(landing, rules, counters))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


FAILED = T.StructType([T.StructField("uid", T.LongType()), T.StructField("path", T.StringType()), T.StructField("error", T.StringType())])


def box_round(
    landing: str, failed: str, rules: Rules, counters: str | None = None, box: messages.Box | None = None
) -> Callable[[DataFrame, int], None]:
    """One round over raw message files: parse each once, note those that are no messages, land the parts of the others.

    Spark reads 32 small files a task; a task would take longer to start than
    to parse them, so a round has a few tasks a core.  Files of a ``box`` are
    paths yet, which those tasks open.
    """
    land = land_round(landing, rules, counters)

    def run(raw: DataFrame, number: int) -> None:
        spark = raw.sparkSession
        tasks = TASKS_A_CORE * spark.sparkContext.defaultParallelism
        few = raw.repartition(tasks) if box else raw.coalesce(tasks)
        rows, scratch = messages.parse(few, box), shared_folder(spark, "messages")
        rows.write.parquet(scratch)
        parsed = spark.read.schema(rows.schema).parquet(scratch)
        write_round(parsed.where(F.col("error").isNotNull()).select(FAILED.fieldNames()), failed, number)
        land(parsed.where(F.col("error").isNull()), number)
        # the round has written all that it leaves
        remove(spark, scratch)

    return run


SEEN = T.StructType([T.StructField("path", T.StringType())])


def box_rounds(
    box: messages.Box, landing: str, failed: str, checkpoint: str, rules: Rules, mark: int = 0, counters: str | None = None, once: bool = False
) -> Callable[[DataFrame, int], None]:
    """At each tick, list the box and handle the files not seen yet, the oldest first: with ``once`` all of them in rounds, else one round.

    Files seen are a table below the checkpoint and never come to the driver.
    A round's files join it when the round is done, and then a pointer; a
    round that dies earlier is repeated under its number.
    """
    one = box_round(landing, failed, rules, counters, box)
    seen, done = f"{checkpoint}/seen", f"{checkpoint}/rounds"

    def run(tick: DataFrame, _: int) -> None:
        spark = tick.sparkSession
        first = generations.current(spark, done)
        scratch = shared_folder(spark, "arrived")
        # paths are so much smaller when stored that Spark would broadcast very many of them, by way of the driver
        known = read_rounds(spark, seen, SEEN).where(F.col("round") < first).hint("merge")
        try:
            messages.listed(spark, box, f"{scratch}/listing").join(known, "path", "left_anti").write.parquet(f"{scratch}/new")
            new = spark.read.parquet(f"{scratch}/new")
            rounds = -(-new.count() // box.per_round)
            if rounds > 1:
                global_position(new, [F.col("modified"), F.col("path")], "place").write.parquet(f"{scratch}/in-order")
                new = spark.read.parquet(f"{scratch}/in-order")
            for n in range(rounds if once else min(rounds, 1)):
                some = new.where(F.floor((F.col("place") - 1) / box.per_round) == n) if rounds > 1 else new
                # Spark leaves out files without a byte
                one(intake.after_mark(some, mark).where("length > 0"), first + n)
                write_round(some.select("path"), seen, first + n)
                generations.point_on(spark, done, first + n + 1)
        finally:
            remove(spark, scratch)

    return run


def box_stream(
    raw: messages.Box | DataFrame,
    landing: str,
    failed: str,
    checkpoint: str,
    rules: Rules = Rules(),
    mark: int = 0,
    counters: str | None = None,
    once: bool = False,
    seconds: int = POLL_SECONDS,
) -> StreamingQuery:
    """Start the watch loop over a folder of raw message files, as :func:`messages.watch` gives it, or over a stream of ``path, content, uid``.

    The checkpoint knows the files it has seen.  ``mark`` spares a new
    checkpoint the files up to that id: they are listed but never opened.
    Spark's file source, which lists in the driver, serves folders that tasks
    cannot open and checkpoints begun with it.
    """
    trigger = {"availableNow": True} if once else {"processingTime": f"{seconds} seconds"}
    if isinstance(raw, messages.Box) and (generations.exists(raw.spark, f"{checkpoint}/sources") or not raw.in_tasks()):
        raw = raw.stream()
    if isinstance(raw, messages.Box):
        rows, run = raw.ticks(), box_rounds(raw, landing, failed, checkpoint, rules, mark, counters, once)
    else:
        rows, run = intake.after_mark(raw, mark), box_round(landing, failed, rules, counters)
    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()


NAMED = T.StructType([f for f in LANDED if f.name != "content"])


def latest_names(parts: DataFrame, sent: str, delay: str) -> DataFrame:
    """Of each name the newest copy among those that follow each other within ``delay``, once no more can come.

    ``parts`` is a stream with ``safe_name, uid, part_no, obvious, sent_iso``
    and an instant ``sent``.  State holds one narrow row for each name that is
    still open and is given up when the watermark passes; copies that arrive
    later than ``delay`` behind the newest row come too late.
    """
    newest = F.max(F.struct("uid", "obvious", (-F.col("part_no")).alias("back"), "sent_iso")).alias("best")
    found = parts.withWatermark(sent, delay).groupBy("safe_name", F.session_window(sent, delay)).agg(newest)
    return found.select(
        "safe_name",
        "best.uid",
        (-F.col("best.back")).alias("part_no"),
        "best.obvious",
        "best.sent_iso",
        F.col("session_window.start").alias("since"),
    )


def latest_names_stream(names: DataFrame, landing: str, checkpoint: str, once: bool = False, seconds: int = POLL_SECONDS) -> StreamingQuery:
    """Land each of :func:`latest_names` unless an earlier round has landed the name; the oldest of a round wins."""

    def run(rows: DataFrame, number: int) -> None:
        landed = read_rounds(rows.sparkSession, landing, NAMED).where(F.col("round") < number)
        found = written(rows, "closed-names")
        new = intake.not_landed(found, intake.known_names(found, landed))
        oldest = intake.latest_per_key(new, ["safe_name"], [-F.unix_micros("since")], [n for n in NAMED.fieldNames() if n != "safe_name"])
        write_round(oldest.select(NAMED.fieldNames()), landing, number)

    trigger = {"availableNow": True} if once else {"processingTime": f"{seconds} seconds"}
    return names.writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def sent_time_round(folder: str) -> Callable[[DataFrame, int], None]:
    """Sent times as a log of writes per round; :func:`current_sent_times` reads the last ones."""

    def run(updates: DataFrame, number: int) -> None:
        rows = updates.select("safe_name", F.coalesce("sent_iso", F.lit("")).alias("sent_iso"), F.col("uid").alias("seq"))
        write_round(rows, folder, number)

    return run


SENT = T.StructType(
    [
        T.StructField("safe_name", T.StringType()),
        T.StructField("sent_iso", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)


def current_sent_times(spark: SparkSession, folder: str) -> DataFrame:
    """Last write per name over all rounds."""
    writes = read_rounds(spark, folder, SENT)
    order = [F.col("round"), F.col("seq")]
    return intake.latest_per_key(writes, ["safe_name"], order, ["sent_iso"])
