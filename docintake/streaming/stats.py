"""Running statistics over a growing chat log."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docintake.fixed_values import CHAT_LOG_HIGH, CHAT_LOG_LOW, DEFAULT_QUESTION_CLASS, POLL_SECONDS
from docintake.operators.chat import retained
from docintake.session import written
from docintake.sources import generations, tables


def running_sums(log: DataFrame) -> DataFrame:
    """Counts and length sums per question class; state is one row per class."""
    kind = F.coalesce("question_type", F.lit(DEFAULT_QUESTION_CLASS)).alias("question_type")
    return log.groupBy(kind).agg(
        F.count(F.lit(1)).alias("chats"),
        F.sum("question_length").alias("question_chars"),
        F.sum("answer_length").alias("answer_chars"),
    )


SUMS = T.StructType(
    [T.StructField("question_type", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("chats", "question_chars", "answer_chars")]]
)


def stats_stream(log: DataFrame, folder: str, checkpoint: str, once: bool = False, seconds: int = POLL_SECONDS) -> StreamingQuery:
    """Keep the sums per class in ``folder``, replaced as a whole by every round."""
    trigger = {"availableNow": True} if once else {"processingTime": f"{seconds} seconds"}
    return (
        running_sums(log)
        .writeStream.outputMode("complete")
        .foreachBatch(lambda rows, number: generations.replace({"sums": rows.coalesce(1)}, folder))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


ROUND = T.StructType([T.StructField("round", T.LongType())])


def capped_round(folder: str, high: int, low: int) -> Callable[[DataFrame, int], None]:
    """One round of a log with retention: append, trim, and take out of the sums what the trim removed.

    Log, sums and the number of the round are one generation, so that they
    always fit together, and a round that is repeated after it was stored
    changes nothing.  The sums follow from the entries that came and those
    that went; the log that stays is not totalled again.
    """

    def run(entries: DataFrame, number: int) -> None:
        spark = entries.sparkSession
        done = generations.read(spark, folder, "round", ROUND).agg(F.max("round")).first()[0]
        if done is not None and done >= number:
            return
        log = tables.read_log(spark, folder)
        new = written(entries.select(log.columns), "entries")
        both = log.unionByName(new)
        kept = written(retained(both, high=high, low=low), "kept-log")
        gone = both.join(kept.select("pos"), "pos", "left_anti")
        old = generations.read(spark, folder, "sums", SUMS)
        taken = running_sums(gone).select("question_type", *[(-F.col(n)).alias(n) for n in SUMS.fieldNames()[1:]])
        sums = old.unionByName(running_sums(new)).unionByName(taken)
        sums = sums.groupBy("question_type").agg(*[F.sum(n).alias(n) for n in SUMS.fieldNames()[1:]]).where("chats > 0")
        generations.replace({"log": kept, "sums": sums.coalesce(1), "round": spark.createDataFrame([(number,)], ROUND)}, folder)

    return run


def capped_stats_stream(
    log: DataFrame,
    folder: str,
    checkpoint: str,
    high: int = CHAT_LOG_HIGH,
    low: int = CHAT_LOG_LOW,
    once: bool = False,
    seconds: int = POLL_SECONDS,
) -> StreamingQuery:
    """Keep a chat log with retention and its sums per class in ``folder``; both are those of the retained log after every round."""
    trigger = {"availableNow": True} if once else {"processingTime": f"{seconds} seconds"}
    return log.writeStream.foreachBatch(capped_round(folder, high, low)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def means(sums: DataFrame) -> DataFrame:
    """Per class the count and the mean lengths, from the stored sums."""
    return sums.select(
        "question_type",
        "chats",
        F.round(F.col("question_chars") / F.col("chats"), 1).alias("average_question"),
        F.round(F.col("answer_chars") / F.col("chats"), 1).alias("average_answer"),
    )


def read_means(spark: SparkSession, folder: str) -> DataFrame:
    return means(generations.read(spark, folder, "sums", SUMS))
