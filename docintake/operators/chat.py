"""Questions, conversations and the chat log."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docintake.fixed_values import (
    CHAT_LOG_HIGH,
    CHAT_LOG_LOW,
    CONTEXT_EXCHANGES,
    CONTEXT_MESSAGES,
    DEFAULT_QUESTION_CLASS,
    OTHER_ROLE_LABEL,
    QUESTION_CLASSES,
    ROLE_LABELS,
    TIME_PHRASES,
)
from docintake.functions import text
from docintake.operators.ordering import previous_rows, running_total

# --- questions ---------------------------------------------------------------


def question_class(question: Column, rules: Sequence[tuple[str, Sequence[str]]] = QUESTION_CLASSES) -> Column:
    return text.first_class(question, rules, DEFAULT_QUESTION_CLASS)


def is_time_question(question: Column, phrases: Sequence[str] = TIME_PHRASES) -> Column:
    return text.contains_any(question, phrases)


def guard_status(question: Column, has_records: Column) -> Column:
    """``empty_question``, ``empty_dataset`` or ``ok``."""
    return (
        F.when(text.is_blank(question), F.lit("empty_question"))
        .when(~has_records, F.lit("empty_dataset"))
        .otherwise(F.lit("ok"))
    )


def routed(questions: DataFrame, records: DataFrame, phrases: Sequence[str] = TIME_PHRASES) -> DataFrame:
    """Adds ``status`` and ``route``: ``none``, ``clock`` or ``model``."""
    status = guard_status(F.col("question"), records.exists())
    route = (
        F.when(F.col("status") != "ok", F.lit("none"))
        .when(is_time_question(F.col("question"), phrases), F.lit("clock"))
        .otherwise(F.lit("model"))
    )
    return questions.withColumn("status", status).withColumn("route", route)


def clock_answer(at: Column) -> Column:
    return F.concat(F.lit("Bây giờ là "), F.date_format(at, "yyyy-MM-dd HH:mm:ss"))


# --- conversation frames -----------------------------------------------------


def numbered_turns(conversations: DataFrame, total: str | None = None) -> DataFrame:
    """``no``: the place of each turn in its conversation, from 1; turns that share a number go by role and text."""
    return running_total(conversations, turn_order(), ["conv_id"], out="no", total=total)


def turn_order() -> list[Column]:
    return [F.col("turn"), F.col("role"), F.xxhash64("text")]


def context_frame(conversations: DataFrame, window: int = CONTEXT_MESSAGES) -> DataFrame:
    """``context``: the messages before each one among the last ``window``, oldest first."""
    item = F.struct("role", F.col("text").alias("content"))
    return previous_rows(numbered_turns(conversations), ["conv_id"], "no", window - 1, item, "context")


def exchanges(conversations: DataFrame) -> DataFrame:
    """One row per user turn: its running number and the first answer after it."""
    asked = F.when(F.col("role") == "user", 1).otherwise(0)
    counted = running_total(conversations, turn_order(), ["conv_id"], value=asked, out="exchange")
    told = counted.where((F.col("exchange") > 0) & F.col("role").isin("user", "assistant"))
    first_reply = F.min(F.when(F.col("role") == "assistant", F.struct("turn", "text")))["text"]
    return told.groupBy("conv_id", "exchange").agg(
        F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("turn"),
        F.max(F.when(F.col("role") == "user", F.col("text"))).alias("question"),
        first_reply.alias("answer"),
    )


def exchange_frame(conversations: DataFrame, window: int = CONTEXT_EXCHANGES) -> DataFrame:
    """``context``: the last ``window`` exchanges before each question; blank messages skipped."""
    pair = F.array(
        F.struct(F.lit("user").alias("role"), F.col("question").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")),
    )
    framed = previous_rows(exchanges(conversations), ["conv_id"], "exchange", window, pair, "context")
    return framed.withColumn(
        "context", F.filter(F.flatten("context"), lambda m: F.coalesce(m["content"], F.lit("")) != "")
    )


# --- transcript --------------------------------------------------------------


def role_label(role: Column) -> Column:
    label = F
    for name, shown in ROLE_LABELS.items():
        label = label.when(role == name, F.lit(shown))
    return label.otherwise(F.lit(OTHER_ROLE_LABEL))


def transcript_sections(conversations: DataFrame, title: str = "Lịch sử Chat", time: str | None = None) -> DataFrame:
    """Markdown sections ``conv_id, section, body``; section 0 is the header.

    A transcript file is the bodies of a conversation in section order.  The
    sections stay rows, so a conversation of any length is never one value.
    """
    placed = numbered_turns(conversations, total="n")
    shown = F.substring(F.col(time).cast("string"), 1, 19) if time else F.lit("")
    body = F.concat(
        F.format_string("## Tin nhắn %d - %s\n", "no", role_label(F.col("role"))),
        F.format_string("**Thời gian:** %s\n\n", shown),
        F.format_string("%s\n\n---\n\n", F.coalesce("text", F.lit(""))),
    )
    header = F.format_string(f"# {title}\n\nTổng số tin nhắn: %d\n\n---\n\n", "n")
    both = F.when(
        F.col("no") == 1,
        F.array(
            F.struct(F.lit(0).cast("long").alias("section"), header.alias("body")),
            F.struct(F.col("no").alias("section"), body.alias("body")),
        ),
    ).otherwise(F.array(F.struct(F.col("no").alias("section"), body.alias("body"))))
    return placed.select("conv_id", F.inline(both))


def transcript_json(conversations: DataFrame, time: str | None = None) -> DataFrame:
    """One JSON object per message: ``conv_id, no, line``."""
    at = F.col(time).cast("string") if time else F.lit("")
    message = F.struct("role", F.col("text").alias("content"), at.alias("timestamp"))
    return numbered_turns(conversations).select("conv_id", "no", F.to_json(message).alias("line"))


# --- log ---------------------------------------------------------------------


def log_entries(answered: DataFrame, rules: Sequence[tuple[str, Sequence[str]]] = QUESTION_CLASSES) -> DataFrame:
    """Log rows with the lengths in characters and the question class."""
    return answered.select(
        "pos",
        "timestamp",
        "question",
        "answer",
        F.length("question").cast("long").alias("question_length"),
        F.length("answer").cast("long").alias("answer_length"),
        question_class(F.col("question"), rules).alias("question_type"),
    )


def retained(
    log: DataFrame,
    order: str = "pos",
    keys: Sequence[str] = (),
    high: int = CHAT_LOG_HIGH,
    low: int = CHAT_LOG_LOW,
    before_append: bool = False,
) -> DataFrame:
    """Logs longer than ``high`` keep their last ``low`` rows.

    The chat log is checked after an append.  With ``before_append`` the check
    is made without the newest row, which is then always added, as the session
    log does it.
    """
    extra = 1 if before_append else 0
    kept = low + extra
    if not keys:
        # a count and a sort with a limit; nothing else is shuffled
        count = log.agg(F.count(F.lit(1))).scalar() - extra
        newest = log.orderBy(F.col(order).desc()).limit(kept)
        return log.where(count <= high).unionByName(newest.where(count > high))
    placed = running_total(log, [F.col(order)], keys, out="__pos", total="__n")
    n = F.col("__n") - extra
    return placed.where((n <= high) | (F.col("__pos") > F.col("__n") - kept)).drop("__pos", "__n")


def last_lines(log: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The newest ``n`` lines as ``[time] LEVEL: message``."""
    line = F.format_string("[%s] %s: %s", "timestamp", F.coalesce("level", F.lit("INFO")), "message")
    return log.orderBy(*order).limit(n).select(line.alias("line"))


def chat_stats_by_type(log: DataFrame) -> DataFrame:
    kind = F.coalesce("question_type", F.lit(DEFAULT_QUESTION_CLASS)).alias("question_type")
    return log.groupBy(kind).agg(F.count(F.lit(1)).alias("chats"))


def chat_stats_by_log(logs: DataFrame, entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for every log, with zeros for those without entries (missing, empty or corrupt)."""
    sums = entries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_chats"),
        F.round(F.avg("question_length"), 1).alias("average_question"),
        F.round(F.avg("answer_length"), 1).alias("average_answer"),
        F.max("timestamp").alias("last_chat"),
    )
    found = logs.select(*keys).join(sums, list(keys), "left")
    zeros = {n: F.coalesce(n, F.lit(0)) for n in ("total_chats", "average_question", "average_answer")}
    return found.withColumns(zeros)


def chat_stats(log: DataFrame) -> DataFrame:
    """One row; an empty log gives zeros and an empty map.

    First one row per question class (combined before the shuffle), then the
    few classes are folded into the totals and the map.
    """
    kind = F.coalesce("question_type", F.lit(DEFAULT_QUESTION_CLASS)).alias("question_type")
    per_class = log.groupBy(kind).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce("question_length", F.lit(0))).alias("q"),
        F.sum(F.coalesce("answer_length", F.lit(0))).alias("a"),
        F.max(F.struct("pos", "timestamp")).alias("last"),
    )

    def mean(c: str) -> Column:
        return F.coalesce(F.round(F.try_divide(F.sum(c), F.sum("n")), 1), F.lit(0.0))

    return per_class.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_chats"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("question_type", "n")))).alias("question_types"),
        mean("q").alias("average_question"),
        mean("a").alias("average_answer"),
        F.max("last")["timestamp"].alias("last_chat"),
    )


def role_counts(conversations: DataFrame, time: str) -> DataFrame:
    """Per conversation: messages, user and assistant messages, start time to the second."""
    first = F.min(F.struct("turn", F.col(time).cast("string").alias("at")))["at"]
    return conversations.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.col("role") == "user").alias("user_messages"),
        F.count_if(F.col("role") == "assistant").alias("assistant_messages"),
        F.substring(first, 1, 19).alias("started"),
    )


