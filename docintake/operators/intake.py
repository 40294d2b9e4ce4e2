"""Message intake: which messages to look at, which attachments to keep and land.

``messages`` has at least ``uid``, ``subject``, ``body`` and ``parts``
(``array<struct<part_no, filename, ...>>``).
"""

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docintake.fixed_values import (
    DEFAULT_KEYWORDS,
    DOCUMENT_SUFFIXES,
    FETCH_BATCH,
    OBVIOUS_NAME_WORDS,
    RECENT_MESSAGES,
)
from docintake.functions import text
from docintake.operators.ordering import elements, global_position, latest_per_key

# --- which messages ----------------------------------------------------------


def unseen(messages: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """Messages without the seen flag, or not in the table of processed ids."""
    if processed is None:
        return messages.where(~F.col("seen"))
    return messages.join(processed.select("uid"), "uid", "left_anti")


def in_window(messages: DataFrame, day: Column, since: date | None = None, before: date | None = None) -> DataFrame:
    """Messages from ``since`` on, the ``before`` day included."""
    if since is not None:
        messages = messages.where(day >= F.lit(since))
    if before is not None:
        messages = messages.where(day < F.date_add(F.lit(before), 1))
    return messages


def after_mark(messages: DataFrame, mark: int | DataFrame, ignore: bool = False) -> DataFrame:
    """Messages above the high-water mark; mark 0 means none was stored.

    The mark is a number or the one-row state table; both reach the scan as a
    filter on ``uid``.
    """
    if ignore or mark == 0:
        return messages
    value = mark.scalar() if isinstance(mark, DataFrame) else F.lit(mark)
    return messages.where((F.col("uid") > value) | (value == 0))


def recent(messages: DataFrame, n: int = RECENT_MESSAGES) -> DataFrame:
    """The last ``n`` messages when a search is not possible; ids sort as numbers."""
    return messages.orderBy(F.col("uid").cast("long").desc()).limit(n)


def numbered_batches(messages: DataFrame, size: int = FETCH_BATCH) -> DataFrame:
    """Newest first in batches of ``size``; ``batch`` counts from 0."""
    placed = global_position(messages, [F.col("uid").desc()], out="__pos")
    return placed.withColumn("batch", F.floor((F.col("__pos") - 1) / F.lit(size)).cast("long")).drop("__pos")


# --- which attachments -------------------------------------------------------


def keyword_hit(subject: Column, body: Column, keywords: Sequence[str] = DEFAULT_KEYWORDS) -> Column:
    """Any keyword as a substring of subject, line feed and body."""
    whole = F.concat(F.coalesce(subject, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))
    return text.contains_any(whole, keywords)


def judged_parts(
    messages: DataFrame,
    keywords: Sequence[str] = DEFAULT_KEYWORDS,
    suffixes: Sequence[str] = DOCUMENT_SUFFIXES,
    words: Sequence[str] = OBVIOUS_NAME_WORDS,
) -> DataFrame:
    """Messages with ``kw`` and ``kept``: document parts that pass the keep rule, best first.

    A part is kept if its name is obvious or its message has a keyword.  All
    of it happens inside the message row, so nothing is shuffled.  Obvious
    names come first, then the order inside the message.  Parts whose payload
    could not be decoded are marked, not left out.
    """
    judged = messages.withColumn("kw", keyword_hit(F.col("subject"), F.col("body"), keywords))

    def judge(p: Column) -> Column:
        return F.struct(
            (~text.obvious_name(p["filename"], words)).alias("plain"),
            p["part_no"].alias("part_no"),
            p["filename"].alias("filename"),
            p["content"].isNotNull().alias("readable"),
        )

    documents = F.filter("parts", lambda p: text.suffix(p["filename"]).isin(list(suffixes)))
    judged = judged.withColumn("documents", F.array_sort(F.transform(documents, judge)))
    obvious = F.filter("documents", lambda p: ~p["plain"])
    return judged.withColumn("kept", F.when(F.col("kw"), F.col("documents")).otherwise(obvious))


def worth_processing() -> Column:
    """A message is skipped when nothing is kept and no keyword occurs."""
    return F.col("kw") | (F.size("kept") > 0)


def kept_parts(judged: DataFrame, *carry: str) -> DataFrame:
    """One row per kept part with a payload: ``uid, part_no, filename, safe_name, obvious, priority``.

    A part without one must not win its name from an older readable copy.
    """
    rows = judged.select("uid", *carry, F.posexplode(elements("kept")).alias("__i", "p"))
    return rows.where("p.readable").select(
        "uid",
        *carry,
        F.col("p.part_no").alias("part_no"),
        F.col("p.filename").alias("filename"),
        text.sanitize_name(F.col("p.filename")).alias("safe_name"),
        (~F.col("p.plain")).alias("obvious"),
        (F.col("__i") + 1).cast("long").alias("priority"),
    )


def first_wins(rows: DataFrame, *carry: str) -> DataFrame:
    """One row per sanitised name: newest message, then obvious names, then part order."""
    newest = [F.col("uid"), F.col("obvious"), -F.col("part_no")]
    return latest_per_key(rows, ["safe_name"], newest, ["uid", "obvious", "part_no", *carry])


def not_landed(rows: DataFrame, landed: DataFrame) -> DataFrame:
    """Rows whose name has not been landed by an earlier run."""
    return rows.join(landed.select("safe_name"), "safe_name", "left_anti")


def known_names(rows: DataFrame, landed: DataFrame) -> DataFrame:
    """The landed names among those of some rows.

    The landed table grows for ever while a run is small.  The names of the
    run go to the landed table, where Spark can broadcast them, so that the
    table is only scanned and never shuffled for a small run.
    """
    names = rows.select("safe_name").distinct()
    return landed.select("safe_name").join(names, "safe_name", "left_semi").distinct()


def to_land(rows: DataFrame, landed: DataFrame, *carry: str) -> DataFrame:
    """First-wins rows that are new.

    The anti-join comes first: it shuffles only narrow rows and spares the
    aggregate every name that is already there.
    """
    return first_wins(not_landed(rows, landed), *carry)


def with_content(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """Payloads of the rows to land."""
    payloads = messages.select("uid", F.inline(elements("parts"))).select("uid", "part_no", "content")
    return rows.join(payloads, ["uid", "part_no"]).where(F.col("content").isNotNull())


# --- state -------------------------------------------------------------------


def upsert(state: DataFrame, updates: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """Last write wins per key; state rows are older than every update; null becomes empty."""
    old = state.select(key, F.coalesce(value, F.lit("")).alias(value), F.lit(0).alias("gen"), F.col(seq).cast("long"))
    new = updates.select(key, F.coalesce(value, F.lit("")).alias(value), F.lit(1).alias("gen"), F.col(seq).cast("long"))
    return latest_per_key(old.unionByName(new), [key], [F.col("gen"), F.col(seq)], [value])


def advance_mark(state: DataFrame, fetched: DataFrame) -> DataFrame:
    """One row ``mark``: the larger of the stored mark and the largest fetched id."""
    stored = state.select(F.col("mark").cast("string").try_cast("long").alias("mark"))
    seen = fetched.select(F.col("uid").alias("mark"))
    return stored.unionByName(seen).agg(F.coalesce(F.max("mark"), F.lit(0)).cast("long").alias("mark"))


def processed_rows(judged: DataFrame) -> DataFrame:
    """Every fetched id with the fact whether the message was kept."""
    return judged.select("uid", worth_processing().alias("kept"))


def run_counters(judged: DataFrame, landed_now: DataFrame) -> DataFrame:
    """Messages processed, messages with kept parts, parts found, files landed."""
    per_message = judged.agg(
        F.count(F.lit(1)).alias("messages_processed"),
        F.count_if(F.size("kept") > 0).alias("messages_with_attachments"),
        F.coalesce(F.sum(F.size("kept")), F.lit(0)).alias("attachments_found"),
    )
    per_file = landed_now.agg(F.count(F.lit(1)).alias("files_landed"))
    # two tables of exactly one row each
    return per_message.select("*", per_file.scalar().alias("files_landed"))


def failures(rows: DataFrame, error: str = "error") -> DataFrame:
    """One row for a run: how many rows failed, and the last error by place ``uid`` or ``path``."""
    place = "uid" if "uid" in rows.columns else "path"
    failed = F.col(error).isNotNull()
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(failed).alias("failed"),
        F.max(F.when(failed, F.struct(place, F.col(error).alias("error"))))["error"].alias("last_error"),
    )


def left_or_right(left: DataFrame, right: DataFrame) -> DataFrame:
    """The left table, or the right one when the left is empty, in one plan."""
    return left.unionByName(right.where(~left.exists()))
