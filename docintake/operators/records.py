"""The record table: sent times, extraction results, projection, order."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docintake.fixed_values import COL_SENT, COL_SOURCE, INFO_KEYS, RECORD_COLUMNS, RECORD_FROM_INFO
from docintake.functions import answers, text, times
from docintake.operators.ordering import global_position

SIMPLE_COLUMNS = [
    COL_SOURCE,
    "Họ tên",
    "Tuổi",
    "Email",
    "Điện thoại",
    "Địa chỉ",
    "Vị trí",
    "Học vấn",
    "Kinh nghiệm",
    "Kỹ năng",
]


def with_sent_time(
    files: DataFrame, key: str, stored: DataFrame, fetched: DataFrame | None = None, out: str = "sent_iso"
) -> DataFrame:
    """Left join with the sent times; times of this fetch go before stored ones.

    ``stored`` and ``fetched`` have one row per key.  No hint: Spark broadcasts
    a side that is small by its statistics and shuffles both sides otherwise.
    """
    value = F.col("__stored")
    joined = files.join(stored.select(key, F.col("sent_iso").alias("__stored")), key, "left")
    if fetched is not None:
        joined = joined.join(fetched.select(key, F.col("sent_iso").alias("__fetched")), key, "left")
        value = F.coalesce(F.col("__fetched"), F.col("__stored"))
    return joined.withColumn(out, F.coalesce(value, F.lit(""))).drop("__stored", "__fetched")


def in_time_range(
    files: DataFrame, sent_iso: str = "sent_iso", start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """From ``start`` on and before ``end``, as ``times.day_bounds`` gives them.

    Rows without a readable time go only if a bound is given.
    """
    instant = times.parse_iso(F.col(sent_iso))
    if start is not None:
        files = files.where(instant >= start)
    if end is not None:
        files = files.where(instant < end)
    return files


def with_regex_info(documents: DataFrame, source_text: str = "text", out: str = "info") -> DataFrame:
    """Fields by regular expressions from the whole text; blank text gives blank fields."""
    whole = documents.withColumn("__text", F.coalesce(F.col(source_text), F.lit("")))
    whole = whole.withColumn("__folded", text.fold_case(F.col("__text")))
    return whole.withColumn(out, text.extract_info(F.col("__text"), F.col("__folded"))).drop("__text", "__folded")


def resolved_answers(responses: DataFrame) -> DataFrame:
    """Per document its fields from recorded answers, of which every attempt counts.

    A block of a document is answered by its first attempt that yields a
    usable object; a field is the first non-empty one over the blocks.
    Without a column ``block`` a document is one block.
    """
    if "block" not in responses.columns:
        responses = responses.withColumn("block", F.lit(0))
    parsed = answers.with_answer_info(responses.where(F.col("error").isNull()), "response")
    # unusable answers are null and lose in the minimum; a filter would parse every answer twice
    first = F.min(F.when(F.col("info").isNotNull(), F.struct("attempt", "info"))).alias("first")
    blocks = parsed.groupBy("doc_id", "block").agg(first).where(F.col("first").isNotNull())
    blocks = blocks.select("doc_id", "block", "first.attempt", "first.info.*")

    def filled(key: str) -> Column:
        return F.min(F.when(F.col(key) != "", F.struct("block", F.col(key).alias("value")))).alias(key)

    found = blocks.groupBy("doc_id").agg(F.min("attempt").alias("attempt"), *map(filled, INFO_KEYS))
    info = F.struct(*[F.coalesce(f"{k}.value", F.lit("")).alias(k) for k in INFO_KEYS])
    return found.select("doc_id", info.alias("llm_info"), "attempt")


def with_info(documents: DataFrame, responses: DataFrame, source_text: str = "text") -> DataFrame:
    """Model fields where an attempt succeeded, regex fields elsewhere."""
    joined = documents.join(resolved_answers(responses), "doc_id", "left")
    found = with_regex_info(joined, source_text, out="__regex")
    given = ~text.is_blank(F.col(source_text)) & F.col("llm_info").isNotNull()
    return found.withColumn("info", F.when(given, F.col("llm_info")).otherwise(F.col("__regex"))).drop(
        "__regex", "llm_info"
    )


def record_columns(sent: Column, source: Column, info: str = "info") -> list[Column]:
    """The eleven columns; an absent value is the empty text."""
    fields = [F.coalesce(F.col(f"{info}.{k}"), F.lit("")).alias(c) for c, k in RECORD_FROM_INFO.items()]
    return [F.coalesce(sent, F.lit("")).alias(COL_SENT), text.base_name(source).alias(COL_SOURCE), *fields]


def to_records(rows: DataFrame, source: str, sent_iso: str = "sent_iso", keep: Sequence[str] = ()) -> DataFrame:
    """Record table with the sent time shown for people."""
    shown = times.format_sent_time(F.col(sent_iso))
    return rows.select(*keep, *record_columns(shown, F.col(source)))


def to_simple_records(rows: DataFrame, source: str) -> DataFrame:
    """The ten-column variant without the sent time."""
    by_name = dict(zip(RECORD_COLUMNS, record_columns(F.lit(""), F.col(source)), strict=True))
    return rows.select(*[by_name[c] for c in SIMPLE_COLUMNS])


def newest_first(sent_iso: Column, source: Column) -> list[Column]:
    """Order by the instant, records without a time last, then by source."""
    return [times.parse_iso(sent_iso).desc_nulls_last(), source.asc()]


def ranked_records(rows: DataFrame, source: str, sent_iso: str = "sent_iso") -> DataFrame:
    """Records with their place in the newest-first order."""
    named = to_records(rows.withColumn("__t", times.parse_iso(F.col(sent_iso))), source, sent_iso, keep=["__t"])
    return global_position(named, [F.col("__t").desc_nulls_last(), F.col(COL_SOURCE).asc()]).drop("__t")


def inventory(files: DataFrame, sent_iso: str = "sent_iso") -> DataFrame:
    """Landed files: name, size text, sent-time text and place, newest first.

    ``files`` has ``safe_name, length, modificationTime`` and the sent time;
    a file without a readable sent time sorts by its modification time.
    """
    instant = F.coalesce(times.parse_iso(F.col(sent_iso)), F.col("modificationTime"))
    rows = files.select(
        F.col("safe_name").alias("file"),
        text.size_text(F.col("length")).alias("size"),
        times.format_sent_time(F.col(sent_iso)).alias("sent"),
        instant.alias("__t"),
    )
    return global_position(rows, [F.col("__t").desc(), F.col("file").asc()]).drop("__t")
