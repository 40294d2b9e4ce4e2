"""Picks and summaries of a table: top sources, previews, widths, prompts."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docintake.fixed_values import COLUMN_WIDTH_MAX, COLUMN_WIDTH_PADDING, TOP_SOURCES
from docintake.functions import answers, text
from docintake.operators.ordering import elements, global_position


def top_sources(
    told: DataFrame, records: DataFrame, source: str, order: Sequence[Column], n: int = TOP_SOURCES, keys: Sequence[str] = ()
) -> DataFrame:
    """``place, source`` and the columns of the named record: the array of a model's answer, or the first ``n`` records.

    ``told`` has answers in ``response``, one row for each of ``keys``, or one
    row without keys.  Names keep their place in the array; names that no
    record has, which the model made up, stay with empty columns.  A source
    that several records share stands for the first of them.  Answers without
    a list share the first records, which are ``n`` rows cut out once.
    """
    kind = [c for c in records.columns if c not in (source, "source", "place", *keys)]
    listed = answers.with_answer_array(told.select(*keys, "response"), "response", "listed")
    listed = listed.withColumn("listed", F.when(F.size("listed") > 0, F.col("listed")))
    chosen = listed.where(F.col("listed").isNotNull()).select(*keys, F.posexplode(elements("listed")).alias("at", "source"))
    placed = global_position(records, order, "__no").select("__no", F.col(source).alias("source"), F.struct(*kind).alias("record"))
    one = placed.groupBy("source").agg(F.min(F.struct("__no", "record"))["record"].alias("record"))
    named = chosen.join(one, "source", "left").select(*keys, (F.col("at") + 1).cast("long").alias("place"), "source", "record.*")
    fallback = placed.where(F.col("__no") <= n).select(F.col("__no").alias("place"), "source", "record.*")
    unlisted = listed.where(F.col("listed").isNull()).select(*keys)
    few = F.array_sort(F.collect_list(F.struct(*fallback.columns)))
    shared = fallback.agg(few.alias("few"))  # n rows
    found = unlisted.withColumn("few", shared.scalar()).select(*keys, F.inline("few"))
    return named.unionByName(found.select(*named.columns))


def preview(rows: DataFrame, order: Sequence[Column], n: int = 10) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def head_and_tail(rows: DataFrame, key: str, max_rows: int) -> DataFrame:
    """All rows up to ``max_rows``; beyond that the first and the last half of as many.

    Two sorts with a limit; the tail is only cut out of longer tables.
    """
    half = max_rows // 2
    count = rows.agg(F.count(F.lit(1))).scalar()
    short = rows.orderBy(key).limit(max_rows).where(count <= max_rows)
    head = rows.orderBy(key).limit(half).where(count > max_rows)
    tail = rows.orderBy(F.col(key).desc()).limit(half).where(count > max_rows)
    return short.unionByName(head).unionByName(tail)


def dataset_summary(rows: DataFrame) -> DataFrame:
    """Row count and column list; count comes from file footers where the source has them."""
    return rows.agg(
        F.count(F.lit(1)).alias("records"), F.lit(", ".join(rows.columns)).alias("columns")
    )


def file_summary(rows: DataFrame) -> DataFrame:
    """Row count, file name and time of change per file of a file-based table."""
    meta = rows.select("_metadata.file_name", "_metadata.file_modification_time")
    return meta.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("records"),
        F.date_format(F.max("file_modification_time"), "yyyy-MM-dd HH:mm:ss").alias("modified"),
    )


def column_widths(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Display width per column: longest cell or header plus padding, at most the maximum."""
    columns = list(columns or rows.columns)
    longest = rows.agg(
        *[F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)).cast("long").alias(c) for c in columns]
    )
    width = F.least(
        F.greatest(F.col("n"), F.length("column").cast("long")) + COLUMN_WIDTH_PADDING,
        F.lit(COLUMN_WIDTH_MAX).cast("long"),
    )
    return longest.unpivot([], columns, "column", "n").select("column", width.alias("width"))


def csv_chunks(rows: DataFrame, line: Column, order: str, rows_per_chunk_bits: int = 6) -> DataFrame:
    """``chunk, lines``: the table as blocks of CSV lines for prompts.

    A whole table does not fit a prompt; each block holds the rows of one
    stretch of ``2**bits`` order values, and together they hold all rows.
    """
    cut = rows.select(F.shiftright(order, rows_per_chunk_bits).alias("chunk"), F.col(order).alias("__o"), line.alias("__l"))
    ordered = F.array_sort(F.collect_list(F.struct("__o", "__l")))
    return cut.groupBy("chunk").agg(
        F.array_join(F.transform(ordered, lambda x: x["__l"]), "\n").alias("lines"),
        F.count(F.lit(1)).alias("records"),
    )


def question_prompts(chunks: DataFrame, question: str, columns: Sequence[str], system: str) -> DataFrame:
    """``chunk, prompt``: instruction, data block and question as an array of texts."""
    head = F.concat(
        F.lit(system + "\n"), F.format_string("Records: %d\n", "records"), F.lit(f"Columns: {', '.join(columns)}")
    )
    data = F.concat(F.lit(",".join(columns) + "\n"), F.col("lines"))
    return chunks.select("chunk", F.array(head, data, F.lit(question)).alias("prompt"))


def extraction_prompts(documents: DataFrame, instruction: str) -> DataFrame:
    """``doc_id, block, prompt``: instruction and text as the parts of one call, for every block of every text."""
    asked = documents.where(~text.is_blank(F.col("text")))
    blocks = asked.select("doc_id", F.posexplode(text.blocks(F.col("text"))).alias("block", "text"))
    return blocks.select("doc_id", "block", F.array(F.lit(instruction), F.col("text")).alias("prompt"))
