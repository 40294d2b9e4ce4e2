"""Large CSV files with line breaks inside cells, read by as many tasks as they have splits.

Whether a line break ends a record depends on all quotes before it.  Quotes
only count modulo two, and sums of whole splits, one row each, tell every
split the parity it starts with; so each split finds its own records.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docintake.session import written
from docintake.sources.tables import CSV

def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, line, quotes): every line with its split and its place, written."""
    lines = spark.read.option("lineSep", "\n").text(path)
    rows = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line"),
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"),
    )
    return written(rows, "csv-lines")


def records(lines: DataFrame) -> DataFrame:
    """(file, block, at, record): every record as one text, with its first line's place."""
    # one row per split
    sums = lines.groupBy("file", "block").agg(F.sum("quotes").alias("__sum"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parity = sums.select("file", "block", F.pmod(F.coalesce(F.sum("__sum").over(before), F.lit(0)), F.lit(2)).alias("__odd"))

    along = Window.partitionBy("file", "block").orderBy("at")
    up_to = F.coalesce(F.sum("quotes").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(parity, ["file", "block"]).withColumn("__starts", F.pmod(F.col("__odd") + up_to, F.lit(2)) == 0)
    alone = F.col("__starts") & (F.col("quotes") % 2 == 0)
    first = F.last(F.when(F.col("__starts"), F.struct("block", "at")), ignorenulls=True).over(along)
    placed = written(placed.withColumns({"__alone": alone, "__first": first}), "csv-records")

    # most records are one line; the lines of the others meet, also those that a split cuts off its first line
    whole = placed.where("__alone").select("file", "block", "at", F.col("line").alias("record"))
    parts = placed.where("not __alone")
    last = parts.groupBy("file", "block").agg(F.max("__first").alias("__last"))
    last = placed.select("file", "block").distinct().join(last, ["file", "block"], "left")
    carried = last.select("file", "block", F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    joined = parts.join(carried, ["file", "block"]).withColumn("__first", F.coalesce("__first", "__carried"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "line"))), lambda x: x["line"])
    long = joined.groupBy("file", "__first").agg(F.array_join(texts, "\n").alias("record"))
    return whole.unionByName(long.select("file", "__first.*", "record"))


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a CSV file or a folder of them, each with a header, in the form that :func:`tables.write_csv` writes.

    Cells may hold line breaks, quotes are doubled.  Texts come as they are,
    and empty cells as the empty text.  Blank lines between records are left
    out.  The files are cut as ``spark.sql.files.maxPartitionBytes`` says.
    """
    found = records(split_lines(spark, path))
    place: Column = F.struct("block", "at")
    heads = found.groupBy("file").agg(F.min(place).alias("__head"))
    rows = found.join(heads, "file").where((place != F.col("__head")) & (F.rtrim("record", F.lit("\r")) != ""))
    options = {k: v for k, v in CSV.items() if k not in ("header", "encoding")}
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    parsed = F.from_csv(F.rtrim("record", F.lit("\r")), columns, {**options, "maxCharsPerColumn": "-1"})
    return rows.select(parsed.alias("__row")).select("__row.*").na.fill("")
