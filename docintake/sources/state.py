"""State files and tables: sent times, high-water mark, processed ids."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docintake.sources import generations

MARK = T.StructType([T.StructField("mark", T.StringType())])


def sent_times_from_text(states: DataFrame, *carry: str) -> DataFrame:
    """JSON objects in ``value`` (name to ISO time) as rows; corrupt text gives no rows."""
    parsed = F.from_json("value", "map<string,string>")
    return states.select(*carry, F.explode(parsed).alias("safe_name", "sent_iso")).withColumn(
        "sent_iso", F.coalesce("sent_iso", F.lit(""))
    )


def import_sent_times(spark: SparkSession, path: str) -> DataFrame:
    """A foreign JSON file of sent times, which is one value; rounds of rows are the form to keep them in."""
    return sent_times_from_text(spark.read.text(path, wholetext=True))


def read_mark(spark: SparkSession, path: str) -> int:
    """The stored high-water mark; 0 when there is none or its value is bad."""
    stored = generations.read(spark, path, "mark", MARK)
    return stored.agg(F.max(F.col("mark").try_cast("long")).alias("mark")).first()["mark"] or 0


def write_mark(mark: DataFrame, path: str) -> None:
    """Store the one-row mark table; a run that dies meanwhile leaves the old one."""
    generations.replace({"mark": mark.select(F.col("mark").cast("string").alias("mark"))}, path)


def reset_mark(spark: SparkSession, path: str) -> None:
    """Forget the mark, so that the next run sees every message."""
    generations.replace({"mark": spark.createDataFrame([], MARK)}, path)
