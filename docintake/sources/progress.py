"""Progress of a run as rows: how many rows each step handled, and how many of them failed.

Rows are counted while they pass, by one ``Observation`` a step; nothing is
read twice for it.
"""

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROGRESS = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("no", T.IntegerType()),
        T.StructField("step", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("failed", T.LongType()),
    ]
)


class Progress:
    """The steps of one run, in the order they were named."""

    def __init__(self, spark: SparkSession, folder: str, run: str):
        self.spark = spark
        self.folder = folder
        self.run = run
        self.steps: list[tuple[str, Observation]] = []

    def step(self, name: str, rows: DataFrame, failed: Column | None = None) -> DataFrame:
        """The rows as they are, counted when they are first computed."""
        seen = Observation(f"{self.run}-{len(self.steps)}-{name}")
        self.steps.append((name, seen))
        bad = F.lit(False) if failed is None else failed
        return rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("failed"))

    def write(self) -> DataFrame:
        """Store the counts of all steps, which must have been computed; a repeated run replaces its rows."""
        found = [(self.run, no, name, seen.get["rows"], seen.get["failed"]) for no, (name, seen) in enumerate(self.steps, 1)]
        rows = self.spark.createDataFrame(found, PROGRESS)
        rows.drop("run").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/run={self.run}")
        return rows


def read_progress(spark: SparkSession, folder: str) -> DataFrame:
    """All steps of all runs."""
    return spark.read.schema(T.StructType([*PROGRESS.fields[1:], PROGRESS.fields[0]])).parquet(folder).select(PROGRESS.fieldNames())
