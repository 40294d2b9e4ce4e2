"""Small helpers of this subpackage."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docintake.session import shared_folder

THIN = 1 << 20


def text_of(name: str = "text") -> Column:
    """A text column, null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def identity(doc_id: str, text: Column) -> Column:
    """What tells documents apart, as one string: the id, and a hash of the text for ids that repeat."""
    shown = F.coalesce(F.concat(F.lit("="), F.col(doc_id).cast("string")), F.lit("-"))
    return F.concat(shown, F.lit("|"), F.hex(F.xxhash64(text)))


def kept(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table once to the folder all executors share, with the writer's options, and read it back.

    Cuts the lineage, and fixes what a second evaluation could change.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        session = df.sparkSession
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = session._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(THIN))


def thinned(rows: DataFrame, key: Column, wanted: DataFrame, name: str, rest: bool = False) -> DataFrame:
    """The rows whose key may be among the wanted ones, or with ``rest`` the others, without a shuffle.

    Only the hash buckets of the wanted keys are broadcast, ``THIN`` numbers
    at most.  A few other rows pass as well; where all buckets are wanted, all
    rows do, and the join that follows gets them as it would without this.
    """
    buckets = wanted.select(bucket(F.col(name)).alias("__b")).distinct()
    marked = rows.withColumn("__b", bucket(key))
    return marked.join(F.broadcast(buckets), "__b", "left_anti" if rest else "left_semi").drop("__b")


def groups_of(df: DataFrame, size: int) -> int:
    """How many groups of about ``size`` rows a written table makes."""
    return max(1, math.ceil(df.count() / size))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def numbered(df: DataFrame, *order: Column, out: str) -> DataFrame:
    """Number the rows of a written table from 1 along an order.

    A range-partitioned sort is written once; a row's number is its place in
    its partition plus one offset per partition.
    """
    parts = kept(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()), "numbered")
    parts = parts.withColumn("__part", F.shiftright("__id", 33))
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return parts.join(F.broadcast(offsets), "__part").withColumn(out, place).drop("__id", "__part", "__before")
