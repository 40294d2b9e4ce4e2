"""Small tables that are replaced as a whole, so that a reader always finds the old one or the new one.

A new table goes into a folder of its own, numbered one higher; only when all
of it is there is a pointer of that number put beside it.  Readers follow the
highest pointer.  A run that dies earlier leaves a folder that nothing points
to and that the next run replaces.
"""

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

POINTERS = "current"


def _files(spark: SparkSession, path: str):
    """A path of the shared file system, and that file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder."""
    at, system = _files(spark, path)
    return system.exists(at)


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the pointers, two or three of them at most."""
    at, system = _files(spark, f"{folder}/{POINTERS}")
    if not system.exists(at):
        return []
    return sorted(int(name) for s in system.listStatus(at) if (name := s.getPath().getName()).isdigit())


def current(spark: SparkSession, folder: str) -> int:
    """The number of the generation to read; 0 before the first one."""
    return max(numbers(spark, folder), default=0)


def place(folder: str, number: int, table: str) -> str:
    return f"{folder}/generation-{number}/{table}"


def replace(tables: Mapping[str, DataFrame], folder: str) -> int:
    """Write the next generation of one or more tables that belong together, then point to it.

    The tables may be computed from the generation before, which stays for
    readers under way; older ones go.
    """
    spark = next(iter(tables.values())).sparkSession
    before = numbers(spark, folder)
    number = max(before, default=0) + 1
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(place(folder, number, name))
    point(spark, folder, number)
    for old in before[:-1]:
        for path in (f"{folder}/{POINTERS}/{old}", f"{folder}/generation-{old}"):
            at, system = _files(spark, path)
            system.delete(at, True)
    return number


def point(spark: SparkSession, folder: str, number: int) -> None:
    at, system = _files(spark, f"{folder}/{POINTERS}/{number}")
    system.create(at, True).close()


def point_on(spark: SparkSession, folder: str, number: int) -> None:
    """Put a pointer and take away the earlier ones."""
    before = numbers(spark, folder)
    point(spark, folder, number)
    for old in before:
        at, system = _files(spark, f"{folder}/{POINTERS}/{old}")
        system.delete(at, False)


def read(spark: SparkSession, folder: str, table: str, schema: T.StructType) -> DataFrame:
    """A table of the current generation; empty before the first one."""
    number = current(spark, folder)
    if not number:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(place(folder, number, table))
