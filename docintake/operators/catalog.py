"""Look-ups in small dimensions and catalogue merging."""


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docintake.operators.intake import left_or_right


def with_label(rows: DataFrame, key: str, dimension: DataFrame, value: str, unknown: str = "unknown") -> DataFrame:
    """Adds the looked-up value, or ``unknown``, and the label ``key (value)``.

    ``dimension`` has one row per key.  Spark broadcasts it if it is small.
    """
    joined = rows.join(dimension.select(key, F.col(value).alias("__v")), key, "left")
    joined = joined.withColumn(value, F.coalesce("__v", F.lit(unknown))).drop("__v")
    plain = F.col(key).cast("string")
    shown = F.concat(plain, F.lit(" ("), F.col(value), F.lit(")"))
    return joined.withColumn("label", F.when(F.col(value) == unknown, plain).otherwise(shown))


def merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct union; each side loses its duplicates before the shuffle."""
    return left.union(right).distinct()


def catalogue(available: DataFrame, fallback: DataFrame, merge: bool) -> DataFrame:
    """Both lists merged, or the fallback only when nothing is available; sorted."""
    both = merged(available, fallback) if merge else left_or_right(available, fallback)
    return both.orderBy(*both.columns)


