"""Order-dependent operators that stay spread out when one key is huge.

A plain window sorts a whole key (or, without a key, the whole table) in one
task.  Here the rows are sorted once into range partitions, which are written
to the shared folder; a key may span as many of them as it needs.  Windows run
inside one partition of one key, and the sums of whole partitions, at most one
row per key and partition, give every partition its offset.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docintake.session import written

SEGMENT_BITS = 16


def elements(array: str) -> Column:
    """A computed array column as the input of explode.

    Around a bare column the optimizer infers a size filter, pushes it below
    the projection and so computes the array twice; around an expression not.
    """
    return F.array_compact(array)


def sorted_parts(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows with ``__id``, which counts up along the order, and ``__part``, the range partition it lies in.

    Rows are written to the shared folder before the sort, which reads its
    input twice, and after it, which fixes the place of rows that tie.
    """
    placed = written(df, "unsorted").orderBy(*order).withColumn("__id", F.monotonically_increasing_id())
    return written(placed, "sorted").withColumn("__part", F.shiftright("__id", 33))


def running_total(
    df: DataFrame,
    order: Sequence[Column],
    keys: Sequence[str] = (),
    value: Column | None = None,
    out: str = "running",
    total: str | None = None,
) -> DataFrame:
    """Running sum of ``value`` (default 1: the position) along an order within ``keys``.

    Any sortable columns will do: dense, sparse or hashed.  Rows that tie
    follow each other in a fixed but arbitrary order; name a tie-breaker to
    choose it.  ``total`` names an optional column with the sum per key.
    """
    value = (F.lit(1) if value is None else value).cast("long")
    # a struct, so that null keys match and join and window share one shuffle
    cut = sorted_parts(df, [*map(F.col, keys), *order]).withColumn("__seg", F.struct(*keys, "__part"))
    parts = cut.groupBy("__seg").agg(F.sum(value).alias("__sum")).select(F.col("__seg").alias("__at"), "__sum", "__seg.*")
    # one row per key and partition
    along = Window.partitionBy(*keys)
    before = F.sum("__sum").over(along.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    placed = parts.select("__at", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__sum").over(along).alias("__all"))

    joined = cut.join(placed, F.col("__seg") == F.col("__at"))
    up_to_here = Window.partitionBy("__seg").orderBy("__id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {out: F.col("__before") + F.sum(value).over(up_to_here)} | ({total: F.col("__all")} if total else {})
    return joined.withColumns(sums).drop("__id", "__part", "__seg", "__at", "__before", "__all")


def previous_rows(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    n: int,
    item: Column,
    out: str,
    bits: int = SEGMENT_BITS,
) -> DataFrame:
    """The items of the ``n`` rows before each row, oldest first.

    ``position`` is dense within ``keys``.  Every segment gets a copy of the
    last ``n`` rows of the segment before it, so no frame looks further.
    """
    width = 1 << bits
    if n >= width:
        raise ValueError("frame longer than a segment")
    home = F.shiftright(F.col(position).cast("long"), bits)
    at_end = F.pmod(F.col(position).cast("long"), F.lit(width)) >= width - n
    copies = df.withColumn("__seg", F.explode(F.when(at_end, F.array(home, home + 1)).otherwise(F.array(home))))
    frame = Window.partitionBy(*keys, "__seg").orderBy(position).rowsBetween(-n, -1)
    framed = copies.withColumn(out, F.collect_list(item).over(frame))
    return framed.where(F.col("__seg") == home).drop("__seg")


def global_position(df: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Number all rows from 1 along any order: the place in the partition plus one offset per partition."""
    parts = sorted_parts(df, order)
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        parts.join(F.broadcast(offsets), "__part")
        .withColumn(out, F.col("__before") + local + 1)
        .drop("__id", "__part", "__before")
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """Per key the values of the row with the greatest order; combined before the shuffle."""
    best = F.max(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *values)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__best.{v}").alias(v) for v in values])
