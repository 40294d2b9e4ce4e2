"""Connected components of a distributed edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docintake.llm.common import kept

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node reachable.

    Large-star and small-star steps in turn: every step moves links towards
    smaller nodes, keeps their number and ends in stars.  A step is two joins
    of the links with one smallest neighbour per node, which is combined
    before its shuffle.  Links are written to the shared folder each round.
    """
    links = kept(edges.select("a", "b").where("a <> b").distinct(), "links")
    state = None
    for _ in range(MOST_ROUNDS):
        links = kept(small_star(large_star(links)), "links")
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == state:
            break
        state = mark
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return roots.union(roots.select(F.col("root"), F.col("root"))).distinct()


def large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the smallest node of its neighbourhood."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("at")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, link to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), "m")
    moved = down.join(least, F.col("a") == F.col("at")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("at").alias("a"), F.col("m").alias("b"))
    return moved.union(own).where("a <> b").distinct()
