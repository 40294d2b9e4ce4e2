"""Exact dedup by a tree merge of sorted digest runs.

Every input partition leaves one run: its rows' digests, sorted, in the shared
folder.  Runs then meet in rounds.  In a round the runs of ``fan_in`` partners
exchange digest ranges, so that every task merges the same range of all
partners and keeps one entry per text: the smallest identifier and how many
rows it stands for.  A digest counts as the same text only with the same
second hash and the same length.  After the last round one group spans all
runs, cut in ranges over all tasks.  The answers go back to the runs, and the
rows of a run ask their own run's copy, so a text that a third of all rows
share is spread over as many keys as there are runs.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docintake.llm.common import kept, text_of

FAN_IN = 16
ROUNDS = 2
SAME = ("digest", "check", "size")


def normalised(text: Column) -> Column:
    """Each run of blank, tab, line feed, vertical tab, form feed and return is one blank."""
    return F.regexp_replace(text, r"[ \x09-\x0D]+", " ")


def sorted_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", runs: int = FAN_IN**ROUNDS) -> DataFrame:
    """The runs, written to the shared folder: digests sorted in their partition, numbered by it."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(text_of(text)).alias("t"))
    digests = rows.select(
        "doc_id",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.xxhash64("t").alias("check"),
        F.length("t").alias("size"),
        F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"),
        F.monotonically_increasing_id().alias("row"),
    )
    return kept(digests.sortWithinPartitions("digest"), "digest-runs")


def merged_runs(runs: DataFrame, fan_in: int = FAN_IN, rounds: int = ROUNDS) -> DataFrame:
    """One row per text: its digest, the entry of the smallest identifier, and its number of rows."""
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    level = runs.groupBy("run", *SAME).agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
    span = F.substring("digest", 1, 2)
    for _ in range(rounds):
        met = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).withColumn("span", span)
        ordered = met.repartition("run", "span").sortWithinPartitions("run", "span", "digest")
        level = ordered.groupBy("run", "span", *SAME).agg(F.min("first").alias("first"), F.sum("n").alias("n")).drop("span")
    return level.drop("run")


def exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: which document of its equal texts stays.

    Columns: doc_id, keep_id, group_size, kept, text_sha256.  A null text is
    the empty text.  A null doc_id stays only if all ids of its group are null.
    Of rows that repeat id and text exactly one is kept.  An empty table gives
    an empty result; other columns of the input are ignored.
    """
    runs = sorted_runs(docs, doc_id, text)
    groups = merged_runs(runs).where("n > 1")
    same = runs.select("run", *SAME).distinct()
    answers = same.join(groups, list(SAME))
    r, a = runs.alias("r"), answers.alias("a")
    found = r.join(a, [F.col(f"r.{c}") == F.col(f"a.{c}") for c in ("run", *SAME)], "left")
    alone = F.col("a.n").isNull()
    return found.select(
        F.col("r.doc_id").alias("doc_id"),
        F.when(alone, F.col("r.doc_id")).otherwise(F.col("a.first.doc_id")).alias("keep_id"),
        F.coalesce("a.n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("r.row") == F.col("a.first.row"))).alias("kept"),
        F.lower(F.hex("r.digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; needs unique doc_ids."""
    keep = exact_copies(docs, doc_id, text).where("kept").select(F.col("doc_id").alias("__keep"))
    return docs.join(keep, F.col(doc_id).eqNullSafe(F.col("__keep")), "left_semi")
