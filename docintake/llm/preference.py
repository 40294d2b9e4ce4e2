"""Preference formatting: one prompt and two masked completions from a pair of conversations.

A conversation is the set of its turns in the order of (turn, role, digest of
the text).  Two conversations first differ at the smallest turn that only one
of them has, so the longest common prefix is everything before it, found by
counting sides per turn and one minimum per pair: no conversation is ever
gathered into one value, and turns meet what is known of their conversation
salted by turn, so that one of any length is spread over ``SALTS`` tasks.

The result has one row per rendered turn.  Prompt turns come once a pair.  In
the completions only what an assistant says, and the mark that ends it, bears
loss: ``loss_from`` and ``loss_to`` are code points of the rendered turn, and
equal where it bears none.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docintake.llm.common import kept, numbered

ASSISTANT = "assistant"
PLACE = ("turn", "role", "digest")
SALTS = 64


def place() -> Column:
    return F.struct(*PLACE)


def beside(turns: DataFrame, known: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Turns with a row known of their conversation; a copy of it goes to each salt of the turns."""
    salted = turns.withColumn("__salt", F.pmod(F.xxhash64(*PLACE), F.lit(SALTS)))
    copies = known.withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, on & (F.col("__salt") == F.col("__at")), how).drop("__salt", "__at")


def turns_of(conversations: DataFrame) -> DataFrame:
    """Turns with a digest of their text; repeated rows count once, null roles and texts are empty."""
    role = F.coalesce("role", F.lit("")).alias("role")
    rows = conversations.select(F.struct("conv_id").alias("conv"), "turn", role, F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    return rows.groupBy("conv", *PLACE).agg(F.min("text").alias("text"))


def partners(turns: DataFrame) -> DataFrame:
    """(conv, other, same, last, other_last): every conversation and the next one by opening turn, then id.

    ``same`` says that both open alike.  ``last`` is the place of the last
    assistant turn.  After the last conversation comes the first.
    """
    own = F.col("role") == ASSISTANT
    ends = turns.groupBy("conv").agg(F.min(place()).alias("first"), F.max(F.when(own, place())).alias("last"))
    ends = kept(ends, "conversations")
    opening = F.struct("first.role", "first.digest")
    count = ends.count()
    placed = numbered(ends, F.col("first.role"), F.col("first.digest"), F.col("conv"), out="at")
    a = placed.select("conv", opening.alias("opens"), "last", (F.col("at") % max(count, 1) + 1).alias("next"))
    b = placed.select(F.col("conv").alias("other"), opening.alias("other_opens"), F.col("last").alias("other_last"), "at")
    met = a.join(b, F.col("next") == F.col("at"))
    same = (F.col("opens") == F.col("other_opens")) & (F.col("conv") != F.col("other"))
    return met.select("conv", "other", same.alias("same"), "last", "other_last")


def sides_of(conversations: DataFrame) -> DataFrame:
    """(pair, side, turn, role, digest, text): chosen and rejected turns from plain conversations.

    Every conversation is chosen once.  Rejected is the next conversation
    that opens alike; a conversation without one is rejected with its last
    answer replaced by the last answer of the next conversation in order.
    """
    turns = kept(turns_of(conversations), "turns")
    pairs = kept(partners(turns), "partners")
    chosen = turns.select(F.col("conv").alias("pair"), F.lit("chosen").alias("side"), *PLACE, "text")

    alike = pairs.where("same").select(F.col("conv").alias("pair"), F.col("other").alias("of"))
    whole = beside(turns, alike, F.col("conv") == F.col("of")).select("pair", F.lit("rejected").alias("side"), *PLACE, "text")

    alone = pairs.where("not same").select(F.col("conv").alias("pair"), "other", "last", "other_last")
    own = beside(turns, alone, F.col("conv") == F.col("pair"))
    before = own.where(F.col("last").isNull() | (place() != F.col("last"))).select("pair", F.lit("rejected").alias("side"), *PLACE, "text")
    given = alone.where("last is not null and other_last is not null")
    answer = turns.join(given, (F.col("conv") == F.col("other")) & (place() == F.col("other_last")))
    grafted = answer.select("pair", F.lit("rejected").alias("side"), F.col("last.turn").alias("turn"), "role", "digest", "text")
    return chosen.unionByName(whole).unionByName(before).unionByName(grafted)


def rendered(role: Column, text: Column) -> Column:
    """A turn between marks; a mark inside the text is broken up."""
    return F.concat(head(role), F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))


def head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def formatted(sides: DataFrame) -> DataFrame:
    """Rows (pair, section, turn, role, text, loss_from, loss_to) of pairs given as (pair, side, turn, role, digest, text).

    ``section`` is prompt, chosen or rejected.  A pair of equal
    conversations is all prompt.
    """
    once = sides.groupBy("pair", *PLACE).agg(F.count_distinct("side").alias("sides"))
    split = once.where("sides = 1").groupBy("pair").agg(F.min(place()).alias("split")).withColumnRenamed("pair", "of")
    rows = beside(sides, split, F.col("pair") == F.col("of"), "left")
    shared = F.col("split").isNull() | (place() < F.col("split"))
    rows = rows.where(~shared | (F.col("side") == "chosen"))
    section = F.when(shared, F.lit("prompt")).otherwise(F.col("side"))
    bears = ~shared & (F.col("role") == ASSISTANT)
    text = rendered(F.col("role"), F.col("text"))
    return rows.select(
        "pair",
        section.alias("section"),
        "turn",
        "role",
        text.alias("text"),
        F.when(bears, F.length(head(F.col("role")))).otherwise(0).cast("long").alias("loss_from"),
        F.when(bears, F.length(text)).otherwise(0).cast("long").alias("loss_to"),
    )


def preferences(conversations: DataFrame) -> DataFrame:
    """Formatted pairs of a table (conv_id, turn, role, text); pair_id is the chosen conversation's conv_id.

    Repeated rows count once.  Turns that share a number follow each other by
    role and digest; null turns come first.  Rows without conv_id are one
    conversation.  Null roles and texts are empty.  An empty table gives an
    empty result; other columns are ignored.
    """
    found = formatted(sides_of(conversations))
    return found.select(F.col("pair.conv_id").alias("pair_id"), *[c for c in found.columns if c != "pair"])
