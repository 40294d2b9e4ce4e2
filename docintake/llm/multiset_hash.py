"""Homomorphic multiset hash of a text's paragraphs.

A paragraph is a line.  It becomes a wide vector: four lanes of 32 bits from two
hashes of the whole line, and 64 lanes of 16 bits that add, for every block of
up to four words of the line, plus or minus one by the bits of the block's
hash.  The vector of a text is the sum over its paragraphs, lane by lane modulo
2**32 and 2**16: the order of the paragraphs does not matter, and a paragraph is
put in or taken out by adding or subtracting its vector.

The narrow lanes keep distances: the squared length of the difference of two
vectors estimates how many blocks the texts do not share, whatever their
length, and so their likeness.  A text of up to four words is one block, so any
change of its words makes it wholly different.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docintake.llm.common import identity, kept, let, numbered, text_of

WIDE, NARROW = 4, 64
WIDE_MODULUS, NARROW_MODULUS = 1 << 32, 1 << 16
WORDS = 4


def modulus(lane: Column) -> Column:
    return F.when(lane < WIDE, F.lit(WIDE_MODULUS)).otherwise(F.lit(NARROW_MODULUS)).cast("long")


def total(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda sum_, x: sum_ + of(x))


def wide_lanes(text: Column) -> Column:
    """Sums of the 32-bit halves of two hashes of each line."""
    low = F.lit(0xFFFFFFFF).cast("long")
    hashes = F.transform(F.split(text, "\n", -1), lambda p: F.struct(F.xxhash64(p).alias("a"), F.xxhash64(p, F.lit(1)).alias("b")))
    halves = [
        lambda h: h["a"].bitwiseAND(low),
        lambda h: F.shiftrightunsigned(h["a"], 32),
        lambda h: h["b"].bitwiseAND(low),
        lambda h: F.shiftrightunsigned(h["b"], 32),
    ]
    return let(hashes, lambda hs: F.array(*[total(hs, half) for half in halves]))


def narrow_lanes(text: Column) -> Column:
    """Per bit of the block hashes: blocks that have it less blocks that don't."""
    block = rf"\S+(?:[^\S\n]+\S+){{0,{WORDS - 1}}}"
    hashes = F.transform(F.regexp_extract_all(text, F.lit(block), F.lit(0)), lambda b: F.xxhash64(b))
    pair = F.lit((1 << 32) + 1)  # bits j and j + 32 of a hash are counted in one long

    def lanes(hs: Column) -> Column:
        counts = F.transform(
            F.sequence(F.lit(0), F.lit(NARROW // 2 - 1)),
            lambda j: total(hs, lambda h: F.call_function("shiftrightunsigned", h, j).bitwiseAND(pair)),
        )
        n = F.size(hs).cast("long")
        both = F.array_append(counts, n)
        return let(
            both,
            lambda c: F.concat(
                F.transform(F.slice(c, 1, NARROW // 2), lambda x: 2 * x.bitwiseAND(F.lit(0xFFFFFFFF)) - c[NARROW // 2]),
                F.transform(F.slice(c, 1, NARROW // 2), lambda x: 2 * F.shiftrightunsigned(x, 32) - c[NARROW // 2]),
            ),
        )

    return let(hashes, lanes)


def vector(text: Column) -> Column:
    """The vector of a text: 4 wide and 64 narrow lanes as longs from 0 below their modulus."""
    return F.transform(F.concat(wide_lanes(text), narrow_lanes(text)), lambda x, i: F.pmod(x, modulus(i)))


def insert(a: Column, b: Column) -> Column:
    """The vector with b's paragraphs put in."""
    return F.transform(F.zip_with(a, b, lambda x, y: x + y), lambda x, i: F.pmod(x, modulus(i)))


def remove(a: Column, b: Column) -> Column:
    """The vector with b's paragraphs taken out."""
    return F.transform(F.zip_with(a, b, lambda x, y: x - y), lambda x, i: F.pmod(x, modulus(i)))


def printed(vec: Column) -> Column:
    """Hex digits, eight a wide and four a narrow lane."""
    digits = F.transform(vec, lambda x, i: F.when(i < WIDE, F.lpad(F.hex(x), 8, "0")).otherwise(F.lpad(F.hex(x), 4, "0")))
    return F.lower(F.array_join(digits, ""))


def squared(narrow: Column) -> Column:
    half = NARROW_MODULUS // 2
    return F.aggregate(
        F.transform(narrow, lambda x: (F.pmod(x + half, F.lit(NARROW_MODULUS)) - half).cast("double")),
        F.lit(0.0),
        lambda s, x: s + x * x,
    )


def likeness(a: Column, b: Column) -> Column:
    """About the blocks shared by both texts, of the mean of their blocks: 0 to 1, 1 for equal vectors."""

    def estimate(ab: Column) -> Column:
        x, y = (F.slice(ab[k], WIDE + 1, NARROW) for k in ("a", "b"))
        apart = squared(F.zip_with(x, y, lambda p, q: p - q))
        size = squared(x) + squared(y)
        near = F.greatest(F.lit(0.0), 1 - apart / size)
        return F.when(ab["a"] == ab["b"], F.lit(1.0)).when(size == 0, F.lit(0.0)).otherwise(near)

    return let(F.struct(a.alias("a"), b.alias("b")), estimate)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the vector of every text."""
    return docs.select(F.col(doc_id).alias("doc_id"), vector(text_of(text)).alias("vector"))


def edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text's fingerprint against that of an edited text and of the next document's text.

    The edit replaces the last third of the code points, rounded down, by the
    first as many (or all) of the next document by descending doc_id; after
    the last comes the first.  Columns: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.  The edited
    fingerprint is made from the first: the lines from the edit on are taken
    out and the new ones put in.

    Null is the empty text.  Null doc_ids come last.  Rows of one doc_id follow
    each other by a hash of their text; of rows that repeat both, each but the
    last has its own text as the next.  A single row is its own next.  An empty
    table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    rows = rows.withColumn("id", identity("doc_id", F.col("text")))

    sizes = kept(rows.groupBy("id").agg(F.max("doc_id").alias("doc_id"), F.max(F.length("text")).alias("n")), "edit-ids")
    placed = numbered(sizes, F.col("doc_id").desc_nulls_last(), F.col("id"), out="at")
    count = sizes.count()
    giving = placed.select(F.col("id").alias("giver"), F.when(F.col("at") > 1, F.col("at") - 1).otherwise(F.lit(count)).alias("before"))
    taking = placed.select(F.col("id").alias("taker"), "doc_id", F.floor(F.col("n") / 3).cast("int").alias("need"), "at")
    pairs = taking.join(giving, F.col("at") == F.col("before")).select("giver", "taker", "doc_id", "need")

    # one shuffle of the texts serves both sides; vectors are made behind it
    dealt = rows.select("id", "text").repartition("id")
    copies = Window.partitionBy("id").orderBy("id")
    texts = dealt.withColumn("copy", F.row_number().over(copies))
    given = texts.where("copy = 1").join(pairs, F.col("id") == F.col("giver"))
    given = given.select("taker", "doc_id", F.col("text").substr(F.lit(1), F.col("need")).alias("head"), vector(F.col("text")).alias("next"))
    met = texts.join(given, F.col("id") == F.col("taker")).withColumn("vector", vector(F.col("text")))

    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    again = F.col("copy") > 1
    parts = met.select(
        "doc_id",
        "vector",
        n.cast("long").alias("n_chars"),
        F.col("text").substr(F.lit(1), n - cut).alias("stays"),
        F.col("text").substr(n - cut + 1, cut).alias("goes"),
        F.when(again, F.col("text").substr(F.lit(1), cut)).otherwise(F.col("head")).alias("comes"),
        F.when(again, F.col("vector")).otherwise(F.col("next")).alias("next"),
    )
    line = F.substring_index("stays", "\n", -1)  # the line the edit begins in
    edited = insert(remove(F.col("vector"), vector(F.concat(line, "goes"))), vector(F.concat(line, "comes")))
    sha = F.sha2(F.concat("stays", "comes"), 256)
    done = parts.select("doc_id", "n_chars", sha.alias("edited_sha256"), "vector", edited.alias("edited"), "next")
    return done.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(F.col("vector")).alias("fingerprint"),
        printed(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited")).alias("near_edited"),
        likeness(F.col("vector"), F.col("next")).alias("near_next"),
    )
