"""Line dedup by an exact set-similarity join.

A line is the set of its lower-case words.  A line that has a Jaccard
similarity of ``4/5`` or more with an earlier line is removed; earlier is a
smaller doc_id, or an earlier line of the same document.

Words are ordered by rarity, then by hash.  Rarity is a logarithmic class of
the number of lines that hold the word, over the whole corpus and counted in
``BUCKETS`` hash buckets, so that the classes are a table of fixed size.  Two sets similar enough share a
word among the first ``n - ceil(4n/5) + 1`` of each (prefix filter), have sizes
within ``4/5`` of each other (length filter), and behind their first shared
word enough words are left (positional filter).  A word also flips one bit of
its set's signature (64 bits, 128 for long lines), so two signatures differ in
at most as many bits as the sets in words, which must be a ninth of all or
fewer.  The pairs that pass are verified on the words themselves.

Equal sets become one before the join.  Variants of one line, which all match
each other, would make pairs in the square of their number; so sets that share
two prefix words chosen by hash first meet the earliest of their group and the
few before them alone, and those found similar to one need no other witness: in
the join they only stand as witnesses for later sets that are still open.
"""

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docintake.llm.common import forget, kept, let, text_of, thinned

BUCKETS = 1 << 16
#: Lines of more words have 128 bits of signature, others 64.
LONG = 64
MASK = 0x2AAAAAAA
BEFORE = 4
LOW = 0x7FFFFFFF
#: Stands above the size of a closed set in the prefix join.
CLOSED = 1 << 30
#: Hashes neither compress nor repeat enough to pay for trying.
AS_IS = {"compression": "none", "parquet.enable.dictionary": "false"}
#: White space inside a line.
BLANKS = " \t\x0b\f\r"


def words_of(text: Column) -> Column:
    """Lower-case words between white space, with empty ones."""
    odd = reduce(or_, [F.contains(text, F.lit(c)) for c in "\t\x0b\f\r"])
    plain = F.when(odd, F.regexp_replace(text, r"[\t\x0b\f\r]", " ")).otherwise(text)
    return F.split(F.lower(plain), " ", -1)


def hashed_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, hash, line, words) of every line with words, written: its distinct words as hashes, cut and hashed once."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).withColumn("hash", F.xxhash64("text"))
    lines = rows.select("doc_id", "hash", F.posexplode(F.array_compact(F.split("text", "\n", -1))).alias("line", "text"))
    # asking the words for their number here would compute them twice
    lines = lines.where(F.ltrim("text", F.lit(BLANKS)) != "")
    words = F.array_distinct(F.transform(F.array_remove(words_of(F.col("text")), ""), lambda w: F.xxhash64(w)))
    return kept(lines.select("doc_id", "hash", "line", words.alias("words")), "line-words", **AS_IS)


def rarity(lines: DataFrame) -> Column:
    """The rarity class of every bucket as an array constant: three steps for each doubling of the lines that hold its words."""
    words = lines.select(F.explode("words").alias("w"))
    counts = words.groupBy(F.col("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).count().collect()  # BUCKETS rows at most
    classes = ["0"] * BUCKETS
    for r in counts:
        classes[r.b] = str(min(127, int(3 * math.log2(r["count"]))))
    # small numbers are shared objects, so the table stays in a core's cache
    return F.split(F.lit(",".join(classes)), ",").cast("array<bigint>")


def tokens(words: Column, classes: Column) -> Column:
    """A line's words as longs in order of rarity: class in the top byte, then hash."""
    low, rest = F.lit(BUCKETS - 1), F.lit((1 << 56) - 1)
    token = lambda h: F.shiftleft(F.get(classes, h.bitwiseAND(low).cast("int")), 56).bitwiseOR(h.bitwiseAND(rest))
    # no token is null, but only where the plan says so are longs sorted as primitive numbers
    return F.sort_array(F.transform(words, lambda h: F.coalesce(token(h), F.lit(0).cast("long"))))


def lines_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, hash, line, set, check, n, bits, more, prefix) of every line with words, written to the shared folder."""
    lines = hashed_lines(docs, doc_id, text)
    found = lines.select("doc_id", "hash", "line", tokens(F.col("words"), rarity(lines)).alias("tokens"))
    n = F.size("tokens")
    first = n - F.floor((4 * n + 4) / 5).cast("int") + 1
    prefix = F.transform(F.slice("tokens", 1, first), lambda t: t.bitwiseAND(F.lit(LOW)).cast("int"))
    one = F.lit(1).cast("long")

    def flipped(bit) -> Column:
        flip = lambda bits, t: bits.bitwiseXOR(F.call_function("shiftleft", bit(t), t.bitwiseAND(F.lit(63)).cast("int")))
        return F.aggregate("tokens", F.lit(0).cast("long"), flip)

    # all words folded into 64 bits, and for long lines those of one half: what is not in that half is in the other
    bits, more = flipped(lambda t: one), F.when(n > LONG, flipped(lambda t: F.shiftright(t, 6).bitwiseAND(one))).otherwise(F.lit(0).cast("long"))
    named = found.select(
        "doc_id", "hash", "line", F.xxhash64("tokens").alias("set"), F.hash("tokens").alias("check"), n.alias("n"), bits.alias("bits"), more.alias("more"), prefix.alias("prefix")
    )
    named = kept(named, "lines")
    forget(lines)
    return named


def distinct_sets(lines: DataFrame) -> DataFrame:
    """One row per set, written: id, set, its number of lines, and its earliest line, with size and prefix."""
    earliest = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash", "line", "check", "n", "bits", "more", "prefix")
    sets = lines.groupBy("set").agg(F.min(earliest).alias("s"), F.count(F.lit(1)).alias("copies"))
    return kept(sets.select(F.monotonically_increasing_id().alias("id"), "set", "copies", "s.*"), "line-sets")


def leader_pairs(sets: DataFrame) -> DataFrame:
    """(x, y): every set with the earliest of those that share two prefix words with it, and with the few before it.

    Half of the keys leave out the rarest word, which is what sets apart the
    lines of one template with a number in it.
    """

    def keys(words: Column, seed: int) -> list[Column]:
        n = F.size(words)
        # two words have one order only
        return [F.xxhash64(words[0], words[1], F.lit(seed)), F.when(n >= 3, F.xxhash64(words[n - 1], words[n - 2], F.lit(seed + 1)))]

    # the low bits of the hashes, in their own order and in that of their distance from a mask: each has two ends
    common = F.when(F.size("prefix") >= 3, F.slice("prefix", 2, F.size("prefix"))).otherwise(F.col("prefix"))
    mixed = F.sort_array(F.transform(common, lambda t: t.bitwiseXOR(F.lit(MASK))))
    ordered = sets.where(F.size("prefix") >= 2).select("id", "no_id", "doc_id", F.sort_array("prefix").alias("all"), mixed.alias("common"))
    ends = F.array(*keys(F.col("all"), 0), *keys(F.col("common"), 2))
    keyed = ordered.select("id", "no_id", "doc_id", F.explode(ends).alias("key")).where("key is not null")
    along = Window.partitionBy("key").orderBy("no_id", "doc_id", "id")
    before = [F.first("id").over(along), *(F.lag("id", n).over(along) for n in range(1, BEFORE + 1))]
    names = [f"before{n}" for n in range(BEFORE + 1)]
    led = keyed.select(F.col("id").alias("y"), *(b.alias(n) for b, n in zip(before, names)))
    # most are the first of their group, or alone in it
    led = led.where("before1 is not null").select("y", F.explode(F.array_distinct(F.array(*names))).alias("x"))
    return kept(led.where("x <> y").select("x", "y").distinct(), "leader-pairs")


def opened(sets: DataFrame, led: DataFrame) -> DataFrame:
    """The sets with ``open``: not yet found similar to an earlier one."""
    near = thinned(sets, F.col("id"), led, "later").join(led, F.col("id") == F.col("later"), "left")
    near = near.withColumn("open", F.col("later").isNull()).drop("later")
    return near.unionByName(thinned(sets, F.col("id"), led, "later", rest=True).withColumn("open", F.lit(True)))


def prefix_pairs(sets: DataFrame) -> DataFrame:
    """(x, y): pairs that pass all filters, x the smaller set, at least one of them open.

    Two sets similar enough share eight ninths of the smaller one's words, so
    of that one the first ``n - ceil(8n/9) + 1`` words are enough.  Open sets
    meet each other, and closed sets meet open ones as witnesses; closed sets
    never meet, so a family of variants that are closed already makes no pairs
    in the square of its size.
    """
    rows = sets.where("n >= 4").select("id", "n", "bits", "more", "open", "prefix")
    first = F.slice("prefix", 1, (F.floor(F.col("n") / 9) + 1).cast("int"))
    closed = F.when(F.col("open"), F.lit(0)).otherwise(F.lit(CLOSED))

    def dealt(rows: DataFrame) -> DataFrame:
        # one number for size, place and whether closed, as these rows are what the joins move and sort
        packed = F.shiftleft((F.col("n") + closed).cast("long"), 32).bitwiseOR(F.col("at").cast("long"))
        rows = rows.select("id", "n", "bits", "more", "open", F.posexplode("prefix").alias("at", "word"))
        return rows.select("word", "id", "bits", "more", packed.alias("p"))

    (nx, ix), (ny, iy) = ((F.shiftright(f"{side}.p", 32).bitwiseAND(F.lit(CLOSED - 1)), F.col(f"{side}.p").bitwiseAND(F.lit(0xFFFFFFFF))) for side in "xy")

    def met(x: DataFrame, y: DataFrame, order: Column) -> DataFrame:
        both = nx + ny
        fits = (
            (F.col("x.word") == F.col("y.word"))
            & order
            & near("x.", "y.", nx, ny)
            & (9 * (nx - ix) >= 4 * both)
            & (9 * (ny - iy) >= 4 * both)
        )
        return x.alias("x").join(y.alias("y"), fits).select(F.col("x.id").alias("x"), F.col("y.id").alias("y"))

    # pairs of one size are met once: by open sets in the order of their ids, by closed ones as x
    x_closed = F.shiftright("x.p", 32) >= CLOSED
    once = (nx < ny) | ((nx == ny) & (x_closed | (F.col("x.id") < F.col("y.id"))))
    # no closed x is below ny; said this way, x stays as it is above, and one shuffle of it serves both joins
    open_below = F.shiftright("x.p", 32) < ny
    few = dealt(rows.withColumn("prefix", first))
    found = met(few, dealt(rows.where("open")), once).union(met(few, dealt(rows.where("not open")), open_below))
    return kept(found.distinct(), "prefix-pairs")


def near(x: str, y: str, nx: Column, ny: Column) -> Column:
    """The length filter and the signature filter."""
    all_, half = (F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}")) for c in ("bits", "more"))
    apart = F.bit_count(half) + F.bit_count(all_.bitwiseXOR(half))
    apart = F.when((nx > LONG) & (ny > LONG), apart).otherwise(F.bit_count(all_))
    return (4 * nx <= 5 * ny) & (4 * ny <= 5 * nx) & (9 * apart <= nx + ny)


def key_of(doc_id: str, text: Column) -> Column:
    """What tells documents apart: the id, and a hash of the text for ids that repeat."""
    return F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("hash"))


def later_of(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(later): the later set of each pair whose words have a Jaccard similarity of 4/5 or more, if it is open, written."""
    ends = pairs.select(F.explode(F.array("x", "y")).alias("end"))
    place = F.struct("no_id", "doc_id", "hash", "line")
    placed = thinned(sets, F.col("id"), ends, "end").select("id", F.struct(place.alias("at"), "n", "bits", "more", "open").alias("s"))
    known = pairs
    for end in ("x", "y"):
        known = known.join(placed.select(F.col("id").alias(end), F.col("s").alias(f"s{end}")), end)
    known = known.where(near("sx.", "sy.", F.col("sx.n"), F.col("sy.n")))
    earlier = F.col("sx.at") < F.col("sy.at")
    # a closed set is a witness for later ones only
    known = known.where(F.when(earlier, F.col("sy.open")).otherwise(F.col("sx.open")))
    second = F.when(earlier, F.col("y")).otherwise(F.col("x"))
    ends = [address("sx.at").alias("kx"), address("sy.at").alias("ky"), F.array("sx.at.hash", "sy.at.hash").alias("hashes")]
    known = kept(known.select(second.alias("later"), (F.col("sx.n") + F.col("sy.n")).alias("both"), *ends), "line-pairs")

    wanted = known.select(F.explode(F.array("kx", "ky")).alias("wanted")).distinct()
    # only texts with such a line are cut into lines
    hashes = known.select(F.explode("hashes").alias("text_hash"))
    texts = thinned(texts, F.col("id.hash"), hashes, "text_hash")
    lines = texts.select(F.col("id").alias("a"), F.posexplode(F.array_compact(F.split("text", "\n", -1))).alias("line", "text"))
    lines = lines.select(address().alias("k"), "text")
    lines = thinned(lines, F.col("k"), wanted, "wanted").join(wanted, F.col("k") == F.col("wanted"), "left_semi")
    # texts travel, words are made behind the joins
    lines = kept(lines.dropDuplicates(["k"]), "line-texts")
    checked = known
    for end in ("x", "y"):
        checked = checked.join(lines.select(F.col("k").alias(f"k{end}"), F.col("text").alias(f"t{end}")), f"k{end}")
    shared = F.array_intersect(F.array_remove(words_of(F.col("tx")), ""), words_of(F.col("ty")))
    checked = checked.where(9 * F.size(shared) >= 4 * F.col("both"))
    later = kept(checked.select("later").distinct(), "later-sets")
    forget(known, lines)
    return later


def address(at: str | None = None) -> Column:
    """A line's document and number as one string."""
    doc_id, hash_, line = (F.col(f"{at}.{c}") for c in ("doc_id", "hash", "line")) if at else (F.col("a.doc_id"), F.col("a.hash"), F.col("line"))
    return F.concat_ws("|", F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("-")), F.hex(hash_), line.cast("string"))


def removed_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(of, gone): the numbers of the lines to remove, per document, written."""
    texts = docs.select(key_of(doc_id, text_of(text)).alias("id"), text_of(text).alias("text"))
    lines = lines_of(docs, doc_id, text)
    sets = distinct_sets(lines)
    first_pairs = leader_pairs(sets)
    led = later_of(first_pairs, sets.withColumn("open", F.lit(True)), texts)
    left = opened(sets, led)
    pairs = prefix_pairs(left)
    later = led.union(later_of(pairs, left, texts)).distinct()

    judged = opened(sets, later).where("copies > 1 or not open")
    l, j = lines.alias("l"), judged.alias("j")
    first = F.col("l.doc_id").eqNullSafe(F.col("j.doc_id")) & (F.col("l.hash") == F.col("j.hash")) & (F.col("l.line") == F.col("j.line"))
    met = l.join(j, (F.col("l.set") == F.col("j.set")) & (F.col("l.check") == F.col("j.check")) & (~F.col("j.open") | ~first))
    own = F.struct(F.col("l.doc_id").alias("doc_id"), F.col("l.hash").alias("hash")).alias("of")
    gone = kept(met.select(own, F.col("l.line").alias("line")).groupBy("of").agg(F.collect_set("line").alias("gone")), "gone-lines")
    forget(lines, sets, first_pairs, pairs)
    return gone


def without_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their lines that repeat an earlier line removed; all rows and columns stay.

    A column n_chars follows the text.  A document none of whose lines go
    keeps its text as it is; one that loses all of them has the empty text.
    Lines without words stay.  Null texts stay null.  Null doc_ids come last;
    documents of one id follow each other by a hash of their text, and rows
    that repeat id and text are one document and get one result.  An empty
    table gives an empty result.
    """
    found = with_gone(docs, doc_id, text)
    clean = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(rest(text_of(text)))
    new = {text: clean}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length(clean))
    return found.withColumns(new).select(*docs.columns)


def with_gone(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The documents with ``__gone``: the numbers of the lines to remove, or null."""
    gone = removed_lines(docs, doc_id, text).select(F.col("of").alias("__of"), F.col("gone").alias("__gone"))
    return docs.withColumn("__id", key_of(doc_id, text_of(text))).join(gone, F.col("__id") == F.col("__of"), "left").drop("__id", "__of")


def rest(text: Column) -> Column:
    """A text without the lines in ``__gone``."""

    def joined(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
        return F.array_join(F.transform(stay, lambda n: lines[n]), "\n")

    return let(F.split(text, "\n", -1), joined)


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, its text without repeated lines, n_lines before, and n_removed."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    return with_gone(rows, "doc_id", "text").select(
        "doc_id",
        F.when(F.col("__gone").isNull(), F.col("text")).otherwise(rest(F.col("text"))).alias("text"),
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
