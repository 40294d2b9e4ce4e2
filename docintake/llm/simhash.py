"""SimHash near-dedup with BK-trees.

Two 64-bit fingerprints that differ in at most three bits agree in one of four
blocks of 16 bits, and their other 48 bits agree in one of four blocks of 12.
The 16 pairs of blocks are the shard keys: no link is lost, and a shard holds
the fingerprints that share 28 bits.  A shard's fingerprints become a BK-tree,
whose children are keyed by their Hamming distance to the parent; a query goes
down the edges within the radius of its own distance only.  Trees meet their
queries by shard key: all trees together grow with the corpus, so they are not
sent to every executor.  A shard of more than ``TREE`` fingerprints is cut into
trees of about that size, and every pair of cuts is a group of its own, in which
one cut asks the other's tree; so no group is larger than two cuts.  A group hands on a spanning forest of the links it
finds, not the links, so a group of copies costs one row a member.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docintake.llm.common import kept, text_of
from docintake.llm.components import components
from docintake.session import send_by_value

send_by_value(__name__)

SEED = 42
SHINGLE = 3
RADIUS = 3
TREE = 4096


def fingerprint_of(text: str, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the hashes of the text's shingles; no words: zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
        return xxhash.xxh64_intdigest(grams[0], SEED)
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        some = words[at : at + 65_536 + shingle - 1]
        grams = map(b" ".join, zip(*(some[i:] for i in range(shingle)), strict=False))
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a signed long."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def compute(batches):
        for batch in batches:
            found = np.fromiter((fingerprint_of(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "print"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(compute, f"doc_id {kind}, print long")


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self):
        self.nodes: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.nodes.append(value)
        self.children.append({})
        at, new = 0, len(self.nodes) - 1
        while at != new:
            at = self.children[at].setdefault((value ^ self.nodes[at]).bit_count(), new)

    def within(self, value: int, radius: int):
        """The nodes at most ``radius`` bits away."""
        nodes, children, todo = self.nodes, self.children, [0] if self.nodes else []
        while todo:
            at = todo.pop()
            far = (value ^ nodes[at]).bit_count()
            if far <= radius:
                yield nodes[at]
            for edge, child in children[at].items():
                if far - radius <= edge <= far + radius:
                    todo.append(child)


class Forest:
    """Union-find that remembers which unions joined two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.parent.setdefault(x, x)
        while up != self.parent[up]:
            self.parent[x] = up = self.parent[up]
            x = up
        return up

    def join(self, a: int, b: int) -> None:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)
            self.links.append((a, b))


def forest_links(nodes: list[int], asking: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the nodes, or, if others ask, of those between them and the nodes."""
    tree, forest = BKTree(), Forest()
    for value in nodes:
        for near in () if asking else tree.within(value, radius):
            forest.join(near, value)
        tree.add(value)
    for value in asking:
        for near in tree.within(value, radius):
            forest.join(near, value)
    return forest.links


def shard_keys(value: str = "print") -> Column:
    """The 16 keys of a fingerprint: table number, a block of 16 bits, a block of 12 of the rest."""
    v = F.col(value)
    keys = []
    for block in range(4):
        high = F.shiftrightunsigned(v, 16 * block).bitwiseAND(F.lit(0xFFFF))
        # the other 48 bits, closed up
        low_bits = v.bitwiseAND(F.lit((1 << 16 * block) - 1))
        above = F.shiftrightunsigned(F.shiftrightunsigned(v, 16 * block), 16)
        rest = low_bits.bitwiseOR(F.shiftleft(above, 16 * block))
        for part in range(4):
            low = F.shiftrightunsigned(rest, 12 * part).bitwiseAND(F.lit(0xFFF))
            number = F.lit((4 * block + part) << 28).cast("long")
            keys.append(number.bitwiseOR(F.shiftleft(high, 12)).bitwiseOR(low))
    return F.array(*keys)


def sharded(prints: DataFrame, tree: int = TREE) -> DataFrame:
    """(key, low, high, print, asks): a row for the fingerprint's own cut, and one for each other cut of a large shard.

    Of the cuts ``low`` and ``high`` the lower one asks the tree of the higher.
    """
    rows = prints.select(F.explode(shard_keys()).alias("key"), "print")
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tree)
    large = large.select(F.col("key").alias("at"), F.ceil(F.col("n") / tree).cast("int").alias("cuts"))
    cut = rows.join(large, F.col("key") == F.col("at"), "left").select("key", "print", F.coalesce("cuts", F.lit(1)).alias("cuts"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("print"), F.col("cuts")).cast("int"))
    met = cut.select("key", "print", "own", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return met.select("key", low.alias("low"), high.alias("high"), "print", (F.col("own") < F.col("other")).alias("asks"))


def near_links(prints: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """(a, b): per shard a spanning forest of the pairs of different fingerprints at most ``radius`` (up to 3) bits apart."""
    if radius > 3:
        raise ValueError("the shard keys hold for at most three bits")

    def search(batches):
        held, values, asks = None, [], []

        def links():
            nodes = [v for v, a in zip(values, asks, strict=True) if not a]
            found = forest_links(nodes, [v for v, a in zip(values, asks, strict=True) if a], radius) if len(values) > 1 else []
            return [(a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b) for a, b in found]

        for batch in batches:
            out = []
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)])
            prints_ = batch.column(3).to_numpy().view(np.uint64)
            asking = batch.column(4).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]) if batch.num_rows else np.array([], int)
            ends = np.r_[starts[1:], batch.num_rows]
            # a shard of one row in the middle of a batch has nobody to meet
            some = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == batch.num_rows))
            for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
                key = tuple(keys[:, s].tolist())
                if key != held:
                    out += links()
                    held, values, asks = key, [], []
                values += prints_[s:e].tolist()
                asks += asking[s:e].tolist()
            if out:
                yield edge_batch(out)
        if out := links():
            yield edge_batch(out)

    rows = sharded(prints, tree).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "print")
    return rows.mapInArrow(search, "a long, b long")


def edge_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links.

    A null text is the empty text; texts without words have fingerprint zero
    and link like any other.  A text with fewer words than a shingle is one
    shingle.  Null doc_ids never are a component's id unless it has no other.
    Repeated rows give repeated result rows; an empty table an empty result.
    """
    prints = kept(fingerprints(docs, doc_id, text, shingle).withColumn("part", F.spark_partition_id()), "prints")
    nodes = kept(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "print-nodes")
    roots = components(near_links(nodes, radius)).select(F.col("node").alias("print"), "root")
    rooted = kept(nodes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")), "print-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = rooted.join(least, "root").select("print", "component_id")
    printed = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    return answered(prints, answer).select("doc_id", printed, "component_id")


def answered(prints: DataFrame, answer: DataFrame) -> DataFrame:
    """The rows with their fingerprint's answer, which goes to every part that has rows of it.

    A part is the rows of one input task, so the fingerprint of a text that a
    third of all rows share is as many keys as tasks have read it.
    """
    asked = prints.select("part", "print").distinct().join(answer, "print")
    return prints.join(asked, ["part", "print"])


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The first document of every component, with all its columns.

    First is the smallest doc_id, null last, then a hash of the text; rows
    that repeat id and text are one document and stay together.
    """
    key = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("hash"))
    found = near_copies(docs.select(key.alias("id"), F.col(text).alias("text")), "id", "text")
    first = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__keep")).distinct()
    return docs.withColumn("__id", key).join(first, F.col("__id") == F.col("__keep"), "left_semi").select(*docs.columns)
