r"""Importance resampling towards a target distribution over hashed word n-grams.

A text's n-grams fall into buckets; a bucket's gain is the logarithm of how
much more frequent it is in the target than in the corpus.  Documents are drawn
without replacement by Gumbel-perturbed sums of their gains.

Within an Arrow batch every distinct n-gram is interned once in an
open-addressed NumPy table: keyed by xxhash64, with linear probing and a
comparison of the bytes, a slot holding the n-gram's bucket and its count.
Occurrences become slot ids.  The counting pass adds the slots' counts to their
buckets; the weighing pass gathers gains through the slot ids.
"""

import math
import operator
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docintake.llm.chunk_ids import blocks
from docintake.llm.common import kept, numbered, text_of
from docintake.session import send_by_value

send_by_value(__name__)
send_by_value("docintake.llm.chunk_ids")

TEXT_AT_ONCE = 4_000_000
#: Digits, letters and all bytes of characters beyond ASCII are parts of words; A-Z become a-z, all else a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class InternTable:
    """Distinct byte strings of one block, open-addressed; grows when half full."""

    def __init__(self, buckets: int, slots: int = 1 << 16):
        self.buckets = buckets
        self.resize(slots)

    def resize(self, slots: int) -> None:
        self.mask = np.uint64(slots - 1)
        self.key = np.zeros(slots, np.uint64)
        self.owner = np.full(slots, -1, np.int64)  # the first occurrence of the slot's n-gram
        self.used = 0

    def intern(self, grams: list[bytes]) -> np.ndarray:
        """The slot of every n-gram; buckets and counts of the slots are set."""
        keys = np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(grams))
        while (slots := self.placed(grams, keys)) is None:
            self.resize(4 * len(self.key))
        self.count = np.bincount(slots, minlength=len(self.key))
        self.bucket = np.zeros(len(self.key), np.int64)
        taken = np.flatnonzero(self.owner >= 0)
        crcs = (zlib.crc32(grams[n]) for n in self.owner[taken].tolist())
        self.bucket[taken] = np.fromiter(crcs, np.int64, len(taken)) % self.buckets
        return slots

    def placed(self, grams: list[bytes], keys: np.ndarray) -> np.ndarray | None:
        """The slot of every n-gram, or None if the table is too small."""
        slots = np.empty(len(grams), np.int64)
        todo = np.arange(len(grams))
        at = (keys & self.mask).astype(np.int64)
        while len(todo):
            free = self.owner[at] < 0
            # of several that claim a free slot the first gets it, as the last written one stays
            self.owner[at[free][::-1]] = todo[free][::-1]
            self.key[at[free]] = keys[self.owner[at[free]]]
            self.used += len(np.unique(at[free]))
            if 2 * self.used > len(self.key):
                return None
            owners = self.owner[at]
            same = self.key[at] == keys[todo]
            same[same] = equal_bytes(grams, todo[same], owners[same])
            slots[todo[same]] = at[same]
            todo = todo[~same]
            at = (at[~same] + 1) & int(self.mask)
        return slots


def equal_bytes(grams: list[bytes], some: np.ndarray, others: np.ndarray) -> np.ndarray:
    get = grams.__getitem__
    return np.fromiter(map(operator.eq, map(get, some.tolist()), map(get, others.tolist())), bool, len(some))


def grams_of(texts: pa.Array, longest: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All n-grams of some texts by text, how many each text has, and how many words."""
    grams, sizes, words = [], [], []
    for text in texts.cast(pa.binary()):
        own = text.as_py().translate(FOLD).split()
        before = len(grams)
        grams += own
        for n in range(2, longest + 1):
            grams += map(b" ".join, zip(*(own[i:] for i in range(n))))
        sizes.append(len(grams) - before)
        words.append(len(own))
    return grams, np.array(sizes, np.int64), np.array(words, np.int64)


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket; a task gives a row a bucket at most."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for some in blocks(batch.column(0), TEXT_AT_ONCE):
                grams = grams_of(some, longest)[0]
                if grams:
                    table = InternTable(buckets)
                    table.intern(grams)
                    np.add.at(total, table.bucket, table.count)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    rows = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for r in rows.collect():  # a row a bucket
        total[r.bucket] = r.n
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each bucket."""
    buckets = len(corpus)
    all_s, all_t = float(corpus.sum() + buckets), float(target.sum() + buckets)
    ratio = ((t + 1.0) * all_s / ((s + 1.0) * all_t) for s, t in zip(corpus.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def weigh(batches):
        gain = shared.value
        for batch in batches:
            columns = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for some in blocks(batch.column(1), TEXT_AT_ONCE):
                grams, sizes, words = grams_of(some, longest)
                weight = np.zeros(1, np.int64)
                if grams:
                    table = InternTable(len(gain))
                    slots = table.intern(grams)
                    weight = np.r_[0, np.cumsum(gain[table.bucket][slots])]
                ends = np.cumsum(sizes)
                for column, values in zip(columns, (words, sizes, weight[ends] - weight[ends - sizes]), strict=True):
                    column.append(values)
            numbers = [pa.array(np.concatenate(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers], ["doc_id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of sha256 of ``seed:doc_id``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def drawn(
    docs: DataFrame,
    target: DataFrame,
    longest: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    least: int = 20,
    seed: int = 2024,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, and rank among the drawn (null: not drawn).

    Drawn are ``floor(percent * N / 100)`` of the N documents with at least
    ``least`` words, by score, ties to the smaller doc_id (null ids last).
    Null and empty texts have no features and weight 0.  Rows are documents of
    their own even if they repeat an id; those get the same noise, and ties
    among them go by weight, then by number of features.  Without target rows
    all features are equally new to it.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    corpus = bucket_counts(rows.select("text"), longest, buckets)
    wanted = bucket_counts(target.select(text_of(target_text).alias("text")), longest, buckets)
    found = weighed(rows, gains(corpus, wanted), longest)
    found = kept(found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")

    enough = F.col("n_words") >= least
    order = F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features")
    places = numbered(found.where(enough), *order, out="place")
    n = found.where(enough).count() * percent // 100
    rank = F.when(F.col("place") <= n, F.col("place"))
    names = "doc_id", "n_features", "weight", "score"
    rest = found.where(~enough).select(*names, F.lit(None).cast("long").alias("rank"))
    return places.select(*names, rank.alias("rank")).unionByName(rest)
