"""Packing of token pieces into sequences of a fixed length.

Pieces are dealt by hash into groups of about ``GROUP`` pieces.  A group is
packed best-fit in order of decreasing length; then a local search takes the
emptiest sequence and moves its pieces, or exchanges one of them for one or two
smaller ones of another underfull sequence, whenever the sum of squared fills
grows, until sequences empty and nothing more improves.  No two sequences of a
group are at most half full; the one that may be goes on to a second packing
with those of other groups.
"""

import re
import zlib
from collections import defaultdict
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docintake.llm.chunk_ids import ChunkIds, blocks, id_bytes, joined
from docintake.llm.common import groups_of, kept, text_of
from docintake.session import send_by_value

send_by_value(__name__)
send_by_value("docintake.llm.chunk_ids")

LENGTH = 2048
GROUP = 2048
SECOND = 64
END = id_bytes([0])


WORD = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")
LETTERS = "abcdefghijklmnopqrstuvwxyz"


class WordTokenizer:
    """Ids of strings.

    Words of ASCII letters go to the library's merge model at once where the
    steps before it leave such words whole and as they are; other words are
    encoded in runs, in which the ids that end a word show.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        steps, added = self.tokenizer, self.tokenizer.get_added_tokens_decoder().values()
        normal = steps.normalizer.normalize_str(LETTERS) if steps.normalizer else LETTERS
        cut = steps.pre_tokenizer.pre_tokenize_str(normal) if steps.pre_tokenizer else [(normal, (0, len(normal)))]
        # a special string among the words would be found before the merge model
        special = any(t.content.isascii() and t.content.isalpha() for t in added)
        self.plain = not special and [t for t, _ in cut] == [LETTERS]

    def many(self, texts: list[str]) -> list[bytes]:
        words = [t for t in texts if WORD.fullmatch(t)]
        known = {}
        if self.plain:
            model = self.tokenizer.model
            known = {t: id_bytes([x.id for x in model.tokenize(t)]) for t in words if t.isascii()}
            words = [t for t in words if t not in known]
        known.update(zip(words, joined(self.tokenizer, words, " ", self.ends, 1), strict=True))
        rest = [t for t in texts if t not in known]
        known.update((t, id_bytes(x.ids)) for t, x in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True))
        return [known[t] for t in texts]


def ids_of(cache: ChunkIds, texts: pa.Array) -> list[bytes]:
    """Ids of each text as bytes: the vocabulary drops white space and splits at it."""
    found = cache.encode(pc.split_pattern(pc.replace_substring(texts, "\n", " "), " "))
    return [ids[a:b].tobytes() for ids, bounds in found for a, b in pairwise(bounds)]


def token_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and a row number: every document's ids with the end id, cut at ``length``."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def tokenize(batches):
        cache = ChunkIds(WordTokenizer(path).many, lower=True)
        for batch in batches:
            row, rows = [], []
            at = 0
            for some in blocks(batch.column(1)):
                for ids in ids_of(cache, some):
                    whole = memoryview(ids + END)
                    for piece, start in enumerate(range(0, len(whole) // 4, length)):
                        part = whole[4 * start : 4 * (start + length)]
                        row.append(at)
                        rows.append((piece, start, len(part) // 4, zlib.crc32(part)))
                    at += 1
            piece, start, size, crc = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
                + [pa.array(x, pa.int64()) for x in (start, size, crc)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    pieces = rows.mapInArrow(tokenize, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    return pieces.withColumn("row", F.monotonically_increasing_id())


class Bins:
    """Sequences under construction, found by their free space."""

    def __init__(self, lengths: list[int], limit: int):
        self.lengths, self.limit = lengths, limit
        self.items: list[list[int]] = []
        self.free: list[int] = []
        self.changes: list[int] = []
        self.at: dict[int, set[int]] = defaultdict(set)  # free space -> sequences
        self.spaces = 0  # bit f is set if some sequence has f free

    def put(self, bin_: int, items: list[int]) -> None:
        """Give a sequence these items."""
        self.leave(bin_)
        self.items[bin_] = items
        self.changes[bin_] += 1
        self.free[bin_] = free = self.limit - sum(self.lengths[i] for i in items)
        if items:
            self.at[free].add(bin_)
            self.spaces |= 1 << free

    def leave(self, bin_: int) -> None:
        old = self.at[self.free[bin_]]
        old.discard(bin_)
        if not old:
            self.spaces &= ~(1 << self.free[bin_])

    def open(self, items: list[int]) -> None:
        self.items.append([])
        self.changes.append(0)
        self.free.append(self.limit)
        self.put(len(self.items) - 1, items)

    def best(self, size: int, but: int = -1) -> int:
        """The fullest sequence with room for ``size``, other than ``but``; -1 if there is none."""
        spaces = self.spaces >> size << size
        while spaces:
            free = (spaces & -spaces).bit_length() - 1
            for bin_ in self.at[free]:
                if bin_ != but:
                    return bin_
            spaces &= spaces - 1
        return -1

    def most_free(self, giver: int) -> int:
        """The largest free space of the other sequences that are as full as this one or fuller."""
        free = self.free[giver]
        spaces = self.spaces & ((2 << free) - 1)
        if len(self.at[free]) == 1:
            spaces &= ~(1 << free)
        return spaces.bit_length() - 1

    def best_fit(self) -> None:
        for i in sorted(range(len(self.lengths)), key=lambda i: -self.lengths[i]):
            bin_ = self.best(self.lengths[i])
            if bin_ < 0:
                self.open([i])
            else:
                self.put(bin_, [*self.items[bin_], i])


class Swaps:
    """Exchanges on offer, by how long a piece they could take.

    One or two pieces of an underfull sequence, together ``give`` long, can go
    for a longer piece of up to ``give`` plus the sequence's free space.
    An offer holds until its sequence changes.
    """

    def __init__(self, bins: Bins):
        self.bins = bins
        self.offers: dict[int, list[tuple[int, int, int, tuple[int, ...]]]] = defaultdict(list)
        self.reaches = 0

    def offer(self, bin_: int) -> None:
        bins = self.bins
        free = bins.free[bin_]
        if not free or not bins.items[bin_]:
            return
        one = {bins.lengths[i]: i for i in bins.items[bin_]}  # one piece of each length will do
        spare = defaultdict(list)
        for i in bins.items[bin_]:
            spare[bins.lengths[i]].append(i)
        sizes = sorted(one)
        gifts = [(s, (one[s],)) for s in sizes]
        for n, a in enumerate(sizes):
            if len(spare[a]) > 1:
                gifts.append((2 * a, (spare[a][0], spare[a][1])))
            gifts += [(a + b, (one[a], one[b])) for b in sizes[n + 1 :]]
        for give, items in gifts:
            if give + free <= bins.limit:
                self.offers[give + free].append((bin_, bins.changes[bin_], give, items))
                self.reaches |= 1 << (give + free)

    def find(self, size: int, giver: int, most: int):
        """A sequence and up to ``most`` items that it would give for ``size``, filling it up as far as possible."""
        bins = self.bins
        if size > bins.limit:
            return None
        # what gives less than it takes has at least the difference free
        last = size + max(0, bins.most_free(giver))
        reaches = self.reaches >> size << size & ((1 << last) - 1)
        while reaches:
            reach = (reaches & -reaches).bit_length() - 1
            stack = self.offers[reach]
            for k in range(len(stack) - 1, -1, -1):
                bin_, change, give, items = stack[k]
                if bins.changes[bin_] != change:
                    stack.pop(k)
                elif len(items) <= most and bin_ != giver and give < size and bins.free[bin_] <= bins.free[giver]:
                    return bin_, items
            if not stack:
                self.reaches &= ~(1 << reach)
            reaches &= reaches - 1
        return None


def improve(bins: Bins) -> None:
    """Empty the emptiest sequence into the others, as long as any step raises the sum of squared fills."""
    swaps = Swaps(bins)
    for bin_ in range(len(bins.items)):
        swaps.offer(bin_)
    better = True
    while better:
        better = False
        for giver in sorted((b for b in range(len(bins.items)) if bins.free[b]), key=lambda b: -bins.free[b]):
            while bins.items[giver] and step(bins, swaps, giver):
                better = True


def step(bins: Bins, swaps: Swaps, giver: int) -> bool:
    """One move or exchange out of a sequence; False if none raises the squared fill."""
    held = sorted(bins.items[giver], key=lambda i: -bins.lengths[i])
    for item in held:
        size = bins.lengths[item]
        to = bins.best(size, giver)
        # fuller afterwards than the giver was
        if to >= 0 and bins.free[to] - size < bins.free[giver]:
            exchange(bins, swaps, giver, (item,), to, ())
            return True
    one_each = list({bins.lengths[i]: i for i in held}.values())
    for item in one_each:
        if found := swaps.find(bins.lengths[item], giver, 2):
            exchange(bins, swaps, giver, (item,), *found)
            return True
    for n, one in enumerate(one_each):
        for two in one_each[n + 1 :]:
            if found := swaps.find(bins.lengths[one] + bins.lengths[two], giver, 1):
                exchange(bins, swaps, giver, (one, two), *found)
                return True
    return False


def exchange(bins: Bins, swaps: Swaps, giver: int, gone: tuple[int, ...], to: int, back: tuple[int, ...]) -> None:
    bins.put(giver, [i for i in bins.items[giver] if i not in gone] + [*back])
    bins.put(to, [i for i in bins.items[to] if i not in back] + [*gone])
    swaps.offer(giver)
    swaps.offer(to)


def pack(lengths: list[int], limit: int = LENGTH) -> list[list[int]]:
    """Sequences of piece numbers."""
    bins = Bins(lengths, limit)
    bins.best_fit()
    improve(bins)
    return [items for items in bins.items if items]


def packed_group(table: pa.Table, limit: int) -> pa.Table:
    """Sequence numbers and offsets of one group's pieces; ``open`` marks a sequence at most half full."""
    lengths = table.column("length").to_pylist()
    number, offset, half = [0] * len(lengths), [0] * len(lengths), [False] * len(lengths)
    group = table.column("group")[0].as_py()
    for n, items in enumerate(pack(lengths, limit)):
        at = 0
        total = sum(lengths[i] for i in items)
        for i in sorted(items):
            number[i], offset[i], half[i] = (group << 24) + n, at, 2 * total <= limit
            at += lengths[i]
    found = {"sequence_id": pa.array(number, pa.int64()), "offset": pa.array(offset, pa.int64()), "open": pa.array(half, pa.bool_())}
    table = table.drop_columns(["group"])
    for name, values in found.items():
        table = table.append_column(name, values)
    return table


def packed(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Written pieces with sequence_id and offset; a sequence's pieces lie gapless from offset 0."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)

    def place(rows: DataFrame, key) -> DataFrame:
        numbered = rows.withColumn("group", key.cast("long"))
        schema = f"{fields}, sequence_id long, offset long, open boolean"
        return numbered.groupBy("group").applyInArrow(lambda table: packed_group(table, length), schema)

    groups = groups_of(pieces, group)
    first = kept(place(pieces, F.pmod(F.xxhash64("row"), F.lit(groups))), "packed")
    # one sequence a group at most
    again = F.lit(groups) + F.floor(F.shiftright("sequence_id", 24) / SECOND)
    second = place(first.where("open").withColumn("group", again).select("group", *pieces.columns), F.col("group"))
    return first.where("not open").unionByName(second).drop("open")


def best_fit_sequences(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone, so every row of the input is in
    the result, repeated rows as often as they come.  A document over
    ``length`` ids is cut into pieces of ``length``; the last may be shorter.
    Null doc_ids stay null; groups go by row, so no id makes a group large.
    An empty table gives an empty result; other columns are ignored.
    """
    pieces = kept(token_pieces(docs, path, doc_id, text, length), "pieces")
    return packed(pieces, length).drop("row")
