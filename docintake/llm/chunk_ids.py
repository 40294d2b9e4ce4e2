"""Token ids of texts through the distinct chunks they fall into.

The tokenizers library costs several microseconds a word and a corpus repeats
its words.  Texts of a batch are cut into chunks by Arrow; every distinct chunk
is encoded once, and the ids of the texts are gathered from those.
"""

import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_ENTRIES = 300_000
TEXT_AT_ONCE = 10_000_000
CHUNKS_AT_ONCE = 200_000
#: Punctuation that never takes part in a contraction rule.
TAIL = ".,;:!?%&$#*|"


def id_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit."""
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class ChunkIds:
    """Ids of chunks; what was encoded is kept, up to a number of entries.

    ``encode_many`` gives the ids of a list of strings as bytes.  With ``lower`` a chunk of
    Latin-1 letters is looked up in lower case.  A chunk that is a word and
    closing punctuation is the word's ids and the punctuation's ids, as the
    splitting pattern of both vocabularies starts anew there.
    """

    def __init__(self, encode_many, lower: bool, entries: int = CACHE_ENTRIES):
        self.encode_many = encode_many
        self.lower = lower
        self.entries = entries
        self.known: dict[str, bytes] = {}

    def parts(self, chunk: str) -> tuple[str, str]:
        if "<|" in chunk or not (chunk.isascii() or max(chunk) < "\u0100"):
            return chunk, ""
        if self.lower:
            chunk = chunk.lower()
        word = chunk.rstrip(TAIL)
        if len(word) < len(chunk) and word and word[-1].isalnum():
            return word, chunk[len(word) :]
        return chunk, ""

    def learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk as bytes."""
        cut = list(map(self.parts, chunks))
        if len(self.known) > self.entries:
            self.known = {}
        known = self.known
        missing = list({p for both in cut for p in both}.difference(known))
        for at in range(0, len(missing), 20_000):
            some = missing[at : at + 20_000]
            known.update(zip(some, self.encode_many(some), strict=True))
        return [known[word] + known[tail] if tail else known[word] for word, tail in cut]

    def encode(self, chunked: pa.ListArray):
        """For some rows after the other: their ids in one array, and the bounds of the rows in it."""
        rows = chunked.offsets.to_numpy() - chunked.offsets[0].as_py()
        coded = chunked.flatten().dictionary_encode()
        del chunked  # the chunks themselves go before their ids come
        # by way of NumPy, as Arrow's own lists take seven times as long to make
        index, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        del coded
        pa.default_memory_pool().release_unused()
        ids = self.learn(distinct)
        flat = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        first = 0
        while first < len(rows) - 1:
            last = max(first + 1, int(np.searchsorted(rows, rows[first] + CHUNKS_AT_ONCE, "right")) - 1)
            some = index[rows[first] : rows[last]]
            yield gathered(flat, sizes, starts, some, rows[first : last + 1] - rows[first])
            first = last


def joined(tokenizer, texts: list[str], glue: str, ends, keep: int) -> list[bytes]:
    """The ids of texts encoded in runs, as one call a text costs more than its ids.

    ``ends`` marks the ids that end a text in a run; ``keep`` is 1 if such an
    id is the text's own last, 0 if it is the glue's.
    """
    out: list[bytes] = []
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        run = glue.join(some) + (glue if not keep else "")
        ids = np.array(tokenizer.encode_batch_fast([run], add_special_tokens=False)[0].ids, "<u4")
        stops = 4 * (np.flatnonzero(ends[ids]) + keep)
        if len(stops) != len(some):
            raise ValueError("a text of a run is not one match of the splitting pattern")
        raw = ids.tobytes()
        starts = np.r_[0, stops[:-1] + 4 * (1 - keep)]
        out += [raw[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
    return out


def gathered(flat: np.ndarray, sizes: np.ndarray, starts: np.ndarray, index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of ``flat`` that an index names, joined, and the bounds of rows that count index entries."""
    own = sizes[index]
    ends = np.cumsum(own)
    shift = starts[index] - (ends - own)
    out = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(shift, own)]
    return out, np.r_[0, ends][rows]


def blocks(texts: pa.Array, limit: int = TEXT_AT_ONCE):
    """Slices of a text column of about ``limit`` bytes, so that what a batch needs stays small."""
    sizes = pc.binary_length(texts).to_pylist()
    start, total = 0, 0
    for n, size in enumerate(sizes):
        total += size
        if total >= limit:
            yield texts.slice(start, n + 1 - start)
            start, total = n + 1, 0
    if start < len(texts):
        yield texts.slice(start)
