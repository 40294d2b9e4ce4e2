"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file becomes a tokenizers model: every split of a token into two tokens
is a merge of the token's rank, bytes are written as one character each, and a
match of the splitting pattern that is itself a token is not merged at all.
Decoding looks ids up in the reversed byte table; a character whose bytes lie
in several tokens comes out with the token that completes it.
"""

import base64
import codecs
import hashlib
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docintake.llm.chunk_ids import ChunkIds, blocks, gathered, id_bytes, joined
from docintake.llm.common import text_of
from docintake.session import send_by_value

send_by_value(__name__)
send_by_value("docintake.llm.chunk_ids")

#: Two white-space characters in a row, any but blank and line feed, or the sign that marks the cuts.
ODD = r"[ \n][ \n]|[\x01\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = re.compile(" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    shifted = {b: chr(256 + i) for i, b in enumerate(others)}
    return [chr(b) if b in printable else shifted[b] for b in range(256)]


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """A tokenizers model with the encodings of a rank file, as a string to broadcast."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    chars = byte_characters()
    written = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = [
        (written[token[:i]], written[token[i:]])
        for token in sorted(ranks, key=ranks.get)
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    model = models.BPE({written[t]: r for t, r in ranks.items()}, merges, ignore_merges=True)
    tokenizer = Tokenizer(model)
    split = pre_tokenizers.Split(Regex(pattern), "isolated")
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer.to_str()


class ByteCodec:
    """Encoder and decoder of one vocabulary, made once a task."""

    def __init__(self, json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json)
        of_char = {c: b for b, c in enumerate(byte_characters())}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        table = [b""] * (max(vocab.values(), default=-1) + 1)
        for written, token in vocab.items():
            table[token] = bytes(of_char[c] for c in written)
        self.table = table
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.sizes = np.fromiter(map(len, table), np.int64, len(table))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ends = np.zeros(len(table) + 1, bool)
        feed = vocab.get(byte_characters()[ord("\n")])
        if feed is not None:
            self.ends[feed] = True
        self.cache = ChunkIds(self.many_bytes if feed is not None else lambda ts: list(map(id_bytes, self.many(ts))), lower=False)

    def many(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def many_bytes(self, texts: list[str]) -> list[bytes]:
        """Words are encoded in runs with line feeds between, which join with nothing."""
        words = [t for t in texts if WORD.fullmatch(t)]
        known = dict(zip(words, joined(self.tokenizer, words, "\n", self.ends, 0), strict=True))
        rest = [t for t in texts if t not in known]
        known.update(zip(rest, map(id_bytes, self.many(rest)), strict=True))
        return [known[t] for t in texts]

    def encode_rows(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text.

        A blank belongs to the word behind it and a line feed stands alone,
        so a text without two white-space characters in a row falls apart
        into chunks; any other text is encoded in one piece.
        """
        whole = pc.match_substring_regex(texts, ODD)
        plain = texts.filter(pc.invert(whole))
        chunked = pc.replace_substring(pc.replace_substring(plain, " ", "\x01 "), "\n", "\x01\n\x01")
        rows = (ids[a:b] for ids, bounds in self.cache.encode(pc.split_pattern(chunked, "\x01")) for a, b in pairwise(bounds))
        alone = iter(self.many(texts.filter(whole).to_pylist()))
        return [np.array(next(alone), "<u4") if w else next(rows) for w in whole.to_pylist()]

    def ids_and_offsets(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and the characters [start, end) each of them touches; one cut character belongs to all its tokens."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return found.ids, found.offsets

    def decode(self, ids) -> bytes:
        """The bytes of the ids; unknown ids are an error, negative ones too."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and ids.min() < 0:
            raise IndexError("negative token id")
        return gathered(self.flat, self.sizes, self.starts, ids, np.array([0]))[0].tobytes()

    def decode_pieces(self, ids) -> list[str]:
        """The text each id completes; the first tokens of a split character give an empty text."""
        steps = codecs.getincrementaldecoder("utf-8")("replace")
        pieces = [steps.decode(self.table[i]) for i in ids]
        if pieces:
            pieces[-1] += steps.decode(b"", final=True)
        return pieces


def encoded(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, starts, ends of every text; start and end count characters of the text.

    Rows follow the same rules as in :func:`round_trip`.  A token that holds a
    part of a character's bytes has the whole character's place.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    json = docs.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(path), pattern))

    def encode(batches):
        codec = ByteCodec(json.value)
        for batch in batches:
            found = [codec.ids_and_offsets(t) for t in batch.column(1).to_pylist()]
            columns = [[f[0] for f in found], [[a for a, _ in f[1]] for f in found], [[b for _, b in f[1]] for f in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.list_(pa.int32())) for c in columns)], ["doc_id", "ids", "starts", "ends"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(encode, f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the bytes they decode to.

    Null is the empty text: no tokens, digests of nothing.  Rows are
    independent, so repeated rows, ties and extra columns change nothing, and
    an empty table gives an empty result.  A text of any length is one value.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    json = docs.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(path), pattern))

    def digests(batches):
        codec = ByteCodec(json.value)
        for batch in batches:
            rows = []
            for some in blocks(batch.column(1)):
                for ids in codec.encode_rows(some):
                    decoded = codec.decode(ids)
                    rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            n, one, two = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(digests, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
