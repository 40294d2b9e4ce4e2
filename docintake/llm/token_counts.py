r"""Token counts by the whole-token shortcut.

Offline, on the driver, every vocabulary string is shown to the merge model by
itself; those that come back as one token are proven whole.  A text is cut into
pre-tokens; a pre-token that is proven whole counts one, and only the rest is
merged.  No ids are made.

The cutting pattern names classes of letters, numbers and white space, which
differ between versions of Unicode.  So the classes are read off the library
itself, over all code points, and written out in the pattern.
"""

import json
import re
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docintake.llm.byte_bpe import byte_characters
from docintake.llm.common import text_of
from docintake.session import send_by_value

send_by_value(__name__)
send_by_value("docintake.llm.byte_bpe")

KNOWN = 300_000
LONG_PIECE = 64
LONG_TEXT = 1_000_000
BEYOND = re.compile("[\U00010000-\U0010ffff]")


def classes(last: int) -> list[str]:
    r"""The code points up to ``last`` that the library takes for \p{L}, \p{N} and \s, as ranges of a pattern."""
    from tokenizers import Regex, pre_tokenizers

    points = [c for c in range(last + 1) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    found = []
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        # the pieces left when the class is taken out; the class lies between them
        others = pre_tokenizers.Split(Regex(name + "+"), "removed").pre_tokenize_str(text)
        edges = [0, *chain.from_iterable(span for _, span in others), len(text)]
        found.append("".join(f"\\U{points[a]:08x}-\\U{points[b - 1]:08x}" for a, b in zip(edges[::2], edges[1::2]) if a < b))
    return found


def pattern(last: int) -> str:
    """The pattern of byte-level pre-tokens with its classes written out."""
    letter, number, space = classes(last)
    return (
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{letter}{number}{space}]+"
        f"|[{space}]+(?![^{space}])|[{space}]+"
    )


def whole_tokens(tokenizer) -> list[str]:
    """The vocabulary strings, as text, that the merge model leaves as one token."""
    of_char = {c: b for b, c in enumerate(byte_characters())}
    proven = []
    for written in tokenizer.get_vocab(with_added_tokens=False):
        if len(tokenizer.model.tokenize(written)) == 1:
            try:
                proven.append(bytes(of_char[c] for c in written).decode())
            except UnicodeDecodeError:
                pass  # a part of a character is no pre-token
    return proven


def prepared(path: str) -> dict:
    """What tasks need to count: the model, the proven strings and the patterns, for a file of this kind of tokenizer."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        model = file.read()
    stated = json.loads(model)
    cut = stated["pre_tokenizer"] or {}
    specials = stated["added_tokens"]
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in specials)
    if stated["normalizer"] or cut.get("type") != "ByteLevel" or not cut.get("use_regex") or cut["add_prefix_space"] or not plain:
        raise ValueError(f"{path}: not a plain byte-level tokenizer")
    strings = sorted((t["content"] for t in specials), key=len, reverse=True)
    return {
        "model": model,
        "whole": whole_tokens(Tokenizer.from_str(model)),
        "special": "|".join(map(re.escape, strings)) or "(?!)",
        "basic": pattern(0xFFFF),
        "full": pattern(0x10FFFF),
    }


class Pieces(dict):
    """Tokens of each pre-token: the proven ones from the start, the others as they are merged."""

    def __init__(self, whole: list[str], model):
        super().__init__(dict.fromkeys(whole, 1))
        self.model = model
        self.proven = len(self)
        self.chars = str.maketrans(dict(enumerate(byte_characters())))

    def __missing__(self, piece: str) -> int:
        n = len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.chars)))
        if len(piece) <= LONG_PIECE and len(self) < self.proven + KNOWN:
            self[piece] = n
        return n


class TokenCounter:
    """Counts the tokens of texts; made once a task."""

    def __init__(self, parts: dict):
        from tokenizers import Tokenizer

        self.pieces = Pieces(parts["whole"], Tokenizer.from_str(parts["model"]).model)
        self.special, self.basic, self.full = (re.compile(parts[k]) for k in ("special", "basic", "full"))

    def count(self, text: str) -> int:
        n = len(self.special.findall(text))
        return n + sum(map(self.ordinary, self.special.split(text) if n else [text]))

    def ordinary(self, text: str) -> int:
        """Tokens of a text without special strings."""
        cut = self.full if BEYOND.search(text) else self.basic
        # pre-tokens of a long text are never all held at once
        found = cut.findall(text) if len(text) <= LONG_TEXT else (m[0] for m in cut.finditer(text))
        return sum(map(self.pieces.__getitem__, found))


def token_counts(docs: DataFrame, path: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every text, as the tokenizers library would count.

    Special strings inside a text are one token each, as by default in the
    library; no others are added.  Null is the empty text: no bytes, no tokens.
    Rows are independent, so repeated rows, null ids, ties and extra columns
    change nothing, and an empty table gives an empty result.  Texts are
    counted whole, however long.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    parts = docs.sparkSession.sparkContext.broadcast(prepared(path))  # grows with the vocabulary only

    def count(batches):
        counter = TokenCounter(parts.value)
        for batch in batches:
            texts = batch.column(1)
            n = pa.array((counter.count(t.as_py()) for t in texts), pa.int64())
            sizes = pc.cast(pc.binary_length(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
