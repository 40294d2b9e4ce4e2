"""Many names found in texts at once, by an Aho-Corasick automaton.

The names go to the tasks, not the texts to the names: no shuffle, and no key
that carries all texts of a common word.  What is sent is measured first;
name tables beyond the bound need the join in :mod:`mentions`.
"""

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docintake.session import send_by_value

send_by_value(__name__)

#: An automaton takes up to some sixty bytes for each character; one shard is one of these a Python worker.
SHARD_CHARS = 1_000_000
MOST_SHARDS = 4


def size_of(names: DataFrame) -> int:
    """Characters of a name table with all it carries."""
    return names.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("n")).first()["n"]


def shards_for(names: DataFrame, shard_chars: int = SHARD_CHARS, most: int = MOST_SHARDS) -> int | None:
    """How many shards a name table makes, or None if it is too large to be sent."""
    shards = max(1, math.ceil(size_of(names) / shard_chars))
    return shards if shards <= most else None


def is_word(sign: str) -> bool:
    return sign.isalnum() or sign == "_"


def at_edge(text: str, at: int) -> bool:
    """Whether a word starts or ends in front of a character."""
    return (at > 0 and is_word(text[at - 1])) != (at < len(text) and is_word(text[at]))


class Finder:
    """Whole-word occurrences of the names of one shard."""

    def __init__(self, names: list[str]):
        from ahocorasick import Automaton

        self.lengths = [len(n) for n in names]
        self.automaton = Automaton()
        for place, name in enumerate(names):
            self.automaton.add_word(name, place)
        self.automaton.make_automaton()

    def found(self, text: str | None) -> list[int]:
        """The places of the names that a text holds as whole words."""
        seen: set[int] = set()
        for last, place in self.automaton.iter(text) if text and self.lengths else ():
            if place not in seen and at_edge(text, last + 1) and at_edge(text, last + 1 - self.lengths[place]):
                seen.add(place)
        return sorted(seen)


def with_found(answers: DataFrame, text: str, names: DataFrame, shards: int, out: str = "found") -> DataFrame:
    """The answers with ``out``: the rows of ``names(name, ...)`` that the text holds as whole words, in no order.

    Names are distinct and not empty.  Texts are read once a shard, in one
    pass over the table.
    """
    spark = answers.sparkSession
    table = names.toArrow()  # at most MOST_SHARDS * SHARD_CHARS characters
    kind = T.ArrayType(T.StructType(names.schema.fields))
    parts = []
    for shard in range(shards):
        part = f"{out}_{shard}"
        shared = spark.sparkContext.broadcast(table.take(pa.array(range(shard, table.num_rows, shards), pa.int64())))

        def find(batches: Iterator[pa.RecordBatch], shared=shared, part=part) -> Iterator[pa.RecordBatch]:
            rows = shared.value.combine_chunks()
            finder = Finder(rows.column("name").to_pylist())
            structs = pa.StructArray.from_arrays([c.combine_chunks() for c in rows.columns], rows.column_names)
            for batch in batches:
                places = [finder.found(t.as_py()) for t in batch.column(text)]
                ends = [0]
                for p in places:
                    ends.append(ends[-1] + len(p))
                hits = structs.take(pa.array([n for p in places for n in p], pa.int64()))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits)
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, part])

        answers = answers.mapInArrow(find, T.StructType([*answers.schema.fields, T.StructField(part, kind)]))
        parts.append(part)
    return answers.withColumn(out, F.concat(*parts)).drop(*parts)
