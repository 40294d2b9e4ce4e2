"""Extraction by an injected model client, one client per task."""

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docintake.fixed_values import BARE_OBJECT, FENCED_OBJECT, INFO_KEYS, MAX_ATTEMPTS, QUOTA_WORDS
from docintake.functions import text
from docintake.operators.records import with_info, with_regex_info
from docintake.schema import RESPONSES
from docintake.session import send_by_value

send_by_value(__name__)

INSTRUCTION = (
    "Read the curriculum vitae below and answer with one JSON object and nothing else. "
    f"Its keys are {', '.join(INFO_KEYS)}; every value is a text, empty when the document does not tell."
)

#: Blocks that are Python texts at the same time; a whole Arrow batch holds up to 64 MB of them.
BLOCKS_AT_ONCE = 256
ARROW = pa.schema([("doc_id", pa.int64()), ("block", pa.int32()), ("attempt", pa.int32()), ("response", pa.string()), ("error", pa.string())])


class Client(Protocol):
    def generate_content(self, parts: list[str]) -> str: ...


def _usable(answer: str | None) -> bool:
    """Whether asking again is pointless: the answer holds a non-empty JSON object."""
    found = re.search(FENCED_OBJECT, answer or "") or re.search(BARE_OBJECT, answer or "")
    try:
        value = json.loads(found.group(1)) if found else None
    except ValueError:
        return False
    return isinstance(value, dict) and bool(value)


def _attempts(client: Client, instruction: str, document: str, attempts: int, wait: Callable[[float], None]):
    """Ask until an answer holds an object; the caller judges the answers again in SQL."""
    for attempt in range(1, attempts + 1):
        answer, error = None, None
        try:
            answer = client.generate_content([instruction, document])
        except Exception as problem:
            error = f"{type(problem).__name__}: {problem}"
        yield attempt, answer, error
        if _usable(answer):
            return
        if error and attempt < attempts and any(w in error.lower() for w in QUOTA_WORDS):
            wait(2.0**attempt)


def ask(
    documents: DataFrame,
    client_factory: Callable[[], Client],
    instruction: str = INSTRUCTION,
    attempts: int = MAX_ATTEMPTS,
    wait: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """``responses`` of a model for ``documents(doc_id, text)``; blank texts are not asked.

    A text is asked about block by block, so all of it is read; ``attempts``
    bounds the calls for a block.

    Write the result to a table before using it: a repeated task would
    otherwise repeat paid calls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = client_factory()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCKS_AT_ONCE):
                some = batch.slice(at, BLOCKS_AT_ONCE).to_pydict()
                rows = [
                    {"doc_id": doc_id, "block": block, "attempt": attempt, "response": answer, "error": error}
                    for doc_id, block, document in zip(some["doc_id"], some["block"], some["text"], strict=True)
                    for attempt, answer, error in _attempts(client, instruction, document, attempts, wait)
                ]
                yield pa.RecordBatch.from_pylist(rows, ARROW)

    asked = documents.where(~text.is_blank(F.col("text")))
    asked = asked.select("doc_id", F.posexplode(text.blocks(F.col("text"))).alias("block", "text"))
    return asked.mapInArrow(run, RESPONSES)


def extract_with(documents: DataFrame, client_factory: Callable[[], Client] | None, folder: str | None = None) -> DataFrame:
    """Documents with ``info``: by model and regex, or by regex alone without a client."""
    if client_factory is None:
        return with_regex_info(documents)
    if folder is None:
        raise ValueError("a folder for the responses is needed")
    ask(documents, client_factory).write.mode("overwrite").parquet(folder)
    responses = documents.sparkSession.read.schema(RESPONSES).parquet(folder)
    return with_info(documents, responses)
