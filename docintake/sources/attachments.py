"""Landed files: listing, text extraction, landing area."""

import io
import zipfile
from collections.abc import Callable, Iterator, Mapping
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docintake.fixed_values import DOCUMENT_SUFFIXES
from docintake.functions import text
from docintake.session import send_by_value

send_by_value(__name__)

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


Reader = Callable[[bytes], str]


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Document files of one folder (not below it): ``path, modificationTime, length, content``.

    Select ``content`` only where it is needed: the source then skips reading files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    return by_suffix(files, "path")


def by_suffix(rows: DataFrame, name: str, suffixes: list[str] = DOCUMENT_SUFFIXES) -> DataFrame:
    return rows.where(text.suffix(F.col(name)).isin(suffixes))


def listing(files: DataFrame) -> DataFrame:
    """Names, sizes and times without reading a file."""
    return files.select(text.base_name(F.col("path")).alias("safe_name"), "length", "modificationTime")


# --- text --------------------------------------------------------------------


def docx_text(payload: bytes) -> str:
    """Paragraphs of the document body, one per line; tables are left out."""
    with zipfile.ZipFile(io.BytesIO(payload)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{WORD}body")
    signs = {f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n"}
    lines = []
    for paragraph in body.findall(f"{WORD}p"):
        pieces = [
            node.text or "" if node.tag == f"{WORD}t" else signs.get(node.tag, "")
            for run in paragraph.iter(f"{WORD}r")
            for node in run
        ]
        lines.append("".join(pieces))
    return "\n".join(lines)


DOCX_ONLY: Mapping[str, Reader] = {".docx": docx_text}


def with_text(files: DataFrame, *carry: str, readers: Mapping[str, Reader] = DOCX_ONLY) -> DataFrame:
    """``path, length, modificationTime``, the carried columns, ``text`` and ``error``.

    ``readers`` takes the text out of a payload, by suffix.  A file without a
    reader, or one that its reader fails on, has an empty text and an error.
    """

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [read(readers, kind, payload) for kind, payload in zip(batch["kind"], batch["content"], strict=True)]
            yield batch.drop(columns=["content", "kind"]).assign(text=[t for t, _ in found], error=[e for _, e in found])

    kept = files.select("path", "length", "modificationTime", *carry)
    found = T.StructType([*kept.schema, T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])
    narrow = files.select(*kept.columns, text.suffix(F.col("path")).alias("kind"), "content")
    return narrow.mapInPandas(texts, found)


def read(readers: Mapping[str, Reader], kind: str, payload: bytes) -> tuple[str, str | None]:
    reader = readers.get(kind)
    if reader is None:
        return "", f"no reader for {kind or 'files without suffix'}"
    try:
        return reader(payload), None
    except Exception as problem:  # a bad file gives empty text, not a failed job
        return "", f"{type(problem).__name__}: {problem}"


ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles and tags out, basic entities in."""
    c = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>", " ")
    c = F.regexp_replace(c, r"(?is)<style\b.*?</style\s*>", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for entity, sign in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


# --- landing area ------------------------------------------------------------


def land(rows: DataFrame, folder: str) -> None:
    """Append attachments (``safe_name, content, sent_iso, uid, ...``) to the landing table."""
    rows.write.mode("append").parquet(folder)


def purge(spark: SparkSession, folder: str) -> int:
    """Empty the landing table; gives the number of files it held."""
    table = spark.read.parquet(folder)
    count = table.count()
    spark.createDataFrame([], table.schema).write.mode("overwrite").parquet(folder)
    return count
