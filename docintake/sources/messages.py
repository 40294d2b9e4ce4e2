"""Mail messages: raw message files to the ``messages`` table."""

import email
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from email.header import decode_header, make_header
from email.message import Message
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docintake.fixed_values import FETCH_BATCH
from docintake.functions import text, times
from docintake.schema import MESSAGES
from docintake.session import TASKS_A_CORE, list_in_few_tasks, send_by_value

send_by_value(__name__)

NO_MESSAGE = "no message"


RAW = "path string, modificationTime timestamp, length long, content binary"


def numbered(files: DataFrame) -> DataFrame:
    """``path, content, uid``; a filter on ``uid`` reaches the file listing, so files it rules out are never opened."""
    return files.select("path", "content", uid_of(F.col("_metadata.file_path")).alias("uid"))


def scan(spark: SparkSession, folder: str, names: str = "*.eml") -> DataFrame:
    """Message files of a folder and those below it; Spark leaves out files without a byte."""
    list_in_few_tasks(spark)
    options = {"pathGlobFilter": names, "recursiveFileLookup": "true"}
    return numbered(spark.read.format("binaryFile").options(**options).load(folder))


Batches = Iterator[pd.DataFrame]


@dataclass(frozen=True)
class Box:
    """A folder of message files to watch, with those below it: which names, and how many files a round."""

    spark: SparkSession
    folder: str
    names: str
    per_round: int

    def in_tasks(self) -> bool:
        """Whether tasks can list and open the files themselves."""
        if re.search(r"[*?\[{]", self.folder):  # a pattern for several folders
            return False
        try:
            system, place, _ = _system(self.folder)
            system.get_file_info(place)
        except (pa.ArrowException, OSError):
            return False
        return True

    def stream(self) -> DataFrame:
        """The files by Spark's file source, which holds the paths of all files in the driver."""
        options = {"pathGlobFilter": self.names, "recursiveFileLookup": "true", "maxFilesPerTrigger": self.per_round}
        return numbered(self.spark.readStream.format("binaryFile").schema(RAW).options(**options).load(self.folder))

    def ticks(self) -> DataFrame:
        """A stream of one row a trigger."""
        return self.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()


def watch(spark: SparkSession, folder: str, names: str = "*.eml", per_round: int = FETCH_BATCH) -> Box:
    """The same for a stream, so many files a round, older ones first."""
    list_in_few_tasks(spark)
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return Box(spark, whole, names, per_round)


def _system(folder: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a full path, the path as it is there, and what a full path has before that."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder.removeprefix("file:"), "file:"
    system, place = pafs.FileSystem.from_uri(quote(folder, safe=":/@"))
    return system, place, folder.removesuffix(place)


LISTED = "path string, modified long, length long, folder boolean"
ROWS = 10_000


def _lister(folder: str, pattern: str) -> Callable[[Batches], Batches]:
    """Folders to what lies in them; hidden names are left out as Spark leaves them out."""

    def run(batches: Batches) -> Batches:
        system, _, prefix = _system(folder)
        hidden, wanted = re.compile(r"(?!_common_metadata|_metadata)(\.|_[^=]*\Z|.*\._COPYING_\Z)", re.S), re.compile(pattern, re.S)
        for batch in batches:
            for path in batch["path"]:
                found = system.get_file_info(pafs.FileSelector(path.removeprefix(prefix), allow_not_found=True))
                for start in range(0, len(found), ROWS):
                    rows = [
                        (prefix + x.path, (x.mtime_ns or 0) // 1000, x.size or 0, x.type == pafs.FileType.Directory)
                        for x in found[start : start + ROWS]
                        if not hidden.match(x.base_name) and (x.type == pafs.FileType.Directory or x.is_file and wanted.fullmatch(x.base_name))
                    ]
                    yield pd.DataFrame(rows, columns=["path", "modified", "length", "folder"])

    return run


def listed(spark: SparkSession, box: Box, scratch: str) -> DataFrame:
    """``path, uid, modified, length`` of the files of a box, written below ``scratch``.

    Tasks list the folders, level by level.  Neither files nor folders come to
    the driver.
    """
    pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern(box.names).compiled().pattern()
    tasks = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    folders, depth = spark.createDataFrame([(box.folder,)], "path string"), 0
    while depth == 0 or not folders.isEmpty():
        level = f"{scratch}/level={depth}"
        folders.repartition(tasks).mapInPandas(_lister(box.folder, pattern), LISTED).write.mode("overwrite").parquet(level)
        folders, depth = spark.read.schema(LISTED).parquet(level).where("folder").select("path"), depth + 1
    files = spark.read.schema(f"{LISTED}, level int").parquet(scratch).where("not folder")
    return files.select("path", uid_of(F.col("path")).alias("uid"), "modified", "length")


PIECE = 4 << 20


def _opener(folder: str, longest: int) -> Callable[[Batches], Batches]:
    """Batches with the ``content`` of their files, about ``PIECE`` bytes at once."""

    def run(batches: Batches) -> Batches:
        system, _, prefix = _system(folder)
        for batch in batches:
            start, size, contents = 0, 0, []
            for n, path in enumerate(batch["path"], 1):
                with system.open_input_file(path.removeprefix(prefix)) as file:
                    if file.size() > longest:
                        raise ValueError(f"{path} has {file.size()} bytes, more than spark.sql.sources.binaryFile.maxLength")
                    contents.append(file.read())
                size += len(contents[-1])
                if size >= PIECE or n == len(batch):
                    yield batch[start:n].assign(content=contents)
                    start, size, contents = n, 0, []

    return run


A_FOLDER = 4096


def put_files(rows: DataFrame, folder: str) -> None:
    """Write ``uid, value`` as message files ``part-<uid>.eml``, ``A_FOLDER`` ids a folder; rows of one id share a file, rows without one are left out.

    The tasks write the files themselves.  Spark's writer makes a folder for
    every file, commits the folders one after the other in the driver, and on
    a local file system starts a process for the mode of each file.  A
    repeated task writes the same files again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = pafs.FileSystem.from_uri(folder)
        made, uid, out = set(), None, None
        for batch in batches:
            for own, value in zip(batch["uid"], batch["value"], strict=True):
                if out is None or own != uid:
                    if out is not None:
                        out.close()
                    place = f"{root}/{own // A_FOLDER}"
                    if place not in made:
                        system.create_dir(place, recursive=True)
                        made.add(place)
                    uid, out = own, system.open_output_stream(f"{place}/part-{own}.eml")
                out.write(f"{value or ''}\n".encode())
        if out is not None:
            out.close()
        yield pd.DataFrame({"uid": []}, dtype="int64")

    files = rows.select(F.col("uid").cast("long").alias("uid"), "value").where("uid is not null").repartition("uid").sortWithinPartitions("uid")
    files.mapInPandas(run, "uid long").write.format("noop").mode("overwrite").save()


def _decoded(value: str | None) -> str | None:
    """A header text with its encoded words read; unreadable ones stay as they are."""
    if value is None:
        return None
    try:
        return str(make_header(decode_header(value)))
    except (LookupError, ValueError):
        return str(value)


def _plain_text(message: Message) -> str:
    texts = []
    for part in message.walk():
        if part.get_content_type() != "text/plain" or part.get_filename():
            continue
        payload = part.get_payload(decode=True) or b""
        charset = part.get_content_charset() or "utf-8"
        try:
            texts.append(payload.decode(charset, errors="ignore"))
        except LookupError:  # unknown charset: this part has no text
            continue
    return "".join(texts)


def _parts(message: Message) -> list[dict]:
    found = []
    for number, part in enumerate(message.walk()):
        name = _decoded(part.get_filename())
        if name:
            found.append({"part_no": number, "filename": name, "content": part.get_payload(decode=True)})
    return found


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [f.name for f in MESSAGES.fields]
    for batch in batches:
        rows = []
        for path, content, internal in zip(batch["path"], batch["content"], batch["internal_date"], strict=True):
            row = dict.fromkeys(columns) | {"path": path, "internal_date": internal, "parts": []}
            try:
                message = email.message_from_bytes(content)
                row["header_date"] = _decoded(message["Date"])
                row["subject"] = _decoded(message["Subject"]) or ""
                row["body"] = _plain_text(message)
                row["parts"] = _parts(message)
            except Exception as problem:  # a bad message becomes a row with an error
                row["error"] = f"{type(problem).__name__}: {problem}"
            rows.append(row)
        yield pd.DataFrame(rows, columns=columns)


def uid_of(path: Column) -> Column:
    """The id of a message: the folder ``uid=...`` it lies in, else the last run of digits in its file name."""
    folder = F.regexp_extract(path, r"/uid=(\d+)/[^/]*\z", 1)
    name = F.regexp_extract(path, r"(\d+)[^/\d]*\z", 1)
    return F.when(folder != "", folder).otherwise(name).try_cast("long")


def parse(raw: DataFrame, box: Box | None = None) -> DataFrame:
    """Raw messages (``path, content`` and maybe ``internal_date``) to ``messages``; files of a ``box`` (``path``) are opened by the tasks that parse them."""
    if "internal_date" not in raw.columns:
        raw = raw.withColumn("internal_date", F.lit(None).cast("string"))
    if box is None:
        rows = raw.select("path", "content", "internal_date").mapInPandas(_parsed, MESSAGES)
    else:
        opened = _opener(box.folder, int(raw.sparkSession.conf.get("spark.sql.sources.binaryFile.maxLength")))
        rows = raw.select("path", "internal_date").mapInPandas(lambda batches: _parsed(opened(batches)), MESSAGES)
    nothing = F.col("header_date").isNull() & (F.col("subject") == "") & (F.size("parts") == 0) & text.is_blank(F.col("body"))
    return rows.withColumns(
        {
            "error": F.coalesce("error", F.when(nothing, F.lit(NO_MESSAGE))),
            "uid": uid_of(F.col("path")),
            "sent_iso": times.sent_iso(F.col("internal_date"), F.col("header_date")),
        }
    )
