"""Record tables and chat logs as files."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docintake.fixed_values import CHAT_LOG_HIGH, CHAT_LOG_LOW
from docintake.functions.answers import strict_json
from docintake.operators.chat import retained
from docintake.schema import CHAT_LOG, RECORDS
from docintake.session import written
from docintake.sources import generations

CSV_ROWS = 20_000

CSV = {
    "header": "true",
    "multiLine": "true",
    "escape": '"',
    "encoding": "UTF-8",
    "lineSep": "\n",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_csv(rows: DataFrame, folder: str) -> None:
    """Replace the CSV output; texts with quotes and line breaks read back exactly.

    A file with line breaks inside cells is read by one task, so the files are
    kept short by a number of rows.
    """
    rows.write.mode("overwrite").options(**CSV, quoteAll="true", maxRecordsPerFile=str(CSV_ROWS)).csv(folder)


def read_csv(spark: SparkSession, folder: str, schema: T.StructType = RECORDS) -> DataFrame:
    """Texts as they are: ``NA`` stays a text and an empty cell is the empty text."""
    return spark.read.options(**CSV, maxCharsPerColumn="-1").schema(schema).csv(folder).na.fill("")


def save_records(records: DataFrame, folder: str) -> int:
    """Write the records as CSV and give their number, counted while writing.

    Without records nothing is written at all.
    """
    counted = Observation("records")
    rows = written(records.observe(counted, F.count(F.lit(1)).alias("n")), "records")
    if counted.get["n"]:
        write_csv(rows, folder)
    return counted.get["n"]


LOG = T.StructType([T.StructField("pos", T.LongType()), *CHAT_LOG])


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log table, rows with ``pos``; empty before the first entry."""
    return generations.read(spark, folder, "log", LOG)


def append_retained(entries: DataFrame, folder: str, high: int = CHAT_LOG_HIGH, low: int = CHAT_LOG_LOW) -> None:
    """Add entries (with ``pos``) to the log and trim it, as one step.

    The kept rows, ``high`` at most, become the next generation of the log; a
    run that dies at any point leaves the old log or the new one.
    """
    log = read_log(entries.sparkSession, folder)
    both = log.unionByName(entries.select(log.columns))
    generations.replace({"log": retained(both, high=high, low=low)}, folder)


def import_chat_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a foreign JSON log file with their place ``pos``; missing, empty and corrupt files give no rows.

    Such a file is one value; import it once and go on with the log table.
    """
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)
    return chat_entries(raw)


def chat_entries(logs: DataFrame, *carry: str) -> DataFrame:
    """The entries of JSON logs in ``value``, each with its place ``pos`` in its log."""
    parsed = strict_json(logs, "value", T.ArrayType(CHAT_LOG).simpleString(), "entries")
    found = parsed.select(*carry, F.posexplode("entries").alias("pos", "entry")).where(F.col("entry.question").isNotNull())
    return found.select(*carry, F.col("pos").cast("long").alias("pos"), "entry.*")
