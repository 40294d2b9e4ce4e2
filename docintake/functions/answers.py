"""Model answers: JSON taken out of free text, and clean-up for display."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docintake.fixed_values import (
    BARE_ARRAY,
    BARE_OBJECT,
    BULLET,
    FACE_EMOJI,
    FENCED_ARRAY,
    FENCED_OBJECT,
    MOOD_MIN_LENGTH,
    NEGATIVE_MARK,
    NEGATIVE_WORDS,
    POSITIVE_MARK,
    POSITIVE_WORDS,
)
from docintake.functions.text import contains_any, strip
from docintake.schema import INFO

STRICT = {"allowSingleQuotes": "false"}


def strict_json(rows: DataFrame, candidate: str, ddl: str, out: str) -> DataFrame:
    """Parse a whole text as one JSON value into ``out``, or null.

    Spark's parser stops after the first value and would let trailing text
    pass.  So the text is wrapped together with its own hash: the hash only
    comes back if the parser read the candidate to its end, and the wrapper
    only has its own two members if the candidate is one value.
    """
    seal = F.xxhash64(candidate).cast("string")
    wrapped = F.concat(F.lit('{"v":'), candidate, F.lit(',"seal":"'), seal, F.lit('"}'))
    alone = F.json_object_keys(wrapped) == F.array(F.lit("v"), F.lit("seal"))
    parsed = rows.withColumn("__parsed", F.from_json(wrapped, f"struct<v:{ddl},seal:string>", STRICT))
    return parsed.withColumn(out, F.when(alone & (F.col("__parsed.seal") == seal), F.col("__parsed.v"))).drop("__parsed")


def _first_of(rows: DataFrame, answer: str, fenced: str, bare: str, out: str) -> DataFrame:
    """The fenced value, else the bare one, else the whole answer, trimmed.

    One column per pattern, so that each runs once and only where it is needed.
    """
    rows = rows.withColumn("__fenced", F.regexp_extract(answer, fenced, 1))
    rows = rows.withColumn("__bare", F.when(F.col("__fenced") == "", F.regexp_extract(answer, bare, 1)))
    chosen = (
        F.when(F.col("__fenced") != "", F.col("__fenced"))
        .when(F.col("__bare") != "", F.col("__bare"))
        .otherwise(strip(F.col(answer)))
    )
    return rows.withColumn(out, chosen).drop("__fenced", "__bare")


def with_answer_info(rows: DataFrame, answer: str, out: str = "info") -> DataFrame:
    """The nine fields of an answer that is a non-empty JSON object, else null."""
    found = _first_of(rows, answer, FENCED_OBJECT, BARE_OBJECT, "__text")
    usable = F.startswith("__text", F.lit("{")) & ~F.col("__text").rlike(r"^\{\s*\}$")
    found = found.withColumn("__text", F.when(usable, F.col("__text")))
    return strict_json(found, "__text", INFO.simpleString(), out).drop("__text")


def with_answer_array(rows: DataFrame, answer: str, out: str) -> DataFrame:
    """The strings of a JSON array in an answer; null if there is no array."""
    found = _first_of(rows, answer, FENCED_ARRAY, BARE_ARRAY, "__text")
    found = found.withColumn("__text", F.when(F.startswith("__text", F.lit("[")), F.col("__text")))
    parsed = strict_json(found, "__text", "array<string>", out).drop("__text")
    return parsed.withColumn(out, F.array_compact(out))


def tidy_layout(answer: Column) -> Column:
    """One blank line at most, a blank after heading signs, one bullet sign."""
    c = strip(F.regexp_replace(answer, r"(?U)\n\s*\n\s*\n", "\n\n"))
    c = F.regexp_replace(c, r"(?Umd)^(#{1,6})\s*(.+)", "$1 $2")
    return F.regexp_replace(c, r"(?Umd)^\s*[-*+]\s*", BULLET)


def mark_mood(answer: Column) -> Column:
    """A sign in front of long answers that carry no face emoji yet."""
    open_to_mark = (F.length(answer) > MOOD_MIN_LENGTH) & ~answer.rlike(FACE_EMOJI)
    return (
        F.when(open_to_mark & contains_any(answer, POSITIVE_WORDS), F.concat(F.lit(POSITIVE_MARK), answer))
        .when(open_to_mark & contains_any(answer, NEGATIVE_WORDS), F.concat(F.lit(NEGATIVE_MARK), answer))
        .otherwise(answer)
    )


def clean_answers(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """Answers laid out and marked for display."""
    laid = rows.withColumn(answer, tidy_layout(F.col(answer)))
    return laid.withColumn(answer, mark_mood(F.col(answer)))
