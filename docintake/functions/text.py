"""Text columns: trimming, truncation, field extraction, names, ordered rules."""

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from docintake.fixed_values import (
    EMAIL_HOST,
    EMAIL_LOCAL_SIGN,
    INFO_KEYS,
    LABEL_SEPARATOR,
    LABELS,
    OBVIOUS_NAME_WORDS,
    PHONE_PATTERN,
    QUOTA_WORDS,
    REST_OF_LINE,
    TEXT_BUDGET,
    TRUNCATION_MARK,
    UP_TO_THREE_DIGITS,
    WHITE_SPACE,
)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def truncate(c: Column, budget: int = TEXT_BUDGET, mark: str = TRUNCATION_MARK) -> Column:
    """The text budget of one model call: longer texts are cut and marked."""
    return F.when(F.length(c) > budget, F.concat(F.substring(c, 1, budget), F.lit(mark))).otherwise(c)


def blocks(c: Column, budget: int = TEXT_BUDGET) -> Column:
    """A text as an array of consecutive blocks within the budget; together they are the text."""
    return F.regexp_extract_all(c, F.lit(f"(?s).{{1,{budget}}}"), F.lit(0))


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """Plain substring test against a list of words, any case."""
    low = F.lower(c)
    return reduce(or_, [F.contains(low, F.lit(w.lower())) for w in words], F.lit(False))


def first_class(c: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str | None = None) -> Column:
    """Name of the first rule with a word inside the text."""
    low = F.lower(c)
    chain = F
    for name, words in rules:
        hit = reduce(or_, [F.contains(low, F.lit(w.lower())) for w in words])
        chain = chain.when(hit, F.lit(name))
    return chain.otherwise(F.lit(default))


def first_prefix(c: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Name of the first rule with a prefix the text starts with; null without one."""
    low = F.lower(strip(c))
    chain = F
    for name, prefixes in rules:
        hit = reduce(or_, [F.startswith(low, F.lit(p.lower())) for p in prefixes])
        chain = chain.when(hit, F.lit(name))
    return chain.otherwise(F.lit(None).cast("string"))


# --- field extraction --------------------------------------------------------


def label_pattern(field: str) -> str:
    value = UP_TO_THREE_DIGITS if field == "tuoi" else REST_OF_LINE
    return f"(?:{'|'.join(LABELS[field])}){LABEL_SEPARATOR}{value}"


def fold_case(c: Column) -> Column:
    """Lower case that also folds the letters a regex treats as equal to i, s and k.

    These letters are rare, so the slow character-wise replacement is kept to
    the texts that hold one.
    """
    rare = reduce(or_, [F.contains(c, F.lit(x)) for x in "\u0130\u0131\u017f\u212a"])
    return F.when(rare, F.lower(F.translate(c, "\u0130\u0131\u017f\u212a", "iisk"))).otherwise(F.lower(c))


def first_place(c: Column, words: Sequence[str]) -> Column:
    """Place (from 1) of the first of some words in a text; null without any."""
    return F.least(*[F.nullif(F.instr(c, F.lit(w)), F.lit(0)) for w in words], F.lit(None).cast("int"))


def extract_field(text: Column, field: str, folded: Column | None = None) -> Column:
    """First match of one field, trimmed, or the empty text.

    A match of a labelled field starts at one of its labels, so the regex is
    only run from the first label on, and not at all on texts without one.
    Folding keeps the places of characters.
    """
    if field == "email":
        # start at the head of a run and never give signs of the run back
        pattern = f"(?<!{EMAIL_LOCAL_SIGN})({EMAIL_LOCAL_SIGN}++{EMAIL_HOST})"
        found = F.when(F.contains(text, F.lit("@")), F.regexp_extract(text, f"(?iU){pattern}", 1))
    elif field == "dien_thoai":
        found = F.regexp_extract(text, f"(?iU){PHONE_PATTERN}", 1)
    else:
        folded = fold_case(text) if folded is None else folded
        start = first_place(folded, [x.lower() for x in LABELS[field]])
        # no label, no start: the null passes through without running the regex
        found = F.regexp_extract(F.substr(text, start), f"(?iU){label_pattern(field)}", 1)
    return F.coalesce(strip(found), F.lit(""))


def extract_info(text: Column, folded: Column | None = None) -> Column:
    """The nine fields of a text as one struct."""
    return F.struct(*[extract_field(text, k, folded).alias(k) for k in INFO_KEYS])


def blank_info() -> Column:
    return F.struct(*[F.lit("").alias(k) for k in INFO_KEYS])


# --- names and paths ---------------------------------------------------------


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^/]*)\z", 1)


def suffix(name: Column) -> Column:
    """Last dot and what follows, lower case; leading dots are part of the stem."""
    return F.lower(raw_suffix(name))


def raw_suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"(?s)[^./][^/]*?([.][^./]*)\z", 1)


def stem(name: Column) -> Column:
    base = base_name(name)
    return F.substr(base, F.lit(1), F.length(base) - F.length(raw_suffix(name)))


def without_suffix(name: Column) -> Column:
    """The whole name up to its suffix, a folder part included."""
    return F.substr(name, F.lit(1), F.length(name) - F.length(raw_suffix(name)))


def sanitize_name(name: Column) -> Column:
    """Every other sign than letters, digits, ``_``, ``-`` and blank replaced in front of the suffix.

    Slashes are such signs, so names that differ in a folder part stay apart.
    """
    return F.concat(F.regexp_replace(without_suffix(name), r"[^\p{L}\p{N}_\- ]", "_"), raw_suffix(name))


def obvious_name(name: Column, words: Sequence[str] = OBVIOUS_NAME_WORDS) -> Column:
    return without_suffix(name).rlike(f"(?iu)({'|'.join(words)})")


def size_text(length: Column) -> Column:
    return F.format_string("%.1f KB", F.bround(length / F.lit(1024.0), 1))


# --- errors ------------------------------------------------------------------


def error_class(error: Column) -> Column:
    """``quota`` errors wait before the next attempt, other errors do not."""
    return F.when(contains_any(error, QUOTA_WORDS), F.lit("quota")).when(error.isNotNull(), F.lit("other"))


def retry_delay(error: Column, attempt: Column, max_attempts: int) -> Column:
    """Seconds to wait before the next attempt; null when none follows."""
    wait = F.when(error_class(error) == "quota", F.pow(F.lit(2), attempt).cast("int")).otherwise(F.lit(0))
    return F.when(error.isNotNull() & (attempt < max_attempts), wait)
