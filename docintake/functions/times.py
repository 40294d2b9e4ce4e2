"""Time text: ISO parsing and display, mail dates, date bounds."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from docintake.fixed_values import MAIL_ZONES
from docintake.functions.text import once

# the extended ISO forms a sent time is stored in
ISO_TEXT = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}:\d{2}(:\d{2}([.]\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"
)

MAIL_DATE = (
    r"^\s*(?:[A-Za-z]+,?\s+)?(\d{1,2})[ -]([A-Za-z]{3})[a-z]*[ -](\d{4})"
    r"\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s+([+-]\d{4}|[A-Za-z]+)(?:\s*\(.*\))?\s*$"
)


def parse_iso(ts: Column) -> Column:
    """ISO text to an instant; anything else gives null."""
    return F.when(ts.rlike(ISO_TEXT), ts.try_cast("timestamp"))


def format_sent_time(ts: Column) -> Column:
    """``h:mm am/pm d/M/yyyy`` in the session zone; unparsable text stays as it is."""
    t = parse_iso(ts)
    shown = F.concat(
        F.date_format(t, "h:mm "),
        F.lower(F.date_format(t, "a")),
        F.date_format(t, " d/M/yyyy"),
    )
    return F.coalesce(shown, ts, F.lit(""))


def mail_date_iso(text: Column) -> Column:
    """A mail date as ISO text that keeps its own offset; null if unparsable.

    One regex pass gives "day|month|year|hour|minute|second|zone".  A text that
    is no mail date comes back as it was, and no mail date can, as its comment
    is left out and bars stand between its fields.
    """
    known = F.create_map(*[F.lit(x) for pair in MAIL_ZONES.items() for x in pair])
    names = F.lit("janfebmaraprmayjunjulaugsepoctnovdec")

    def iso(told: Column) -> Column:
        read = F.regexp_replace(told, MAIL_DATE, "$1|$2|$3|$4|$5|$6|$7")
        return once(read, lambda read: F.when(read != told, once(F.split(read, r"\|"), laid_out)))

    def laid_out(fields: Column) -> Column:
        day, month, year, hour, minute, second, zone = (fields[i] for i in range(7))
        # position of the month name in the run of names gives its number
        at = F.instr(names, F.lower(month))
        number = F.when(at % 3 == 1, F.lpad(((at + 2) / 3).cast("int").cast("string"), 2, "0"))
        offset = F.when(F.substring(zone, 1, 1).isin("+", "-"), zone).otherwise(F.try_element_at(known, F.upper(zone)))
        clock = F.concat_ws(":", F.lpad(hour, 2, "0"), minute, F.when(second == "", F.lit("00")).otherwise(second))
        shown = F.concat(year, F.lit("-"), number, F.lit("-"), F.lpad(day, 2, "0"), F.lit("T"), clock)
        shown = F.concat(shown, F.substring(offset, 1, 3), F.lit(":"), F.substring(offset, 4, 2))
        # the shape is right by now, the numbers need not be
        return once(shown, lambda iso: F.when(iso.try_cast("timestamp").isNotNull(), iso))

    return once(text, iso)


def sent_iso(internal_date: Column, header_date: Column) -> Column:
    """Server date first, else the header date, else the empty text."""
    return F.coalesce(mail_date_iso(internal_date), mail_date_iso(header_date), F.lit(""))


def parse_day(text: Column, pattern: str = "d/M/yyyy") -> Column:
    """A day given by hand; impossible days give null."""
    return F.try_to_date(text, pattern)


def utc_day_start(day: Column) -> Column:
    """First instant of a day in UTC, whatever the session zone is."""
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00Z")).try_cast("timestamp")


def day_bounds(first: Column, last: Column, pattern: str = "d/M/yyyy") -> tuple[Column, Column]:
    """Closed-open UTC instants that cover both days whole."""
    return (
        utc_day_start(parse_day(first, pattern)),
        utc_day_start(F.date_add(parse_day(last, pattern), 1)),
    )
