"""How the driver tables stand in for the engine's tables, in Spark and in SQL."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docintake.fixed_values import EMAIL_HOST, EMAIL_LOCAL_SIGN, PHONE_PATTERN, RECORD_FROM_INFO, WHITE_SPACE
from docintake.functions.text import label_pattern
from docintake.plans.registry import Tables

# --- SQL fragments -----------------------------------------------------------

SQL_WHITE = "||".join(f"chr({ord(c)})" for c in WHITE_SPACE)


def sql_strip(c: str) -> str:
    return f"trim({c}, {SQL_WHITE})"


def sql_field(field: str, text: str) -> str:
    if field == "email":
        return f"regexp_extract({text}, '{EMAIL_LOCAL_SIGN}+{EMAIL_HOST}', 0)"
    if field == "dien_thoai":
        return sql_strip(f"regexp_extract({text}, '{PHONE_PATTERN}', 0)")
    return sql_strip(f"regexp_extract({text}, '(?i){label_pattern(field)}', 1)")


def sql_shown(ts: str) -> str:
    """A UTC timestamp as ``h:mm am/pm d/M/yyyy``."""
    return (
        f"ltrim(strftime({ts}, '%I'), '0') || strftime({ts}, ':%M ') || lower(strftime({ts}, '%p'))"
        f" || strftime({ts}, ' %-d/%-m/%Y')"
    )


# --- documents with labelled lines in front ----------------------------------


def texts(t: Tables) -> DataFrame:
    """Documents."""
    return t.documents


def profile(t: Tables) -> DataFrame:
    """Documents whose text starts with labelled lines in two languages."""
    line = {
        "ten": F.concat(F.lit("HỌ TÊN: U "), F.col("doc_id").cast("string")),
        "tuoi": F.concat(F.lit("Age - "), F.col("n_chars").cast("string")),
        "vi_tri": F.concat(F.lit("Vị trí:\t"), F.col("lang")),
        "hoc_van": F.concat(F.lit("education: "), F.col("source")),
        "dia_chi": F.concat(F.lit("Address:  "), F.col("lang"), F.lit(" "), F.col("source"), F.lit("  ")),
    }
    head = F.concat_ws("\n", *line.values())
    return texts(t).withColumn("text", F.concat(head, F.lit("\n"), F.col("text"), F.lit("\nSkills: "), F.col("lang")))


SQL_PROFILE = """
    select doc_id, source, lang, n_chars,
           'HỌ TÊN: U ' || doc_id || chr(10) || 'Age - ' || n_chars || chr(10) || 'Vị trí:' || chr(9) || lang || chr(10)
           || 'education: ' || source || chr(10) || 'Address:  ' || lang || ' ' || source || '  ' || chr(10)
           || text || chr(10) || 'Skills: ' || lang as text
    from documents
"""

SQL_TRUNCATED = "case when length(text) > 8000 then substring(text, 1, 8000) || '...[text truncated]' else text end"

SQL_FIELDS = ",\n".join(
    f'{sql_field(field, "cut")} as "{column}"' for column, field in RECORD_FROM_INFO.items()
)

# --- sent times --------------------------------------------------------------


def iso_text(ts: Column, offset: str = "Z") -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset))


def sent_times(t: Tables, *kinds: str, offset: str = "Z") -> DataFrame:
    """Events of some kinds as sent times of the documents with the same number."""
    events = t.events.where(F.col("event_type").isin(*kinds))
    return events.select(F.col("event_id").alias("doc_id"), iso_text(F.col("ts"), offset).alias("sent_iso"))


def source_name() -> Column:
    return F.concat("source", F.lit("/"), F.col("lang"), F.lit("-"), F.col("doc_id").cast("string"))


# --- mailbox of pages --------------------------------------------------------

PAGE_KEYWORDS = ["edthor", "quevi"]
PAGE_WORDS = ["the", "der", "ist"]
PAGE_SUFFIXES = [".pdf", ".docx"]


def mailbox(pages: DataFrame) -> DataFrame:
    """Pages as messages: the title is the subject, every link target an attachment name."""
    name = lambda h: F.regexp_extract(h, r"([^/]*)\z", 1)
    kind = lambda n: (
        F.when(n.rlike("[aeiou]$"), F.lit(".pdf")).when(n.rlike("[a-z]$"), F.lit(".DOCX")).otherwise(F.lit(".txt"))
    )
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    parts = F.transform(
        links,
        lambda h, i: F.struct(
            (i + 1).cast("long").alias("part_no"),
            F.concat(F.when(i % 3 == 2, F.lit("der/")).otherwise(F.lit("")), name(h), kind(name(h))).alias("filename"),
            # links with this ending have a payload that could not be decoded
            F.when(~h.rlike("n$"), F.encode(h, "UTF-8")).alias("content"),
        ),
    )
    return pages.select(
        F.col("page_id").alias("uid"),
        "url",
        F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("subject"),
        F.col("html").alias("body"),
        parts.alias("parts"),
    )


SQL_PARTS = """
    messages as (
        select page_id as uid, url, html,
               regexp_matches(lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1) || chr(10) || html),
                              'edthor|quevi') as kw,
               regexp_extract_all(html, 'href="([^"]+)"', 1) as links
        from pages
    ),
    links as (
        select uid, url, kw, unnest(links) as link, unnest(range(1, len(links) + 1)) as part_no from messages
    ),
    names as (
        select uid, url, kw, part_no, link, not regexp_matches(link, 'n$') as readable,
               case when part_no % 3 = 0 then 'der/' else '' end || regexp_extract(link, '([^/]*)$', 1) as stem,
               case when regexp_matches(regexp_extract(link, '([^/]*)$', 1), '[aeiou]$') then '.pdf'
                    when regexp_matches(regexp_extract(link, '([^/]*)$', 1), '[a-z]$') then '.DOCX'
                    else '.txt' end as ext
        from links
    ),
    parts as (
        select uid, url, kw, part_no, link, readable, stem || ext as filename,
               regexp_replace(stem, '[^\\p{L}\\p{N}_\\- ]', '_', 'g') || ext as safe_name,
               regexp_matches(stem, '(?i)(the|der|ist)') as obvious
        from names
        where lower(ext) in ('.pdf', '.docx')
    ),
    found as (select * from parts where obvious or kw),
    kept as (select * from found where readable)
"""
