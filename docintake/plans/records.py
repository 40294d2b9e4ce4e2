"""Queries on documents and records."""

import datetime as dt

from pyspark.sql import functions as F

from docintake.fixed_values import COL_SOURCE
from docintake.functions import text
from docintake.operators import intake, records, selection
from docintake.plans.registry import Tables, query
from docintake.plans.roles import (
    SQL_FIELDS,
    SQL_PROFILE,
    SQL_TRUNCATED,
    profile,
    sent_times,
    source_name,
    sql_field,
    sql_shown,
    texts,
)
from docintake.session import shared_folder
from docintake.sources import model, split_csv, tables

SQL_SENT = "select event_id, ts from events where event_type in ('click', 'signup')"

SQL_RECORDS = f"""
    with profiles as ({SQL_PROFILE}),
    cuts as (select *, text as cut from profiles),
    sent as ({SQL_SENT})
    select coalesce({sql_shown('ts')}, '') as "Thời gian nhận",
           lang || '-' || doc_id as "Nguồn",
           {SQL_FIELDS},
           ts
    from cuts left join sent on doc_id = event_id
"""


def _extracted(t: Tables):
    files = records.with_sent_time(profile(t), "doc_id", sent_times(t, "click", "signup"))
    return records.with_regex_info(files.withColumn("name", source_name()))


@query("records", sql=f"select * exclude (ts) from ({SQL_RECORDS})")
def q_records(t: Tables):
    return records.to_records(_extracted(t), "name")


@query("records_simple", sql=f'select * exclude (ts, "Thời gian nhận") from ({SQL_RECORDS})')
def q_records_simple(t: Tables):
    return records.to_simple_records(_extracted(t), "name")


@query(
    "records_ranked",
    sql=f"""
    select * exclude (ts), row_number() over (order by date_trunc('second', ts) desc nulls last, "Nguồn") as rank
    from ({SQL_RECORDS})
    """,
)
def q_records_ranked(t: Tables):
    return records.ranked_records(_extracted(t), "name")


@query(
    "single_document",
    sql=f"""
    with profiles as ({SQL_PROFILE}), cuts as (select *, text as cut from profiles)
    select doc_id, {SQL_FIELDS} from cuts
    """,
)
def q_single_document(t: Tables):
    """The fields of each document as it would be handled alone, from its text only."""
    alone = records.with_regex_info(profile(t).select("doc_id", "text"))
    return alone.select("doc_id", *records.record_columns(F.lit(""), F.lit(""))[2:])


@query(
    "extract_fields",
    sql=f"select doc_id, {sql_field('email', 'text')} as email, {sql_field('dien_thoai', 'text')} as dien_thoai from documents",
)
def q_extract_fields(t: Tables):
    return texts(t).select(
        "doc_id", *[text.extract_field(F.col("text"), k).alias(k) for k in ("email", "dien_thoai")]
    )


@query(
    "labelled_fields",
    sql=f"with cuts as (select doc_id, text as cut from ({SQL_PROFILE})) select doc_id, {SQL_FIELDS} from cuts",
)
def q_labelled_fields(t: Tables):
    rows = profile(t).withColumn("folded", text.fold_case(F.col("text")))
    rows = rows.select("doc_id", text.extract_info(F.col("text"), F.col("folded")).alias("info"))
    return rows.select("doc_id", *records.record_columns(F.lit(""), F.lit(""))[2:])


@query(
    "truncate_text",
    sql=f"select doc_id, md5(cut) as text_md5, length(cut) as chars from (select doc_id, {SQL_TRUNCATED} as cut from documents)",
)
def q_truncate_text(t: Tables):
    cut = t.documents.select("doc_id", text.truncate(F.col("text")).alias("cut"))
    return cut.select("doc_id", F.md5("cut").alias("text_md5"), F.length("cut").cast("long").alias("chars"))


# --- sent times --------------------------------------------------------------


@query(
    "sent_time_join",
    sql="""
    with stored as (select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' as iso from events
                    where event_type in ('click', 'signup')),
    fetched as (select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+07:00' as iso from events
                where event_type in ('signup', 'error'))
    select doc_id, coalesce(f.iso, s.iso, '') as sent_iso
    from documents
    left join stored s on s.event_id = doc_id
    left join fetched f on f.event_id = doc_id
    """,
)
def q_sent_time_join(t: Tables):
    stored = sent_times(t, "click", "signup")
    fetched = sent_times(t, "signup", "error", offset="+07:00")
    return records.with_sent_time(t.documents.select("doc_id"), "doc_id", stored, fetched)


@query(
    "time_range",
    sql=f"""
    with sent as ({SQL_SENT})
    select doc_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' as sent_iso
    from documents join sent on doc_id = event_id
    where date_trunc('second', ts) >= timestamp '2024-01-01 06:00:00'
      and date_trunc('second', ts) < timestamp '2024-01-02 18:00:00'
    """,
)
def q_time_range(t: Tables):
    files = records.with_sent_time(t.documents.select("doc_id"), "doc_id", sent_times(t, "click", "signup"))
    start = F.lit(dt.datetime(2024, 1, 1, 6, tzinfo=dt.timezone.utc))
    end = F.lit(dt.datetime(2024, 1, 2, 18, tzinfo=dt.timezone.utc))
    return records.in_time_range(files, start=start, end=end)


@query(
    "inventory_order",
    sql=f"""
    with sent as ({SQL_SENT})
    select doc_id, row_number() over (order by coalesce(date_trunc('second', ts),
               timestamp '2024-01-01 00:00:00' + to_seconds(n_chars)) desc, file) as rank
    from (select *, lang || '-' || doc_id as file from documents) left join sent on doc_id = event_id
    """,
)
def q_inventory_order(t: Tables):
    files = records.with_sent_time(t.documents.drop("text"), "doc_id", sent_times(t, "click", "signup"))
    listed = files.select(
        F.concat("lang", F.lit("-"), F.col("doc_id").cast("string")).alias("safe_name"),
        F.col("n_chars").alias("length"),
        F.timestamp_seconds(F.col("n_chars") + F.lit(1704067200)).alias("modificationTime"),
        "sent_iso",
    )
    placed = records.inventory(listed)
    return placed.select(F.regexp_extract("file", r"(\d+)$", 1).cast("long").alias("doc_id"), "rank")


@query(
    "inventory",
    sql=f"""
    with sent as ({SQL_SENT}),
    files as (select page_id, regexp_extract(url, '([^/]*)$', 1) as file, length(encode(html)) as n from pages)
    select file, printf('%.1f KB', n / 1024.0) as size, coalesce({sql_shown('ts')}, '') as sent,
           row_number() over (order by coalesce(date_trunc('second', ts),
               timestamp '2024-01-01 00:00:00' + to_seconds(page_id)) desc, file) as rank
    from files left join sent on page_id = event_id
    """.replace("length(encode(html))", "octet_length(encode(html))"),
)
def q_inventory(t: Tables):
    files = t.pages.select(
        F.col("page_id").alias("doc_id"),
        text.base_name(F.col("url")).alias("safe_name"),
        F.octet_length("html").cast("long").alias("length"),
        F.timestamp_seconds(F.col("page_id") + F.lit(1704067200)).alias("modificationTime"),
    )
    return records.inventory(records.with_sent_time(files, "doc_id", sent_times(t, "click", "signup")))


# --- model answers -----------------------------------------------------------


def _responses(t: Tables):
    """Conversation turns as attempts of the document with the conversation's number."""
    name = F.concat(F.lit('"N '), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit('"'))
    answer = (
        F.when(F.col("role") == "system", F.lit("{}"))
        .when(F.col("role") == "user", F.concat(F.lit("{broken "), F.col("text"), F.lit("}")))
        .otherwise(
            F.concat(F.lit("Sure:\n```json\n{\"ten\": "), name, F.lit(', "tuoi": '), F.length("text").cast("string"), F.lit("}\n```\n"))
        )
    )
    return t.conversations.select(
        F.col("conv_id").alias("doc_id"),
        (F.col("turn") + 1).cast("int").alias("attempt"),
        answer.alias("response"),
        F.lit(None).cast("string").alias("error"),
    )


@query(
    "resolve_responses",
    sql=f"""
    with first as (
        select conv_id, min(turn) as turn from conversations where role = 'assistant' group by conv_id
    ),
    hits as (
        select c.conv_id, c.turn, 'N ' || c.conv_id || '.' || c.turn as ten, length(c.text) as chars
        from conversations c join first f on c.conv_id = f.conv_id and c.turn = f.turn
    ),
    cuts as (select *, text as cut from ({SQL_PROFILE}))
    select doc_id,
           coalesce(ten, {sql_field('ten', 'cut')}) as "Họ tên",
           coalesce(chars::varchar, {sql_field('tuoi', 'cut')}) as "Tuổi",
           case when ten is null then {sql_field('email', 'cut')} else '' end as "Email",
           (turn + 1)::integer as attempt
    from cuts left join hits on conv_id = doc_id
    """,
)
def q_resolve_responses(t: Tables):
    rows = records.with_info(profile(t), _responses(t))
    wanted = [c for c in records.record_columns(F.lit(""), F.lit(""))[3:6]]
    return rows.select("doc_id", *wanted, "attempt")


# --- table as a whole --------------------------------------------------------


@query("records_csv_roundtrip", sql="select doc_id, source, md5(text) as text_md5 from documents")
def q_records_csv_roundtrip(t: Tables):
    folder = shared_folder(t.spark, "csv")
    rows = t.documents.select("doc_id", "source", "text")
    tables.write_csv(rows, folder)
    back = tables.read_csv(t.spark, folder, rows.schema)
    return back.select("doc_id", "source", F.md5("text").alias("text_md5"))


@query(
    "dataset_summary",
    sql="select count(*) as records, 'doc_id, text, lang, source, n_chars' as columns from documents",
)
def q_dataset_summary(t: Tables):
    return selection.dataset_summary(t.documents)


@query("rescan_if_empty", sql="select doc_id, lang, source from documents")
def q_rescan_if_empty(t: Tables):
    listed = t.documents.select("doc_id", "lang", "source")
    return intake.left_or_right(listed.where(F.col("lang") == "none yet"), listed)


@query(
    "prompt_rows",
    sql=f"""
    select doc_id >> 6 as chunk,
           'Answer from these records.' || chr(10) || 'Records: ' || count(*) || chr(10)
           || 'Columns: doc_id,lang,email,n_chars' as system,
           'doc_id,lang,email,n_chars' || chr(10) || string_agg(
               doc_id || ',' || lang || ',"' || {sql_field('email', 'text')} || '",' || n_chars, chr(10) order by doc_id) as data,
           'Who has an address?' as question
    from documents group by 1
    """.replace("Columns: doc_id,lang,email,n_chars' as system", "Columns: doc_id, lang, email, n_chars' as system"),
)
def q_prompt_rows(t: Tables):
    email = text.extract_field(F.col("text"), "email")
    line = F.concat(
        F.concat_ws(",", F.col("doc_id").cast("string"), "lang"),
        F.lit(',"'),
        email,
        F.lit('",'),
        F.col("n_chars").cast("string"),
    )
    chunks = selection.csv_chunks(texts(t), line, "doc_id")
    columns = ["doc_id", "lang", "email", "n_chars"]
    prompts = selection.question_prompts(chunks, "Who has an address?", columns, "Answer from these records.")
    return prompts.select("chunk", *[F.get("prompt", F.lit(i)).alias(c) for i, c in enumerate(["system", "data", "question"])])


@query(
    "extraction_prompts",
    sql="""
    with cuts as (select doc_id, text, unnest(range(0, (length(text) + 7999) // 8000)) as block from documents)
    select doc_id, block::integer as block, md5(substring(text, block * 8000 + 1, 8000)) as text_md5 from cuts
    """,
)
def q_extraction_prompts(t: Tables):
    asked = selection.extraction_prompts(t.documents, model.INSTRUCTION)
    return asked.select("doc_id", "block", F.md5(F.get("prompt", F.lit(1))).alias("text_md5"))


class LengthClient:
    """A model that tells the length of what it was asked about, and fails on some lengths at first.

    A task lives as long as its input is; all the client remembers is the text it was asked about last.
    """

    def __init__(self):
        self.last = None

    def generate_content(self, parts: list[str]) -> str:
        length, again = len(parts[1]), parts[1] == self.last
        self.last = parts[1]
        return "{broken" if length % 2 and not again else f'Sure: {{"ten": "N{length}"}}'


@query(
    "model_answers",
    sql="""
    select doc_id, 'N' || least(length(text), 8000) as ten, '' as email
    from documents where length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 0
    """,
)
def q_model_answers(t: Tables):
    told = t.documents.where(~text.is_blank(F.col("text")))
    found = model.extract_with(told, LengthClient, shared_folder(t.spark, "responses"))
    return found.select("doc_id", "info.ten", "info.email")


@query("extract_without_model", sql=f"with cuts as (select doc_id, text as cut from ({SQL_PROFILE})) select doc_id, {SQL_FIELDS} from cuts")
def q_extract_without_model(t: Tables):
    found = model.extract_with(profile(t), None)
    return found.select("doc_id", *records.record_columns(F.lit(""), F.lit(""))[2:])


@query("save_records_count", sql="select count(*) as saved, count(*) as read_back from documents")
def q_save_records_count(t: Tables):
    folder = shared_folder(t.spark, "records")
    rows = t.documents.select("doc_id", "source", "text")
    saved = tables.save_records(rows, folder)
    return tables.read_csv(t.spark, folder, rows.schema).agg(F.lit(saved).cast("long").alias("saved"), F.count(F.lit(1)).alias("read_back"))


@query(
    "large_csv_split",
    sql="select doc_id::varchar as doc_id, coalesce(source, '') as source, md5(coalesce(text, '')) as text_md5, length(coalesce(text, '')) as chars from documents",
)
def q_large_csv_split(t: Tables):
    """CSV files with line breaks inside cells, each read by several tasks."""
    folder = shared_folder(t.spark, "large-csv")
    rows = t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "text")
    rows.write.options(**tables.CSV, quoteAll="true").csv(folder)
    read = split_csv.read_split_csv(t.spark, folder, rows.schema)
    return read.select("doc_id", "source", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("chars"))


# --- top five ----------------------------------------------------------------


def _scored(t: Tables):
    return t.documents.join(t.labels, "doc_id").select("doc_id", "quality", "n_chars", source_name().alias(COL_SOURCE))


SQL_SCORED = """
    select d.doc_id, quality, n_chars, source || '/' || lang || '-' || d.doc_id as src
    from documents d join labels l on d.doc_id = l.doc_id
"""


def _best():
    return [F.col("quality").desc(), F.col("n_chars").desc(), F.col("doc_id").asc()]


@query(
    "top5",
    sql=f"""
    with first as (
        select row_number() over (order by quality desc, n_chars desc, doc_id) as place, src as source, doc_id, quality, n_chars
        from ({SQL_SCORED}) order by place limit 5
    )
    select item_id, first.* from benchmark, first
    """,
)
def q_top5(t: Tables):
    # each row of the benchmark is an answer of its own, and none holds an array
    told = t.benchmark.select("item_id", F.col("text").alias("response"))
    return selection.top_sources(told, _scored(t), COL_SOURCE, _best(), keys=["item_id"])


@query(
    "top5_from_answer",
    sql=f"""
    with scored as ({SQL_SCORED}),
    listed as (
        select item_id, unnest([1, 2, 3, 4]) as place,
               unnest(['item ' || item_id, d.source || '/' || d.lang || '-' || d.doc_id, 'x"y', d.source || '/' || d.lang || '-' || d.doc_id]) as source
        from benchmark join documents d on d.doc_id = item_id where item_id % 3 > 0
    ),
    first as (
        select row_number() over (order by quality desc, n_chars desc, doc_id) as place, src as source, doc_id, quality, n_chars
        from scored order by place limit 5
    )
    select item_id, place, source, doc_id, quality, n_chars from listed left join scored on src = source
    union all
    select item_id, first.* from benchmark, first where item_id % 3 = 0
    """,
)
def q_top5_from_answer(t: Tables):
    names = t.documents.select(F.col("doc_id").alias("item_id"), source_name().alias("own"))
    item = F.concat(F.lit("item "), F.col("item_id").cast("string"))
    listed = F.to_json(F.array(item, F.col("own"), F.lit('x"y'), F.col("own")))
    fenced = F.concat(F.lit("Here:\n```json\n"), listed, F.lit("\n```"))
    response = F.when(F.col("item_id") % 3 > 0, fenced).otherwise("[]")
    told = t.benchmark.select("item_id").join(names, "item_id").select("item_id", response.alias("response"))
    return selection.top_sources(told, _scored(t), COL_SOURCE, _best(), keys=["item_id"])


@query(
    "preview_head_tail",
    sql="""
    with n as (select *, row_number() over (order by o_orderkey) as a, row_number() over (order by o_orderkey desc) as z,
                      count(*) over () as c from orders)
    select * exclude (a, z, c) from n where c <= 20 or a <= 10 or z <= 10
    """,
)
def q_preview_head_tail(t: Tables):
    return selection.head_and_tail(t.orders, "o_orderkey", 20)


@query("preview_first", sql="select * from orders order by o_orderkey limit 10")
def q_preview_first(t: Tables):
    return selection.preview(t.orders, [F.col("o_orderkey")])


@query(
    "column_widths",
    sql="""
    with w as (
        select unnest(['event_id', 'user_id', 'event_type', 'props']) as "column",
               unnest([max(length(event_id::varchar)), max(length(user_id::varchar)), max(length(event_type)),
                       max(length(props))]) as n
        from events)
    select "column", least(greatest(n, length("column")) + 2, 50) as width from w
    """,
)
def q_column_widths(t: Tables):
    return selection.column_widths(t.events, ["event_id", "user_id", "event_type", "props"])
