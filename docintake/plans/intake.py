"""Queries on messages, attachments and intake state."""

import datetime as dt

from pyspark.sql import functions as F

from docintake.functions import text
from docintake.operators import intake
from docintake.operators.ordering import elements
from docintake.plans.registry import Tables, query
from docintake.plans import jobs
from docintake.plans.roles import (
    PAGE_KEYWORDS,
    PAGE_SUFFIXES,
    PAGE_WORDS,
    SQL_FIELDS,
    SQL_PARTS,
    iso_text,
    mailbox,
    sql_shown,
)
from docintake.session import shared_folder
from docintake.sources import attachments, messages, state
from docintake.streaming import intake as rounds

# --- events as a mailbox -----------------------------------------------------


def events_as_messages(t: Tables):
    return t.events.select(
        F.col("event_id").alias("uid"), "ts", F.col("event_type").alias("subject"), (F.col("event_type") == "view").alias("seen")
    )


@query("unseen_only", sql="select event_id as uid, event_type as subject from events where event_type <> 'view'")
def q_unseen_only(t: Tables):
    return intake.unseen(events_as_messages(t)).select("uid", "subject")


@query(
    "unseen_by_processed",
    sql="""
    select event_id as uid, event_type as subject from events
    where event_id not in (select page_id from pages)
    """,
)
def q_unseen_by_processed(t: Tables):
    processed = t.pages.select(F.col("page_id").alias("uid"))
    return intake.unseen(events_as_messages(t), processed).select("uid", "subject")


@query(
    "message_window",
    sql="""
    select event_id as uid, event_type as subject from events
    where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-11'
    """,
)
def q_message_window(t: Tables):
    rows = intake.in_window(events_as_messages(t), F.col("ts"), dt.date(2024, 1, 5), dt.date(2024, 1, 10))
    return rows.select("uid", "subject")


SQL_MARK = "(select coalesce(max(event_id), 0) from events where ts < timestamp '2024-01-15')"


@query("incremental_after_mark", sql=f"select event_id as uid, event_type as subject from events where event_id > {SQL_MARK}")
def q_incremental_after_mark(t: Tables):
    earlier = events_as_messages(t).where(F.col("ts") < F.lit(dt.date(2024, 1, 15)))
    empty = t.region.select(F.lit(None).cast("string").alias("mark"))
    mark = intake.advance_mark(empty, earlier)
    return intake.after_mark(events_as_messages(t), mark).select("uid", "subject")


@query("advance_mark", sql="select greatest(coalesce(max(event_id), 0), (select max(o_orderkey) from orders)) as mark from events")
def q_advance_mark(t: Tables):
    stored = t.orders.select(F.col("o_orderkey").cast("string").alias("mark"))
    return intake.advance_mark(stored, events_as_messages(t))


@query("recent_messages", sql="select event_id as uid, event_type as subject from events order by event_id desc limit 100")
def q_recent_messages(t: Tables):
    return intake.recent(events_as_messages(t)).select("uid", "subject")


@query(
    "batch_numbers",
    sql="""
    select event_id as uid, (row_number() over (order by event_id desc) - 1) // 100 as batch
    from events where event_type <> 'view'
    """,
)
def q_batch_numbers(t: Tables):
    return intake.numbered_batches(intake.unseen(events_as_messages(t))).select("uid", "batch")


@query(
    "upsert_last_write",
    sql="""
    with writes as (
        select user_id, event_id, case when event_type = 'click' then 1 else 0 end as gen,
               case when value > 5 then strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' else '' end as sent_iso
        from events where event_type in ('view', 'click')
    )
    select user_id::varchar as safe_name, arg_max(sent_iso, gen * 1000000000 + event_id) as sent_iso
    from writes group by user_id
    """,
)
def q_upsert_last_write(t: Tables):
    writes = t.events.select(
        "event_type",
        F.col("user_id").cast("string").alias("safe_name"),
        F.when(F.col("value") > 5, iso_text(F.col("ts"))).alias("sent_iso"),
        F.col("event_id").alias("seq"),
    )
    stored = writes.where(F.col("event_type") == "view")
    updates = writes.where(F.col("event_type") == "click")
    return intake.upsert(stored, updates, "safe_name", "sent_iso", "seq")


@query("map_state_read", sql="select event_id, 'k' as safe_name, json_extract_string(props, '$.k') as sent_iso from events")
def q_map_state_read(t: Tables):
    states = t.events.select("event_id", F.col("props").alias("value"))
    return state.sent_times_from_text(states, "event_id")


# --- pages as messages with attachments --------------------------------------


def judged(t: Tables):
    return intake.judged_parts(mailbox(t.pages), PAGE_KEYWORDS, PAGE_SUFFIXES, PAGE_WORDS)


@query(
    "keep_rule",
    sql=f"with {SQL_PARTS} select uid, part_no, filename, safe_name, obvious, kw from kept",
)
def q_keep_rule(t: Tables):
    return intake.kept_parts(judged(t), "kw").select("uid", "part_no", "filename", "safe_name", "obvious", "kw")


@query(
    "attachment_priority",
    sql=f"""
    with {SQL_PARTS}
    select uid, part_no, priority
    from (select *, row_number() over (partition by uid order by obvious desc, part_no) as priority from found)
    where readable
    """,
)
def q_attachment_priority(t: Tables):
    return intake.kept_parts(judged(t)).select("uid", "part_no", "priority")


SQL_FIRST = "row_number() over (partition by safe_name order by uid desc, obvious desc, part_no) = 1"


@query(
    "dedupe_first_wins",
    sql=f"with {SQL_PARTS} select safe_name, uid, part_no, obvious from kept qualify {SQL_FIRST}",
)
def q_dedupe_first_wins(t: Tables):
    return intake.first_wins(intake.kept_parts(judged(t)))


SQL_LANDED = f"""
    with {SQL_PARTS},
    landed as (select distinct safe_name from kept where contains(url, '.org')),
    new as (
        select * from kept where not contains(url, '.org') and safe_name not in (select safe_name from landed)
        qualify {SQL_FIRST}
    )
"""


def _rounds(t: Tables):
    """Messages of an earlier run and of this run."""
    both = judged(t)
    earlier = F.contains("url", F.lit(".org"))
    return both.where(earlier), both.where(~earlier)


@query(
    "land_new_attachments",
    sql=f"{SQL_LANDED} select safe_name, uid, part_no, obvious, md5(link) as content_md5 from new",
)
def q_land_new_attachments(t: Tables):
    earlier, now = _rounds(t)
    landed = intake.kept_parts(earlier).select("safe_name").distinct()
    new = intake.to_land(intake.kept_parts(now), landed)
    return intake.with_content(new, now).select(
        "safe_name", "uid", "part_no", "obvious", F.md5("content").alias("content_md5")
    )


@query(
    "run_counters",
    sql=f"""
    {SQL_LANDED}
    select (select count(*) from messages where not contains(url, '.org')) as messages_processed,
           count(distinct uid) as messages_with_attachments,
           count(*) as attachments_found,
           (select count(*) from new) as files_landed
    from found where not contains(url, '.org')
    """,
)
def q_run_counters(t: Tables):
    earlier, now = _rounds(t)
    landed = intake.kept_parts(earlier).select("safe_name").distinct()
    return intake.run_counters(now, intake.to_land(intake.kept_parts(now), landed))


@query(
    "mark_processed",
    sql=f"with {SQL_PARTS} select uid, kw or uid in (select uid from found) as kept from messages",
)
def q_mark_processed(t: Tables):
    return intake.processed_rows(judged(t))


@query(
    "scan_by_extension",
    sql="select page_id, url from pages where regexp_matches(lower(url), '[^./][^/]*\\.(org|com)$') or regexp_matches(url, '/[^./][^/]*\\.html$')",
)
def q_scan_by_extension(t: Tables):
    return attachments.by_suffix(t.pages.select("page_id", "url"), "url", [".org", ".com", ".html"])


@query(
    "obvious_name",
    sql=r"""
    select page_id, regexp_matches(regexp_replace(url, '([^./][^/]*)[.][^./]*$', '\1'), '(?i)(blog|top|ref)') as obvious
    from pages
    """,
)
def q_obvious_name(t: Tables):
    return t.pages.select("page_id", text.obvious_name(F.col("url"), ["blog", "top", "ref"]).alias("obvious"))


@query(
    "sanitize_name",
    sql="""
    select page_id, regexp_replace(url, '[^\\p{L}\\p{N}_\\- ]', '_', 'g')
                    || case when url like '%/' then '_pdf' else '.pdf' end as safe_name
    from pages
    """,
)
def q_sanitize_name(t: Tables):
    return t.pages.select("page_id", text.sanitize_name(F.concat("url", F.lit(".pdf"))).alias("safe_name"))


@query(
    "path_parts",
    sql="""
    with b as (select page_id, regexp_extract(split_part(url, '?', 1), '([^/]*)$', 1) || '.v2.PDF' as base from pages)
    select page_id, base, base[:-5] as stem, '.pdf' as suffix from b
    """,
)
def q_path_parts(t: Tables):
    path = F.concat(F.get(F.split("url", r"\?"), F.lit(0)), F.lit(".v2.PDF"))
    return t.pages.select(
        "page_id", text.base_name(path).alias("base"), text.stem(path).alias("stem"), text.suffix(path).alias("suffix")
    )


PREFIXES = [("secure", ["HTTPS://"]), ("mobile", ["http://m.", "http://mobile"]), ("plain", ["http://"])]


@query(
    "classify_prefix",
    sql="""
    select page_id, case when starts_with(lower(url), 'https://') then 'secure'
                         when starts_with(lower(url), 'http://m.') or starts_with(lower(url), 'http://mobile') then 'mobile'
                         when starts_with(lower(url), 'http://') then 'plain' end as kind
    from pages
    """,
)
def q_classify_prefix(t: Tables):
    return t.pages.select("page_id", text.first_prefix(F.col("url"), PREFIXES).alias("kind"))


# --- raw messages ------------------------------------------------------------


def raw_messages(pages):
    """Pages written out as multipart mail, byte for byte."""
    crlf = "\r\n"

    def encoded(c):
        return F.base64(c)

    head = F.concat(
        F.lit("From: sender@example.com" + crlf + "Subject: =?utf-8?b?"),
        F.regexp_replace(encoded(F.encode("url", "UTF-8")), r"\s", ""),
        F.lit("?=" + crlf + "Date: Wed, 20 Sep 2023 10:15:00 -0400" + crlf + "MIME-Version: 1.0" + crlf),
        F.lit('Content-Type: multipart/mixed; boundary="cut"' + crlf + crlf),
    )
    body = F.concat(
        F.lit("--cut" + crlf + "Content-Type: text/plain; charset=utf-8" + crlf + "Content-Transfer-Encoding: base64" + crlf + crlf),
        encoded(F.encode("html", "UTF-8")),
    )
    part = F.concat(
        F.lit(crlf + "--cut" + crlf + 'Content-Type: application/pdf; name="cv '),
        F.col("page_id").cast("string"),
        F.lit('.pdf"' + crlf + 'Content-Disposition: attachment; filename="cv '),
        F.col("page_id").cast("string"),
        F.lit('.pdf"' + crlf + "Content-Transfer-Encoding: base64" + crlf + crlf),
        encoded(F.encode("url", "UTF-8")),
        F.lit(crlf + "--cut--" + crlf),
    )
    return pages.select(
        F.concat(F.lit("box/"), F.col("page_id").cast("string"), F.lit(".eml")).alias("path"),
        F.encode(F.concat(head, body, part), "UTF-8").alias("content"),
    )


@query(
    "parse_messages",
    sql="""
    select page_id as uid, url as subject, md5(html) as body_md5, 'cv ' || page_id || '.pdf' as filename,
           md5(url) as content_md5, '2023-09-20T10:15:00-04:00' as sent_iso
    from pages
    """,
)
def q_parse_messages(t: Tables):
    parsed = messages.parse(raw_messages(t.pages))
    return parsed.select("uid", "subject", F.md5("body").alias("body_md5"), "sent_iso", F.inline(elements("parts"))).select(
        "uid", "subject", "body_md5", "filename", F.md5("content").alias("content_md5"), "sent_iso"
    )


HTML_STEPS = r"""
    regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'),
                                  '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')
"""
for _entity, _sign in attachments.ENTITIES:
    HTML_STEPS = f"replace({HTML_STEPS}, '{_entity}', '{_sign.replace(chr(39), chr(39) * 2)}')"


@query(
    "extract_text_pages",
    sql=f"select page_id, trim(regexp_replace({HTML_STEPS}, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) as text from pages",
)
def q_extract_text_pages(t: Tables):
    return t.pages.select("page_id", attachments.html_text(F.col("html")).alias("text"))


# --- state and landing area --------------------------------------------------


@query(
    "sent_time_rounds",
    sql="""
    with writes as (
        select 'f' || user_id as safe_name, event_id, case when event_type = 'click' then 2 else 1 end as round,
               strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' as sent_iso
        from events where event_type in ('view', 'click')
    )
    select safe_name, arg_max(sent_iso, round * 1000000000 + event_id) as sent_iso from writes group by safe_name
    """,
)
def q_sent_time_rounds(t: Tables):
    folder = shared_folder(t.spark, "sent")
    rows = t.events.select(
        "event_type", F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("safe_name"), iso_text(F.col("ts")).alias("sent_iso"), F.col("event_id").alias("uid")
    )
    for number, kind in enumerate(("view", "click"), 1):
        rounds.sent_time_round(folder)(rows.where(F.col("event_type") == kind), number)
    return rounds.current_sent_times(t.spark, folder)


@query("reset_mark", sql="select event_id as uid, (select max(event_id) from events) as before from events")
def q_reset_mark(t: Tables):
    folder = shared_folder(t.spark, "mark")
    state.write_mark(intake.advance_mark(t.region.select(F.lit("0").alias("mark")), events_as_messages(t)), folder)
    before = state.read_mark(t.spark, folder)
    state.reset_mark(t.spark, folder)
    rows = intake.after_mark(events_as_messages(t), state.read_mark(t.spark, folder))
    return rows.select("uid", F.lit(before).cast("long").alias("before"))


@query("purge_landing", sql="select count(*) as purged, 0 as left_over from pages")
def q_purge_landing(t: Tables):
    folder = shared_folder(t.spark, "purged")
    attachments.land(t.pages.select(F.col("url").alias("safe_name"), F.encode("html", "UTF-8").alias("content")), folder)
    purged = attachments.purge(t.spark, folder)
    left = t.spark.read.parquet(folder).agg(F.count(F.lit(1)).cast("int").alias("left_over"))
    return left.select(F.lit(purged).cast("long").alias("purged"), "left_over")


@query(
    "round_counters",
    sql=f"""
    with {SQL_PARTS}
    select (select count(*) from messages) as messages_processed, count(distinct uid) as messages_with_attachments,
           count(*) as attachments_found, (select count(distinct safe_name) from kept) as files_landed
    from found
    """,
)
def q_round_counters(t: Tables):
    landing, counters = shared_folder(t.spark, "landing"), shared_folder(t.spark, "counters")
    rules = rounds.Rules(PAGE_KEYWORDS, PAGE_SUFFIXES, PAGE_WORDS)
    rounds.land_round(landing, rules, counters)(mailbox(t.pages).withColumn("sent_iso", F.lit("")), 1)
    return t.spark.read.parquet(counters).drop("round")


@query(
    "run_failures",
    sql="""
    with files as (select page_id, 'f' || page_id || case page_id % 3 when 0 then '.docx' when 1 then '.pdf' else '.txt' end as path from pages)
    select count(*) as rows, count(*) filter (where page_id % 3 <> 2) as failed,
           arg_max(case page_id % 3 when 0 then 'BadZipFile: File is not a zip file' else 'no reader for .pdf' end, path)
               filter (where page_id % 3 <> 2) as last_error
    from files
    """,
)
def q_run_failures(t: Tables):
    kind = F.element_at(F.array(F.lit(".docx"), F.lit(".pdf"), F.lit(".txt")), (F.col("page_id") % 3 + 1).cast("int"))
    files = t.pages.select(
        F.concat(F.lit("f"), F.col("page_id").cast("string"), kind).alias("path"),
        F.octet_length("html").alias("length"),
        F.lit(None).cast("timestamp").alias("modificationTime"),
        F.encode("html", "UTF-8").alias("content"),
    )
    readers = {**attachments.DOCX_ONLY, ".txt": lambda payload: payload.decode()}
    return intake.failures(attachments.with_text(files, readers=readers))


@query(
    "fetch_to_records",
    sql=f"""
    with {SQL_PARTS},
    first as (select *, 'Họ tên: ' || link as cut from kept qualify {SQL_FIRST})
    select coalesce({sql_shown('ts')}, '') as "Thời gian nhận", safe_name as "Nguồn", {SQL_FIELDS}
    from first left join events on event_id = uid
    """,
)
def q_fetch_to_records(t: Tables):
    landing = shared_folder(t.spark, "landing")
    named = F.transform(
        "parts",
        lambda p: p.withField("content", F.encode(F.concat(F.lit("Họ tên: "), F.decode(p["content"], "UTF-8")), "UTF-8")),
    )
    sent = t.events.select(F.col("event_id").alias("uid"), iso_text(F.col("ts")).alias("sent_iso"))
    mail = mailbox(t.pages).withColumn("parts", named).join(sent, "uid", "left")
    rounds.land_round(landing, rounds.Rules(PAGE_KEYWORDS, PAGE_SUFFIXES, PAGE_WORDS))(mail, 1)
    plain = lambda payload: payload.decode()
    return jobs.process_landed(t.spark, landing, readers={".pdf": plain, ".docx": plain})
