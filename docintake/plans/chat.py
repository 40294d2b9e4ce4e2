"""Queries on questions, conversations, answers and logs."""

from pyspark.sql import functions as F

from docintake.functions import answers, text
from docintake.operators import chat, mentions
from docintake.plans.registry import Tables, query
from docintake.plans.roles import texts
from docintake.session import shared_folder
from docintake.sources import tables

CLASSES = [("article", ["the ", "des "]), ("particle", ["nicht", "sich"]), ("ending", ["TION", "ung"])]
PHRASES = ["heon", "queon", "current time"]

SQL_CLASS = """
    case when contains(lower({c}), 'the ') or contains(lower({c}), 'des ') then 'article'
         when contains(lower({c}), 'nicht') or contains(lower({c}), 'sich') then 'particle'
         when contains(lower({c}), 'tion') or contains(lower({c}), 'ung') then 'ending'
         else 'general' end
"""


@query(
    "classify_question",
    sql=f"select conv_id, turn, {SQL_CLASS.format(c='text')} as question_type from conversations",
)
def q_classify_question(t: Tables):
    return t.conversations.select("conv_id", "turn", chat.question_class(F.col("text"), CLASSES).alias("question_type"))


@query(
    "classify_question_default",
    sql="""
    select doc_id, case when contains(x, 'tìm') then 'search' when contains(x, 'stats') or contains(x, 'count') then 'statistics'
                        when contains(x, 'skill') then 'skills' when contains(x, 'kinh nghiệm') then 'experience'
                        else 'general' end as question_type
    from (select doc_id, lower(text || case lang when 'fr' then ' KINH NGHIỆM' when 'de' then ' Skills' when 'es' then ' Tìm' else '' end) as x
          from documents)
    """,
)
def q_classify_question_default(t: Tables):
    tail = (
        F.when(F.col("lang") == "fr", " KINH NGHIỆM").when(F.col("lang") == "de", " Skills").when(F.col("lang") == "es", " Tìm")
    )
    question = F.concat("text", F.coalesce(tail, F.lit("")))
    return texts(t).select("doc_id", chat.question_class(question).alias("question_type"))


def _questions(t: Tables):
    asked = F.when(F.col("role") == "system", F.lit(" \n ")).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", asked.alias("question"))


@query(
    "guard_status",
    sql="""
    select conv_id, turn, case when role = 'system' then 'empty_question' else 'empty_dataset' end as status
    from conversations
    """,
)
def q_guard_status(t: Tables):
    nothing = t.labels.where(F.col("quality") > 1)
    return chat.routed(_questions(t), nothing).select("conv_id", "turn", "status")


@query(
    "route_time_question",
    sql="""
    select conv_id, turn, case when role = 'system' then 'none'
                               when regexp_matches(lower(text), 'heon|queon|current time') then 'clock'
                               else 'model' end as route
    from conversations
    """,
)
def q_route_time_question(t: Tables):
    return chat.routed(_questions(t), t.labels, PHRASES).select("conv_id", "turn", "route")


@query(
    "keyword_match",
    sql="select doc_id, regexp_matches(lower(text), 'thorea|blees|der schach') as matched from documents",
)
def q_keyword_match(t: Tables):
    hit = text.contains_any(F.col("text"), ["Thorea", "blees", "Der Schach"])
    return texts(t).select("doc_id", hit.alias("matched"))


# --- frames ------------------------------------------------------------------


def _shown(context):
    return F.array_join(F.transform(context, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


@query(
    "context_frame",
    sql="""
    select conv_id, turn, coalesce(string_agg(role || ': ' || text, chr(10)) over (
               partition by conv_id order by turn rows between 9 preceding and 1 preceding), '') as context
    from conversations
    """,
)
def q_context_frame(t: Tables):
    return chat.context_frame(t.conversations).select("conv_id", "turn", _shown("context").alias("context"))


@query(
    "context_frame_short",
    sql="""
    select conv_id, turn, coalesce(string_agg(role || ': ' || text, chr(10)) over (
               partition by conv_id order by turn rows between 2 preceding and 1 preceding), '') as context
    from conversations
    """,
)
def q_context_frame_short(t: Tables):
    return chat.context_frame(t.conversations, window=3).select("conv_id", "turn", _shown("context").alias("context"))


@query(
    "exchange_frame",
    sql="""
    with counted as (
        select *, sum((role = 'user')::int) over (partition by conv_id order by turn) as x from conversations
    ),
    pairs as (
        select conv_id, x, max(case when role = 'user' then turn end) as turn,
               max(case when role = 'user' then text end) as question,
               arg_min(text, turn) filter (role = 'assistant') as answer
        from counted where x > 0 group by conv_id, x
    ),
    lines as (select *, 'user: ' || question || coalesce(chr(10) || 'assistant: ' || answer, '') as line from pairs)
    select conv_id, turn, coalesce(string_agg(line, chr(10)) over (
               partition by conv_id order by x rows between 5 preceding and 1 preceding), '') as context
    from lines
    """,
)
def q_exchange_frame(t: Tables):
    return chat.exchange_frame(t.conversations).select("conv_id", "turn", _shown("context").alias("context"))


@query(
    "transcript_export",
    sql="""
    with placed as (
        select *, row_number() over (partition by conv_id order by turn) as no, count(*) over (partition by conv_id) as n
        from conversations
    )
    select conv_id, no as section,
           '## Tin nhắn ' || no || ' - ' || case when role = 'user' then '👤 Bạn' else '🤖 AI' end || chr(10)
           || '**Thời gian:** ' || strftime(timestamp '2024-01-01' + to_seconds(conv_id * 60 + turn), '%Y-%m-%d %H:%M:%S')
           || chr(10) || chr(10) || text || chr(10) || chr(10) || '---' || chr(10) || chr(10) as body
    from placed
    union all
    select distinct conv_id, 0, '# Lịch sử Chat' || chr(10) || chr(10) || 'Tổng số tin nhắn: ' || n || chr(10) || chr(10)
           || '---' || chr(10) || chr(10)
    from placed
    """,
)
def q_transcript_export(t: Tables):
    return chat.transcript_sections(_timed(t), time="at")


@query(
    "transcript_json",
    sql="""
    select conv_id, row_number() over (partition by conv_id order by turn) as no, role, md5(text) as content_md5
    from conversations
    """,
)
def q_transcript_json(t: Tables):
    lines = chat.transcript_json(t.conversations)
    parsed = F.from_json("line", "struct<role:string,content:string>")
    rows = lines.select("conv_id", "no", parsed.alias("m"))
    return rows.select("conv_id", "no", "m.role", F.md5("m.content").alias("content_md5"))


def _timed(t: Tables):
    seconds = F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn")
    return t.conversations.withColumn("at", F.timestamp_seconds(seconds))


@query(
    "role_counts",
    sql="""
    select conv_id, count(*) as messages, count_if(role = 'user')::bigint as user_messages,
           count_if(role = 'assistant')::bigint as assistant_messages,
           strftime(timestamp '2024-01-01' + to_seconds(min(conv_id * 60 + turn)), '%Y-%m-%d %H:%M:%S') as started
    from conversations group by conv_id
    """,
)
def q_role_counts(t: Tables):
    return chat.role_counts(_timed(t), "at")


# --- log ---------------------------------------------------------------------

SQL_LOG = f"""
    select conv_id * 65536 + turn as pos, timestamp '2024-01-01' + to_seconds(conv_id * 60 + turn) as ts,
           length(text) as question_length, length(role) as answer_length,
           {SQL_CLASS.format(c='text')} as question_type
    from conversations
"""


def chat_log(t: Tables):
    """Every turn as a log entry whose answer is its role."""
    answered = _timed(t).select(
        (F.col("conv_id") * 65536 + F.col("turn")).alias("pos"),
        F.col("at").alias("timestamp"),
        F.col("text").alias("question"),
        F.col("role").alias("answer"),
    )
    return chat.log_entries(answered, CLASSES)


@query(
    "log_entries",
    sql=f"select pos, question_length, answer_length, question_type from ({SQL_LOG})",
)
def q_log_entries(t: Tables):
    return chat_log(t).select("pos", "question_length", "answer_length", "question_type")


@query(
    "chat_stats",
    sql=f"""
    with log as ({SQL_LOG}),
    kinds as (select question_type, count(*) as n from log group by 1)
    select count(*) as total_chats, round(sum(question_length) / count(*), 1) as average_question,
           round(sum(answer_length) / count(*), 1) as average_answer,
           strftime(arg_max(ts, pos), '%Y-%m-%d %H:%M:%S') as last_chat,
           (select '{{' || string_agg('"' || question_type || '":' || n, ',' order by question_type) || '}}' from kinds)
               as question_types
    from log
    """,
)
def q_chat_stats(t: Tables):
    stats = chat.chat_stats(chat_log(t))
    return stats.withColumns(
        {
            "question_types": F.to_json("question_types"),
            "last_chat": F.date_format("last_chat", "yyyy-MM-dd HH:mm:ss"),
        }
    )


@query(
    "chat_stats_by_type",
    sql=f"select question_type, count(*) as chats from ({SQL_LOG}) group by 1",
)
def q_chat_stats_by_type(t: Tables):
    return chat.chat_stats_by_type(chat_log(t))


@query(
    "retention_cap",
    sql="""
    with n as (select user_id, event_id, count(*) over (partition by user_id) as n,
                      row_number() over (partition by user_id order by event_id desc) as r from events)
    select user_id, event_id from n where n <= 65 or r <= 50
    """,
)
def q_retention_cap(t: Tables):
    kept = chat.retained(t.events.select("user_id", "event_id"), "event_id", ["user_id"], high=65, low=50)
    return kept.select("user_id", "event_id")


@query(
    "retention_cap_whole_log",
    sql="select event_id from events qualify count(*) over () <= 1000 or row_number() over (order by event_id desc) <= 800",
)
def q_retention_cap_whole_log(t: Tables):
    return chat.retained(t.events.select("event_id"), "event_id")


def sql_capped(chunks: int, high: int, low: int) -> str:
    """CTEs ``log0`` to ``log{n}``: the log after each append of a chunk of conversations."""
    steps = [f"log as (select *, (pos >> 16) % {chunks} as chunk from ({SQL_LOG}))"]
    for n in range(chunks):
        both = f"select * from log where chunk = {n}" + (f" union all select * from log{n - 1}" if n else "")
        steps.append(
            f"log{n} as materialized (select * from ({both}) qualify count(*) over () <= {high} or row_number() over (order by pos desc) <= {low})"
        )
    return ",\n".join(steps)


CHUNKS, HIGH, LOW = 4, 150, 100


@query("log_append", sql=f"with {sql_capped(CHUNKS, HIGH, LOW)} select pos, question_length, answer_length, question_type from log{CHUNKS - 1}")
def q_log_append(t: Tables):
    """A log that is appended to in four runs and trimmed in each."""
    folder = shared_folder(t.spark, "chat-log")
    for n in range(CHUNKS):
        chunk = chat_log(t).where(F.shiftright("pos", 16) % CHUNKS == n)
        tables.append_retained(chunk, folder, HIGH, LOW)
    return tables.read_log(t.spark, folder).select("pos", "question_length", "answer_length", "question_type")


@query(
    "chat_stats_empty",
    sql="""
    select conv_id, turn, case when turn % 4 = 0 then 2 else 0 end as total_chats,
           case when turn % 4 = 0 then round((conv_id + turn) / 2, 1) else 0 end as average_question,
           case when turn % 4 = 0 then length(role)::double else 0 end as average_answer,
           case when turn % 4 = 0 then '2024-01-02 00:00:00' end as last_chat
    from conversations
    """,
)
def q_chat_stats_empty(t: Tables):
    """Every turn has a log of its own: two entries, a corrupt text, an empty one, or none at all."""

    def entry(day: str, length):
        return F.struct(
            F.lit(f"2024-01-{day}T00:00:00Z").alias("timestamp"), F.lit("q").alias("question"), F.col("role").alias("answer"),
            length.alias("question_length"), F.length("role").alias("answer_length"),
        )

    good = F.to_json(F.array(entry("02", F.col("conv_id")), entry("01", F.col("turn"))))
    kind = F.col("turn") % 4
    value = F.when(kind == 0, good).when(kind == 1, F.concat(good, F.lit("corrupt"))).when(kind == 2, F.lit(""))
    logs = t.conversations.select("conv_id", "turn", value.alias("value"))
    stats = chat.chat_stats_by_log(logs, tables.chat_entries(logs, "conv_id", "turn"), ["conv_id", "turn"])
    return stats.withColumn("last_chat", F.date_format("last_chat", "yyyy-MM-dd HH:mm:ss"))


@query(
    "last_n_lines",
    sql="""
    select '[' || strftime(ts, '%H:%M:%S') || '] ' || upper(event_type) || ': ' || props as line
    from events order by event_id desc limit 50
    """,
)
def q_last_n_lines(t: Tables):
    log = t.events.select(
        "event_id",
        F.date_format("ts", "HH:mm:ss").alias("timestamp"),
        F.upper("event_type").alias("level"),
        F.col("props").alias("message"),
    )
    return chat.last_lines(log, 50, [F.col("event_id").desc()])


# --- answers -----------------------------------------------------------------


@query(
    "clean_answer",
    sql="""
    with raw as (
        select doc_id, '##' || lang || chr(10) || chr(10) || ' ' || chr(10) || chr(10) || '-  one' || chr(10) || '  * two' || chr(10)
               || case lang when 'fr' then 'Tìm thấy ' when 'de' then 'KHÔNG ' when 'es' then '😀 được ' else '' end
               || text || chr(10) || '+three  ' as answer
        from documents
    ),
    laid as (
        select doc_id, regexp_replace(regexp_replace(trim(regexp_replace(answer, '\\n\\s*\\n\\s*\\n', chr(10) || chr(10), 'g'), ' ' || chr(10)),
                   '(?m)^(#{1,6})\\s*(.+)', '\\1 \\2', 'g'), '(?m)^\\s*[-*+]\\s*', '• ', 'g') as c
        from raw
    ),
    marked as (
        select doc_id, case when length(c) <= 50 or regexp_matches(c, '[\\x{1F600}-\\x{1F64F}]') then c
                            when regexp_matches(lower(c), 'tìm thấy|có|thành công|được') then '✅ ' || c
                            when regexp_matches(lower(c), 'không|chưa|thiếu') then 'ℹ️ ' || c
                            else c end as c
        from laid
    )
    select doc_id, md5(c) as answer_md5, length(c) as chars, c[:2] as start from marked
    """,
)
def q_clean_answer(t: Tables):
    mood = F.when(F.col("lang") == "fr", "Tìm thấy ").when(F.col("lang") == "de", "KHÔNG ").when(F.col("lang") == "es", "😀 được ")
    raw = F.concat(
        F.lit("##"), "lang", F.lit("\n\n \n\n-  one\n  * two\n"), F.coalesce(mood, F.lit("")), "text", F.lit("\n+three  ")
    )
    clean = answers.clean_answers(texts(t).select("doc_id", raw.alias("c")), "c")
    return clean.select(
        "doc_id", F.md5("c").alias("answer_md5"), F.length("c").cast("long").alias("chars"), F.substring("c", 1, 2).alias("start")
    )


@query(
    "json_from_answer",
    sql="""
    with a as (select event_id, event_type, json_extract_string(props, '$.k') as k from events)
    select event_id, case event_type when 'click' then 'N ' || k when 'view' then 'V' || k end as ten,
           case event_type when 'click' then k when 'view' then '["a","' || k || '"]' end as tuoi
    from a
    """,
)
def q_json_from_answer(t: Tables):
    k = F.get_json_object("props", "$.k")
    answer = (
        F.when(
            (F.col("event_type") == "error") & (F.col("event_id") % 2 == 1),
            F.concat(F.lit('{"ten": "A"}, "notes": {"x": '), k, F.lit("}")),  # members of a wrapper, no JSON value
        )
        .when(F.col("event_type") == "click", F.concat(F.lit('Sure {x\n```json\n{"ten": "N '), k, F.lit('", "tuoi": '), k, F.lit("}\n``` {}")))
        .when(F.col("event_type") == "view", F.concat(F.lit('[{"ten": "V'), k, F.lit('", "tuoi": ["a","'), k, F.lit('"], "email": null}]')))
        .when(F.col("event_type") == "error", F.concat(F.lit('{"ten":1} and {"ten":'), k, F.lit("}")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("["), k, F.lit("]")))
        .otherwise(F.concat(F.lit("{'ten': "), k, F.lit("}")))
    )
    told = t.events.select("event_id", answer.alias("answer"))
    rows = answers.with_answer_info(told, "answer")
    return rows.select("event_id", "info.ten", "info.tuoi")


@query(
    "classify_error",
    sql="""
    with e as (
        select event_id, event_id % 3 + 1 as attempt,
               case event_type when 'error' then 'HTTP 429 ' || props when 'view' then 'Rate Limit hit'
                               when 'click' then 'RESOURCE_EXHAUSTED' when 'purchase' then 'timeout ' || props end as error
        from events
    )
    select event_id, case when error is null then null
                          when regexp_matches(lower(error), 'quota|429|resource_exhausted|rate limit') then 'quota' else 'other' end as kind,
           case when error is null or attempt = 3 then null
                when regexp_matches(lower(error), 'quota|429|resource_exhausted|rate limit') then 2 * attempt else 0 end as delay
    from e
    """.replace("2 * attempt", "(1 << attempt)"),
)
def q_classify_error(t: Tables):
    error = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("HTTP 429 "), "props"))
        .when(F.col("event_type") == "view", F.lit("Rate Limit hit"))
        .when(F.col("event_type") == "click", F.lit("RESOURCE_EXHAUSTED"))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("timeout "), "props"))
    )
    attempt = F.pmod("event_id", F.lit(3)) + 1
    return t.events.select(
        "event_id", text.error_class(error).alias("kind"), text.retry_delay(error, attempt, 3).cast("long").alias("delay")
    )


# --- mentions ----------------------------------------------------------------


def _names(t: Tables):
    """Names, each with a file: whole benchmark texts, their first two words, and words that many texts hold."""
    file = F.concat(F.lit("item $"), F.col("item_id").cast("string"), F.lit(".pdf"))
    item = F.col("item_id").cast("int")
    heads = F.regexp_extract("text", r"^[\p{L}]+ [\p{L}]+", 0)
    common = F.element_at(F.array(F.lit("The"), F.lit("der"), F.lit("of the")), F.pmod(item, F.lit(3)) + 1)
    kinds = [(0, F.rtrim(F.col("text"), F.lit("."))), (1, heads), (2, common)]
    return t.benchmark.select(
        F.inline(F.array(*[F.struct((item * 3 + n).alias("pos"), name.alias("name"), file.alias("file")) for n, name in kinds]))
    )


SQL_NAMES = """
    kinds as (
        select item_id * 3 as pos, rtrim(text, '.') as name, 'item $' || item_id || '.pdf' as file from benchmark
        union all
        select item_id * 3 + 1, regexp_extract(text, '^[\\p{L}]+ [\\p{L}]+', 0), 'item $' || item_id || '.pdf' from benchmark
        union all
        select item_id * 3 + 2, ['The', 'der', 'of the'][item_id % 3 + 1], 'item $' || item_id || '.pdf' from benchmark
    ),
    names as (
        select min(pos) as pos, trim(name, ' ' || chr(10)) as name, arg_min(file, pos) as file from kinds
        where trim(name, ' ' || chr(10)) <> '' group by 2
    ),
    pairs as (
        select distinct doc_id as id, name
        from documents join names on contains(text, name)
        where name <> '' and regexp_matches(text, '(^|[^0-9A-Za-z_À-ɏ])' || regexp_escape(name) || '($|[^0-9A-Za-z_À-ɏ])')
    )
"""


@query("mention_join", sql=f"with {SQL_NAMES} select id, name from pairs")
def q_mention_join(t: Tables):
    told = texts(t).select(F.col("doc_id").alias("id"), F.col("text").alias("answer"))
    return mentions.mention_pairs(told, _names(t))


@query(
    "link_names",
    sql=f"""
    with {SQL_NAMES},
    steps as (
        select p.id, list('(^|[^0-9A-Za-z_À-ɏ])' || regexp_escape(n.name) || '($|[^0-9A-Za-z_À-ɏ])' || chr(1)
                          || '\\1' || n.name || ' (' || case when l.doc_id is null then n.file else '<' || n.file || '>' end || ')\\2'
                          order by n.pos) as links
        from pairs p join names n on n.name = p.name left join labels l on l.doc_id = n.pos // 3
        group by p.id
    )
    select doc_id as id,
           md5(list_reduce(list_prepend(text, coalesce(links, [])),
                           lambda told, x: regexp_replace(told, split_part(x, chr(1), 1), split_part(x, chr(1), 2)))) as answer_md5
    from documents left join steps on id = doc_id
    """,
)
def q_link_names(t: Tables):
    told = texts(t).select(F.col("doc_id").alias("id"), F.col("text").alias("answer"))
    file = F.concat(F.lit("item $"), F.col("item_id").cast("string"), F.lit(".pdf")).alias("file")
    files = t.benchmark.join(t.labels, F.col("item_id") == F.col("doc_id")).select(file)
    files = files.select("file", F.concat(F.lit("<"), "file", F.lit(">")).alias("link"))
    return mentions.link_names(told, _names(t), files).select("id", F.md5("answer").alias("answer_md5"))


def _landed_files(t: Tables):
    file = F.concat(F.lit("cv "), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return t.labels.select(file.alias("file"), F.concat(F.lit("<"), file, F.lit(", landed/"), file, F.lit(">")).alias("link"))


@query(
    "link_if_exists",
    sql="""
    select d.doc_id, case when l.doc_id is null then 'cv ' || d.doc_id || '.pdf'
                          else '<cv ' || d.doc_id || '.pdf, landed/cv ' || d.doc_id || '.pdf>' end as link
    from documents d left join labels l on d.doc_id = l.doc_id
    """,
)
def q_link_if_exists(t: Tables):
    file = F.concat(F.lit("cv "), F.col("doc_id").cast("string"), F.lit(".pdf"))
    rows = t.documents.select("doc_id", file.alias("file"))
    return mentions.link_or_name(rows, _landed_files(t)).select("doc_id", "link")


def _told_files(t: Tables):
    answer = F.concat(
        "text", F.lit("\nSee: the cv "), F.col("doc_id").cast("string"), F.lit(".pdf, and cv "),
        (F.col("doc_id") + 1).cast("string"), F.lit(".PDF or notes.docx!"),
    )
    return texts(t).select(F.col("doc_id").alias("id"), answer.alias("answer"))


@query(
    "file_mentions",
    sql="""
    with told as (
        select doc_id as id, text || chr(10) || 'See: the cv ' || doc_id || '.pdf, and cv ' || (doc_id + 1) || '.PDF or notes.docx!' as a
        from documents
    ),
    found as (select id, regexp_extract_all(a, '(?i)[\\p{L}\\p{N}_\\s.-]+\\.(?:pdf|docx?)') as m from told),
    mentions as (select id, unnest(range(1, len(m) + 1)) as no, trim(unnest(m), ' ' || chr(9) || chr(10)) as mention from found)
    select id, no, md5(mention) as mention_md5,
           case when ends_with(mention, 'the cv ' || id || '.pdf') and id in (select doc_id from labels) then 'cv ' || id || '.pdf' end as file
    from mentions
    """,
)
def q_file_mentions(t: Tables):
    rows = mentions.resolved_mentions(_told_files(t), _landed_files(t))
    return rows.select("id", "no", F.md5("mention").alias("mention_md5"), "file")


@query(
    "link_files",
    sql="""
    select d.doc_id as id, md5(text || chr(10) || 'See: the '
               || case when l.doc_id is null then 'cv ' || d.doc_id || '.pdf'
                       else '<cv ' || d.doc_id || '.pdf, landed/cv ' || d.doc_id || '.pdf>' end
               || ', and cv ' || (d.doc_id + 1) || '.PDF or notes.docx!') as answer_md5
    from documents d left join labels l on d.doc_id = l.doc_id
    """,
)
def q_link_files(t: Tables):
    linked = mentions.link_files(_told_files(t), _landed_files(t))
    return linked.select("id", F.md5("answer").alias("answer_md5"))
