"""Queries on time text, row rules, look-ups and catalogues."""

from pyspark.sql import functions as F

from docintake.functions import times
from docintake.operators import catalog, intake, quality
from docintake.plans.registry import Tables, query
from docintake.plans.roles import iso_text, sql_shown

# --- time text ---------------------------------------------------------------


@query(
    "format_sent_time",
    sql=f"""
    select event_id,
           case event_type when 'click' then {sql_shown('ts')}
                           when 'view' then {sql_shown("(ts - interval 7 hour)")}
                           when 'purchase' then {sql_shown("(ts + interval 210 minute)")}
                           when 'signup' then {sql_shown("date_trunc('day', ts)")}
                           else 'at ' || user_id end as sent
    from events
    """,
)
def q_format_sent_time(t: Tables):
    ts = F.col("ts")
    written = (
        F.when(F.col("event_type") == "click", iso_text(ts))
        .when(F.col("event_type") == "view", F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+07:00")))
        .when(F.col("event_type") == "purchase", iso_text(ts, "-03:30"))
        .when(F.col("event_type") == "signup", F.date_format(ts, "yyyy-MM-dd"))
        .otherwise(F.concat(F.lit("at "), F.col("user_id").cast("string")))
    )
    return t.events.select("event_id", times.format_sent_time(written).alias("sent"))


@query(
    "mail_date_precedence",
    sql="""
    select event_id,
           case event_type when 'click' then strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-04:00'
                           when 'view' then strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+05:30'
                           when 'signup' then strftime(ts, '%Y-%m-%dT%H:%M') || ':00+00:00'
                           when 'purchase' then strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-05:00'
                           else '' end as sent_iso
    from events
    """,
)
def q_mail_date_precedence(t: Tables):
    kind, ts = F.col("event_type"), F.col("ts")
    internal = (
        F.when(kind == "click", F.concat(F.date_format(ts, "d-MMM-yyyy HH:mm:ss"), F.lit(" -0400")))
        .when(kind == "view", F.lit(None))
        .when(kind == "error", F.lit("31-Feb-2024 10:00:00 +0000"))
        .otherwise(F.lit("not a date"))
    )
    header = (
        F.when(kind == "view", F.concat(F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0530 (IST)")))
        .when(kind == "signup", F.concat(F.date_format(ts, "d MMM yyyy HH:mm"), F.lit(" GMT")))
        .when(kind == "purchase", F.concat(F.date_format(ts, "E, dd MMM yyyy HH:mm:ss"), F.lit(" EST")))
        .when(kind == "click", F.lit("Wed, 20 Sep 2023 10:15:00 -0400"))
        .otherwise(F.lit("Wed, 20 Sep 2023 25:15:00 -0400"))
    )
    mails = t.events.select("event_id", internal.alias("internal"), header.alias("header"))
    return mails.select("event_id", times.sent_iso(F.col("internal"), F.col("header")).alias("sent_iso"))


@query(
    "bound_parse",
    sql="""
    with d as (
        select o_orderkey, strftime(o_orderdate, '%-d/%-m/%Y') as first,
               '31/' || strftime(o_orderdate, '%m/%Y') as last
        from orders
    )
    select o_orderkey, strftime(try_strptime(first, '%d/%m/%Y'), '%Y-%m-%d %H:%M:%S') as start,
           strftime(try_strptime(last, '%d/%m/%Y') + interval 1 day, '%Y-%m-%d %H:%M:%S') as stop
    from d
    """,
)
def q_bound_parse(t: Tables):
    first = F.date_format("o_orderdate", "d/M/yyyy")
    last = F.concat(F.lit("31/"), F.date_format("o_orderdate", "MM/yyyy"))
    start, stop = times.day_bounds(first, last)
    shown = "yyyy-MM-dd HH:mm:ss"
    return t.orders.select(
        "o_orderkey", F.date_format(start, shown).alias("start"), F.date_format(stop, shown).alias("stop")
    )


# --- rules -------------------------------------------------------------------


def _rules():
    return quality.connection_rules(
        host=F.concat(F.col("c_mktsegment"), F.when(F.col("c_nationkey") > 12, F.lit(".example")).otherwise(F.lit(""))),
        port=F.col("c_acctbal").cast("int"),
        user=F.replace("c_name", F.lit("#0000000"), F.lit("@")),
        password=F.col("c_custkey").cast("string"),
    )


SQL_RULES = """
    select c_custkey, c_nationkey > 12 as host_valid, trunc(c_acctbal)::int between 1 and 65535 as port_valid,
           contains(replace(c_name, '#0000000', '@'), '@') as user_valid, length(c_custkey::varchar) > 3 as password_valid
    from customer
"""


@query(
    "validate_rows",
    sql=f"select *, host_valid and port_valid and user_valid and password_valid as valid from ({SQL_RULES})",
)
def q_validate_rows(t: Tables):
    rules = _rules()
    return quality.validated(t.customer, rules).select("c_custkey", *rules, "valid")


@query(
    "validate_keys",
    sql="""
    select c_custkey, case when c_mktsegment = 'BUILDING' then c_acctbal >= 0
                           when c_mktsegment = 'MACHINERY' then true
                           when c_mktsegment = 'FURNITURE' then true
                           else true end as valid
    from customer
    """,
)
def q_validate_keys(t: Tables):
    segment = F.col("c_mktsegment")
    provider = (
        F.when(segment == "BUILDING", "google").when(segment == "MACHINERY", "openrouter").when(segment == "FURNITURE", "vectorshift")
    ).otherwise("other")
    start = (
        F.when(segment == "BUILDING", F.when(F.col("c_acctbal") >= 0, "AIza").otherwise("aiza"))
        .when(segment == "MACHINERY", "sk-or-")
        .when(segment == "FURNITURE", "VS-")
        .otherwise("")
    )
    return t.customer.select("c_custkey", quality.key_rule(F.concat(start, "c_name"), provider).alias("valid"))


@query(
    "quality_report",
    sql=f"""
    with r as ({SQL_RULES}),
    c as (
        select unnest(['host_valid', 'port_valid', 'user_valid', 'password_valid']) as "check",
               unnest([count_if(host_valid), count_if(port_valid), count_if(user_valid), count_if(password_valid)])::bigint as passed,
               count(*) as total
        from r
    )
    select *, case when passed = total then 'HEALTHY' when passed >= total * 0.8 then 'WARNING' else 'CRITICAL' end as status
    from c
    """,
)
def q_quality_report(t: Tables):
    return quality.report(t.customer, _rules())


@query(
    "null_policy",
    sql="""
    select d.doc_id, coalesce(quality::varchar, '') as quality, coalesce(toxic::varchar, '') as toxic
    from documents d left join labels l on d.doc_id = l.doc_id
    """,
)
def q_null_policy(t: Tables):
    rated = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return quality.blanks_for_nulls(
        rated.select("doc_id", F.col("quality").cast("string"), F.col("toxic").cast("string"))
    )


@query(
    "named_rows",
    sql="""
    select d.doc_id, quality::varchar as quality
    from documents d join labels l on d.doc_id = l.doc_id where quality = 1
    """,
)
def q_named_rows(t: Tables):
    rated = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    text = F.when(F.col("quality") == 0, F.lit(" \t")).otherwise(F.col("quality").cast("string"))
    return quality.named_rows(rated.select("doc_id", text.alias("quality")), ["doc_id", "quality"])


# --- look-ups and catalogues -------------------------------------------------


@query(
    "lookup_label",
    sql="""
    select c_custkey, coalesce(n_name, 'unknown') as n_name,
           case when n_name is null then c_nationkey::varchar else c_nationkey || ' (' || n_name || ')' end as label
    from customer left join (select * from nation where n_regionkey <> 1) on c_nationkey = n_nationkey
    """,
)
def q_lookup_label(t: Tables):
    priced = t.nation.where(F.col("n_regionkey") != 1).withColumnRenamed("n_nationkey", "c_nationkey")
    return catalog.with_label(t.customer, "c_nationkey", priced, "n_name").select("c_custkey", "n_name", "label")


@query(
    "catalog_union",
    sql="select c_nationkey as nation from customer union select s_nationkey from supplier",
)
def q_catalog_union(t: Tables):
    return catalog.catalogue(
        t.customer.select(F.col("c_nationkey").alias("nation")),
        t.supplier.select(F.col("s_nationkey").alias("nation")),
        merge=True,
    )


@query("fallback_if_empty", sql="select n_nationkey as nation from nation")
def q_fallback_if_empty(t: Tables):
    none = t.customer.where(F.col("c_acctbal") > 1e12).select(F.col("c_nationkey").alias("nation"))
    return catalog.catalogue(none, t.nation.select(F.col("n_nationkey").alias("nation")), merge=False)


@query("fallback_not_needed", sql="select s_nationkey as nation from supplier")
def q_fallback_not_needed(t: Tables):
    left = t.supplier.select(F.col("s_nationkey").alias("nation"))
    return intake.left_or_right(left, t.nation.select(F.col("n_nationkey").alias("nation")))
