"""Row rules, null policy and the check report."""

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docintake.fixed_values import KEY_LENGTH, KEY_RULES, WARNING_SHARE
from docintake.functions import text

# --- rules: a condition that is false (not null) for an absent value ---------


def sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def has_sign(c: Column, sign: str) -> Column:
    return sure(F.contains(c, F.lit(sign)))


def in_range(c: Column, low: int, high: int) -> Column:
    return sure(c.between(low, high))


def longer_than(c: Column, n: int) -> Column:
    return sure(F.length(c) > n)


def connection_rules(host: Column, port: Column, user: Column, password: Column) -> dict[str, Column]:
    """The four checks of a mail connection row."""
    return {
        "host_valid": has_sign(host, "."),
        "port_valid": in_range(port, 1, 65535),
        "user_valid": has_sign(user, "@"),
        "password_valid": longer_than(password, 3),
    }


def key_rule(
    key: Column, provider: Column, rules: Sequence[tuple[str, str, int]] = KEY_RULES, longer: int = KEY_LENGTH
) -> Column:
    """Form and length of an access key by the rule of its provider; without a rule only the length."""
    bare = text.strip(key)
    checked = F
    for name, form, length in rules:
        checked = checked.when(provider == name, sure(F.rlike(bare, F.lit(form)) & (F.length(bare) > length)))
    return checked.otherwise(sure(F.length(bare) > longer))


def validated(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One boolean column per rule and ``valid`` for all of them."""
    checked = rows.withColumns(dict(rules))
    return checked.withColumn("valid", reduce(and_, [F.col(r) for r in rules]))


# --- report ------------------------------------------------------------------


def status(passed: Column, total: Column) -> Column:
    return (
        F.when(passed == total, F.lit("HEALTHY"))
        .when(passed >= total * WARNING_SHARE, F.lit("WARNING"))
        .otherwise(F.lit("CRITICAL"))
    )


def report(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Per rule: rows passed, rows checked, status.  One scan, one aggregate."""
    counts = rows.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(name) for name, c in rules.items()]
    )
    per_rule = counts.unpivot("total", list(rules), "check", "passed")
    return per_rule.select("check", "passed", "total", status(F.col("passed"), F.col("total")).alias("status"))


# --- nulls -------------------------------------------------------------------


def blanks_for_nulls(rows: DataFrame) -> DataFrame:
    return rows.na.fill("")


def named_rows(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose listed columns are neither null nor blank."""
    return rows.na.drop(subset=list(columns)).where(reduce(and_, [text.strip(F.col(c)) != "" for c in columns]))
