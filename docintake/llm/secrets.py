"""Secret scan through a trigram inverted index.

Each rule's expression gives a Boolean trigram query.  The index holds, for the
trigrams of all queries, the documents they occur in; the postings of an
alternative are intersected by counting its trigrams per document, those of a
rule's alternatives are united.  Only the candidates are verified with the
expression itself.  A rule without a mandatory trigram scans every text.
"""

import hashlib
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docintake.llm.common import let, text_of
from docintake.llm.trigrams import ANY, trigram_query
from docintake.session import send_by_value

send_by_value(__name__)


@dataclass(frozen=True)
class Rule:
    """Matches are found from the left without overlap; those whose group is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 20),
    # the same as the runs [0-9a-f]+ of 24 signs and more
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hosting_token", r"gh[opsu]_[A-Za-z0-9]{36}"),
    Rule("chat_token", r"xox[abp]-[A-Za-z0-9-]{20,}"),
)
RULES = BASE + MORE


def index(docs: DataFrame, key: Column, text: Column, trigrams: list[str]) -> DataFrame:
    """(key, trigram): the postings of the given trigrams; documents whose key is the same count once."""
    found = let(F.lower(text), lambda low: F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(low, t)))
    return docs.select(key.alias("key"), F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, key: Column, text: Column, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(key, rules): the documents each rule must verify; None if no rule has a mandatory trigram."""
    queries = {r.kind: trigram_query(r.pattern, r.flags) for r in rules}
    terms = [
        (kind, n, trigram, len(alternative))
        for kind, query in queries.items()
        if query != ANY
        for n, alternative in enumerate(sorted(query, key=sorted))
        for trigram in alternative
    ]
    if not terms:
        return None
    # as many rows as the rules' expressions have trigrams
    asked = docs.sparkSession.createDataFrame(terms, "kind string, alternative int, term string, need int")
    postings = index(docs, key, text, sorted({t[2] for t in terms}))
    met = postings.join(F.broadcast(asked), F.col("trigram") == F.col("term"))
    seen = met.groupBy("key", "kind", "alternative", "need").agg(F.collect_set("trigram").alias("seen"))
    whole = seen.where(F.size("seen") == F.col("need"))
    return whole.groupBy("key").agg(F.collect_set("kind").alias("rules"))


def verifier(rules: tuple[Rule, ...]):
    """A column function (text, kinds to verify) -> what was found."""
    order = {r.kind: n for n, r in enumerate(rules)}
    base = {r.kind for r in BASE}
    always = {r.kind for r in rules if trigram_query(r.pattern, r.flags) == ANY}

    def written(spans) -> str:
        return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, clean string")
    def verify(texts: pd.Series, asked: pd.Series) -> pd.DataFrame:
        patterns = {r.kind: (re.compile(r.pattern, r.flags), r) for r in rules}
        rows = []
        for text, kinds in zip(texts, asked, strict=True):
            spans = []
            for kind in always.union(kinds if kinds is not None else ()):
                pattern, rule = patterns[kind]
                spans += [
                    (m.start(), order[kind], kind, m.end())
                    for m in pattern.finditer(text)
                    if m.end(rule.group) - m.start(rule.group) >= rule.least
                ]
            spans.sort()
            own = [s for s in spans if s[2] in base]
            counts = [sum(s[2] == kind for s in own) for kind in ("assign", "access", "hex")]
            rows.append((*counts, hashlib.sha256(written(own).encode()).hexdigest(), written(spans), masked(text, spans)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "clean"])

    return verify


def masked(text: str, spans) -> str | None:
    """The text with each stretch of overlapping spans replaced by the first one's kind; None without spans."""
    if not spans:
        return None
    out, at = [], 0
    for start, _, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def found_in(docs: DataFrame, doc_id: str, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """The documents with a struct column ``__found``; rows of equal id and text share their postings."""
    key = F.struct(F.col(doc_id).alias("id"), F.xxhash64(text_of(text)).alias("hash"))
    asked = candidates(docs, key, text_of(text), rules)
    if asked is None:
        kinds = docs.withColumn("__rules", F.array().cast("array<string>"))
    else:
        asked = asked.select(F.col("key").alias("__key"), F.col("rules").alias("__rules"))
        kinds = docs.withColumn("__at", key).join(asked, F.col("__at") == F.col("__key"), "left").drop("__at", "__key")
    return kinds.withColumn("__found", verifier(rules)(text_of(text), F.col("__rules"))).drop("__rules")


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points by start, then by the rules'
    order.  Null is the empty text, with no spans and the digest of nothing.
    Repeated rows give repeated results, an empty table an empty one; other
    columns of the input are ignored.
    """
    found = found_in(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", rules)
    return found.select("doc_id", *(f"__found.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")))


def without_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every secret replaced by ``<kind>``; a column n_chars follows the text."""
    found = found_in(docs, doc_id, text, rules)
    clean = F.coalesce("__found.clean", text)
    new = {text: clean} | ({"n_chars": F.when(F.col("__found.clean").isNull(), F.col("n_chars")).otherwise(F.length(clean))} if "n_chars" in docs.columns else {})
    return found.withColumns(new).select(*docs.columns)
