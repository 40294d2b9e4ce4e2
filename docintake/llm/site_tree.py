"""Main text of pages by a site style tree.

The element trees of all pages of a host are merged by path: tag, class and id
words from the root down.  For every merged node two importances come from
entropies over the m pages that hold it.  Presentation: how evenly its child
sequences spread over the pages, ``-sum p log_m p``.  Content: 1 less the mean
of ``log_m c`` over the texts found there, where a text is on c pages; a text
on every page counts 0 and one on a single page counts 1.  Both are weighted
into one number per node, and nodes below ``LEAST`` are template.  Pages of a
host with equal main content count once, and of a template node only the texts
that repeat on pages of different main content go.

A page's text is all of its blocks but the site's template texts.  Being in an
article or main element is one more sign: beside one, nodes below ``BESIDE``
are template too.  Still decided by tag, role and name are the elements that
never hold main text.  The paragraphs and headings of an article come back if
more than ``MOST`` of them would go, as with near copies.
"""

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docintake.llm.common import identity, kept, text_of
from docintake.llm.html_blocks import Block, Page, Parser
from docintake.session import send_by_value

send_by_value(__name__)
send_by_value("docintake.llm.html_blocks")

LEAST = 0.3
BESIDE = 0.5
MOST = 0.8
CONTENT = 0.9
PAGES = 4
SALTS = 16
PRESENTATION, TEXT = 0, 1


def host_of(url: str = "url") -> Column:
    """The host of an address in lower case; without one, the empty host."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def node_rows(page: Page) -> list[tuple[int, int, int, int]]:
    """(path, parent, kind, value) once a page: the child sequence of every node, and the texts at every block's path."""
    parents = {b.path: b.parent for b in page.blocks}
    rows = {(p, parents.get(p, 0), PRESENTATION, value(",".join(runs(tags)))) for p, tags in page.children.items()}
    rows |= {(p, up, PRESENTATION, 0) for p, up in parents.items() if p not in page.children}
    rows |= {(b.path, b.parent, TEXT, value(b.text)) for b in page.blocks}
    return sorted(rows)


def core_of(blocks: list[Block]) -> list[Block]:
    """The blocks in article and main elements, if they make up half of the page's text or more."""
    core = [b for b in blocks if b.main]
    return core if 2 * sum(len(b.text) for b in core) >= sum(len(b.text) for b in blocks) else []


def runs(tags: list[str]) -> list[str]:
    return [t for n, t in enumerate(tags) if not n or tags[n - 1] != t]


def value(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def nodes(pages: pd.Series) -> pd.DataFrame:
    """The node rows of each page, and a hash of its main content, which copies share."""
    parser = Parser()
    kinds = ("path", "parent", "kind", "value")
    rows, contents = [], []
    for markup in pages:
        page = parser.read(markup)
        rows.append([dict(zip(kinds, r, strict=True)) for r in node_rows(page)])
        contents.append(value("\n".join(b.text for b in core_of(page.blocks) or page.blocks)))
    return pd.DataFrame({"nodes": pd.Series(rows, dtype=object), "content": pd.Series(contents, dtype="int64")})


def parsed(rows: DataFrame) -> DataFrame:
    """(key, host, nodes, content) of the pages; rows that are equal in all columns have one key."""
    found = F.pandas_udf(nodes, "nodes array<struct<path:long,parent:long,kind:int,value:long>>, content long")
    return rows.select("key", "host", found("html").alias("x")).select("key", "host", "x.*")


def counted(pages: DataFrame) -> DataFrame:
    """(host, path, parent, kind, value, c): on how many pages of different main content a value is found.

    Of the pages of a host with equal main content one stands for all.
    """
    once = pages.groupBy("host", "content").agg(F.min_by("nodes", "key").alias("nodes"))
    rows = once.select("host", F.explode("nodes").alias("x")).select("host", "x.*")
    return rows.groupBy("host", "path", "parent", "kind", "value").agg(F.count(F.lit(1)).alias("c"))


def importances(values: DataFrame) -> DataFrame:
    """(host, path, parent, pages, presentation, content, leaf) of the merged nodes."""
    own = F.col("kind") == PRESENTATION
    c = F.col("c").cast("double")
    sums = values.groupBy("host", "path").agg(
        F.max("parent").alias("parent"),
        F.sum(F.when(own, F.col("c")).otherwise(0)).alias("pages"),
        F.sum(F.when(own, c * F.log(c)).otherwise(0.0)).alias("own_log"),
        F.sum(F.when(own, 0.0).otherwise(c)).alias("texts"),
        F.sum(F.when(own, 0.0).otherwise(c * F.log(c))).alias("text_log"),
    )
    m = F.log(F.col("pages").cast("double"))
    one = F.col("pages") <= 1
    return sums.select(
        "host",
        "path",
        "parent",
        "pages",
        F.when(one, F.lit(1.0)).otherwise((F.col("pages") * m - F.col("own_log")) / (F.col("pages") * m)).alias("presentation"),
        F.when(one | (F.col("texts") == 0), F.lit(1.0)).otherwise(1 - F.col("text_log") / (F.col("texts") * m)).alias("content"),
        (F.col("texts") > 0).alias("leaf"),
    )


def template_nodes(merged: DataFrame) -> DataFrame:
    """(host, path, sure) of the blocks whose importance is below ``BESIDE``, on at least ``PAGES`` pages; sure below ``LEAST``."""
    up = merged.select(F.col("host").alias("of"), F.col("path").alias("at"), F.col("presentation").alias("above"))
    weight = CONTENT * F.col("content") + (1 - CONTENT) * F.coalesce("above", F.lit(1.0))
    low = merged.where((F.col("leaf")) & (F.col("pages") >= PAGES) & (CONTENT * F.col("content") < BESIDE))
    low = low.join(up, (F.col("host") == F.col("of")) & (F.col("parent") == F.col("at")), "left")
    return low.where(weight < BESIDE).select("host", "path", (weight < LEAST).alias("sure"))


def template_texts(values: DataFrame, low: DataFrame) -> DataFrame:
    """(host, path, value, sure) of the texts at low paths that repeat on pages of different main content."""
    texts = values.where((F.col("kind") == TEXT) & (F.col("c") > 1)).withColumn("salt", salt("value"))
    return texts.join(copied(low), ["host", "path", "salt"]).select("host", "path", "value", "sure")


def templates(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, template): the template texts of each page that has any."""
    rows = pages.select("key", "host", salt("key").alias("salt"), F.explode("nodes").alias("x")).where(F.col("x.kind") == TEXT)
    rows = rows.select("key", "host", "salt", "x.path", "x.value")
    found = rows.join(copied(texts), ["host", "path", "value", "salt"])
    return found.groupBy("key").agg(F.collect_set(F.struct("path", "value", "sure")).alias("template"))


def salt(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int")


def copied(rows: DataFrame) -> DataFrame:
    """A copy of each row for every salt, to meet the many rows of one host or text in as many tasks."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def own_blocks(page: Page, low: dict[tuple[int, int], bool]) -> list[Block]:
    """The blocks of a page without the site's."""
    blocks = page.blocks or page.named
    core = core_of(blocks)
    inside = any(b.main for b in blocks)

    def gone(b: Block) -> bool:
        sure = low.get((b.path, value(b.text)))
        return sure is not None and (sure or (inside and not b.main))

    out = [gone(b) for b in blocks]
    prose = sum(len(b.text) for b in core if b.prose)
    # near copies of an article repeat it beside a little that differs
    back = sum(len(b.text) for b, x in zip(blocks, out, strict=True) if x and core and b.main and b.prose) > MOST * prose
    left = [b for b, x in zip(blocks, out, strict=True) if not x or (back and b.main and b.prose)]
    # a page keeps its text if all of it is the site's
    return left or core or blocks


def main_text(pages: pd.Series, templates: pd.Series) -> pd.Series:
    parser = Parser()
    out = []
    for page, template in zip(pages, templates, strict=True):
        low = {} if template is None else {(t["path"], t["value"]): t["sure"] for t in template}
        out.append("\n".join(b.text for b in own_blocks(parser.read(page), low)))
    return pd.Series(out, dtype=object)


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Null markup is an empty page with empty text.  A null or odd address
    belongs to the host of empty name.  Repeated rows count as pages of their
    own; an empty table gives an empty result; other columns are ignored.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), text_of(markup).alias("html"))
    rows = rows.withColumn("key", identity("page_id", F.struct("url", "html"))).withColumn("host", host_of())
    read = kept(parsed(rows), "site-pages")
    values = kept(counted(read), "site-tree")
    low = template_nodes(importances(values))
    template = templates(read, template_texts(values, low))
    hosted = rows.join(template, "key", "left")
    done = hosted.select("page_id", "url", F.pandas_udf(main_text, "string")("html", "template").alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long"))
