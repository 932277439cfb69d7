"""Line dedup by site-relative frequency: lines that too large a share of a site's pages carry are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: A line on more than this share of its site's pages goes; sites of fewer pages give no verdict.
RATIO, MIN_PAGES = 0.1, 10
#: Where pages of one content count once, a boilerplate line is on at least so many contents; no site is exempt for its size.
MIN_CONTENTS = 3

# Fixed patterns, the same in Java and RE2.
HIDDEN = r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->"
BLOCK = r"(?i)</?(?:p|div|li|ul|ol|nav|h[1-6]|br|tr|td|th|table|article|section|header|footer|main|title|head|body|html)(?:[ \t\n/][^>]*)?>"
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def _trimmed(x: Column) -> Column:
    return F.btrim(x, F.lit(" \t\r"))


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def html_lines(html: Column) -> Column:
    """The visible lines of a page: block elements end lines, other tags vanish, blank lines are left out."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), BLOCK, "\n"), TAG, "")
    return F.filter(F.transform(F.split(text, "\n"), _trimmed), lambda x: x != "")


def text_lines(text: Column) -> Column:
    """The lines of a plain text, blank ones included."""
    return F.split(text, "\n")


def least_run(words: str) -> Column:
    """The least hash of the runs of five words in an array column: equal for copies, and mostly for near copies.

    Runs that reach over the end are hashed as they are.  `words` is a column of its own: inside a lambda an
    expression would be made anew for each word.
    """
    w = F.col(words)
    return F.array_min(F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, 5)])))


def _key(line: Column) -> Column:
    # two seeds of a 64-bit hash stand for the line: 128 bits
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def boilerplate(pages: DataFrame, ratio: float, min_pages: int, by_content: bool) -> DataFrame:
    """host and the array of its boilerplate lines' keys, of pages (host, lines, and content where asked).

    A page counts once for a line however often it has it.  An array holds at most (mean lines of a page) /
    ratio keys, whatever the site's size, as each line in it takes up `ratio` of the site's pages.  By content
    the pages of a site that agree in it count as one, in a line's share and in the total, and a line needs
    MIN_CONTENTS contents in place of a site of `min_pages` pages.  A host of any size is counted by partial
    sums, and lines that are too rare for any site are dropped before totals are joined.
    """
    full = F.filter("lines", lambda x: _trimmed(x) != "")
    keys = F.explode(F.array_distinct(F.transform(full, _key))).alias("key")
    if by_content:
        total = pages.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("pages"))
        per_page = pages.select("host", "content", keys).distinct()
        least, enough = MIN_CONTENTS - 1, F.lit(True)
    else:
        total = pages.groupBy("host").agg(F.count("*").alias("pages"))
        per_page = pages.select("host", keys)
        least, enough = ratio * min_pages, F.col("pages") >= min_pages
    counts = per_page.groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") > least)
    # one row for each host: staged, so that the optimizer knows when it is small
    often = counts.join(staged(total), "host").filter(enough & (F.col("n") > ratio * F.col("pages")))
    return often.groupBy("host").agg(F.collect_set("key").alias("often"))


def drop_boilerplate(
    pages: DataFrame, host: Column, lines: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, words: Column | None = None
) -> DataFrame:
    """row (all columns as a struct), host, lines and kept (lines that stay; null where lines is null).

    A row whose host is null belongs to no site and keeps its lines.  Rows given twice count as two pages,
    or as one where the array `words` of its text is given, by which copies and near copies are told.
    Blank lines neither count nor go.  An empty table gives no rows.  A very long text is one array of lines.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row")
    work = pages.select(row, host.alias("host"), lines.alias("lines"))
    if words is None:
        counted = pages.select(host.alias("host"), lines.alias("lines"))
    else:
        counted = pages.select(host.alias("host"), lines.alias("lines"), words.alias("words")).select("host", "lines", least_run("words").alias("content"))
    often = staged(boilerplate(counted.filter("host is not null and lines is not null"), ratio, min_pages, words is not None))
    # the written table's size is known, so the optimizer broadcasts it only where it is small
    joined = work.join(often, "host", "left")
    stays = lambda x: (_trimmed(x) == "") | ~F.array_contains(F.col("often"), _key(x))
    return joined.select("row", "host", "lines", F.when(F.col("often").isNull(), F.col("lines")).otherwise(F.filter("lines", stays)).alias("kept"))


def page_lines(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, host, n_lines, n_dropped and text (the lines that stay) of every page.

    A null page has null text and no lines, an empty one empty text; a page given twice counts as two; a page
    whose url is null or has no host keeps all its lines.
    """
    # the lines are needed twice and their patterns are the work: they are extracted once and written
    lines = staged(pages.select("page_id", host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("lines")))
    made = drop_boilerplate(lines, F.col("host"), F.col("lines"), ratio, min_pages)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return made.select(
        "row.page_id",
        "host",
        size("lines").alias("n_lines"),
        (size("lines") - size("kept")).alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )


def document_lines(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, near_copies_as_one: bool = False) -> DataFrame:
    """The documents with their source's boilerplate lines taken out of text; n_chars follows; all columns.

    A null text stays null, an empty one empty; a row given twice counts as two documents, or as
    one where near copies count as one; a row without a source keeps its lines.
    """
    words = F.split("text", "[\\t-\\r ]+") if near_copies_as_one else None
    made = drop_boilerplate(docs, F.col("source"), text_lines(F.col("text")), ratio, min_pages, words)
    text = F.array_join("kept", "\n")
    new = {"text": text, "n_chars": F.length(text).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return made.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])
