"""Line deduplication by site-relative frequency.

A line counts once for each page of its host that holds it; where it is on more than ``ratio`` of
the host's pages, and on ``min_pages`` at least, it is boilerplate and goes from every page of that
host. A line of one page alone never repeats, so the least floor is two. Lines are compared without
surrounding blanks, tabs and carriage returns; blank lines stay.

A page counts each distinct line once before the shuffle, which moves 128-bit hashes, not lines,
with partial counts. A host's boilerplate has at most (lines of its pages on average) / ``ratio``
entries, so it is one short array by host. That table is broadcast up to ``broadcast_hosts`` hosts;
beyond, Spark joins by host and splits the hot ones.

A page's lines are looked up in its own boilerplate, which is sorted, so a page costs its lines times the logarithm of that.

Defined results: null text stays null and its page counts for its host; null hosts are one host;
rows that repeat count as pages each; an empty table gives an empty result;
without ``keep_whole`` a page may end without a line, as where two equal pages are a host's only ones; a very long text is its array of lines in
its task, about a hundred bytes a line. Other columns pass
through; the added name is a parameter, and working names are chosen free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, settle, small_enough


def html_lines(html: Column) -> Column:
    """The text of a page, a line for each block-level element."""
    bare = F.regexp_replace(html, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->", " ")
    block = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|article|section|nav|header|footer|title|head|body|html|main|aside|form|blockquote|pre)(?:[ \t\r\n/][^>]*)?>"
    return F.regexp_replace(F.regexp_replace(bare, block, "\n"), r"<[^>]*>", "")


def url_host(url: Column) -> Column:
    """The host of a URL, lower-cased; empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def _key(line: Column) -> Column:
    bare = F.trim(line, F.lit(" \t\r"))
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b"))


def _name(key: Column) -> Column:
    """A key as text, which array functions hash (structs they compare one by one)."""
    return F.concat(F.hex(key["a"]), F.lit("-"), F.hex(key["b"]))


def _blank(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r")) == ""


def _holds(ordered: Column, x: Column) -> Column:
    """Whether a sorted array has ``x``: by comparison with each where it is short, else by halving, a step for each power of two of its size."""
    most = F.ceil(F.log2(F.size(ordered))).cast("int")
    steps = F.transform(F.sequence(F.lit(0), most), lambda i: F.pow(F.lit(2), most - i).cast("int"))
    up_to = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= F.size(ordered)) & (F.get(ordered, at + s - 1) <= x), at + s).otherwise(at))
    return F.when(F.size(ordered) <= 16, F.array_contains(ordered, x)).otherwise(F.coalesce(F.get(ordered, up_to - 1) == x, F.lit(False)))


def _own(text: str) -> Column:
    """The keys, as text, of the lines of a page."""
    return F.transform(F.filter(F.split(text, "\n"), lambda x: ~_blank(x)), lambda x: _name(_key(x)))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, lines): the hashed boilerplate lines of each host."""
    df = pages.select(F.col(host).alias("__ld_host"), F.split(text, "\n").alias("__ld_lines"))
    totals = df.groupBy("__ld_host").agg(F.count(F.lit(1)).alias("__ld_pages"))
    own = F.array_distinct(F.transform(F.filter("__ld_lines", lambda x: ~_blank(x)), _key))
    counts = df.select("__ld_host", F.explode(own).alias("__ld_key")).groupBy("__ld_host", "__ld_key").agg(F.count(F.lit(1)).alias("__ld_n"))
    common = counts.where(F.col("__ld_n") >= min_pages).withColumnRenamed("__ld_host", "__ld_h")
    found = common.join(totals, F.col("__ld_h").eqNullSafe(F.col("__ld_host"))).where(F.col("__ld_n") > F.lit(ratio) * F.col("__ld_pages"))
    return found.groupBy("__ld_host").agg(F.collect_list("__ld_key").alias("__ld_drop"))


def line_dedup(
    pages: DataFrame, host: str, text: str, ratio: float = 0.3, min_pages: int = 2, dropped: str | None = None, broadcast_hosts: int = 20_000, keep_whole: bool = False
) -> DataFrame:
    """``pages`` with the boilerplate lines gone from ``text``; ``dropped`` names a column of their number.

    With ``keep_whole`` a page that would lose all its lines keeps them: it is a copy of other pages, not what stands around theirs.
    """
    name = free_name(pages, "__ld")
    site, drop, left = f"{name}host", f"{name}drop", f"{name}left"
    found = settle(boilerplate(pages, host, text, ratio, min_pages), "boilerplate").toDF(site, drop)
    small = small_enough(found, broadcast_hosts)
    joined = pages.join(F.broadcast(found) if small else found, F.col(host).eqNullSafe(F.col(site)), "left")
    lines = F.split(text, "\n")
    # a page's own boilerplate is found by hashing, once, and sorted; each line then looks into that by halving
    hit = F.array_sort(F.array_intersect(_own(text), F.transform(drop, _name)))
    joined = joined.withColumn(drop, F.when(F.col(drop).isNotNull(), hit)).withColumn(drop, F.when(F.size(drop) > 0, F.col(drop)))
    some = F.filter(lines, lambda x: _blank(x) | ~_holds(F.col(drop), _name(_key(x))))
    if keep_whole:
        some = F.when(F.exists(some, lambda x: ~_blank(x)), some).otherwise(lines)
    joined = joined.withColumn(left, F.when(F.col(drop).isNotNull(), some).otherwise(lines))
    out = {text: F.array_join(left, "\n")}
    if dropped:
        out[dropped] = F.coalesce(F.size(lines) - F.size(left), F.lit(0)).cast("long")
    return joined.withColumns(out).drop(site, drop, left)


def page_line_dedup(pages: DataFrame, min_pages: int = 2) -> DataFrame:
    """page_id, host, n_dropped, text of every page: its lines without its site's boilerplate."""
    rows = pages.select("page_id", url_host(F.col("url")).alias("host"), html_lines(F.col("html")).alias("text"))
    return line_dedup(rows, "host", "text", ratio=0.3, min_pages=min_pages, dropped="n_dropped").select("page_id", "host", "n_dropped", "text")
