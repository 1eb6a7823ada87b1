"""Line dedup by site-relative frequency.

A page's lines are what its markup and its line ends part: block tags and
`br` end a line, cells of a row are parted by a space, other tags vanish from
within it; scripts, styles, templates, titles and comments are no text.  Within
each host, the pages that contain a line are divided by the host's pages;
lines above a ratio are boilerplate of the site and are dropped from all its
pages.

Pages are parsed once and written as lines.  Lines are counted once a page and
by 128 bits of hashes, so texts aren't shuffled to be counted; counts are
summed in each task first, so one line on all pages of one host costs a row a
task.  A host has at most 1/ratio times as many boilerplate lines as its mean
page has lines.  Pages of a large host are dealt to many tasks, and the host's
boilerplate to each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch, ship, spread_join

# Patterns that Java and RE2 read alike, each linear in the page.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
NO_TEXT = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{x}\b.*?(?:</{x}[^<>]*>|\z)" for x in ("script", "style", "template", "title"))
LINE_END = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|caption|center|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hgroup|hr|html|"
    r"legend|li|main|menu|nav|ol|optgroup|option|p|pre|search|section|select|summary|table|tbody|tfoot|thead|tr|ul)(?:[ \t\n\f\r/][^<>]*)?>"
)
CELL = r"(?i)</?(?:td|th)(?:[ \t\n\f\r/][^<>]*)?>"
TAG = r"</?[A-Za-z!?][^<>]*>?"
BLANKS = r"[ \t\f\r\x0B]+"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&amp;": "&"}
KEY = "array<struct<a:bigint,b:bigint>>"


def host(url: Column) -> Column:
    """The lower-case host of a URL, without user and port; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def lines(html: Column) -> Column:
    """A page's lines, with single spaces and without blank ends; empty ones are left out."""
    text = F.coalesce(html, F.lit(""))
    for pattern, by in ((NO_TEXT, " "), (LINE_END, "\n"), (CELL, " "), (TAG, "")):
        text = F.regexp_replace(text, F.lit(pattern), F.lit(by))
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    text = F.regexp_replace(text, F.lit(BLANKS), F.lit(" "))
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b"))


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with their lines, keys and their host's boilerplate -> without it."""

    def pairs(column: pa.Array, i: int) -> list[tuple[int, int]]:
        own = column[i].values
        return [] if own is None else list(zip(own.field("a").to_pylist(), own.field("b").to_pylist(), strict=True))

    for batch in batches:
        pages, hosts, all_lines, keys, boiler = batch.columns
        n, gone, texts, last, drop = [], [], [], None, frozenset()
        for i, (own, site) in enumerate(zip(all_lines.to_pylist(), hosts.to_pylist(), strict=True)):
            if site != last:  # a host's pages come one after another
                last, drop = site, frozenset(pairs(boiler, i))
            kept = [x for x, k in zip(own, pairs(keys, i), strict=True) if k not in drop] if drop else own
            n.append(len(own))
            gone.append(len(own) - len(kept))
            texts.append("\n".join(kept))
        yield pa.RecordBatch.from_arrays([pages, hosts, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], ["page_id", "host", "n_lines", "n_dropped", "text"])


def drop_boilerplate(pages: DataFrame, *, ratio: float = 0.3) -> DataFrame:
    """Pages without the lines that more than `ratio` of their host's pages have.

    pages has page_id, url and html; other columns are ignored.  Returns a row
    for each row: page_id, host, n_lines, n_dropped, text (the lines that stay,
    one below the other).

    Every host is judged by the ratio alone; a line has to be on two pages at
    least to be any site's, so a host of one page loses nothing.  A line at
    exactly the ratio stays.  A null or empty page has no lines.  Pages without
    a URL are one host of empty name.  A line that a page repeats counts once
    there, and all its places are dropped.  Repeated rows are pages each.

    A tag ends at the next angle bracket, whatever quotes hold.  The entities
    of ENTITIES are read; others stay as they are written.
    """
    ship(pages.sparkSession)
    scratch = Scratch(pages.sparkSession, "lines")
    parsed = pages.select("page_id", host(F.col("url")).alias("host"), lines(F.col("html")).alias("lines"), F.monotonically_increasing_id().alias("_row"))
    parsed = scratch.keep(parsed.withColumn("keys", F.transform("lines", _key)), "parsed")
    total = parsed.groupBy("host").agg(F.count("*").alias("pages"))
    each = parsed.select("host", F.explode(F.transform(F.array_distinct("lines"), _key)).alias("key"))
    count = scratch.keep(each.groupBy("host", "key").agg(F.count("*").alias("n")).where("n > 1"), "count")
    boiler = spread_join(count, total, ["host"], ["key"]).where(F.col("n") > F.lit(ratio) * F.col("pages")).groupBy("host").agg(F.collect_list("key").alias("boiler"))
    found = spread_join(parsed, scratch.keep(boiler, "boiler"), ["host"], ["_row"], "left").select("page_id", "host", "lines", "keys", F.coalesce("boiler", F.array().cast(KEY)).alias("boiler"))
    return found.mapInArrow(_drop, f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, n_lines long, n_dropped long, text string")


def _sql() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    text = "coalesce(html, '')"
    for pattern, by in ((NO_TEXT, "' '"), (LINE_END, "chr(10)"), (CELL, "' '"), (TAG, "''")):
        text = f"regexp_replace({text}, {quoted(pattern)}, {by}, 'g')"
    for name, char in ENTITIES.items():
        text = f"replace({text}, {quoted(name)}, {quoted(char)})"
    text = f"regexp_replace({text}, {quoted(BLANKS)}, ' ', 'g')"
    return f"""
with page as (
  select page_id, lower(coalesce(regexp_extract(url, {quoted(HOST)}, 1), '')) as host,
    list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') as lines
  from pages
), total as (
  select host, count(*) as pages from page group by host
), each as (
  select host, unnest(list_distinct(lines)) as line from page
), boiler as (
  select e.host, list(e.line) as boiler
  from (select host, line, count(*) as n from each group by all) e join total t on e.host = t.host
  where e.n > 1 and e.n > 0.3 * t.pages group by e.host
)
select p.page_id, p.host, cast(len(p.lines) as bigint) as n_lines,
  cast(len(p.lines) - len(list_filter(p.lines, lambda x: not list_contains(coalesce(b.boiler, []), x))) as bigint) as n_dropped,
  array_to_string(list_filter(p.lines, lambda x: not list_contains(coalesce(b.boiler, []), x)), chr(10)) as text
from page p left join boiler b on p.host = b.host
"""


SQL = _sql()
