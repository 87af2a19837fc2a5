"""Main text of web pages by differencing with the nearest URL.

1. Every page is cut into blocks (lines) at block-level tags; markup, scripts,
   styles, forms, menus, headers, footers, sidebars, notices, adverts and
   reader comments are left out by their elements, roles and class names.
2. Pages of one host are put in URL path order; a page is paired with the page
   before it and the page after it, its nearest URLs.
3. The lines of a pair are aligned by longest common subsequence (a line's
   k-th occurrence can only meet the other page's k-th). Shared lines are the
   host's furniture and are deleted. Two cases are no furniture: lines inside
   an explicit article element (documents quote the same passages), unless
   they are no sentences or headings and both neighbours share them at the article's very
   start or end; and pairs that share most of their text, which are copies of
   one article.

Scale: only line hashes are paired. The order within hosts is a range sort on
(host, path, key), so one host may hold most pages; a partition's first page
finds its predecessor through one row per partition. Pages are parsed twice,
which costs less than keeping all lines; the second pass meets the places to
delete, a row for each page that loses a line (broadcast only if Spark's
threshold on the written table's size allows).

Defined results: null and empty html give an empty text with 0 characters;
a null url is a host of its own; repeated rows come back once each, and rows
with equal id, url and html are one page for pairing; an empty table gives an
empty result; extra columns are not touched.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import map_rows, materialize, stored

# HTML elements by role.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead title tr ul video".split())
DROPPED = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe input label math menu nav noscript object "
    "option script select style svg template textarea title video".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in class, id or role that mark page furniture.
FURNITURE = frozenset(
    "ad ads adbox advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment "
    "comments commentlist consent contentinfo cookie cookies disqus dropdown footer gdpr header login masthead menu "
    "menubar modal nav navbar navigation newsletter notice notices notification pager pagination paywall "
    "popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription toolbar topbar widget".split())
# First words of layout names, and of headers that are no article's.
WITH = frozenset(("has", "with", "no", "without", "is"))
SITE = frozenset(("header", "site", "page", "global", "main", "top", "nav", "masthead"))
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

#: A line that ends like a sentence, or is longer than twelve words.
SENTENCE = r"[.!?…:;\"'”’»)]\s*$|^(\S+\s+){12}"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_NAME = re.compile(r"[A-Za-z]+(?:[-_][A-Za-z]+)*")


def _furniture(attributes: str) -> bool:
    """Whether an element's class, id or role names page furniture."""
    if "=" not in attributes:
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        value = value.strip("\"'").lower()
        if key.lower() == "aria-hidden":
            if value == "true":
                return True
            continue
        for name in _NAME.findall(value):
            parts = re.split("[-_]", name)
            if parts[0] in WITH or "with" in parts:  # says what a layout holds
                continue
            if any(p in FURNITURE and (p != "header" or parts[0] in SITE) for p in parts):
                return True
    return False


def lines(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, inside an article element, heading) of the blocks of a page,
    furniture elements left out; only the article elements' blocks if there
    are any with text."""
    page = page or ""
    out: list[tuple[str, bool, bool]] = []
    text: list[str] = []
    at, main, skipping, depth, heading = 0, 0, None, 0, False
    skipped: list[tuple[str, bool, bool]] = []  # what an element that never closes has hidden
    lower = None

    def close():
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if block:
                (out if skipping is None else skipped).append((block, main > 0, heading))

    find = _TOKEN.search
    while m := find(page, at):
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        ending, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK or tag in DROPPED:
            close()
            heading = tag in HEADINGS and not ending
            if skipping == "p" and tag in BLOCK and not ending:  # a paragraph ends at the next block
                skipping = None
                skipped.clear()
        elif tag == "br":
            text.append(" ")
        if ending:
            if skipping == tag:
                depth -= 1
                if not depth:
                    skipping = None
                    skipped.clear()
            elif tag in MAIN and skipping is None:
                main = max(0, main - 1)
            continue
        alone = tag in VOID or attributes.rstrip().endswith("/")
        if tag in RAW and not alone:  # nothing inside is markup
            if lower is None:
                lower = page.lower()
            end = lower.find(f"</{tag}", at)
            stop = page.find(">", end) if end >= 0 else -1
            at = stop + 1 if stop >= 0 else len(page)
            continue
        if skipping is not None:
            depth += tag == skipping and not alone
        elif not alone and tag not in ("html", "body") and (
                tag in DROPPED or tag == "header" and not main
                or tag not in MAIN and attributes and _furniture(attributes)):
            if not (tag in BLOCK or tag in DROPPED):
                close()
            skipping, depth = tag, 1
        elif tag in MAIN and not alone:
            main += 1
    text.append(page[at:])
    close()
    # a dropped element that never closed took no more than its first block
    out += skipped[1:]
    return [x for x in out if x[1]] or out


def shared(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of two lists, k-th
    occurrences meeting k-th occurrences (so n log n for any lists)."""
    def numbered(x):
        seen: dict = {}
        out = []
        for v in x:
            seen[v] = seen.get(v, 0) + 1
            out.append((v, seen[v]))
        return out

    place = {v: k for k, v in enumerate(numbered(b))}
    tails, tail_at, before = [], [], {}
    for i, v in enumerate(numbered(a)):
        j = place.get(v)
        if j is None:
            continue
        k = bisect_left(tails, j)
        before[i] = tail_at[k - 1] if k else None
        if k == len(tails):
            tails.append(j)
            tail_at.append(i)
        else:
            tails[k], tail_at[k] = j, i
    out, i = [], tail_at[-1] if tail_at else None
    while i is not None:
        out.append(i)
        i = before[i]
    return out[::-1]


def deleted(own: list[int], sizes: list[int], main: bool, neighbours: list[list[int] | None],
            loose: list[bool], copy_share: float = 0.5) -> list[int]:
    """Places of a page's lines that differencing deletes.

    ``loose`` says which lines are neither sentences nor headings."""
    total, found = sum(sizes), []
    for other in neighbours:
        if other:
            common = shared(own, other)
            # a pair that shares most of its text is one article twice
            if sum(sizes[i] for i in common) <= copy_share * total:
                found.append(set(common))
    if not found:
        return []
    if not main:
        return sorted(set().union(*found))
    if len(found) < 2:
        return []
    n, both = len(own), {i for i in found[0] & found[1] if loose[i]}
    first = next((i for i in range(n) if i not in both), n)
    last = next((i for i in reversed(range(n)) if i not in both), -1)
    return sorted(i for i in both if i < first or i > last)


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    spark = df.sparkSession
    kinds = dict(df.dtypes)

    page_hash = F.xxhash64(F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit("")))
    found = df.select(F.col(id_col), F.col(url_col), page_hash.alias("page_hash"), F.col(html_col))

    def parse():
        def row(key, url, page_hash, page):
            got = lines(page)
            yield key, url, page_hash, [x[0] for x in got], [x[2] for x in got], bool(got and got[0][1])
        return row

    cut = map_rows(found, f"{id_col} {kinds[id_col]}, {url_col} string, page_hash long, lines array<string>, "
                   "heading array<boolean>, main boolean",
                   parse)

    # narrow rows: the host, the path and the line hashes
    place = F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(place, r"^[^/?#]*", 0))
    path = F.regexp_extract(place, r"^[^/?#]*([^?#]*)", 1)
    narrow = cut.select(
        F.col(id_col), "page_hash", host.alias("host"), path.alias("path"), "main",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("own"),
        F.transform("lines", lambda x: F.char_length(x)).alias("sizes"),
        F.zip_with("lines", "heading", lambda x, h: ~x.rlike(SENTENCE) & ~h).alias("loose")).dropDuplicates([id_col, "page_hash"])
    order = ["host", "path", id_col, "page_hash"]
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # range sort: a host may spread over many partitions; the checkpoint fixes them
    placed = materialize(narrow.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    run = Window.partitionBy("part").orderBy(*order)
    near = F.struct("host", "own")
    ends = placed.groupBy("part").agg(
        F.min(F.struct(*order, "own")).alias("head"), F.max(F.struct(*order, "own")).alias("tail"))
    parts = Window.orderBy("part")  # a row a partition
    ends = ends.select("part", F.lag("tail").over(parts).alias("above"), F.lead("head").over(parts).alias("below"))
    paired = placed.withColumn("up", F.lag(near).over(run)).withColumn("down", F.lead(near).over(run))
    paired = paired.join(ends, "part").select(
        id_col, "page_hash", "own", "sizes", "loose", "main", "host",
        F.coalesce("up", F.struct("above.host", "above.own")).alias("up"),
        F.coalesce("down", F.struct("below.host", "below.own")).alias("down"))
    same = lambda c: F.when(F.col(f"{c}.host") == F.col("host"), F.col(f"{c}.own"))
    paired = paired.select(id_col, "page_hash", "own", "sizes", "loose", "main", same("up").alias("up"), same("down").alias("down"))

    def difference():
        def row(key, page_hash, own, sizes, loose, main, up, down):
            gone = deleted(own, sizes, main, [up, down], loose)
            if gone:
                yield key, page_hash, gone
        return row

    gone = map_rows(paired, f"{id_col} {kinds[id_col]}, page_hash long, gone array<int>", difference)
    gone = stored(gone.select(F.col(id_col).alias("k"), F.col("page_hash").alias("h"), "gone"), "page-gone")
    met = cut.join(gone, (F.col("page_hash") == F.col("h")) & F.col(id_col).eqNullSafe(F.col("k")), "left")
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x, i: ~F.array_contains("gone", i)))
    out = met.select(F.col(id_col), F.col(url_col), F.array_join(left, "\n").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
