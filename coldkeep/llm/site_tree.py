"""HTML extraction with site style trees.

Every page is parsed into text blocks, each with its path of elements (tag, id and classes).
The DOMs of a host are merged by path. For a merged node the importance of its content is the entropy
of its texts over the host's pages, as a share of the largest possible; a node whose pages
nearly all show the same text has an importance near 0 and its branch is removed. A
single text that most of the host's pages show at one path is removed in the same way, so that a notice
between the paragraphs of an article goes too. Presentation counts first: elements whose tag, role,
id or class names furniture (menus, forms, adverts, comments, ...) or hidden parts have importance 0.
A page that marks its article (`article`, else `main`) has its other branches removed as well.

Pages of a host with the same text count once, and only nodes of at least `PAGES` different pages are judged,
so copies of one page never make its article look like furniture. All counting is by DataFrame
groupings that combine before the shuffle; html is shuffled only if the list of removed nodes is
too large to be sent to every task.

Defined results: null or empty html gives the empty text; a null url belongs to the host with
the empty name; unclosed, unknown and badly nested elements, comments without an end and stray `<` do not fail;
repeated pages are reported each; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coldkeep.llm.frames import BROADCAST_BYTES
from coldkeep.session import written

PAGES = 8
LEAST_IMPORTANCE = 0.25
COMMON_SHARE = 0.6

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"""|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]{0,4096}+"|'[^']{0,4096}+')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Fixed: elements of html.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in ("script", "style", "textarea", "title", "xmp", "noembed", "iframe", "noframes")}
_FURNITURE = frozenset("head title script style noscript template iframe object embed svg math canvas audio video nav footer header aside form button select option textarea input dialog menu noembed noframes xmp".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies discussion disqus footer form gdpr header login masthead menu menubar modal nav navbar "
    "navigation newsletter notice notices notification overlay pagination pager popup promo promoted promotion recommended related replies reply "
    "respond rss search share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription teaser toc toolbar topbar widget widgets".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_KEEPS = frozenset("ul ol dl table tbody thead div article section main body".split())


class Block:
    __slots__ = ("path", "text", "zone", "links")

    def __init__(self, path: str, text: str, zone: int, links: bool):
        self.path, self.text, self.zone, self.links = path, text, zone, links


def _furniture(tag: str, attributes: str, in_article: bool) -> tuple[bool, str]:
    """Whether an element is furniture by its presentation, and its name in paths."""
    name, bad = tag, tag in _FURNITURE and not (tag == "header" and in_article)
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                name += "." + " ".join(value.split())
                if tag not in ("body", "html") and not _NAMES.isdisjoint(re.split(r"[^a-z0-9]+", value)):
                    bad = True
            elif key == "role":
                bad = bad or value in _ROLES
            elif key == "hidden" or key == "aria-hidden" and value == "true":
                bad = True
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                bad = True
    return bad, name


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page that presentation does not rule out, in page order."""
    out: list[Block] = []
    if not page:
        return out
    # open elements: tag, path, furniture here or above, zone (2 in article, 1 in main, 0 elsewhere)
    stack = [("", "", False, 0)]
    texts: list[str] = []
    linked = plain = 0
    open_links = 0

    def close() -> None:
        nonlocal linked, plain
        if texts:
            if text := " ".join(entities.unescape("".join(texts)).split()):
                out.append(Block(stack[-1][1], text, stack[-1][3], linked > 4 * plain))
            texts.clear()
        linked = plain = 0

    def add(text: str) -> None:
        nonlocal linked, plain
        if text and not stack[-1][2]:
            texts.append(text)
            if open_links:
                linked += len(text)
            else:
                plain += len(text)

    def pop_to(depth: int) -> None:
        close()
        del stack[depth:]

    at = 0
    while m := _TAG.search(page, at):
        add(page[at: m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag in _INLINE:
                if tag == "a" and open_links:
                    open_links -= 1
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    open_links = 0
                    break
            else:
                close()
            continue
        tag = (m[2] or m[4] or "").lower()
        if not tag:
            continue
        attributes = m[3] or m[5] or ""
        if tag in _INLINE:
            if tag == "br":
                add(" ")
            elif tag == "a":
                open_links = 1
            if attributes and tag not in _VOID and not stack[-1][2] and tag != "a" and _furniture(tag, attributes, False)[0]:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else at
            continue
        if tag in _RAW and not attributes.endswith("/"):
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        close()
        open_links = 0
        if tag in _VOID or attributes.endswith("/") and tag not in ("p", "div"):
            continue
        if tag in _CLOSED_BY:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in _CLOSED_BY[tag]:
                    pop_to(i)
                    break
                if stack[i][0] in _KEEPS:
                    break
        elif stack[-1][0] == "p":
            pop_to(len(stack) - 1)
        bad, name = _furniture(tag, attributes, stack[-1][3] == 2)
        if tag in ("article", "main") and not bad:
            while stack[-1][2] and stack[-1][0] not in ("article", "main"):  # furniture that was never closed
                stack.pop()
        if tag == "body":
            while len(stack) > 1 and stack[-1][0] != "html":
                stack.pop()
        _, path, above, zone = stack[-1]
        zone = 2 if tag == "article" and not bad else max(zone, 1) if tag == "main" else zone
        stack.append((tag, f"{path}>{name}", above or bad, zone))
    add(page[at:])
    close()
    return out


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def main_blocks(page: str | None) -> list[Block]:
    """The blocks of the marked article; of all zones if none is marked, without blocks that are links only."""
    found = blocks(page)
    zone = max((b.zone for b in found), default=0)
    return [b for b in found if b.zone == zone and (zone or not b.links)]


NODES = "host string, page long, path long, content long"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            found = main_blocks(page)
            whole = _hash("\n".join(b.text for b in found))
            rows.extend((host, whole, *pair) for pair in {(_hash(b.path), _hash(b.text)) for b in found})
        columns = zip(*rows) if rows else [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["host", "page", "path", "content"])


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def unimportant(nodes: DataFrame) -> DataFrame:
    """host and the path (`gone_paths`) or single texts (`gone_texts`) its pages lose."""
    texts = nodes.distinct().groupBy("host", "path", "content").agg(F.count(F.lit(1)).alias("n"))
    # sum of -p log p, from the sums of n and n log n
    shown = texts.groupBy("host", "path").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("nlogn"))
    importance = F.when(F.col("s") > 1, (F.log(F.col("s").cast("double")) - F.col("nlogn") / F.col("s")) / F.log(F.col("s").cast("double"))).otherwise(1.0)
    paths = shown.filter((F.col("s") >= PAGES) & (importance < LEAST_IMPORTANCE)).groupBy("host").agg(F.collect_list("path").alias("gone_paths"))
    pages = nodes.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    common = texts.filter(F.col("n") >= PAGES).join(pages, "host").filter(F.col("n") > COMMON_SHARE * F.col("pages"))
    common = common.groupBy("host").agg(F.collect_list(F.struct("path", "content")).alias("gone_texts"))
    return paths.join(common, "host", "full").select("host", "gone_paths", "gone_texts")


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    hosted = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    nodes = written(spark, hosted.select("host", "html").mapInArrow(_nodes, NODES), "nodes")
    gone = written(spark, unimportant(nodes), "unimportant")
    listed = F.coalesce(F.size("gone_paths"), F.lit(0)) + 2 * F.coalesce(F.size("gone_texts"), F.lit(0))
    size = gone.agg(F.sum(8 * listed + F.length("host") + 64)).collect()[0][0] or 0
    judged = hosted.join(F.broadcast(gone) if size <= BROADCAST_BYTES else gone, "host", "left")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, paths, single in zip(*(batch.column(c).to_pylist() for c in ("html", "gone_paths", "gone_texts"))):
                kept = main_blocks(page)
                if paths or single:
                    whole, pairs = set(paths or ()), {(s["path"], s["content"]) for s in single or ()}
                    kept = [b for b in kept if (at := _hash(b.path)) not in whole and (at, _hash(b.text)) not in pairs]
                texts.append("\n".join(b.text for b in kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return judged.select("page_id", "url", "html", "gone_paths", "gone_texts").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
