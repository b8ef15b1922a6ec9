"""Main text of web pages with site style trees.

The pages of a host are merged into one tree whose element nodes are paths of tags with their class and id.  A first
pass emits, per page and element node, its presentation (the sequence of child tags) and the content of its text
blocks as hashes; Spark counts pages by (host, node, hash), salted by the hash itself, and from these counts gets

* presentation importance: the entropy, in base m, of the presentations over the m pages with the node;
* content importance: 1 - the mean entropy, in base m, of the node's content features over these pages.

A node is noise if neither reaches a threshold and enough pages have it.  A second pass over each whole page drops
the text of noise nodes, and branches whose tag, role, class or id names a menu, header, footer, sidebar, notice, advert,
form or comment list, and writes out the remaining blocks.  Every node is judged by its own importance, wherever it
stands; that it stands in an article or main element is a prior, which lowers the threshold.  If nothing remains of a
page, noise nodes of the style tree are kept.

Noise nodes are broadcast while their number is below a bound; beyond it they are joined by host.  A null html gives an
empty text; a null url the empty host; repeated rows are extracted one by one; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import save

THRESHOLD = 0.5  # importance below which a node is noise
MAIN_THRESHOLD = 0.25  # the same inside article and main
LEAST_PAGES = 5  # pages of a host that must have a node before it can be noise
BROADCAST_NODES = 200_000
DEPTH = 512  # elements opened inside so many others count as their siblings, as in browsers

# Kinds of HTML elements.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp".split())
NOISE_TAGS = frozenset("nav footer aside form head menu button select dialog object canvas svg math audio video".split())
CLOSES = {  # an opening tag ends these open elements
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
    "tfoot": {"thead", "tbody", "tr", "td", "th"}, "thead": {"caption"},
}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
NOISE_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adsbygoogle banner breadcrumb breadcrumbs comment comments commentlist "
    "cookie cookies consent gdpr disqus footer header masthead menu modal nav navbar navigation newsletter notice notices overlay "
    "pager pagination popup promo promotion related reply replies respond share sharing sidebar skip social sponsor sponsored "
    "subscribe subscription toc toolbar topbar widget widgets signup login search complementary contentinfo alert".split()
)
# Words that say where or how often such a branch stands, not what else it is about.
PLACE_NAMES = frozenset(
    "a area bar block body bottom box btn button buttons center col column container content count cta desktop div group head icon icons inner "
    "item items left link links list main mobile module outer page panel primary right row secondary section site slot small "
    "sticky sub top ul unit view wrap wrapper".split()
)
MAIN_NAMES = frozenset("main article".split())

TOKEN = re.compile(
    r"""<(?:!--(?:.*?--!?>|.*\Z)|[!?][^>]*+>?|(?P<end>/)?(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>"']|"[^"]*+"|'[^']*+')*+)>"""
    r"""|(?P<end2>/)?(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs2>[^>]*+)(?:>|\Z))""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.IGNORECASE)
NAME = re.compile(r"[a-z0-9]+")
HOST = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


class Element:
    __slots__ = ("children", "is_main", "name", "noise", "path", "tag")

    def __init__(self, tag: str, attrs: str, parent: Element | None) -> None:
        self.tag, self.name = tag, tag
        self.children: list[str] = []
        names: set[str] = set()
        hidden = False
        role = ""
        if attrs:
            for key, value in ATTRIBUTE.findall(attrs):
                key, value = key.lower(), value.strip("\"'").lower()
                if key in ("class", "id"):
                    self.name += f" {key[0]}={value}"
                    for word in value.split():
                        parts = {x.strip("0123456789") for x in NAME.findall(word)} - {""}
                        if parts & NOISE_NAMES and parts <= NOISE_NAMES | PLACE_NAMES:  # share-buttons, but not share-price
                            names |= parts
                elif key == "role":
                    role = value
                else:
                    hidden |= key == "hidden" or value == "true"
        self.path = xxhash.xxh64_intdigest(f"{parent.path if parent else 0} {self.name}") >> 1
        inside = bool(parent and parent.is_main)
        self.is_main = inside or tag in MAIN_NAMES or role in MAIN_NAMES
        own = tag in NOISE_TAGS or hidden or role in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "menu", "form")
        own |= tag == "header" and not inside
        if tag not in MAIN_NAMES and tag not in ("html", "body"):
            own |= bool(names & NOISE_NAMES) and not (inside and names & NOISE_NAMES <= {"header"} and tag == "header")
        self.noise = own or bool(parent and parent.noise)


def walk(page: str) -> Iterator[tuple[Element, list[Element], str | None]]:
    """(element, open elements, text) of every text run; text None where a block ends or an element closes."""
    root = Element("html", "", None)
    stack = [root]
    at, size = 0, len(page)
    while at < size:
        found = TOKEN.search(page, at)
        if found is None:
            yield stack[-1], stack, page[at:]
            return
        if found.start() > at:
            yield stack[-1], stack, page[at : found.start()]
        at = found.end()
        tag = found["tag"] or found["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if found["end"] or found["end2"]:
            if tag in BLOCKS:
                yield stack[-1], stack, None
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            # An inline end tag does not close blocks around it.
            if depth and (tag in BLOCKS or not any(e.tag in BLOCKS for e in stack[depth + 1 :])):
                del stack[depth:]
            continue
        attrs = found["attrs"] if found["tag"] else found["attrs2"]
        if tag == "html" or (tag == "body" and len(stack) == 1 and stack[0].tag == "html"):
            if tag == "body":
                stack.append(Element(tag, attrs or "", stack[-1]))
            continue
        if tag in RAW:
            closing = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = closing.end() if closing else size
            continue
        if tag in BLOCKS:
            yield stack[-1], stack, None
            if tag == "body":
                del stack[1:]
            if tag in MAIN_NAMES:  # never part of a menu or an advert that was left open
                keep = next((k for k, e in enumerate(stack) if e.noise and not e.is_main), len(stack))
                del stack[max(1, keep) :]
            paragraph = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "p"), 0)
            if paragraph and not any(e.tag in BLOCKS for e in stack[paragraph + 1 :]):
                del stack[paragraph:]
            if closes := CLOSES.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in LIMITS.get(tag, ()):
                        break
                    if stack[k].tag in closes:
                        del stack[k:]
        elif tag == "br":
            yield stack[-1], stack, " "
        element = Element(tag, attrs or "", stack[-1])
        stack[-1].children.append(element.name)
        if tag not in VOID and not (attrs or "").endswith("/") and len(stack) < DEPTH:
            stack.append(element)


def blocks(page: str) -> Iterator[tuple[list[Element], str]]:
    """(elements from the block's own up, text) of every block with text, in page order."""
    parts: list[str] = []
    where: list[Element] = []
    flush = lambda: (where, " ".join("".join(parts).split()))
    last_block = None
    for _, stack, text in walk(page):
        if text is None:
            if parts and (done := flush())[1]:
                yield done
            parts, where, last_block = [], [], None
            continue
        depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag in BLOCKS), 0)
        noise = stack[-1].noise and not stack[depth].noise  # an inline element that is noise by itself
        if stack[depth] is not last_block and parts:
            if (done := flush())[1]:
                yield done
            parts = []
        last_block, where = stack[depth], stack[: depth + 1]
        if not noise:
            parts.append(html.unescape(text))  # references end where a tag begins
    if parts and (done := flush())[1]:
        yield done


def features(page: str) -> set[tuple[int, bool, int]]:
    """Distinct (node, is content, hash) of a page."""
    out: set[tuple[int, bool, int]] = set()
    seen: dict[int, Element] = {}
    for where, text in blocks(page):
        out.add((where[-1].path, True, xxhash.xxh64_intdigest(text) >> 1))
        seen.update((id(e), e) for e in where)
    for e in seen.values():
        runs = [c for k, c in enumerate(e.children) if not k or e.children[k - 1] != c]
        out.add((e.path, False, xxhash.xxh64_intdigest(">".join(runs)) >> 1))
    return out


def extract(page: str, noise: set[int] | frozenset[int]) -> str:
    """Text of a page; noise holds nodes below THRESHOLD, and the complement of those below MAIN_THRESHOLD."""
    kept, fallback = [], []
    for where, text in blocks(page):
        last = where[-1]
        if last.noise:
            continue
        fallback.append(text)
        if (~last.path if last.is_main else last.path) not in noise:
            kept.append(text)
    return "\n".join(kept or fallback)


def node_features(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, node, content, value = [], [], [], []
            for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for n, c, v in features(page or ""):
                    host.append(h)
                    node.append(n)
                    content.append(c)
                    value.append(v)
            arrays = [pa.array(host, pa.string()), pa.array(node, pa.int64()), pa.array(content, pa.bool_()), pa.array(value, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "node", "content", "value"])

    return pages.mapInArrow(run, "host string, node long, content boolean, value long")


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, pages, presentation, content) for each element node of each site; pages has host and html."""
    counted = node_features(pages).groupBy("host", "node", "content", "value").agg(F.count("*").alias("n"))
    sums = counted.groupBy("host", "node").agg(
        F.sum(F.when(~F.col("content"), F.col("n")).otherwise(0)).alias("pages"),
        F.sum(F.when(~F.col("content"), F.col("n") * F.log("n")).otherwise(0.0)).alias("style_log"),
        F.sum(F.when(F.col("content"), F.col("n")).otherwise(0)).alias("features"),
        F.sum(F.when(F.col("content"), F.col("n") * F.log("n")).otherwise(0.0)).alias("content_log"),
    )
    m = F.log(F.col("pages"))
    return sums.select(
        "host",
        "node",
        "pages",
        F.when(F.col("pages") > 1, (m - F.col("style_log") / F.col("pages")) / m).otherwise(1.0).alias("presentation"),
        F.when((F.col("pages") > 1) & (F.col("features") > 0), 1 - F.col("content_log") / F.col("features") / m)
        .when(F.col("features") > 0, 1.0)
        .otherwise(0.0)
        .alias("content"),
        "features",
    )


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row."""
    source = with_host(pages)
    importance = F.greatest("presentation", "content")
    known = F.when(importance < MAIN_THRESHOLD, F.array("node", F.bitwise_not("node"))).otherwise(F.array("node"))
    noise = save(
        style_tree(source)
        .where((F.col("pages") >= LEAST_PAGES) & (F.col("features") > 0) & (importance < THRESHOLD))
        .select("host", F.explode(known).alias("node"))
    )
    rows = noise.limit(BROADCAST_NODES + 1).toPandas()
    kinds = f"page_id {source.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    if len(rows) <= BROADCAST_NODES:
        by_host: dict[str, set[int]] = {}
        for host, node in zip(rows["host"], rows["node"], strict=True):
            by_host.setdefault(host, set()).add(int(node))
        return source.mapInArrow(extractor(source.sparkSession.sparkContext.broadcast(by_host)), kinds)
    listed = noise.groupBy("host").agg(F.collect_set("node").alias("noise"))
    return source.join(listed, "host", "left").mapInArrow(extractor(None), kinds)


def extractor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none: frozenset[int] = frozenset()
        for batch in batches:
            if shared is not None:
                noise = [shared.value.get(h, none) for h in batch.column("host").to_pylist()]
            else:
                noise = [frozenset(x or ()) for x in batch.column("noise").to_pylist()]
            out = [extract(page, known) for page, known in zip(batch.column("html").to_pylist(), noise, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return run
