"""Main text of web pages with a site style tree.

Every page is parsed once into elements and text blocks. An element's place is its path of tags with their classes and
ids; pages of a host are merged place by place into one tree (each distinct page once), and each place gets an importance
from 0 to 1:

* content, for places that hold text: 1 - mean of log(df) / log(m), where m pages have the place and df of them hold the
  same text there. Text of its own on every page gives 1, one text on all pages 0.
* presentation, for places that hold elements: the entropy of their sequences of child places over pages, by log(m).
* a place with elements: (1 - GAMMA^l) presentation + GAMMA^l content, l its number of different sequences, content the
  mean over all blocks below it.

A branch whose importance is below the limit is removed from each page of the host: LOW in general, LINKS for blocks made of links
alone, each halved inside an article or main element, which is evidence of content. Then go the elements that say they
are no main text by tag, role or a class or id that consists of such words only (`ad-slot`, not `share-price`). If an
article or main element holds at least half of what is left of a page, it bounds the text.

Defined cases: null or empty html gives an empty text; broken or cut markup is read as far as it goes, a `<` that opens
no tag is text, elements nested deeper than DEEPEST become siblings; a place on fewer than MIN_PAGES distinct pages of
its host counts as important; a page whose blocks would all go keeps those inside its article; an empty table gives an
empty table; other columns of the input are kept, result columns replace those of the same name, no other name is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, small_batches, unused
from .urls import url_host

#: Distinct pages that a place needs to be judged, limits of importance, weight of content under a single presentation.
MIN_PAGES, LOW, LINKS, GAMMA = 8, 0.35, 0.8, 0.9
DEEPEST = 256

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|title|select|math|object|video|audio|canvas)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S | re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
SPLIT = re.compile(r"[^a-z0-9]+")
SPACE = re.compile(r"\s+")
CUT = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that end the current block of text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: A start tag that closes an open element of these tags.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: Elements that hold no main text.
NOISE_TAGS = frozenset("head nav aside footer form button menu dialog search label input datalist fieldset".split())
NOISE_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words that name what is no main text, and words that say nothing beside them.
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent gdpr "
    "disclaimer disqus footer footers foot form login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promos promoted promotion "
    "recommended related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription tagcloud toolbar topbar tracking widget widgets".split()
)
NEUTRAL = frozenset("a area articles bar block body bottom box btn button buttons col column container content div entry first group holder icons id inner item items js last left link links list main message mobile module outer page panel policy pop post posts primary region right row secondary section site slot the title to top unit up user view wrap wrapper".split())
HEADER_NAMES = frozenset("header headers".split())
INLINE = frozenset("b i em strong span a u small sub sup mark code font abbr cite q time".split())
MASK = (1 << 61) - 1


class Node:
    """An open element: its place, what it is, and the sequence of its child places so far."""

    __slots__ = ("tag", "parent", "place", "noise", "inside", "link", "sequence", "depth")

    def __init__(self, tag: str, parent: Node | None, place: int, noise: bool, inside: bool, link: bool):
        self.tag, self.parent, self.place, self.noise, self.inside, self.link = tag, parent, place, noise, inside, link
        self.sequence, self.depth = 0, parent.depth + 1 if parent else 0


class Block:
    """A run of text at a node, with a place of its own below the node's; linked if all of it stands in links."""

    __slots__ = ("node", "text", "linked", "place")

    def __init__(self, node: Node, text: str, linked: bool):
        self.node, self.text, self.linked, self.place = node, text, linked, (node.place * 1000003 ^ 7) & MASK


def attributes_of(found: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(found)}


def says_noise(told: str) -> bool:
    """Whether one of the class or id names consists of noise words (and neutral ones) only."""
    for name in told.split():
        parts = {x for x in SPLIT.split(name) if x and not x.isdigit()}
        if parts & NOISE_NAMES and parts <= NOISE_NAMES | NEUTRAL:
            return True
    return False


def parse(html: str | None) -> tuple[list[Block], list[Node]]:
    """The text blocks of a page in order, and its elements that are not inline."""
    blocks: list[Block] = []
    root = Node("", None, 0, False, False, False)
    stack, nodes = [root], []
    held: list[str] = []
    open_p = 0
    under, linked = root, True

    def flush() -> None:
        nonlocal linked
        text = "".join(held)
        held.clear()
        if text and not text.isspace():
            text = SPACE.sub(" ", unescape(text) if "&" in text else text).strip()
            if text:
                blocks.append(Block(under, text, linked))
        linked = True

    def close(i: int) -> None:
        nonlocal open_p
        open_p -= sum(x.tag == "p" for x in stack[i:])
        del stack[i:]

    at = 0
    html = html or ""
    for m in MARKUP.finditer(html):
        if m.start() > at:
            held.append(html[at : m.start()])
            linked = linked and (stack[-1].link or held[-1].isspace())
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        closing, found = (m[2], m[4]) if m[3] else (m[5], m[7])
        if tag in BLOCK:
            flush()
        elif tag == "br":
            held.append(" ")
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in ("article", "main", "body") and tag not in ("body", "html", "article", "main"):
                    break
        elif tag not in VOID:
            shut = CLOSES.get(tag, ())
            if tag in BLOCK and open_p:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        close(i)
                        break
                    if stack[i].tag in BLOCK:
                        break
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in shut:
                    close(i)
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "select", "div", "article", "section", "body"):
                    break
            if len(stack) > DEEPEST:
                close(len(stack) - 1)
            top = stack[-1]
            told = role = ""
            hidden = body = False
            if found and not found.isspace():
                has = attributes_of(found)
                told, role = f"{has.get('class', '')} {has.get('id', '')}".strip(), has.get("role", "")
                hidden = "hidden" in has or has.get("aria-hidden") == "true" or "display:none" in has.get("style", "").replace(" ", "")
                body = has.get("itemprop") == "articlebody"
            inside = top.inside or tag in ("article", "main") or role in ("main", "article") or body
            noise = top.noise or hidden or tag in NOISE_TAGS or role in NOISE_ROLES or tag not in ("body", "html", "main", "article") and told != "" and says_noise(told)
            noise = noise or not top.inside and (tag == "header" or told in HEADER_NAMES)
            if tag in INLINE and not told:
                stack.append(Node(tag, top, top.place, noise, inside, top.link or tag == "a"))
                stack[-1].depth = top.depth
            else:
                label = f"{tag}.{told}{'!' if inside else ''}"
                place = (top.place * 1000003 ^ crc32(label.encode("utf-8", "surrogatepass")) * 2654435761) & MASK if tag not in ("html", "body") else 0
                top.sequence = (top.sequence * 31 + place + 1) & MASK
                stack.append(Node(tag, top, place, noise, inside, top.link or tag == "a"))
                nodes.append(stack[-1])
            open_p += tag == "p"
        if tag in BLOCK or under is not stack[-1] and not held:
            under = stack[-1]
        elif stack[-1].noise != under.noise:
            flush()
            under = stack[-1]
    rest = html[at:]
    if rest:
        cut = CUT.search(rest)
        held.append(rest[: cut.start()] if cut else rest)
        linked = linked and stack[-1].link
    flush()
    return blocks, nodes


def above(node: Node) -> list[int]:
    """The places of a node and of the elements around it, the innermost first; the root of all pages is none."""
    out: list[int] = []
    at: Node | None = node
    while at is not None:
        if at.place and (not out or out[-1] != at.place):
            out.append(at.place)
        at = at.parent
    return out


def hash64(text: str) -> int:
    raw = text.encode("utf-8", "surrogatepass")
    return crc32(raw) << 31 ^ crc32(raw[::-1])


#: kind 0: a child sequence of a place; 1: a text at a place; 2: an element (value) around a place; `first` once a page.
SEEN = "host string, page long, kind int, place long, value long, inside boolean, linked boolean, first int"


def observed(host: str | None, blocks: list[Block], nodes: list[Node], known: set[int]) -> list[tuple]:
    """The rows of SEEN of one page; places whose surroundings are known already have no rows of kind 2."""
    page = hash64("\0".join(f"{b.place}\0{b.text}" for b in blocks))
    styles = dict.fromkeys((0, n.place, n.sequence, n.inside, False) for n in nodes if n.place and n.sequence)
    texts = dict.fromkeys((1, b.place, hash64(b.text), b.node.inside, b.linked) for b in blocks)
    had: set[tuple[int, int]] = set()
    rows = []
    for kind, place, value, inside, linked in [*styles, *texts]:
        rows.append((host, page, kind, place, value, inside, linked, int((kind, place) not in had)))
        had.add((kind, place))
    for b in blocks:
        if b.place not in known:
            known.add(b.place)
            rows += [(None, None, 2, b.place, x, False, False, 0) for x in above(b.node)]
    return rows


def importance(seen: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, place, inside, linked, importance of every place of rows like SEEN, that enough pages have.

    Counts are summed before and after the shuffle; a hot host is spread by place and value.
    """
    each = seen.where("kind < 2").distinct().groupBy("host", "kind", "place", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("first").alias("pages"), F.max("inside").alias("inside"), F.min("linked").alias("linked"))
    weight = F.sum(F.col("n") * F.ln("n")) / F.sum("n")
    tree = each.groupBy("host", "kind", "place").agg(
        F.sum("pages").alias("m"), F.sum("n").alias("n"), weight.alias("weight"), F.count(F.lit(1)).alias("different"), F.max("inside").alias("inside"), F.min("linked").alias("linked")
    )
    tree = keep(tree, "style-tree")
    log_m = F.ln(F.greatest("m", F.lit(2)))
    texts = tree.where("kind = 1").withColumn("content", F.when(F.col("m") < min_pages, 1.0).otherwise(F.greatest(1 - F.col("weight") / log_m, F.lit(0.0))))
    inner = tree.where((F.col("kind") == 0) & (F.col("m") >= min_pages))
    shown = F.least(F.greatest((F.ln("n") - F.col("weight")) / log_m, F.lit(0.0)), F.lit(1.0))
    around = seen.where("kind = 2").select("place", F.col("value").alias("outer")).distinct()
    below = texts.join(around, "place").groupBy("host", F.col("outer").alias("place")).agg((F.sum(F.col("n") * F.col("content")) / F.sum("n")).alias("content"))
    share = F.pow(F.lit(GAMMA), F.col("different"))
    branches = inner.join(below, ["host", "place"]).select("host", "place", "inside", F.lit(False).alias("linked"), ((1 - share) * shown + share * F.col("content")).alias("importance"))
    return texts.where(F.col("m") >= min_pages).select("host", "place", "inside", "linked", F.col("content").alias("importance")).unionByName(branches)


def low_places(rated: DataFrame, low: float = LOW, links: float = LINKS) -> DataFrame:
    """host and places: the places of low importance, for hosts that have any."""
    limit = F.when(F.col("linked"), links).otherwise(low) * F.when(F.col("inside"), 0.5).otherwise(1.0)
    return rated.where(F.col("importance") < limit).groupBy("host").agg(F.collect_set("place").alias("places"))


def style_tree(pages: DataFrame, host: str, html: str, min_pages: int = MIN_PAGES, low: float = LOW, links: float = LINKS) -> DataFrame:
    """host and places to remove, from all pages."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: set[int] = set()
        names = [x.split()[0] for x in SEEN.split(", ")]
        for part in batches:
            if len(known) > 1_000_000:
                known.clear()
            yield pd.DataFrame([x for h, t in zip(part["host"], part["html"]) for x in observed(h, *parse(t), known)], columns=names).astype({"page": "Int64"})

    seen = keep(pages.select(F.col(host).alias("host"), F.col(html).alias("html")).mapInPandas(places, SEEN), "style-seen")
    return low_places(importance(seen, min_pages), low, links)


def removed_by_tree(blocks: list[Block], low: frozenset[int] | set[int]) -> list[bool]:
    return [bool(low) and (b.place in low or any(x in low for x in above(b.node))) for b in blocks]


def main_text(html: str | None, low: frozenset[int] | set[int] = frozenset()) -> str:
    """The text of a page without the host's low places and without what says it is noise."""
    blocks, _ = parse(html)
    plain = [(b, gone) for b, gone in zip(blocks, removed_by_tree(blocks, low)) if not b.node.noise]
    left = [b for b, gone in plain if not gone]
    inside, outside = [b for b in left if b.node.inside], [b for b in left if not b.node.inside]
    if not inside:
        inside = [b for b, _ in plain if b.node.inside]
        left = [b for b, gone in plain if b.node.inside or not gone]
    bounds = inside and sum(len(b.text) for b in inside) >= sum(len(b.text) for b in outside)
    return "\n".join(b.text for b in (inside if bounds else left))


def extract(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, low: float = LOW, links: float = LINKS) -> DataFrame:
    """pages with text and n_chars instead of the html. Hosts' places join by host: broadcast while small, else by key."""
    small_batches(pages.sparkSession)
    host = url_host(F.col(url))
    tree = keep(style_tree(pages.select(host.alias("host"), F.col(html).alias("html")), "host", "html", min_pages, low, links), "style-low")
    key, places, told = (unused(pages, x) for x in ("host_key", "low_places", "main_text"))
    met = pages.withColumn(key, host).join(tree.toDF(key, places), key, "left")

    def texts(html: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([main_text(x, frozenset() if p is None else set(p.tolist())) for x, p in zip(html, places)], dtype=object)

    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars", html.lower())]
    out = met.select(*kept, F.pandas_udf(texts, "string")(F.col(html), F.col(places)).alias(told))
    return out.select(*kept, F.col(told).alias("text"), F.length(told).cast("long").alias("n_chars"))
