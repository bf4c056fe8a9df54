"""Main text of web pages: site templates and page furniture removed, blocks kept in order.

1. Each page is parsed once, in a task. Every element subtree with text gets a hash of its
   tags and text; each text block keeps the hashes of the elements around it. A page that
   marks its article or main part keeps that part, but for furniture inside it: what a tag,
   role or class names as a menu, advert, form, comments and so on. The mark wins over a
   named wrapper and over a form around it, not over an aside, a footer or a menu. Where
   nothing is marked, furniture goes, and a form only if there is text outside of it.
2. Spark counts the subtrees of all pages per host over distinct contents: pages with the same
   text are one page, so copies of an article are no template. Of a marked part the boxes in it
   count (``BOXES``: wrappers, lists, tables; its paragraphs and headings are its text, and so is
   a box with more than half of it), with the longest block beside the box for the content: near
   copies of an article are one page too. A marked part and what is around it do not count. A
   subtree on at least ``MIN_PAGES`` distinct pages of its host is a template, whatever its share
   of the host.
3. On every page the blocks inside a template go. The others are joined.

The parsed blocks are written once. Counting moves hashes; the key is (host, hash), merged before
the shuffle. On the way back the templates, a row each, meet the hashes around the blocks that may
go in a plain join, which adaptive execution splits where a host with a third of all pages makes a
hot key. The texts of pages with such blocks move once, to meet the hashes that go, unless those
are few enough for Spark to broadcast; a marked part without a box has none. Hosts without such
a block are not counted.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from faultline.llm.urls import host_path
from faultline.sources.tables import stage

MIN_PAGES = 8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
FURNITURE = frozenset(
    "aside button dialog footer form head header iframe input menu nav noscript object option script select style "
    "svg template textarea title canvas".split())
FURNITURE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
MAIN_TAGS, MAIN_ROLES = frozenset(("article", "main")), frozenset(("article", "main"))
#: Elements inside a marked part that a template may be; others there hold its own text.
BOXES = frozenset("address center details div dl fieldset hgroup ol section table ul".split())
#: Class and id names that mark furniture: one of these, or joined by hyphens with more of them or of ``NEUTRAL``.
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices notification "
    "pagination popup promo promoted promotion related share sharing sidebar signup skip social sponsor sponsored "
    "subscribe toolbar widget".split())
NEUTRAL = frozenset(
    "area bar block bottom box button buttons container content fixed global left link links list main page primary "
    "right secondary section site sticky top wrap wrapper".split())
#: Tags and roles that a marked part does not lift out of.
STRONG = frozenset("aside dialog footer iframe menu nav object option select svg template".split())
STRONG_ROLES = frozenset("alertdialog complementary contentinfo dialog menu menubar navigation".split())
_P_ENDS = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Fixed values of HTML: an opening tag ends open elements of these names, up to the given parents.
_ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
#: A name, and a value if there is one; read in order, so that no value is taken for a name.
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORDS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


PLAIN, FORM, WEAK, FIRM = range(4)


class _Element:
    __slots__ = ("tag", "kind", "main", "pieces", "first", "holds_main")

    def __init__(self, tag: str, kind: int, main: bool, first: int):
        self.tag, self.kind, self.main, self.first, self.holds_main = tag, kind, main, first, False
        self.pieces: list[str] = [tag]


def _named(names: str) -> bool:
    """Whether one of the class or id names is furniture's."""
    for name in names.split():
        words = [w.lower() for w in _WORDS.split(name) if w]
        if any(w in FURNITURE_NAMES for w in words) and all(w in FURNITURE_NAMES or w in NEUTRAL for w in words):
            return True
    return False


def _marks(tag: str, attributes: str) -> tuple[int, bool, bool]:
    """The kind of an element, whether it is a main part, and whether a name calls it furniture."""
    role, names, hidden = "", "", False
    for name, value in _ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "role":
            role = value.lower()
        elif name in ("class", "id"):
            names += " " + value
        elif name in ("hidden", "aria-hidden"):
            hidden = hidden or value.lower() != "false"
    main = tag in MAIN_TAGS or role in MAIN_ROLES
    named = bool(names) and tag not in ("html", "body") and _named(names)
    if tag in STRONG or role in STRONG_ROLES or hidden:
        kind = FIRM
    elif tag == "form" or role == "form":
        kind = FORM
    elif tag in FURNITURE or role in FURNITURE_ROLES or (named and not main):
        kind = WEAK
    else:
        kind = PLAIN
    return kind, main, named


@dataclass
class Page:
    """The blocks of a page that may stay, and what its host's templates are counted from."""

    marked: bool
    #: Text, whether it stands in a form, and the hashes of the elements around it (if marked: of the boxes).
    blocks: list[tuple[str, bool, list[int]]]
    #: Distinct hashes of the subtrees outside any main part.
    subtrees: list[int]
    #: Distinct hashes of the boxes inside a main part, each with a hash of the longest block beside it.
    boxes: list[tuple[int, int]] = field(default_factory=list)

    @property
    def content(self) -> int:
        """A hash of the text; pages of the same text count once."""
        return _hash("\x00".join(t for t, _, _ in self.blocks))


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _marked_page(blocks: list[tuple[str, bool, list[int]]], subtrees: list[int]) -> Page:
    """A page of a marked part's blocks; a box with more than half of their text is no box."""
    held: dict[int, int] = {}
    for text, _, inside in blocks:
        for value in set(inside):
            held[value] = held.get(value, 0) + len(text)
    half = sum(len(t) for t, _, _ in blocks) / 2
    small = {value for value, size in held.items() if size <= half}
    longest = sorted(blocks, key=lambda b: (-len(b[0]), b[0]))
    boxes = [(value, _hash(next(t for t, _, inside in longest if value not in inside))) for value in sorted(small)]
    return Page(True, [(t, form, [v for v in inside if v in small]) for t, form, inside in blocks], subtrees, boxes)


def read_page(page: str | None) -> Page:
    """Parse a page. A block is the text between two edges of block elements, white space as one space."""
    if not page:
        return Page(False, [], [])
    stack = [_Element("#", PLAIN, False, 0)]
    # Text, kind, whether in a main part, hashes around it.
    blocks: list[tuple[str, int, bool, list[int]]] = []
    texts: list[str] = []
    subtrees: list[int] = []
    mains = 0

    def flush() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(texts))).strip() if texts else ""
        texts.clear()
        if text:
            stack[-1].pieces.append(text)
            outer = next((k for k, e in enumerate(stack) if e.main), None)
            if outer is None:
                kind = max(e.kind for e in stack)
            else:
                inside = any(e.kind for e in stack[outer + 1:])
                kind = FIRM if inside or any(e.kind == FIRM for e in stack[:outer + 1]) else PLAIN
            blocks.append((text, kind, outer is not None, []))

    def close() -> None:
        nonlocal mains
        element = stack[-1]
        if element.tag in BLOCK or element.kind or element.main:
            flush()
        stack.pop()
        mains -= element.main
        if element.main or element.holds_main:
            stack[-1].holds_main = True
        if len(element.pieces) == 1:
            return
        if element.tag not in BLOCK:
            stack[-1].pieces.extend(element.pieces)
            return
        value = _hash("\x00".join(element.pieces))
        stack[-1].pieces.append(str(value))
        if not element.main and not element.holds_main and (not mains or element.tag in BOXES):
            if not mains:
                subtrees.append(value)
            for _, _, _, inside in blocks[element.first:]:
                inside.append(value)

    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if found is None:
            texts.append(page[at:])
            break
        texts.append(page[at:found.start()])
        at = found.end()
        if found.group(2) is None:
            continue
        tag = found.group(2).lower()
        if found.group(1):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    while len(stack) > depth:
                        close()
                    break
            continue
        attributes = found.group(3)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else size
            closing = page.find(">", at)
            at = size if closing < 0 else closing + 1
            continue
        if tag == "br":
            texts.append(" ")
        if tag in _P_ENDS:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    while len(stack) > depth:
                        close()
                    break
                if stack[depth].tag in BLOCK:
                    break
        if tag in _ENDED_BY:
            ended, limits = _ENDED_BY[tag]
            depth = len(stack) - 1
            while depth > 0 and stack[depth].tag not in limits:
                if stack[depth].tag in ended:
                    while len(stack) > depth:
                        close()
                depth -= 1
        if tag in BLOCK:
            flush()
        if tag in VOID or attributes.endswith("/"):
            continue
        kind, main, named = _marks(tag, attributes)
        if main and named and mains:
            # A comment or a teaser in the main part that is an article of its own.
            kind, main = max(kind, WEAK), False
        if (kind or main) and tag not in BLOCK:
            flush()
        stack.append(_Element(tag, kind, main, len(blocks)))
        mains += main
    while len(stack) > 1:
        close()
    flush()
    if any(main and kind == PLAIN for _, kind, main, _ in blocks):
        return _marked_page([(t, False, inside) for t, kind, main, inside in blocks if main and kind == PLAIN], sorted(set(subtrees)))
    return Page(
        False, [(t, kind == FORM, inside) for t, kind, _, inside in blocks if kind in (PLAIN, FORM)], sorted(set(subtrees)))


def parsed(page: str | None) -> tuple[list[tuple[str, list[int]]], list[int]]:
    """The blocks of a page before templates go, with the hashes around each, and the subtrees that are counted."""
    found = read_page(page)
    outside = any(not form for _, form, _ in found.blocks)
    return [(t, i) for t, form, i in found.blocks if not (form and outside)], found.subtrees


def templates(nodes: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Template subtrees (host, subtree) from nodes (host, content, subtree): those in enough distinct contents."""
    once = nodes.groupBy("host", "subtree", "content").agg(F.lit(1).alias("one"))
    seen = once.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("seen"))
    return seen.where(F.col("seen") >= min_pages).select("host", "subtree")


def extract(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """Add text: the main text of each page, blocks joined by two line feeds.

    Null, empty and text-free pages have the empty text, and so has a page without a marked
    part that is nothing but templates; a marked part that is nothing else keeps its text; pages without a host count as one host. A column named
    text is replaced, others kept; repeated rows stay, each a page, and count once.
    """
    kept = [c for c in pages.columns if c not in ("text", html)]
    rows = pages.withColumn("_row", F.monotonically_increasing_id())
    host, _ = host_path(F.col(url))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [read_page(h) for h in batch["_html"]]
            batch = batch.drop(columns="_html")
            batch["_marked"] = [p.marked for p in found]
            batch["_blocks"] = [[{"text": t, "form": form, "inside": inside} for t, form, inside in p.blocks] for p in found]
            batch["_subtrees"] = [p.subtrees for p in found]
            batch["_content"] = [p.content for p in found]
            batch["_boxes"] = [[{"subtree": s, "content": c} for s, c in p.boxes] for p in found]
            yield batch

    packed = rows.select(
        F.col("_row"), F.coalesce(host, F.lit("")).alias("_host"),
        F.struct(*(F.col(c) for c in kept)).alias("_page") if kept else F.lit(None).cast("struct<x:int>").alias("_page"),
        F.col(html).alias("_html"))
    schema = (
        f"_row bigint, _host string, _page {packed.schema['_page'].dataType.simpleString()}, _marked boolean, "
        "_blocks array<struct<text:string,form:boolean,inside:array<bigint>>>, _subtrees array<bigint>, _content bigint, "
        "_boxes array<struct<subtree:bigint,content:bigint>>")
    read = stage(packed.mapInPandas(parse, schema), "page-blocks")
    outer = F.transform("_subtrees", lambda v: F.struct(
        v.alias("subtree"), F.col("_content").alias("content"), (~F.col("_marked")).alias("open")))
    inner = F.transform("_boxes", lambda b: F.struct(b["subtree"], b["content"], F.lit(True).alias("open")))
    nodes = read.select(F.col("_host").alias("host"), F.col("_row").alias("row"), F.inline(F.concat(outer, inner)))
    hosts = stage(nodes.where("open").select("host").distinct(), "page-hosts")
    found = stage(templates(nodes.join(hosts, "host", "left_semi"), min_pages), "page-templates")
    gone = nodes.where("open").join(found, ["host", "subtree"]).groupBy(
        F.col("row").alias("_row")).agg(F.collect_set("subtree").alias("_gone"))
    gone = stage(gone, "page-gone")
    done = F.col("_marked") & (F.size("_boxes") == 0)
    open_ = read.where(~done).join(gone, "_row", "left")
    done = read.where(done).withColumn("_gone", F.lit(None).cast("array<bigint>"))
    stay = F.filter("_blocks", lambda b: F.col("_gone").isNull() | ~F.arrays_overlap(b["inside"], F.col("_gone")))
    outside = F.filter("_stay", lambda b: ~b["form"])
    chosen = F.when(F.size(outside) > 0, outside).otherwise(F.col("_stay"))
    # A marked part of nothing but templates is its page's own text.
    stay = F.when(F.col("_marked") & (F.size(stay) == 0), F.col("_blocks")).otherwise(stay)
    names = ("_page", "_marked", "_blocks", "_gone")
    return open_.select(*names).unionByName(done.select(*names)).select("_page", stay.alias("_stay")).select(
        *(F.col(f"_page.{c}").alias(c) for c in kept),
        F.array_join(F.transform(chosen, lambda b: b["text"]), "\n\n").alias("text"))
