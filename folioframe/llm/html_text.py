"""Main-text extraction with site template removal.

Each page is parsed once, in time proportional to it, into a tree. Elements
that are boilerplate by tag, role or name go, the main element and the articles
outside it (else the body) stay, and their blocks are written out beside the
block elements that hold them, numbered from the top down, so that an element
holds the blocks from its own number to its last one.

Each element has a digest of its whole subtree, text included. One that holds
little but links and lies in no article also has a digest of its shape: tags,
classes and the shapes of its children, so that a menu recurs although its
words differ from page to page. Spark counts for every host on how many
different pages each digest occurs; the blocks of an element go when one of
its digests recurs on ``share`` of the host's pages and on ``least_pages`` of
them. Pages with the same content count once, so that copies of a page are no
template.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, materialise, pick, table

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^'">]|"[^"]*+"|'[^']*+')*+)>""")
LOOSE = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>""")  # after a quote that never ends
ATTRIBUTE = re.compile(r"""([A-Za-z_:-][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PART = re.compile(r"[a-z0-9]+")

RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noframes"))
RAW_END = {tag: re.compile(f"</{tag}(?![A-Za-z0-9])", re.IGNORECASE) for tag in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
CLOSES_P = BLOCKS - {"body", "html", "li", "option", "tbody", "tfoot", "thead", "tr"}
DROPPED = frozenset("head nav footer aside form button select input script style noscript template iframe svg canvas audio video object dialog menu textarea title label map".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: A class or id names boilerplate if one of its parts is here and all others are here or mere furniture.
DROPPED_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe signup sidebar aside comment comments respond disqus replies menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar share sharing social related recommended widget pagination pager".split())
FURNITURE = frozenset("area articles bar bars block body bottom box button buttons container content form group header icons inner item items left link links list main message outer page panel post posts right row section site slot stories text top wrap wrapper".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("ul ol dl table article section div main body aside nav td th blockquote".split())


class Node:
    __slots__ = ("tag", "attributes", "children", "digest", "shape", "size", "linked", "links", "like")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag = tag
        self.attributes = attributes
        self.children: list[Node | str] = []


class _Open:
    """The elements that are open while a page is parsed, and where each tag is open last."""

    def __init__(self, root: Node) -> None:
        self.stack = [root]
        self.places: dict[str, list[int]] = defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.stack))
        self.stack.append(node)

    def close(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        for node in self.stack[place:]:
            self.places[node.tag].pop()
        del self.stack[place:]

    def last(self, tags: frozenset[str] | set[str]) -> int:
        """Where one of the tags is open last, 0 where none is."""
        return max((self.places[tag][-1] for tag in tags if self.places.get(tag)), default=0)


def parse(html: str) -> Node:
    """A forgiving tree: paragraphs, items and cells end where the next one begins, stray end tags are passed over."""
    root = Node("#root")
    opened = _Open(root)
    at, length, last_close = 0, len(html), html.rfind(">")
    text_from = 0
    pattern = TAG
    while True:
        at = html.find("<", at)
        if at < 0 or (at > last_close and not html.startswith("<!--", at)):
            break  # no tag can end any more
        if html.startswith("<!--", at):
            stop = html.find("-->", at + 4)
            stop, found = (length if stop < 0 else stop + 3), None
        else:
            found = pattern.match(html, at)
            if not found and pattern is TAG and html[at + 1 : at + 3].strip("/")[:1].isalpha() and html[at + 1 : at + 3].isascii():
                pattern = LOOSE  # a quote without its end: from here on the next > ends a tag
                found = pattern.match(html, at)
            if found:
                stop = found.end()
            elif html[at + 1 : at + 2] in ("!", "?", "/"):
                stop = html.find(">", at) + 1
            else:
                at += 1
                continue
        if at > text_from:
            opened.stack[-1].children.append(html[text_from:at])
        at = text_from = stop
        if not found:
            continue
        tag, attributes = found[2].lower(), found[3]
        if found[1]:
            place = opened.last({tag})
            if place and (tag in FENCES or tag in BLOCKS or place >= opened.last(FENCES)):
                opened.close(place)
            continue
        if tag in CLOSES_P:
            place = opened.last({"p"})
            if place and place > opened.last(FENCES):
                opened.close(place)
        if tag in CLOSED_BY:
            place = opened.last(CLOSED_BY[tag])
            if place and place >= opened.last(FENCES - {"td", "th"} if tag == "tr" else FENCES):
                opened.close(place)
        node = Node(tag, attributes)
        opened.stack[-1].children.append(node)
        if tag in RAW:
            end = RAW_END[tag].search(html, at)
            after = html.find(">", end.end()) if end else -1
            at = text_from = after + 1 if after >= 0 else length
        elif tag not in VOID and not attributes.endswith("/"):
            opened.push(node)
    if text_from < length:
        opened.stack[-1].children.append(html[text_from:])
    return root


def attributes_of(node: Node) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(node.attributes)} if node.attributes.strip(" /") else {}


def names_boilerplate(name: str) -> bool:
    """Whether a class or id names something that is no part of an article: ``cookie-notice`` does, ``notice-board`` doesn't."""
    parts = NAME_PART.findall(name)
    return not DROPPED_NAMES.isdisjoint(parts) and all(part in DROPPED_NAMES or part in FURNITURE or part.isdigit() for part in parts)


def is_boilerplate(node: Node, inside: bool) -> bool:
    """Whether the element is no part of an article by its tag, role, class, id or because it is hidden."""
    if node.tag in DROPPED or (node.tag == "header" and not inside):
        return True
    if not node.attributes or node.tag in ("html", "body"):
        return False
    found = attributes_of(node)
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "") in DROPPED_ROLES or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    if node.tag in ("main", "article") and not {"comment", "comments"} & set(NAME_PART.findall(found.get("class", "").lower())):
        return False
    return any(map(names_boilerplate, (found.get("class", "") + " " + found.get("id", "")).lower().split()))


def prune(node: Node, inside: bool = False) -> None:
    stack = [(node, inside)]
    while stack:
        top, within = stack.pop()
        within = within or top.tag in ("article", "main")
        top.children = [c for c in top.children if isinstance(c, str) or not is_boilerplate(c, within)]
        stack += [(c, within) for c in top.children if not isinstance(c, str)]


def main_elements(root: Node) -> list[Node]:
    """The outermost main elements and articles, in page order; the whole where there is none."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag in ("main", "article") or (node.attributes and attributes_of(node).get("role") == "main"):
            found.append(node)
        else:
            stack += [c for c in reversed(node.children) if not isinstance(c, str)]
    return found or [root]


def _digest(start: str, parts: Iterator[bytes]) -> bytes:
    h = blake2b(start.encode("utf-8", "replace"), digest_size=8)
    for part in parts:
        h.update(part)
    return h.digest()


def _measure(top: Node, in_article: bool) -> None:
    """Digests, shapes (of what holds little but links, outside articles), sizes and link sizes, from the leaves up."""
    stack, order = [(top, in_article)], []
    while stack:
        node, within = stack.pop()
        within = within or node.tag == "article"
        order.append((node, within))
        stack += [(c, within) for c in node.children if not isinstance(c, str)]
    for node, within in reversed(order):
        parts, shapes = [], []
        node.size = node.linked = node.links = 0
        for i, child in enumerate(node.children):
            if isinstance(child, str):
                child = node.children[i] = unescape(child) if "&" in child else child
                text = " ".join(child.split())
                node.size += len(text)
                parts.append(b"\x00" + text.encode("utf-8", "replace"))
            else:
                parts.append(b"\x01" + child.digest)
                if not shapes or shapes[-1] != child.shape:
                    shapes.append(child.shape)
                node.size, node.linked, node.links = node.size + child.size, node.linked + child.linked, node.links + child.links
        if node.tag == "a":
            node.linked, node.links = node.size, 1
        node.digest = _digest(node.tag, iter(parts))
        named = attributes_of(node) if node.attributes else {}
        node.shape = _digest(f"shape\x00{node.tag}\x00{named.get('class', '')}", iter(shapes))
        node.like = not within and node.links >= 2 and 5 * node.linked >= 4 * node.size


def blocks_of(tops: list[Node]) -> tuple[list[tuple[str, int]], list[tuple[bytes, bytes | None, int, int]]]:
    """The blocks of the elements in page order as (text, number of the innermost block element or -1), and their
    block elements with text, ``tops`` excluded, as (digest, shape, number, number after the last inside)."""
    out: list[tuple[str, int]] = []
    elements: list[list] = []
    pending: list[str] = []
    holder = -1

    def close() -> None:
        if pending:
            text = " ".join("".join(pending).split())
            if text:
                out.append((text, holder))
            pending.clear()

    for top in tops:
        _measure(top, top.tag == "article")
        # nodes to open, or the number of an element to end (or -1) and its holder
        stack: list = [top]
        while stack:
            item = stack.pop()
            if isinstance(item, tuple):
                close()
                if item[0] >= 0:
                    elements[item[0]][3] = len(elements)
                holder = item[1]
            elif isinstance(item, str):
                pending.append(item)
            elif item.tag == "br" or item.tag in ("td", "th"):
                pending.append(" ")
                stack += [" ", *reversed(item.children)]
            elif item is top:
                close()
                stack += [(-1, -1), *reversed(item.children)]
            elif item.tag in BLOCKS:
                close()
                number = -1
                if item.size:
                    number = len(elements)
                    elements.append([item.digest, item.shape if item.like else None, number, -1])
                stack += [(number, holder), *reversed(item.children)]
                holder = number if number >= 0 else holder
            else:
                stack += reversed(item.children)
    return out, [tuple(e) for e in elements]


def page_parts(html: str | None) -> tuple[list[tuple[str, int]], list[tuple[bytes, bytes | None, int, int]]]:
    if not html:
        return [], []
    root = parse(html)
    prune(root)
    return blocks_of(main_elements(root))


def host_of(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parsed_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, h (hash of the host), blocks (text and number of the element that holds it), elements (their
    digests, numbers and ends) and a digest of the content."""
    frame = pick(pages, "page_id", "url", "html")
    schema = f"page_id {frame.schema['page_id'].dataType.simpleString()}, url string, blocks array<struct<text:string,at:int>>, elements array<struct<digest:bigint,at:int,stop:int>>"
    block = pa.list_(pa.struct([("text", pa.string()), ("at", pa.int32())]))
    element = pa.list_(pa.struct([("digest", pa.int64()), ("at", pa.int32()), ("stop", pa.int32())]))
    number = lambda digest: int.from_bytes(digest, "big", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, elements = [], []
            for html in batch.column(2):
                found, held = page_parts(html.as_py())
                blocks.append([{"text": text, "at": at} for text, at in found])
                elements.append([{"digest": number(d), "at": at, "stop": stop} for digest, shape, at, stop in held for d in ((digest,) if shape is None else (digest, shape))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blocks, block), pa.array(elements, element)], names=["page_id", "url", "blocks", "elements"])

    return frame.mapInArrow(run, schema).withColumn("h", F.xxhash64(host_of())).withColumn("content", F.xxhash64(F.col("blocks.text")))


def site_templates(parsed: DataFrame, share: float, least_pages: int) -> DataFrame:
    """h and the subtree digests that recur on many of its different pages.

    A host keeps at most (digests a page) / share digests, so its list is
    bounded by its pages' own size.
    """
    seen = parsed.select("h", "content", F.explode(F.array_distinct("elements.digest")).alias("digest")).distinct()
    counted = seen.groupBy("h", "digest").agg(F.count(F.lit(1)).alias("n"))
    sizes = parsed.select("h", "content").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("pages"))
    many = counted.filter(F.col("n") >= least_pages).join(sizes, "h").filter(F.col("n") >= F.col("pages") * share)
    return many.groupBy("h").agg(F.collect_list("digest").alias("template"))


def extract_main_text(pages: DataFrame, share: float = 0.3, least_pages: int = 10, broadcast_digests: int = 2_000_000) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    Null and empty pages give an empty text, null urls belong to the host
    with the empty name, repeated rows give equal rows, an empty table gives
    none; columns besides page_id, url and html are not looked at whatever
    their names. White space inside a block becomes one space, blocks are
    joined by one line feed, nothing is cut off, however long a page or deep
    its nesting. Hosts of fewer than ``least_pages`` different pages lose no
    templates. Templates are broadcast up to ``broadcast_digests`` digests of
    8 bytes, beyond it those of hot hosts only.
    """
    parsed = materialise(parsed_pages(pages), "html-blocks")
    templates = materialise(site_templates(parsed, share, least_pages), "html-templates")
    digests = templates.agg(F.coalesce(F.sum(F.size("template")), F.lit(0))).first()[0]
    joined = join_unique(parsed, templates, ["h"], "left", rows=broadcast_digests if digests <= broadcast_digests else 0)
    recurring = F.array_intersect(F.col("elements.digest"), F.coalesce("template", F.array().cast("array<bigint>")))
    marked = joined.withColumn("gone", F.filter("elements", lambda e: F.array_contains(recurring, e["digest"])))
    kept = F.filter("blocks", lambda b: ~F.exists("gone", lambda e: (e["at"] <= b["at"]) & (b["at"] < e["stop"])))
    text = F.array_join(F.transform(F.when(F.size("gone") > 0, kept).otherwise(F.col("blocks")), lambda b: b["text"]), "\n")
    return marked.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op9_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
