"""Main text of web pages: site templates found by counting element subtrees per host, then removed.

1. Each page is parsed once into text blocks. Every element that holds others is a subtree, menus, adverts and
   articles too, hashed over its tag, attributes, text and the subtrees in it; a list of links (most of its text is links,
   and so it is in all its parts) is hashed over its structure as well, without text and with repeats counted once, so a menu
   with other words is the same menu.
2. Spark counts on how many distinct pages of a host each hash occurs (copies of a page are one: equal text outside
   dropped elements); one that occurs on many is template.
3. A page's blocks inside template subtrees go. Of what remains, elements that are never article text (menus,
   footers, adverts, forms, reader comments ...) go by their tag, role or class; then the article is preferred.

Paragraphs, headings, list items, table cells and quotes are not subtrees of their own: a sentence that many
articles share is text. A subtree is kept as the range of blocks it holds, and the scanner looks at each character a
bounded number of times, so time and memory grow with the page, whatever its markup.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, written

MIN_PAGES, MIN_SHARE = 3, 0.2
# Names of HTML elements and the words by which sites mark what is not article text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea title svg math select option button object canvas".split())
DROP = RAW | set("head nav footer aside form menu dialog label fieldset audio video".split())
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
            "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - set("body html".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
STRUCTURE = set("aside details div dl figure footer form header main nav ol section table ul".split())
LEAF = HEADINGS | set("p li dt dd td th tr pre blockquote address figcaption summary hr label html".split())     # no subtrees of their own
DROP_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Whole class names and ids, "_" read as "-"; never parts of them.
DROP_NAMES = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation "
                 "menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices newsletter subscribe "
                 "subscription signup login popup modal overlay social share sharing related recommended comment comments "
                 "commentlist respond disqus widget toolbar pagination pager skip "
                 "ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper banner-ad top-ad side-ad google-ad adsbygoogle ad-placeholder "
                 "cookie-banner cookie-bar cookie-consent cookie-message cookie-notice cookie-policy-banner cookie-popup consent-banner gdpr-banner "
                 "site-footer page-footer main-footer footer-nav footer-menu footer-links footer-widgets site-header-nav "
                 "main-nav main-menu main-navigation site-nav site-navigation primary-nav primary-menu nav-menu nav-bar nav-links top-nav navbar-nav "
                 "post-navigation posts-navigation navigation-menu menu-main-menu mobile-menu mobile-nav skip-link side-bar left-sidebar right-sidebar "
                 "sidebar-left sidebar-right widget-area widgetarea share-buttons share-bar share-links share-this social-share social-links social-media "
                 "social-icons social-buttons sharedaddy related-posts related-articles related-stories related-content related-links recommended-posts "
                 "recommended-articles comment-list comment-form comment-respond comments-area comments-section disqus-thread newsletter-signup newsletter-form "
                 "subscribe-form signup-form login-form sponsored-content sponsored-links promo-box".split())
#: Of these, the ones that also name parts of an article: inside one they count only where most of the text is links.
LOOSE_NAMES = set("related recommended menu notice notices comment social sharing banner promotion popup modal overlay widget toolbar pager skip "
                  "subscription login signup footer".split())
KEEPS_NAMES = HEADINGS | set("html body main article p".split())       # never dropped by class or id
FAST_TAG = 256
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTR = re.compile(r"(?<![^\s=/\"'<>])([^\s=/\"'<>]++)\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s>]+)")
#: White space as \\s has it. Fixed values.
_SPACES = [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_RAW_END = {t: re.compile(rf"</{t}\s*+>", re.I) for t in RAW}
_GT = re.compile(">")
_FOREIGN_TEXT = re.compile("<foreignobject|<annotation-xml", re.I)
RAW_TEXT = set("script style iframe textarea title".split())      # without an end tag they reach to the end of the page
FOREIGN = set("svg math".split())                                # may close themselves; a text element ends them
_LEAVES_FOREIGN = re.compile(r"<(?=(?:p|div|h[1-6]|ul|ol|dl|table|pre|blockquote|body|main|article|section|header|footer)[\s/>])|<(?=/(?:p|div|body|main|article|section|header|footer|h[1-6]|li|td)\s*>)", re.I)


def _marks(attributes: str) -> tuple[set[str], str]:
    """Names in class and id, and the role."""
    names, role = set(), ""
    if "=" in attributes:
        for name, value in _ATTR.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "role":
                role = value
            elif name in ("class", "id"):
                names.update(value.replace("_", "-").split())
    return names, role


class _Finder:
    """The next match of a pattern at or after a place. Places only grow and a match ahead is kept, so the page is searched
    once in all."""
    __slots__ = ("pattern", "page", "low", "hit")

    def __init__(self, pattern, page: str):
        self.pattern, self.page, self.low, self.hit = pattern, page, None, None

    def next(self, at: int):
        if self.low is None or at < self.low or (self.hit is not None and at > self.hit.start()):
            self.low, self.hit = at, self.pattern.search(self.page, at)
        return self.hit


class _TagEnds:
    """Where the tag that begins at each ``<`` ends: its name, then text and whole quoted strings up to a ``>``. Worked out for
    all of a page at once, in arrays: from every quote or ``>`` outside quotes, the next one outside is known, and doubling
    these steps leads each to its ``>`` (or to nothing)."""

    def __init__(self, page: str):
        codes = np.frombuffer(page.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        marks = np.flatnonzero((codes == 34) | (codes == 39) | (codes == 62))
        kind, n = codes[marks], len(marks)
        step = np.full(n + 1, n, dtype=np.int64)            # n: nothing follows
        for quote in (34, 39):
            own = np.flatnonzero(kind == quote)
            step[own[:-1]] = own[1:] + 1
        ends = np.flatnonzero(kind == 62)
        step[ends] = ends
        while True:
            further = step[step]
            if np.array_equal(further, step):
                break
            step = further
        opens = np.flatnonzero(codes == 60)
        stops = np.flatnonzero(np.isin(codes, [*_SPACES, 47, 62]))
        name = opens + 1 + (codes[np.minimum(opens + 1, len(codes) - 1)] == 47)
        after = np.concatenate([stops, [len(codes)]])[np.searchsorted(stops, name)]
        at = step[np.searchsorted(marks, after)]
        self.opens, self.close = opens.tolist(), np.concatenate([marks, [-1]])[at].tolist()

    def of(self, at: int) -> int:
        """The place of the ``>`` that ends the tag at ``at``, -1 if it has none."""
        return self.close[bisect_left(self.opens, at)]


class _Scanner:
    """Tags of a page, and where elements without text end."""

    def __init__(self, page: str):
        self.page, self.ends = page, None
        self.gt, self.leaves, self.foreign_text = _Finder(_GT, page), _Finder(_LEAVES_FOREIGN, page), _Finder(_FOREIGN_TEXT, page)
        self.raw: dict[str, _Finder] = {}

    def tag(self, at: int):
        """(end, closing, name, attributes) of the tag at ``at``; name None: a comment or declaration; None: no tag."""
        page = self.page
        c = page[at + 1:at + 2]
        if c in ("!", "?"):
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return (end + 3 if end >= 0 else len(page)), False, None, ""
            hit = self.gt.next(at + 2)
            return None if hit is None else (hit.end(), False, None, "")
        if self.ends is None:
            m = _TAG.match(page, at, at + FAST_TAG)
            if m:
                return m.end(), bool(m[1]), m[2].lower(), m[3]
        start = at + 1 + (c == "/")
        if not ("a" <= page[start:start + 1].lower() <= "z"):
            return None
        if self.ends is None:
            self.ends = _TagEnds(page)
        end = self.ends.of(at)
        if end < 0:
            return None
        name = _NAME.match(page, start, end)
        return end + 1, start > at + 1, name[0].lower(), page[name.end():end]

    def raw_end(self, tag: str, attributes: str, at: int) -> int:
        """Where the text goes on after the start tag (which ends at ``at``) of an element whose content is no text."""
        if tag in FOREIGN and attributes.endswith("/"):
            return at
        if tag not in self.raw:
            self.raw[tag] = _Finder(_RAW_END[tag], self.page)
        e = self.raw[tag].next(at)
        if tag in FOREIGN:
            leaves = self.leaves.next(at)
            if leaves and (e is None or leaves.start() < e.start()):
                inner = self.foreign_text.next(at)
                if inner is None or inner.start() >= leaves.start():
                    return leaves.start()
        return e.end() if e else len(self.page) if tag in RAW_TEXT else at


class _Node:
    __slots__ = ("tag", "drop", "main", "header", "loose", "hash", "shape", "last_shape", "blocks", "first", "chars", "links", "mixed")

    def __init__(self, tag, drop, main, header, loose, names, first):
        self.tag, self.drop, self.main, self.header, self.loose = tag, drop, main, header, loose
        self.hash = self.shape = None
        if tag not in LEAF:
            head = f"{tag} {' '.join(sorted(names))}\0".encode()
            self.hash, self.shape, self.last_shape = hashlib.blake2b(head, digest_size=8), hashlib.blake2b(head, digest_size=8), b""
        self.blocks, self.first, self.chars, self.links, self.mixed = 0, first, 0, 0, False

    def link_list(self) -> bool:
        """Most of the text is links, and so it is in every part but headings."""
        return not self.mixed and 2 * self.links >= self.chars

    def add(self, digest: bytes, shape: bytes, chars: int, links: int, mixed: bool) -> None:
        self.hash.update(digest)
        self.mixed |= mixed
        if shape != self.last_shape:
            self.shape.update(shape)
            self.last_shape = shape
        self.blocks, self.chars, self.links = self.blocks + 1, self.chars + chars, self.links + links


class Page:
    """A parsed page: text blocks, whether each is article text, whether a rule drops it; and the subtrees with text as
    (hash, hash of the structure or 0, first block, block after the last)."""
    __slots__ = ("texts", "mains", "drops", "subtrees")

    def __init__(self):
        self.texts, self.mains, self.drops, self.subtrees = [], [], [], []


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


def parse(html: str | None) -> Page:
    out = Page()
    if not html:
        return out
    scan = _Scanner(html)
    stack: list[_Node] = []
    holders: list[_Node] = []           # open subtrees
    shields: list[_Node] = []           # open paragraphs and structure: what a block closes, or not
    lists: list[_Node] = []             # open items and lists
    opened: dict[str, int] = {}
    buffer: list[str] = []
    linked, headings = [0, False], 0    # characters of links in the buffer, whether a link is open

    def flush():
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            links = min(linked[0], len(text))
            buffer.clear()
            linked[0] = 0
            if text:
                top = stack[-1] if stack else None
                if holders:
                    holders[-1].add(f"{top.tag}\0{text}\0".encode(), f"{top.tag}\0".encode(), len(text), links, 2 * links < len(text) and top.tag not in HEADINGS)
                out.texts.append(text)
                out.mains.append(bool(top and top.main))
                out.drops.append(bool(top and (top.drop or top.header and not headings)))

    def close():
        nonlocal headings
        node = stack.pop()
        opened[node.tag] -= 1
        headings -= node.tag in HEADINGS
        for kept in (shields, lists):
            if kept and kept[-1] is node:
                kept.pop()
        if node.hash is not None:
            holders.pop()
            if node.blocks:
                digest, shape = node.hash.digest(), node.shape.digest()
                out.subtrees.append((_number(digest), _number(shape) if node.link_list() else 0, node.first, len(out.texts)))
                if node.loose and 2 * node.links >= node.chars:
                    out.drops[node.first:] = [True] * (len(out.texts) - node.first)
                if holders:
                    holders[-1].add(b"\0" + digest, b"\0" + shape, node.chars, node.links, not node.link_list())

    at, end = 0, len(html)
    while at < end:
        begin = html.find("<", at)
        if begin < 0:
            begin = end
        if begin > at:
            buffer.append(html[at:begin])
            if linked[1]:
                linked[0] += begin - at
        if begin == end:
            break
        found = scan.tag(begin)
        if found is None:
            buffer.append("<")
            at = begin + 1
            continue
        at, closing, tag, attributes = found
        if tag is None:
            continue
        if tag == "a":
            linked[1] = not closing
        if closing:
            if tag == "br":
                buffer.append(" ")
            if opened.get(tag):
                flush()
                while stack[-1].tag != tag:
                    close()
                close()
            elif tag in BLOCK or tag in DROP:
                flush()
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                buffer.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            at = scan.raw_end(tag, attributes, at)
            continue
        if tag not in BLOCK and tag not in DROP:
            continue                     # inline elements only mark up text
        flush()
        linked[1] = False
        if tag in CLOSES_P and shields and shields[-1].tag == "p":
            last = shields[-1]
            while stack[-1] is not last:
                close()
            close()
        if tag == "li" and lists and lists[-1].tag == "li":     # an open item of the same list ends
            last = lists[-1]
            while stack[-1] is not last:
                close()
            close()
        top = stack[-1] if stack else None
        names, role = _marks(attributes)
        inside = bool(top and top.main)
        marked = names & DROP_NAMES if tag not in KEEPS_NAMES else set()
        loose = bool(marked) and inside and marked <= LOOSE_NAMES
        drop = bool(top and top.drop) or tag in DROP or role in DROP_ROLES or (bool(marked) and not loose)
        main = inside or (not drop and (tag in ("article", "main") or role in ("main", "article")))
        node = _Node(tag, drop, main, bool(top and top.header) or tag == "header", loose, names, len(out.texts))
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1
        headings += tag in HEADINGS
        if node.hash is not None:
            holders.append(node)
        if tag == "p" or tag in STRUCTURE:
            shields.append(node)
        if tag in ("li", "ul", "ol"):
            lists.append(node)
    flush()
    while stack:
        close()
    return out


PARSED = ("row long, page_id long, url string, host string, texts array<string>, mains array<boolean>, drops array<boolean>, "
          "hashes array<long>, shapes array<long>, firsts array<int>, lasts array<int>, content long")


def _parser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = [parse(h) for h in batch.column(4).to_pylist()]
        subtrees = lambda k, t: pa.array([[x[k] for x in p.subtrees] for p in pages], pa.list_(t))
        content = [_number(hashlib.blake2b("\0".join(t for t, d in zip(p.texts, p.drops, strict=True) if not d).encode(), digest_size=8).digest()) for p in pages]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array([p.texts for p in pages], pa.list_(pa.string())), pa.array([p.mains for p in pages], pa.list_(pa.bool_())),
             pa.array([p.drops for p in pages], pa.list_(pa.bool_())), subtrees(0, pa.int64()), subtrees(1, pa.int64()), subtrees(2, pa.int32()),
             subtrees(3, pa.int32()), pa.array(content, pa.int64())],
            names=["row", "page_id", "url", "host", "texts", "mains", "drops", "hashes", "shapes", "firsts", "lasts", "content"])


def main_text(texts: list[str], mains, drops, hashes, shapes, firsts, lasts, gone: set[int]) -> str:
    """Blocks outside template subtrees, then outside dropped elements, then the article if any of it remains."""
    kept = ~np.array(drops, dtype=bool)
    if gone:
        edges = np.zeros(len(texts) + 1, dtype=np.int64)
        for h, s, first, last in zip(hashes, shapes, firsts, lasts, strict=True):
            if h in gone or s in gone:
                edges[first] += 1
                edges[last] -= 1
        kept &= np.cumsum(edges[:-1]) == 0
    article = kept & np.array(mains, dtype=bool)
    return "\n\n".join([texts[k] for k in np.flatnonzero(article if article.any() else kept)])


def _assembler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[2:]]
        texts = [main_text(*row[:7], set(row[7] or ())) for row in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def extract_pages(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages`` (``page_id, url, html``).

    The text is the page's article: blocks in page order, white space inside a block turned into one space,
    joined by an empty line. A subtree on at least ``min_pages`` distinct pages and ``min_share`` of the distinct
    pages of its host is template and goes. Where nothing marked as article remains, the rest of the body counts.

    Null, empty and text-free pages give an empty text. A null or odd url belongs to the host "". Repeated
    rows are pages of their own. Unclosed, crossed and cut-off markup is read as far as it goes; very long pages are read
    whole. An empty table gives an empty result; extra columns are ignored.
    """
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url",
                        host_of(F.col("url")).alias("host"), "html")
    parsed = written(rows.mapInArrow(_parser, PARSED), "html-blocks", TEXT_ROWS)
    found = written(template_of(parsed, min_pages, min_share), "html-template")
    left = parsed.join(found, "row", "left").select("page_id", "url", "texts", "mains", "drops", "hashes", "shapes", "firsts", "lasts", "_gone")
    texts = written(left.mapInArrow(_assembler, "page_id long, url string, text string"), "html-texts", TEXT_ROWS)
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def template_of(parsed: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``row, _gone``: the hashes on a page that are template of its host; pages without any are left out."""
    hosts = parsed.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("_pages"))
    marks = F.explode(F.array_distinct(F.concat("hashes", F.filter("shapes", lambda s: s != 0))))
    own = parsed.select("row", "host", "content", marks.alias("subtree"))
    counted = own.select("host", "content", "subtree").distinct().groupBy("host", "subtree").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_pages)
    template = counted.join(hosts, "host").where(F.col("_n") >= min_share * F.col("_pages")).select("host", "subtree")
    return own.select("row", "host", "subtree").join(template, ["host", "subtree"], "left_semi").groupBy("row").agg(F.collect_set("subtree").alias("_gone"))
