"""Main text of web pages, with site template removal.

A page becomes a tree of block elements. Every subtree gets a hash; Spark counts
on how many different pages of a host each hash occurs, and subtrees that recur
on at least MIN_PAGES pages and half of the host's pages are deleted as the
site's template. Around that stand the fixed rules of HTML: elements that never
are main text (menus, footers, asides, forms, scripts and the like, or named so
by class, id or role) go, inline elements too, without parting the block that
they stand in, and where a page marks its article, only that is kept.
Names are whole words of a class or id, or compounds of nothing but names and
the words that go with them: `no-ads` and `right-sidebar` are no names. A marked
article stays inside whatever else is dropped, such as a form around the page,
unless that is an aside, menu, comment, footer or the like.
Inside a marked article, paragraphs, headings and other text elements are never
taken for a template, so that articles which a site publishes twice stay.

Pages that differ in nothing but their copy count once. Only subtrees that the
fixed rules leave are counted, so what is shuffled is small beside the pages.

Defined results: null html gives the empty text; a page without host counts with
those of no host; unclosed elements end with the page; a page of no markup is
its text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_PAGES, MIN_SHARE = 4, 0.5
#: Template hashes up to this number (32 MB) are broadcast; more are joined by host.
BROADCAST_HASHES = 1 << 22

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*'|["'])*)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|\Z", re.I) for t in RAW}
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("nav footer aside form head script style svg canvas object select button template video audio map menu dialog fieldset datalist search label".split())
#: Inline elements that may end with their start tag.
FOREIGN = frozenset("svg math".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li ol ul dl dt dd blockquote pre table tbody thead tfoot tr td th figure figcaption main article".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar footer cookie cookies consent notice notices gdpr comment comments reply replies disqus respond share sharing social related recommended newsletter subscribe subscription popup modal overlay widget toolbar pagination pager skip login signup masthead copyright legal disclaimer tags toc".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words that articles use as classes, too: names in compounds only, such as related-posts.
WEAK = frozenset("legal related tags toc".split())
#: In compounds, words that follow names, and words before names of the last kind.
AFTER = frozenset("area bar block box button buttons container inner item items link links list posts section slot unit wrap wrapper".split())
BEFORE, PLACES = frozenset("bottom global main page primary secondary site top".split()), frozenset("breadcrumb breadcrumbs footer header masthead menu nav navbar navigation".split())
#: Names that drop an article inside as well, and tags and roles that drop a main element, too.
ASIDES = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion menu nav navbar navigation sidebar footer comment comments reply replies disqus respond related recommended widget".split())
FIRM = NEVER - frozenset("form fieldset label".split())
FIRM_ROLES = frozenset("navigation contentinfo complementary menu menubar toolbar".split())
SOFT, ASIDE, HARD = 1, 2, 3
#: A new start tag ends open ones of these kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WALLS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}


class Node:
    __slots__ = ("tag", "junk", "marked", "parts", "texts", "digest", "parent", "dropped", "depth")

    def __init__(self, tag: str, junk: int, marked: bool, parent: Node | None):
        self.tag, self.junk, self.marked, self.parent = tag, junk, marked, parent
        self.depth = parent.depth + 1 if parent else 0
        self.parts: list[Node | str] = []
        self.digest, self.dropped = b"", False


def _name(token: str, names: frozenset) -> set[str]:
    """The names of a class token, if it is nothing else."""
    words = [w for w in re.split(r"[^a-z0-9]+", token) if w]
    if len(words) > 1 and words[0] in BEFORE and words[-1] in PLACES:
        words = words[1:]
    if len(words) == 1 and words[0] in WEAK:
        return set()
    return set(words) & names if words and words[0] in names and set(words) <= names | AFTER else set()


def _junk(tag: str, attributes: str, inside: bool) -> int:
    """0, or how firmly an element is dropped: SOFT unless an article or main element is inside, ASIDE unless a main element is, HARD in any case."""
    level = (HARD if tag in FIRM else SOFT) if tag in NEVER or tag == "header" and not inside else 0
    if "=" in attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value = (a or b or c).lower()
            if name.lower() == "role":
                if value in ROLES:
                    level = max(level, HARD if value in FIRM_ROLES else SOFT)
            elif tag not in ("html", "body", "article", "main"):
                names = NAMES if inside or tag in ("h1", "h2") else NAMES | {"header"}
                for token in value.split():
                    if found := _name(token, names):
                        level = max(level, ASIDE if found & ASIDES else SOFT)
    return level


def _inherited(tag: str, level: int) -> int:
    """What an element takes over from the one around it."""
    return 0 if tag == "article" and level <= SOFT or tag == "main" and level <= ASIDE else level


def parse(html: str) -> Node:
    """The tree of block elements; inline markup leaves only its text, and that of dropped inline elements goes: up to their end, or that of the block around them."""
    root = Node("", 0, False, None)
    top, at, size = root, 0, len(html)
    text: list[str] = []
    hidden: list[tuple[str, int, int]] = []  # open inline elements that are dropped, and those of their name inside: tag, depth of the block, level

    hidden_in: dict[int, list[tuple[str, int, int]]] = {}

    def flush() -> None:
        if text:
            block = " ".join(unescape("".join(text)).split())
            text.clear()
            if block:
                top.parts.append(block)

    def pop(to: Node | None) -> None:
        nonlocal top
        while top is not to:
            left, top.digest = top, _digest(top)
            top = top.parent
            if id(left) in hidden_in:  # back in the dropped inline element around the block
                hidden[:] = hidden_in.pop(id(left))
        while hidden and top and hidden[-1][1] > top.depth:
            hidden.pop()

    while at < size:
        m = TOKEN.search(html, at)
        if not m:
            if not hidden:
                text.append(html[at:])
            break
        if not hidden:
            text.append(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
                node = top
                while node is not root and node.tag != tag:
                    node = node.parent
                if node is not root:
                    pop(node.parent)
            elif hidden and hidden[-1][0] == tag and hidden[-1][1] == top.depth:
                hidden.pop()
            continue
        if tag in RAW_END:
            end = RAW_END[tag].search(html, at)
            at = end.end()
            continue
        if tag == "br":
            if not hidden:
                text.append(" ")
        elif tag == "hr":
            flush()
        elif tag in BLOCKS and tag not in EMPTY:
            flush()
            node = top
            while node is not root and node.tag == "p":
                node = node.parent
            if tag in ENDS:
                up = node
                while up is not root and up.tag not in WALLS[tag] and up.tag not in ENDS[tag]:
                    up = up.parent
                if up is not root and up.tag in ENDS[tag]:
                    node = up.parent
            if node is not top:
                pop(node)
            marked = top.marked or tag in ("article", "main")
            above = max(top.junk, hidden[-1][2] if hidden else 0)
            child = Node(tag, max(_inherited(tag, above), _junk(tag, m[3], marked)), marked, top)
            top.parts.append(child)
            top = child
            if hidden:  # its own text is judged by its level
                hidden_in[id(child)] = hidden[:]
                hidden.clear()
        elif tag not in EMPTY and not (tag in FOREIGN and m[3].rstrip().endswith("/")):
            level = _junk(tag, m[3], top.marked)
            if hidden and hidden[-1][0] == tag:
                hidden.append((tag, top.depth, max(level, hidden[-1][2])))
            elif level and not hidden:
                hidden.append((tag, top.depth, level))
    flush()
    pop(None)
    return root


def _digest(node: Node) -> bytes:
    h = hashlib.blake2b(node.tag.encode(), digest_size=8)
    for p in node.parts:
        h.update(b"\0" + (p.digest if isinstance(p, Node) else p.encode("utf-8", "replace")))
    return h.digest()


def nodes(root: Node) -> Iterator[Node]:
    """All elements, parents first."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [p for p in node.parts if isinstance(p, Node)]


def main_text(root: Node) -> str:
    """The blocks that are left, in page order: of the marked article, if the page has one."""
    blocks: list[tuple[str, bool]] = []
    stack: list[Node | tuple[str, bool]] = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            blocks.append(x)
        elif x.junk:
            stack += [p for p in reversed(x.parts) if isinstance(p, Node)]  # an article inside may stay
        elif not x.dropped:
            stack += [p if isinstance(p, Node) else (p, x.marked) for p in reversed(x.parts)]
    if any(m for _, m in blocks):
        blocks = [b for b in blocks if b[1]]
    return "\n\n".join(b for b, _ in blocks)


def host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _key(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def candidates(root: Node) -> list[Node]:
    """Elements that the fixed rules leave and that may be a template: any outside a marked article, and containers inside it."""
    whole = not any(n.marked and not n.junk for n in nodes(root))
    return [n for n in nodes(root) if n.parent and not n.junk and n.parts and (n.tag not in TEXT if n.marked else whole and n.tag not in ("html", "body"))]


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        site, key, page = [], [], []
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if not html:
                continue
            name = host(url).encode("utf-8", "replace")
            own, root = _key(b"host\0" + name), parse(html)
            content = _key(root.digest)
            for k in {own, *(_key(name + b"\0" + n.digest) for n in candidates(root))}:
                site.append(own)
                key.append(k)
                page.append(content)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (site, key, page)], names=["site", "key", "page"])


def _extract(batches: Iterator[pa.RecordBatch], known: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        sets = None if known is not None else batch.column("keys").to_pylist()
        for i, (url, html) in enumerate(zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)):
            if not html:
                texts.append("")
                continue
            root = parse(html)
            if known is None or len(known):
                name = host(url).encode("utf-8", "replace")
                own = candidates(root)
                keys = np.array([_key(name + b"\0" + n.digest) for n in own], np.int64)
                if known is None:
                    there = [k in sets[i] for k in keys.tolist()] if sets[i] else [False] * len(own)
                else:
                    there = known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys
                for n, hit in zip(own, there, strict=True):
                    n.dropped = bool(hit)
            texts.append(main_text(root).encode("utf-8", "replace").decode())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(site, key) of subtrees that recur on that many different pages of a host, and on that share of them."""
    found = common.only(pages, "url", "html").mapInArrow(_subtrees, "site long, key long, page long").distinct()
    counts = found.groupBy("site", "key").agg(F.count("*").alias("n"))
    counts = common.cut(counts.where((F.col("n") >= min_pages) | (F.col("site") == F.col("key"))), "subtrees")
    sites = counts.where("site = key").select("site", F.col("n").alias("pages"))
    return counts.where("site <> key").join(sites, "site").where(F.col("n") >= F.col("pages") * min_share).select("site", "key")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    own = common.only(pages, "page_id", "url", "html")
    templates = common.cut(site_templates(own, min_pages, min_share), "templates")
    schema = f"page_id {dict(own.dtypes)['page_id']}, url string, text string, n_chars long"
    if templates.count() <= BROADCAST_HASHES:
        known = np.sort(np.array([r.key for r in templates.select("key").toLocalIterator()], np.int64))
        shared = own.sparkSession.sparkContext.broadcast(known)
        return own.mapInArrow(lambda it: _extract(it, shared.value), schema)
    # a host has at most (subtrees of its average page) / min_share templates, so the sets are bounded
    sets = templates.groupBy("site").agg(F.collect_set("key").alias("keys"))
    keyed = own.mapInArrow(_with_site, f"page_id {dict(own.dtypes)['page_id']}, url string, html string, site long")
    return keyed.join(sets, "site", "left").select("page_id", "url", "html", "keys").mapInArrow(lambda it: _extract(it, None), schema)


def _with_site(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        site = [_key(b"host\0" + host(u).encode("utf-8", "replace")) for u in batch.column("url").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(site, pa.int64())], names=["page_id", "url", "html", "site"])
