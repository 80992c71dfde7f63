"""Main-text extraction with container paths agreed on per host.

Each page scores its containers by the text in them, outside links and
boilerplate, and votes with all its scores for their generalised tag-class
paths. Spark sums the votes per host, and the best path of each host wins.
Pages are then extracted again along their host's path. Pages that lack it fall
back to their own best container, so nothing is dropped for being unusual, and
nothing inside the chosen container is cut for standing on other pages, too.

Boilerplate is what HTML says (``nav``, ``footer``, ...), what a class or id
names in full (``site-footer``, but not ``share-price``) and lists of links
outside the article. A form is none if it holds an article or half of the
page's text, and a named box (but reader comments) none if it holds an article
or next to all text: frameworks wrap whole sites in forms and widgets.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

# Element names as HTML uses them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style title textarea iframe xmp noembed noframes"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
BOILER_TAGS = frozenset("head nav header footer aside button dialog menu fieldset option datalist noscript template svg object select".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
BOX_TAGS = frozenset("article main section div td body center blockquote".split())
LISTS = frozenset("ul ol dl table".split())
CLOSES_P = frozenset(
    "address article aside blockquote body center details dialog div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table td th tr ul".split()
)
SAME_LEVEL = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
#: Words of a class or id that name boilerplate, if the name's other words are among the plain ones.
BOILER_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent"
    " cookie cookies disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo"
    " related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Words that only say where or what kind of box it is.
PLAIN_WORDS = frozenset(
    "area bar block blocks body bottom box btn button buttons card center col column container content cookie entry fixed footer form global group header holder icon icons id inner"
    " item items js left link links list main mobile module outer page panel primary region right row secondary section site slot sticky text title top unit user web wrap wrapper zone".split()
)
#: Words of the article itself, which may stand before a boilerplate word (``article-comments``) but not after it.
ARTICLE_WORDS = frozenset("article blog content entry news page post story text".split())

#: Of these, those that name what readers write.
READER_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Share of a page's text in a form that makes it the page's frame, and beside a named box that is next to nothing.
FRAME_SHARE, REST_SHARE = 0.5, 0.05
#: Links and share of link text that make a list a menu.
LINKS, LINK_SHARE = 3, 0.7

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<({'|'.join(RAW.split())})\b[^>]*(?:/>|>(.*?)(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S | re.I,
)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _heads_article(name: str) -> bool:
    """Whether a class or id names the head of an article and not that of a site."""
    words = [w.lower() for w in _WORDS.findall(name)]
    return bool(words) and words[-1] == "header" and any(w in ARTICLE_WORDS and w != "page" for w in words)


def _names_boilerplate(name: str) -> int:
    """Whether a class or id, as a whole, names boilerplate (1), or more closely what readers write (2)."""
    words = [w.lower() for w in _WORDS.findall(name)]
    at = [k for k, w in enumerate(words) if w in BOILER_WORDS]
    if not at or _heads_article(name):
        return 0
    if not all(w in BOILER_WORDS or w in PLAIN_WORDS or (w in ARTICLE_WORDS and k < at[-1]) for k, w in enumerate(words)):
        return 0
    return 2 if any(w in READER_WORDS for w in words) else 1


@lru_cache(maxsize=1 << 16)
def _marks(attrs: str) -> tuple[str, int, bool, bool]:
    """The generalised class of a start tag, whether its names say boilerplate, whether it is hidden or has such a role, and whether it heads an article."""
    cls, named, hidden, heads = "", 0, False, False
    for k, a, b, c in _ATTR.findall(attrs):
        k, v = k.lower(), unescape(a or b or c)
        if k == "class":
            cls = ".".join(sorted({re.sub(r"\d+", "0", x.lower()) for x in v.split()}))
        if k in ("class", "id"):
            named = max(named, *map(_names_boilerplate, v.split()), 0)
            heads |= any(map(_heads_article, v.split()))
        elif k == "role":
            hidden |= v.lower() in BOILER_ROLES
        elif k == "style":
            hidden |= bool(_HIDING.search(v.lower()))
        else:
            hidden |= k == "hidden" or v.lower() == "true"
    return cls, named, hidden, heads


@lru_cache(maxsize=1 << 16)
def _label(tag: str, cls: str) -> int:
    return zlib.crc32(f"{tag}.{cls}".encode()) * 0x9E3779B97F4A7C15


class Page:
    """The elements of a page and its pieces of text in page order.

    Elements are numbered; ``path`` is a hash of the tags and generalised
    classes from the root on. Nesting may be of any depth.
    """

    def __init__(self, html: str):
        self.tag, self.parent, self.path = [""], [0], [0]
        self.named, self.by_tag, self.link, self.h1 = [0], [False], [False], [False]  # named and by_tag: of the element itself, until judged
        self.box, self.article, self.main = [0], [0], [0]  # nearest such element, itself included; 0: none
        self.title = ""
        self.pieces: list[tuple[int, str | None]] = []  # None: a block ends
        self._read(html)
        self._judge()

    def _add(self, tag: str, attrs: str, top: int) -> int:
        cls, named, hidden, heads = _marks(attrs) if attrs else ("", 0, False, False)
        i = len(self.tag)
        inside = self.article[top]
        boiler = hidden or tag in BOILER_TAGS and not (tag == "header" and (inside or heads))
        if tag in ("html", "body", "main"):
            named = 0
        elif tag == "article":
            named = named if "comment" in cls else 0
        self.tag.append(tag)
        self.parent.append(top)
        inline = tag in INLINE
        self.path.append(self.path[top] if inline else (self.path[top] * 0x100000001B3 ^ _label(tag, cls)) & (1 << 63) - 1)
        self.named.append(named)
        self.by_tag.append(boiler)
        self.link.append(tag == "a" or self.link[top])
        self.h1.append(tag == "h1" or self.h1[top])
        self.box.append(i if tag in BOX_TAGS else self.box[top])
        self.article.append(i if tag == "article" else inside)
        self.main.append(i if tag == "main" else self.main[top])
        return i

    def _read(self, html: str) -> None:
        stack, tags, open_tags = [0], self.tag, {}

        def close(i):
            for x in stack[i:]:
                open_tags[tags[x]] -= 1
            del stack[i:]

        at, put = 0, self.pieces.append
        for m in _PIECE.finditer(html):
            if m.start() > at:
                put((stack[-1], html[at : m.start()]))
            at = m.end()
            tag = m[4] or m[7]
            if not tag:
                if m[1]:
                    put((stack[-1], None))
                    if m[1].lower() == "title" and not self.title:
                        self.title = " ".join(unescape(m[2] or "").split())
                continue
            tag, closing, attrs = tag.lower(), m[3] or m[6], m[5] or m[8] or ""
            if tag not in INLINE:
                put((stack[-1], None))
            if closing:
                if open_tags.get(tag):
                    for i in range(len(stack) - 1, 0, -1):
                        if tags[stack[i]] == tag:
                            close(i)
                            break
                        if tag in INLINE and tags[stack[i]] not in INLINE:
                            break  # an inline end tag does not close blocks
                continue
            if tag in VOID or attrs.endswith("/") and tag not in BOX_TAGS:
                continue
            if tag in CLOSES_P and open_tags.get("p"):
                for i in range(len(stack) - 1, 0, -1):
                    if tags[stack[i]] == "p":
                        close(i)
                        break
                    if tags[stack[i]] not in INLINE:
                        break
            if tag in SAME_LEVEL and open_tags.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    if tags[stack[i]] == tag:
                        close(i)
                        break
                    if tags[stack[i]] in SAME_LEVEL[tag]:
                        break
            stack.append(self._add(tag, attrs, stack[-1]))
            open_tags[tag] = open_tags.get(tag, 0) + 1
        if at < len(html):
            put((stack[-1], html[at:]))

    def _judge(self) -> None:
        """Find menus (lists of links that stand in no article), and forms and named boxes that are the page's frame; then hand boilerplate down."""
        n = len(self.tag)
        chars, linked, links = [0] * n, [0] * n, [t == "a" for t in self.tag]
        whole = [t in ("article", "main") and not self.named[i] for i, t in enumerate(self.tag)]  # holds an article
        for node, text in self.pieces:
            if text:
                size = len(text.strip())
                chars[node] += size
                if self.link[node]:
                    linked[node] += size
        own = [a - b for a, b in zip(chars, linked)]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            links[p] += links[i]
            whole[p] = whole[p] or whole[i]
        plain = [a - b for a, b in zip(chars, linked)]
        tag, parent, by_tag, named = self.tag, self.parent, self.by_tag, self.named
        for i in range(1, n):
            menu = tag[i] in LISTS and links[i] >= LINKS and linked[i] >= LINK_SHARE * chars[i] and not self.article[i] and not self.main[i]
            form = tag[i] == "form" and not whole[i] and plain[i] < FRAME_SHARE * plain[0]
            by_tag[i] = by_tag[i] or menu or form or by_tag[parent[i]]
            if named[i] == 1 and whole[i]:
                named[i] = 0
        if any(named):
            outer = [0] * n  # the outermost named box around each element
            for i in range(1, n):
                outer[i] = outer[parent[i]] or (i if named[i] else 0)
            inside: dict[int, int] = {}
            for i in range(1, n):
                if own[i] and not by_tag[i]:
                    inside[outer[i]] = inside.get(outer[i], 0) + own[i]
            boxes = {i: size for i, size in inside.items() if i and named[i] == 1}
            if boxes:
                most = max(boxes, key=lambda i: (boxes[i], -i))
                if inside.get(0, 0) < REST_SHARE * boxes[most]:
                    named[most] = 0
        for i in range(1, n):
            named[i] = named[i] or named[parent[i]]

    def boiler(self, by_name: bool = True) -> list[bool]:
        return [a or bool(b) for a, b in zip(self.by_tag, self.named)] if by_name else self.by_tag

    def scores(self, boiler: list[bool]) -> list[tuple[int, float]]:
        """``(path, share of the page's score)`` of the containers, best first."""
        by_path: dict[int, float] = {}
        for node, text in self.pieces:
            n = len(text.strip()) if text else 0
            if not n or boiler[node] or self.link[node]:
                continue
            weight, box = float(n), self.box[node]
            for _ in range(3):
                if not box:
                    break
                if self.tag[box] not in ("article", "main"):
                    by_path[self.path[box]] = by_path.get(self.path[box], 0.0) + weight
                weight, box = weight / 3, self.box[self.parent[box]]
            # an article or the main part is one container, however deep its text lies
            for whole, worth in ((self.article[node], 1.5), (self.main[node], 1.2)):
                if whole:
                    by_path[self.path[whole]] = by_path.get(self.path[whole], 0.0) + worth * n
        total = sum(by_path.values())
        return [(p, s / total) for p, s in sorted(by_path.items(), key=lambda x: (-x[1], x[0]))]

    def blocks(self, boiler: list[bool]) -> list[tuple[int, str]]:
        """``(element, text)`` of the blocks outside boilerplate, white space turned into single spaces."""
        out, held, own = [], [], 0
        for node, text in self.pieces:
            if text is None:
                if held:
                    if block := " ".join("".join(held).split()):
                        out.append((own, block))
                    held = []
            elif not boiler[node]:
                own = node
                held.append(unescape(text) if "&" in text else text)
        if held and (block := " ".join("".join(held).split())):
            out.append((own, block))
        return out

    def at(self, path: int, blocks: list[tuple[int, str]]) -> list[str]:
        """The blocks inside the containers at ``path``, with the heading that the title repeats, wherever it stands."""
        inside = [False]
        for i in range(1, len(self.tag)):
            inside.append(inside[self.parent[i]] or self.path[i] == path)
        if any(self.h1[node] and inside[node] for node, _ in blocks):
            return [b for node, b in blocks if inside[node]]
        return [b for node, b in blocks if inside[node] or self.h1[node] and len(b) > 2 and b in self.title]

    def whole(self) -> tuple[list[tuple[int, str]], list[bool]]:
        """All blocks outside boilerplate, and what counts as such: names only if they leave anything."""
        boiler = self.boiler()
        got = self.blocks(boiler)
        if not got and any(self.named) and (more := self.blocks(self.by_tag)):
            return more, self.by_tag
        return got, boiler


def votes(html: str) -> tuple[list[tuple[int, float]], list[tuple[int, str]], list[bool]]:
    """Scores of a page's containers, its blocks, and which of its elements are boilerplate."""
    page = Page(html)
    found, boiler = page.whole()
    return page.scores(boiler), found, boiler


def main_text(html: str | None, path: int | None = None) -> str:
    """Main text along the agreed path, else along the page's own best container, else of the whole page.

    The agreed path is left where it holds less than a quarter of the page's
    best container.
    """
    if not html:
        return ""
    page = Page(html)
    found, boiler = page.whole()
    if not found:
        return ""
    best = page.scores(boiler)
    blocks = page.at(best[0][0], found) if best else [b for _, b in found]
    if path is not None and best and path != best[0][0]:
        agreed = page.at(path, found)
        blocks = agreed if 4 * sum(map(len, agreed)) >= sum(map(len, blocks)) else blocks
    return " ".join(blocks or [b for _, b in found])


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Add ``text`` and ``n_chars`` (code points) to every row of ``pages``.

    Null and empty pages have an empty text; pages with a null url share one
    nameless host. Repeated rows vote and are extracted each. An empty table
    gives an empty result. Columns named ``text`` or ``n_chars``, in any case,
    are replaced; all others are kept.
    """
    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    columns = [F.col(f"`{c}`") for c in kept]
    hosted = pages.select(_host(url).alias("__host"), *columns)

    def vote(batches):
        for batch in batches:
            host, path, share = [], [], []
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                for p, s in votes(page.as_py() or "")[0]:
                    host.append(h)
                    path.append(p)
                    share.append(round(s * 1_000_000))
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.int64()), pa.array(share, pa.int64())], names=["host", "path", "share"])

    ballots = hosted.select("__host", html).mapInArrow(vote, "host string, path long, share long")
    sums = ballots.groupBy("host", "path").agg(F.sum("share").alias("votes"))
    best = stash(sums.groupBy(F.col("host").alias("__host")).agg(F.max_by("path", F.struct("votes", "path")).alias("__path")))
    joined = hosted.join(best, "__host", "left").select(*columns, "__path")
    schema = pages.select(*columns).schema.add("text", "string").add("n_chars", "long")
    at = kept.index(html)

    def read(batches):
        for batch in batches:
            text = [main_text(page.as_py(), path) for page, path in zip(batch.column(at), batch.column(len(kept)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*kept, "text", "n_chars"])

    return joined.mapInArrow(read, schema)
