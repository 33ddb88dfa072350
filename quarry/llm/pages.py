"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text with their place in the tree. A logistic
classifier, trained here on pages made by the rules in `sample_pages`, gives
each block a cost for either label; these are the capacities from and to the
terminals. Blocks that follow one another, and those next in the same parent,
are joined by edges whose capacity falls with their distance in the tree. The
minimum cut then parts content from boilerplate.

Markup is read after HTML's rules for tokens: a tag's name goes up to white
space, `/` or `>`, an attribute's value may be unquoted, only script, style and
the like have content that is no markup, and an svg may close itself. What
names boilerplate counts on whole words of class, id and role, and not on an
element that holds the main part.

Defined cases: null and empty pages, and those without content, give the empty
text; an empty table gives an empty result; unclosed elements and comments end
where HTML lets them, buttons and drawings with the next block at the latest, a
tag that the page ends in is dropped; a block at equal cost of both labels
(a tie) is boilerplate; very long pages are read whole, in time that grows with
their blocks; repeated rows, also those with one page_id and several texts, are
answered each; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .kernels import slices

#: Where markup starts, as HTML's tokenizer has it; any other `<` is text.
_MARK = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*)|/)")
_ATTRIBUTES = re.compile(r"((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)?)*+)>")
_COMMENT_END = re.compile(r"(?<=<!)--!?>|(?<=<!-)-!?>|--!?>")
_PAIR = re.compile(r"([^\s/=][^\s/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'][^\s]*)))?")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

# HTML's elements by how they are read and how they break text, and what names say.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
FOREIGN = frozenset("svg math".split())
GONE = frozenset("button select datalist svg math object audio video canvas meter progress".split())
GONE_BLOCKS = frozenset("template noscript head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
AWAY = frozenset("nav header footer aside form menu dialog fieldset search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
AWAY_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising advertorial sponsor sponsors sponsored promo promos promotion banner banners sidebar sidebars nav navs navbar navigation navlinks menu menus submenu"
    " breadcrumb breadcrumbs foot footer footers masthead header comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe"
    " subscription signup login share shares sharing sharebar social related recommend recommended recommendations widget widgets pagination pager toolbar copyright legal disclaimer search searchbox complementary contentinfo"
    " tags taglist skip skiplink".split()
)
#: A name that begins with one of these says what the page has, not what the element is.
ABOUT_PAGE = frozenset("no not has have with without is hide hidden show js page body layout single theme site template type admin logged custom".split())
#: These parts of a name say how its element looks or is fixed, and `header` with one of the second kind is a heading inside the article.
LOOKS = frozenset("fixed sticky visible enabled disabled open closed collapsed expanded active on off".split())
ARTICLE_PARTS = frozenset("article post entry story content section chapter page".split())
CONTENT_NAMES = frozenset("article articlebody content main post entry story text bodytext articletext postbody".split())

FEATURES = 9
EDGE = 0.8
LIMIT = 6.0


def _is_away(name: str) -> bool:
    """Whether a class, id or role names boilerplate: `site-footer` does, `no-sidebar`, `header-fixed` and `entry-header` don't."""
    parts = _PARTS.findall(_HUMP.sub("-", name).lower())
    if not parts or (len(parts) > 1 and (parts[0] in ABOUT_PAGE and not (parts[0] in ("site", "page") and len(parts) == 2) or LOOKS.intersection(parts))):
        return False
    found = [x for x in parts if x in AWAY_NAMES]
    if found == ["header"] and len(parts) > 1 and ARTICLE_PARTS.intersection(parts):
        return False
    return bool(found) or "side-bar" in name or "".join(parts) in AWAY_NAMES


@lru_cache(4096)
def _named(names: str) -> tuple[bool, bool]:
    """(away, content) of the words of class, id and role."""
    words = names.split()
    return any(map(_is_away, words)), any(CONTENT_NAMES.intersection(_PARTS.findall(_HUMP.sub("-", w).lower())) and not _is_away(w) for w in words)


class Node:
    """An element. own: 0, or why it may be boilerplate: 1 by its name, 2 as a form, 3 by its element, 4 surely (not shown)."""

    __slots__ = ("content", "depth", "holds", "link", "own", "parent", "settled", "tag", "gone")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.settled, self.holds = tag, parent, None, 0
        if parent is None:
            self.depth, self.own, self.content, self.link, self.gone = 0, 0, 0, False, False
            return
        names, own, main = "", 0, tag == "main"
        if attributes:
            for m in _PAIR.finditer(attributes):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key in ("class", "id", "role"):
                    names += " " + value
                    main |= key == "role" and value.strip().lower() == "main"
                elif key == "itemprop" and value.strip().lower() == "articlebody":
                    main = True
                elif key == "hidden" and value.lower() != "until-found" or key == "style" and _HIDING.search(value) or key == "aria-hidden" and value.lower() == "true":
                    own = 4
        away, content = _named(names) if names else (False, False)
        self.depth = parent.depth + 1
        if tag in ("html", "body") or main:
            self.own = own if main else 0
        else:
            self.own = own or (2 if tag == "form" else 3 if tag in AWAY else int(away))
        self.content = 2 if tag == "article" or main or parent.content == 2 else int(content) or parent.content
        self.link = parent.link or tag == "a"
        self.gone = parent.gone or tag in GONE or tag in GONE_BLOCKS
        kind = 4 if main else 2 if tag == "article" else 1 if tag == "h1" else 0
        if kind:
            node = parent
            while node is not None and node.holds & kind == 0:
                node.holds |= kind
                node = node.parent

    @property
    def away(self) -> bool:
        """Whether it stands in boilerplate. What holds the main part, or with a mere name or as a form the article or its heading, is a wrapper; `main` is none of it. A header inside the article is a part of it."""
        todo, node = [], self
        while node is not None and node.settled is None:
            todo.append(node)
            node = node.parent
        for node in reversed(todo):
            own = node.own
            if own in (1, 2, 3) and (node.holds & 4 or own < 3 and node.holds):
                own = 0
            elif own == 3 and node.tag == "header" and node.parent.content == 2:
                own = 0
            node.settled = bool(own) or (node.parent is not None and node.parent.settled)
        return self.settled


class Block:
    __slots__ = ("linked", "node", "text")

    def __init__(self, text: str, node: Node, linked: int):
        self.text, self.node, self.linked = text, node, linked


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): `text`, `open`, `close` and `raw`, an element whose content is no markup and was skipped. Comments are left out."""
    at, n = 0, len(html)
    text = 0  # where the text that is not given yet starts
    while True:
        m = _MARK.search(html, at)
        if m is None:
            break
        if m.start() > text:
            yield "text", html[text : m.start()], ""
        name = m[2]
        if name is None:
            if m[0] == "<!--":
                end = _COMMENT_END.search(html, m.start() + 2)
                at = end.end() if end else n
            else:
                end = html.find(">", m.end())
                at = end + 1 if end >= 0 else n
            text = at
            continue
        end = _ATTRIBUTES.match(html, m.end())
        if end is None:  # the page ends inside a tag
            text = at = n
            break
        text = at = end.end()
        name = name.lower()
        if m[1]:
            yield "close", name, ""
        elif name in RAW:
            close = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
            text = at = close.end() if close else n
            yield "raw", name, ""
        else:
            yield "open", name, end[1]
    if text < n:
        yield "text", html[text:], ""


def blocks(html: str | None) -> list[Block]:
    """The blocks of text of a page, in order."""
    if not html:
        return []
    here = root = Node("html", None)
    out: list[Block] = []
    parts: list[str] = []
    linked, owner = 0, here

    def end() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, owner, linked))
        parts.clear()
        linked = 0

    for kind, name, attributes in tokens(html):
        if kind == "text":
            if not here.gone:
                text = unescape(name) if "&" in name else name
                parts.append(text)
                if here.link:
                    linked += len(text)
        elif kind == "raw":
            if name in ("textarea", "iframe"):
                parts.append(" ")
        elif kind == "close":
            if name in INLINE or name in GONE or (here.gone and here.tag not in GONE_BLOCKS and name not in CLOSES_P and name not in ("body", "html")):
                node = here
                while node.tag != name and node.parent is not None and (node.tag in INLINE or node.gone and node.tag not in GONE_BLOCKS):
                    node = node.parent
                if node.tag == name and node.parent is not None:
                    here = node.parent
                if name == "br" or name in GONE:
                    parts.append(" ")
                continue
            end()
            node = here
            while node is not None and node.tag != name:
                node = node.parent
            if node is not None and node.parent is not None:
                here = node.parent
            owner = here
        elif here.gone and name not in CLOSES_P and here.tag not in GONE_BLOCKS:
            # inside what isn't text, up to its end or the next block
            if name not in VOID and not attributes.endswith("/") and name in GONE | {"g", "option", "optgroup", "text", "a", "span"}:
                here = Node(name, here, attributes)
        elif name in GONE:
            parts.append(" ")
            if not (name in FOREIGN and attributes.endswith("/")):
                here = Node(name, here, attributes)
        elif name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name not in VOID:
                here = Node(name, here, attributes)
        else:
            end()
            while (here.tag in INLINE or here.gone and here.tag not in GONE_BLOCKS) and here.parent is not None:
                here = here.parent
            if here.tag == "head" and name not in ("meta", "link", "base", "template", "noscript"):
                here = here.parent  # the body's first element ends an open head
            if name in ("html", "body") and here is root:
                here = root = Node(name, here, attributes)
                owner = here
                continue
            if name in CLOSES_P and here.tag == "p":
                here = here.parent
            elif name in SAME:
                node = here
                while node.parent is not None and node.tag not in SAME[name] and node.tag not in SCOPES.get(name, ()):
                    node = node.parent
                if node.tag in SAME[name] and node.parent is not None:
                    here = node.parent
                    if name == "tr" and here.tag == "tr":
                        here = here.parent
            if name not in VOID:
                here = Node(name, here, attributes)
            owner = here
    end()
    return out


def features(b: Block) -> list[float]:
    n = b.node
    words = b.text.count(" ") + 1
    return [
        1.0,
        float(n.content == 2),
        float(n.content == 1),
        float(n.away),
        min(1.0, b.linked / max(1, len(b.text))),
        min(1.0, math.log1p(words) / 5),
        float(n.tag in HEADINGS),
        float(n.tag == "p"),
        min(1.0, 10 * sum(map(b.text.count, ".,;!?")) / len(b.text)),
    ]


def distance(a: Node, b: Node) -> int:
    """Steps between two places in the tree."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
        if a is None or b is None:
            break
    return n


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """(i, j, capacity) between blocks that follow one another, and those next in the same parent."""
    out = [(i, i + 1, EDGE / (1 + distance(found[i].node, found[i + 1].node))) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        parent = id(b.node.parent)
        if parent in last and last[parent] < i - 1:
            out.append((last[parent], i, EDGE / 3))
        last[parent] = i
    return out


def minimum_cut(gain: list[float], joined: list[tuple[int, int, float]]) -> list[bool]:
    """True on the source's side. gain[i] > 0: capacity from the source; < 0: to the sink. By Dinic's algorithm."""
    n = len(gain)
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, forward: float, backward: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forward)
        out[b].append(len(to))
        to.append(a)
        room.append(backward)

    for i, g in enumerate(gain):
        if g > 0:
            link(s, i, g, 0.0)
        elif g < 0:
            link(i, t, -g, 0.0)
    for i, j, w in joined:
        link(i, j, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        todo = deque([s])
        while todo:
            a = todo.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    todo.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        following = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(room[e] for e in path)
                cut = 0
                for k, e in enumerate(path):
                    room[e] -= flow
                    room[e ^ 1] += flow
                    if room[e] <= 1e-9:
                        cut = k
                        break
                for e in path[cut + 1 :]:
                    room[e] -= flow
                    room[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            while following[a] < len(out[a]):
                e = out[a][following[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                following[a] += 1
            else:
                if not path:
                    break
                e = path.pop()
                a = to[e ^ 1]
                following[a] += 1
                continue
            path.append(e)
            a = to[e]


def sample_pages(n: int = 240, seed: int = 3) -> list[str]:
    """Pages made by rule; words of content start with c, those of boilerplate with b."""
    r = random.Random(seed)

    def words(first: str, a: int, b: int) -> str:
        k = r.randint(a, b)
        return " ".join(first + "".join(r.choices("aeiouthnrs", k=r.randint(1, 8))) + ("," if r.random() < 0.08 else "." if r.random() < 0.08 else "") for _ in range(k))

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{words("b", 1, 3)}</a></li>' for _ in range(k)) + "</ul>"

    pages = []
    for _ in range(n):
        away = [
            f"<nav>{links(r.randint(2, 9))}</nav>",
            f"<header><div>{words('b', 1, 8)}</div>{links(3)}</header>",
            f'<div class="{r.choice(["ad", "ads", "sidebar", "cookie-notice", "related", "newsletter", "share"])}">{r.choice(["", "<p>"])}{words("b", 2, 40)}</div>',
            f"<aside>{links(4)}<p>{words('b', 3, 30)}</p></aside>",
            f"<form><label>{words('b', 1, 4)}</label><input></form>",
            f"<footer>{words('b', 2, 14)}</footer>",
        ]
        r.shuffle(away)
        cut = r.randint(0, len(away))
        text = [f"<h1>{words('c', 2, 10)}</h1>"]
        for _ in range(r.randint(1, 9)):
            text.append(r.choice([f"<p>{words('c', 1, 120)}</p>", f"<p>{words('c', 10, 90)} <a href='/y'>{words('c', 1, 3)}</a> {words('c', 1, 20)}</p>", f"<h2>{words('c', 1, 6)}</h2>", f"<ul><li>{words('c', 2, 20)}<li>{words('c', 2, 20)}</ul>", f"<blockquote>{words('c', 5, 40)}</blockquote>"]))
            if r.random() < 0.1:
                text.append(f'<div class="ad">{words("b", 2, 30)}</div>')
        if r.random() < 0.3:
            text.append(f'<section class="comments"><h2>{words("b", 1, 3)}</h2>' + "".join(f"<p>{words('b', 3, 50)}</p>" for _ in range(3)) + "</section>")
        box = r.choice(["article", "main", "div class=content", "div id=main", "div"])
        pages.append(f"<html><body>{''.join(away[:cut])}<{box}>{''.join(text)}</{box.split()[0]}>{''.join(away[cut:])}</body></html>")
    return pages


@lru_cache(1)
def trained() -> tuple[float, ...]:
    """Weights of the logistic classifier."""
    rows = [(features(b), b.text[0] == "c") for page in sample_pages() for b in blocks(page)]
    x, y = np.array([f for f, _ in rows]), np.array([t for _, t in rows], float)
    w = np.zeros(FEATURES)
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(FEATURES)
        w -= np.linalg.solve(h, x.T @ (p - y) + w)
    return tuple(w.tolist())


def main_text(html: str | None, weights: tuple[float, ...]) -> str:
    found = blocks(html)
    if not found:
        return ""
    gain = [max(-LIMIT, min(LIMIT, sum(map(float.__mul__, weights, features(b))))) for b in found]
    side = minimum_cut(gain, edges(found))
    return "\n".join(b.text for b, ok in zip(found, side, strict=True) if ok)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    weights = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(x.as_py(), weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
