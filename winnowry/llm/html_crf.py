"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, runs of text between block-level tags.  Features of a block
are its ancestors' tags and class names and its text's shape; a two-label chain (main text
or not), trained on labelled pages by its exact gradient, is decoded by Viterbi.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .packed import with_columns

# HTML element classes.
_RAW = "script style noscript template textarea iframe title xmp noembed noframes"
#: Elements whose text is left out; markup inside is read as elsewhere.
_SKIPPED = frozenset("head object svg math select canvas audio video datalist".split())
#: A start tag of _BREAKOUT ends an open one of these.
_ENDED = ("head", "select")
_BREAKOUT = frozenset(
    "article aside blockquote body dd div dl dt footer form h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table ul".split()
)
_RAW_SET = frozenset(_RAW.split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br".split()
)
_CLOSES = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",),
    "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("td", "th", "tr", "thead"),
}
_NONE: frozenset[str] = frozenset()
# what keeps an open element from being closed by a new one further in
_SCOPE = {"li": frozenset({"ul", "ol"}), "td": frozenset({"table"}), "th": frozenset({"table"}), "tr": frozenset({"table"})}
# A quote begins a value only after an equals sign; elsewhere it is a character like others.
_REST = r"""(?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(_RAW.split())})(?=[\s/>]){_REST}>.*?</(?P=raw)(?=[\s/>])[^>]*>"
    r"|<(?P<open>script|style)(?=[\s/>]).*\Z"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>{_REST})>"
    r"|<[!?/][^>]*>?|<[a-zA-Z][^>]*\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?""")
_PLACE = frozenset({"class", "id", "role", "aria-label"})
#: Elements that hold the main text; a first one of them tells which class words lie around the text and which inside it.
_CONTENT = frozenset({"article", "main"})
#: Attributes that take an element off the page, but not the page itself.
_OFF = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PAGE = frozenset({"html", "body", "main", "article"})
# Kinds of class words that name something else than the text.
_KINDS = {
    "ad": "ad ads advert adverts advertisement advertisements advertising advertorial adsense adslot sponsor sponsored sponsors promo promoted promotion banner taboola outbrain",
    "comments": "comment comments commentlist commenters respond response responses reply replies disqus",
    "social": "share sharing social follow followers",
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager",
    "side": "sidebar aside rail related recommended recommendations trending popular widget widgets teaser teasers",
    "notice": "cookie cookies consent gdpr notice popup modal overlay dialog alertdialog lightbox toast paywall",
    "form": "form newsletter subscribe subscription signup login signin register search searchform",
    "foot": "footer copyright legal",
}
_KIND = {w: k for k, v in _KINDS.items() for w in v.split()}
_TAG_KIND = {"nav": "nav", "aside": "side", "footer": "foot", "form": "form"}
_NAME = re.compile(r"[a-z]+")


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]  # ancestors' tags
    names: tuple[str, ...]  # words of ancestors' class, id and role
    linked: int  # characters inside links
    inside: int = 0  # how many of names come from above the text's own element


def leaf_blocks(page: str | None) -> list[Block]:
    """Leaf blocks with text, in page order; scripts, styles, comments, the head, dialogs and hidden elements are left out.

    An end tag may be missing: an unclosed script or style holds the rest of the page, any other raw or skipped
    element without an end tag is taken as empty, and a head ends where the first element of a body begins.
    """
    out: list[Block] = []
    closers: dict[str, int] = {}
    hidden = 0  # open skipped elements
    # each entry: tag, block-level tags down to here, class words down to here, inside a link, words above the text's own element, left out
    stack: list[tuple[str, tuple[str, ...], tuple[str, ...], bool, int, bool]] = [("", (), (), False, 0, False)]
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(text, stack[-1][1], stack[-1][2], linked, stack[-1][4]))
            parts.clear()
            linked = 0

    def pop_to(tag: str) -> None:
        nonlocal hidden
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                if stack[-1][1] is not stack[i - 1][1]:
                    flush()
                if hidden:
                    hidden -= sum(x[5] for x in stack[i:])
                del stack[i:]
                return

    def closes(tag: str) -> bool:
        """Whether an end tag of this name stands further on."""
        if closers.get(tag, -1) < at:
            m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            closers[tag] = m.start() if m else len(page)
        return closers[tag] < len(page)

    def gone(tag: str, rest: str) -> bool:
        """Whether an element is not shown: a dialog that is not open, or one with an attribute that hides it."""
        if tag == "dialog":
            away = not any(k.lower() == "open" for k, _ in _ATTR.findall(rest))
        elif tag in _PAGE or "hidden" not in rest and "display" not in rest and "dialog" not in rest and "HIDDEN" not in rest:
            return False
        else:
            found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(rest)}
            away = "hidden" in found or bool(_OFF.search(found.get("style", ""))) or found.get("role") in ("dialog", "alertdialog")
        return away and (tag in _CLOSES or closes(tag))

    at, page = 0, page or ""
    for m in _TOKEN.finditer(page):
        if m.start() > at and not hidden:
            parts.append(page[at : m.start()])
            if stack[-1][3]:
                linked += m.start() - at
        at = m.end()
        raw, close, tag, rest = m.group("raw", "close", "tag", "rest")
        if tag is None:
            if raw:
                parts.append(" ")
            continue
        tag = tag.lower()
        if hidden and not close and tag in _BREAKOUT:
            for t in _ENDED:
                if any(x[0] == t for x in stack):
                    pop_to(t)
        if close:
            pop_to(tag)
        elif tag in _SKIPPED:
            if tag in _ENDED or rest[-1:] != "/" and closes(tag):
                _, path, names, link, inside, _ = stack[-1]
                stack.append((tag, path, names, link, inside, True))
                hidden += 1
        elif tag in _RAW_SET or hidden and rest[-1:] == "/":
            continue  # no end tag
        elif tag in _INLINE or "-" in tag:
            if tag == "br":
                parts.append(" ")
            elif tag not in _VOID:
                _, path, names, link, inside, _ = stack[-1]
                off = gone(tag, rest)
                stack.append((tag, path, names, link or tag == "a", inside, off))
                hidden += off
        else:
            flush()
            if tag in _VOID:
                continue
            for t in _CLOSES.get(tag, ("p",)):
                path = stack[-1][1]
                if t in path and not _SCOPE.get(t, _NONE) & set(path[len(path) - path[::-1].index(t) :]):
                    pop_to(t)
            _, path, names, link, inside, _ = stack[-1]
            if "=" in rest:
                words: list[str] = []
                for k, v in _ATTR.findall(rest):
                    if k.lower() in _PLACE:
                        words += _NAME.findall(v.lower())
                names += tuple(words)
            if tag in ("html", "body") or tag in _CONTENT and not _CONTENT & set(path):
                inside = len(names)
            off = gone(tag, rest)
            stack.append((tag, (*path, tag), names, link, inside, off))
            hidden += off
    if at < len(page) and not hidden:
        parts.append(page[at:])
    flush()
    return out


def place_features(path: tuple[str, ...], names: tuple[str, ...], inside: int = 0) -> list[str]:
    """Features of where a block is: its own tag, its ancestors' tags and class words, and the kinds of class words inside the text's own element."""
    at = next((i for i, x in enumerate(path) if x in _CONTENT), None)
    # a form around a whole page says nothing about its blocks
    below = path[at:] if at is not None else tuple(x for x in path if x != "form")
    kinds = {_KIND[w] for w in names[inside:] if w in _KIND} | {_TAG_KIND[x] for x in below if x in _TAG_KIND}
    out = [f"own={path[-1] if path else ''}", *(f"tag={t}" for t in sorted(set(path))), *(f"name={t}" for t in sorted(set(names)))]
    return out + [f"kind={k}" for k in sorted(kinds)] + (["named"] if kinds else [])


def text_features(b: Block, first: bool, last: bool) -> list[str]:
    """Features of a block's text."""
    low = b.text.lower()
    out = ["bias", f"words={min((b.text.count(' ') + 1).bit_length(), 7)}", f"links={min(4, 5 * b.linked // max(1, len(b.text)))}"]
    if b.text[-1] in ".!?…\"»”":
        out.append("stop")
    if "©" in low or "copyright" in low:
        out.append("copyright")
    if "cookie" in low:
        out.append("cookie")
    if first:
        out.append("first")
    if last:
        out.append("last")
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """Ancestor-tag and text features of each block."""
    n = len(blocks) - 1
    return [place_features(b.path, b.names, b.inside) + text_features(b, i == 0, i == n) for i, b in enumerate(blocks)]


class Chain:
    """Weights of the two-label chain: label 1 is main text."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray) -> None:
        self.index, self.emit, self.move = index, emit, move
        self._known: dict[tuple, tuple[float, float]] = {}

    def _sum(self, names: list[str]) -> tuple[float, float]:
        at = [self.index[f] for f in names if f in self.index]
        x, y = self.emit[at].sum(axis=0)
        return float(x), float(y)

    def scores(self, blocks: list[Block]) -> list[tuple[float, float]]:
        """Emission scores of each block; sums for a place or a kind of text are kept."""
        known, out, n = self._known, [], len(blocks) - 1
        if len(known) > 50_000:
            known.clear()
        for i, b in enumerate(blocks):
            where = (b.path, b.names, b.inside)
            place = known.get(where)
            if place is None:
                place = known[where] = self._sum(place_features(*where))
            kind = tuple(text_features(b, i == 0, i == n))
            text = known.get(kind)
            if text is None:
                text = known[kind] = self._sum(list(kind))
            out.append((place[0] + text[0], place[1] + text[1]))
        return out

    def viterbi(self, s: list[tuple[float, float]]) -> list[int]:
        """The best label sequence; of equal ones that with fewer main blocks at the end."""
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b, back = 0.0, 0.0, []
        for i, (x, y) in enumerate(s):
            if i:
                p, q = a + m00 >= b + m10, a + m01 >= b + m11
                a, b = (a + m00 if p else b + m10), (a + m01 if q else b + m11)
                back.append((0 if p else 1, 0 if q else 1))
            a, b = a + x, b + y
        path = [int(b > a)]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]


def train(pages: list[tuple[str, list[int]]], rounds: int = 200, rate: float = 0.5, l2: float = 1e-3) -> Chain:
    """Fits the chain to pages and the labels of their leaf blocks by the gradient of the log-likelihood."""
    data = [(features(leaf_blocks(p)), y) for p, y in pages]
    index = {f: i for i, f in enumerate(sorted({f for fs, _ in data for x in fs for f in x}))}
    rows = [[index[f] for f in x] for fs, _ in data for x in fs]
    flat = np.concatenate([np.array(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    size = np.array([len(fs) for fs, _ in data])
    start = np.cumsum(size) - size
    top = size.max()
    pos = start[:, None] + np.arange(top)[None, :]
    live = np.arange(top)[None, :] < size[:, None]
    pos[~live] = 0
    gold = np.concatenate([np.array(y) for _, y in data])
    emit, move = np.zeros((len(index), 2)), np.zeros((2, 2))
    ge, gm = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    y = gold[pos]
    both = live[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    for _ in range(rounds):
        s = np.zeros((len(rows), 2))
        np.add.at(s, owner, emit[flat])
        e = s[pos]
        fwd = np.zeros((len(data), top, 2))
        bwd = np.zeros_like(fwd)
        fwd[:, 0] = e[:, 0]
        for t in range(1, top):
            step = np.logaddexp.reduce(fwd[:, t - 1, :, None] + move[None], axis=1) + e[:, t]
            fwd[:, t] = np.where(live[:, t, None], step, fwd[:, t - 1])
        for t in range(top - 2, -1, -1):
            step = np.logaddexp.reduce(move[None] + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
            bwd[:, t] = np.where(live[:, t + 1, None], step, 0)
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        p = np.exp(fwd + bwd - z[:, None, None])
        pair = np.exp(fwd[:, :-1, :, None] + move[None, None] + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
        dm = seen - (pair * both[:, :, None, None]).sum(axis=(0, 1))
        d = np.eye(2)[gold]
        d[pos[live]] -= p[live]
        de = np.zeros_like(emit)
        np.add.at(de, flat, d[owner])
        de, dm = de / len(data) - l2 * emit, dm / len(data) - l2 * move
        ge += de**2
        gm += dm**2
        emit += rate * de / np.sqrt(ge)
        move += rate * dm / np.sqrt(gm)
    return Chain(index, emit, move)


def labelled_pages(count: int = 400, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages of many layouts with the label of every leaf block, made by rule from a seed."""
    r = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzéüñ"))
    pick = lambda *xs: xs[int(r.integers(len(xs)))]
    word = lambda: "".join(r.choice(letters, int(r.integers(2, 10))))
    words = lambda a, b: " ".join(word() for _ in range(int(r.integers(a, b))))
    out = []
    for _ in range(count):
        body: list[str] = []
        y: list[int] = []

        def add(tag: str, text: str, label: int, inner: str = "{}", body: list[str] = body, y: list[int] = y) -> None:
            name, _, attrs = tag.partition(" ")
            end = "" if name in ("p", "li") and r.random() < 0.15 else f"</{name}>"
            body.append(f"<{tag}>{inner.format(text)}{end}")
            y.append(label)

        def wrap(tag: str, fill, body: list[str] = body) -> None:
            body.append(f"<{tag}>")
            fill()
            body.append(f"</{tag.split()[0]}>")

        def menu() -> None:
            body.append("<ul>")
            for _ in range(int(r.integers(2, 8))):
                add("li", words(1, 3), 0, '<a href="/x">{}</a>')
            body.append("</ul>")

        def aside() -> None:
            add(pick("h3", "h2", "p"), words(1, 4), 0)
            menu()

        def comments() -> None:
            add(pick("h3", "h2"), words(1, 3), 0)
            for _ in range(int(r.integers(1, 6))):
                add(pick("p", 'div class="comment-body"', "li"), words(3, 40) + pick(".", "!", ""), 0)

        def junk(text: str, own: str) -> None:
            kind = pick(*_KINDS)
            attr = pick("class", "class", "id") + '="' + pick("", "", "", "main-", "inline-", "article-") + pick(*_KINDS[kind].split()) + pick("", "", "", "-box", "-inner", "-1") + '"'
            # an article in an article is a comment or the like; the first one of a page is the text's own element
            tag = pick(f"div {attr}", f"div {attr}", f"section {attr}", f"ul {attr}", f"article {attr}" if own in _CONTENT else f"div {attr}", f"aside {attr}", "aside", "form", "nav", 'div role="navigation"', 'div role="complementary"')
            form = r.random()
            if form < 0.2 and " " in tag:
                add(tag, text, 0)
            elif form < 0.3:
                wrap(tag, lambda: wrap("div", lambda: add("p", text, 0)))
            else:
                wrap(tag, lambda: [add(pick("p", "p", "p", "div", "li", "h3"), text if i == 0 else words(2, 30) + pick(".", ""), 0) for i in range(pick(1, 1, 1, 2, 3))])

        def article(own: str) -> None:
            if r.random() < 0.8:
                add(pick("h1", "h1", "h2"), words(1, 12) + pick("", "", "."), 1)
            for _ in range(int(r.integers(1, 14))):
                kind = r.random()
                if kind < 0.75:
                    add("p", words(1, pick(4, 20, 80)) + pick(".", ".", ".", "", "!"), 1, pick("{}", "{}", "<b>{}", "<b>{}</b><br>", "{}<br>"))
                elif kind < 0.83:
                    add(pick("h2", "h3"), words(1, 8), 1)
                elif kind < 0.9:
                    body.append("<ul>")
                    for _ in range(int(r.integers(1, 5))):
                        add("li", words(2, 20) + pick(".", ""), 1)
                    body.append("</ul>")
                elif kind < 0.95:
                    add("blockquote", words(4, 40) + ".", 1)
                else:
                    add("p", words(3, 20) + ".", 1, '{} <a href="/y">' + words(1, 4) + "</a>")
                if r.random() < 0.04:
                    wrap(pick("div", 'div class="text"', 'div class="paragraph"', 'section class="part"', 'div class="lead"', 'div id="intro"'), lambda: add("p", words(3, 40) + pick(".", ".", ""), 1))
                if r.random() < 0.08:
                    junk(words(2, pick(8, 15, 50)) + pick(".", ".", "", "!"), own)
            if r.random() < 0.1:
                wrap(pick('div class="related"', 'div class="tags"', 'nav'), aside)
            if r.random() < 0.15:
                wrap(pick('div class="comments"', 'section id="comments"', 'div class="reader-comments"', 'div id="comment-list"', 'ol class="commentlist"'), comments)
            if r.random() < 0.15:
                junk(words(8, 60) + ".", own)

        if r.random() < 0.5:
            wrap(pick("header", 'div class="header"', 'div id="top-header"'), lambda: add(pick("h1", "p", "div"), words(1, 4), 0))
        if r.random() < 0.85:
            wrap(pick("nav", "nav", 'div class="nav"', 'div class="menu"', 'div role="navigation"'), menu)
        if r.random() < 0.25:
            add(pick('div class="cookie-notice"', 'div class="notice"', 'div id="cookie-banner"', 'div class="consent"'), words(3, 20) + pick(" cookies.", "."), 0)
        if r.random() < 0.5:
            add(pick('div class="ad"', 'div class="advert"', 'div class="ads"', 'div class="sponsored"', 'div class="promo"'), words(2, 20) + pick(".", ""), 0)
        if r.random() < 0.2:
            wrap(pick("aside", 'div class="sidebar"'), aside)
        own = pick("article", "article", "article", "main", 'div class="content"', 'div class="article-body"', 'div id="main"', 'div class="post"')
        wrap(own, lambda own=own: article(own))
        if r.random() < 0.35:
            wrap(pick("aside", 'div class="sidebar"', 'div class="related"', 'div id="sidebar"'), aside)
        if r.random() < 0.3:
            wrap(pick('div class="comments"', 'section id="comments"', 'div class="reader-comments"', 'ol class="commentlist"'), comments)
        if r.random() < 0.25:
            wrap(pick('form action="/s"', 'form class="newsletter"'), lambda: add(pick("p", "label", "button"), words(1, 8), 0))
        if r.random() < 0.85:
            add(pick("footer", "footer", 'div class="footer"', 'div id="footer"'), pick("© ", "&copy; ", "") + words(1, 16) + pick(".", ""), 0)
        page = "<!DOCTYPE html><html><head><title>t</title></head><body>" + "".join(body) + pick("</body></html>", "")
        if len(leaf_blocks(page)) == len(y):  # a tag left open may join two blocks of the plan; such pages have no sure labels
            out.append((page, y))
    return out


@functools.lru_cache(maxsize=1)
def default_chain() -> Chain:
    return train(labelled_pages())


def main_text(page: str | None, chain: Chain) -> str:
    """Blocks labelled main text, joined by an empty line; empty for a page without any."""
    blocks = leaf_blocks(page)
    if not blocks:
        return ""
    labels = chain.viterbi(chain.scores(blocks))
    return "\n\n".join(b.text for b, v in zip(blocks, labels, strict=True) if v)


def extract(pages: DataFrame, html_col: str = "html", chain: Chain | None = None) -> DataFrame:
    """Adds text (the main text) and n_chars (its code points) to pages.

    Defined cases: null and empty html give empty text; markup that is cut off is read as far
    as it goes; very long pages are read whole; other columns pass through, and input columns
    named like the added ones are replaced; no rows give no rows.
    """
    chain = chain or default_chain()

    def fill(column: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
        for at in range(0, len(column), 200):
            texts = [main_text(p, chain) for p in column.slice(at, 200).to_pylist()]
            yield len(texts), [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return with_columns(pages, html_col, "text string, n_chars long", fill)
