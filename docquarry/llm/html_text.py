"""Main text of HTML pages by tag-path ratios.

A page is read once into blocks: stretches of text between the edges of block elements. For every path
of tags from the root to a block, text length outside links and punctuation marks are added up and
divided by the number of blocks on the path. Both ratios are laid along the page in block order,
smoothed with a Gaussian, and fused by multiplication; blocks whose fused ratio reaches the threshold
(the standard deviation over the page, the mean at most) are content. The content element is the
deepest one that holds nearly all text of content blocks, or the article around it; its blocks, content
blocks elsewhere and headings right before them are the text, so that headings and short paragraphs of
an article come along. Blocks in elements that by their tag or role are
navigation, headers, footers, asides, controls or scripts never count. Forms, and words of class and id that name such
things (comments, adverts, notices), are only a mark, which is weighed against the text: a marked element
counts after all when its ratio is far above that of the text with fewer marks, or when it holds most of
the page's text by ratio and no article, main element or heading is outside. Inside an article, words
that sections are also called by count for little.

Defined results: null or empty html gives an empty text; unclosed elements end with their parent, an
unfinished tag at the end is left out; white space inside a block becomes one space; repeated rows are
read each; other columns do not matter. Pages are read whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
RAW = frozenset("script style title textarea xmp noembed noframes iframe".split())
# An opening tag of the key ends an open element of these tags.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"},
}
SCOPES = frozenset("ul ol dl table select article section div main body html td th blockquote aside nav header footer form".split())
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre "
    "section table ul".split()
)

# Tags, roles and words of class and id attributes that mark what is not the article.
ASIDE_TAGS = frozenset(
    "head script style noscript template nav footer aside button select option textarea input iframe object svg canvas menu dialog "
    "audio video".split()
)
# Marked like words of class and id: a whole page may lie in one form.
FORM_TAGS = frozenset("form label fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent gdpr notice notification alert popup modal "
    "overlay newsletter subscribe subscription signup login comment comments respond reply replies disqus discussion related "
    "recommended share sharing social pagination pager toolbar copyright legal disclaimer".split()
)
# Words that sections of an article are called by as well.
SECTION_WORDS = frozenset(
    "notice notification alert menu navigation promotion banner consent subscription discussion related social legal disclaimer copyright "
    "overlay widget".split()
)
MARKS = re.compile(r"[.,;:!?…。，、；：！？]")

# Attributes as browsers read them: a quote opens a value only after the "=" of a name; elsewhere it is a character like others,
# and the tag ends at the next ">". Only quotes in place of a name with "<" right behind them leave the tag unfinished.
_ATTRIBUTES = r"""(?:[\s/]+|(?!["']+<)[^\s/>][^\s/>=]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*|(?=>)))?)*+"""
_TOKEN = re.compile(
    rf"""<!--(?P<comment>.*?)(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>{_ATTRIBUTES})>|<[!?/][^>]*>""",
    re.DOTALL,
)
_OPEN_TAG = re.compile(r"<[a-zA-Z/!?]")
_PAIR = re.compile(r"""([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SMOOTHING = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
MARKED_RATIO, SECTION_RATIO = 10.0, 0.5  # times the ratio of the other text, for a marked element to count
HELD_SHARE = 0.9  # of the text of content blocks that the content element holds
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_TAGS = HEADINGS | frozenset(  # with those of lists and tables, which are no content element either
    "p pre blockquote li ul ol dd dt dl td th tr tbody thead tfoot table figure figcaption caption summary address".split()
)


class _Element:
    __slots__ = ("tag", "path", "parent", "aside", "depth", "least", "words", "marked", "n_marks", "head")

    def __init__(self, tag: str, label: str, parent: _Element | None, aside: bool, least: float = 0.0, words: frozenset[str] = frozenset()):
        self.tag, self.parent, self.aside = tag, parent, aside
        self.least, self.words = least, words  # of a marked element: times the ratio of other text that makes it content; why
        self.marked = self if least else parent and parent.marked  # the innermost marked element around
        self.head = tag in ("article", "main", "h1", "h2") or parent is not None and parent.head
        self.n_marks = (parent.n_marks if parent else 0) + (least > 0)
        self.path = (parent.path if parent else "") + "/" + label
        self.depth = parent.depth + 1 if parent else 0


class _Block:
    __slots__ = ("owner", "text", "linked")

    def __init__(self, owner: _Element, text: str, linked: int):
        self.owner, self.text, self.linked = owner, text, linked


def _attributes(rest: str) -> dict[str, str]:
    """Names and values of a tag's attributes; of a repeated name the first counts."""
    found: dict[str, str] = {}
    for name, *values in _PAIR.findall(rest):
        found.setdefault(name.lower(), next((v for v in values if v), ""))
    return found


def _marks(tag: str, rest: str, within: _Element | None) -> tuple[str, bool, float, frozenset[str]]:
    """The element's label in paths, whether it is beside the article, what its class and id ask of its ratio, and why."""
    aside, label, least, why = tag in ASIDE_TAGS, tag, 0.0, frozenset()
    inside = within is not None and bool({"article", "main"} & set(within.path.split("/")))
    if tag == "header":
        aside = not inside  # the head of an article holds its title
    if tag in FORM_TAGS:
        least, why = MARKED_RATIO, frozenset((tag,))
    named = _attributes(rest) if rest.strip() else {}
    for name in ("class", "id"):
        words = {w.lower() for w in _WORDS.findall(named.get(name, ""))}
        if name in named:
            label += "." + ".".join(sorted(words)[:3])
        beside = words & ASIDE_WORDS
        if (beside - {"header"} or beside and not inside) and tag not in ("html", "body", "article", "main"):
            least = max(least, SECTION_RATIO if inside and not beside - SECTION_WORDS - {"header"} else MARKED_RATIO)
            why |= beside
    aside = aside or named.get("role", "").strip().lower() in ASIDE_ROLES
    if "hidden" in named or named.get("aria-hidden", "").lower() == "true":
        aside = aside or tag not in ("html", "body")
    return label, aside, least, why


def blocks_of(html: str) -> list[_Block]:
    """The blocks with text, in page order."""
    root = _Element("", "", None, False)
    stack, blocks = [root], []
    inline: list[str] = []  # open inline tags
    parts, linked, at = [], 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(_Block(stack[-1], text, linked))
        parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = unescape(raw)
            parts.append(text)
            if "a" in inline:
                linked += len(text.strip())

    def close(depth: int) -> None:
        flush()
        del stack[depth:]

    def open_at(tags: set[str], stop: frozenset[str]) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in stop:
                return 0
        return 0

    while True:
        start = _OPEN_TAG.search(html, at)
        say(html[at : start.start()] if start else html[at:])
        token = start and _TOKEN.match(html, start.start())
        if token is None:
            break  # a tag that never ends takes the rest of the page
        at = token.end()
        tag = token["tag"] and token["tag"].lower()
        if not tag:
            continue
        if token["end"]:
            if tag in INLINE:
                if tag in inline:
                    del inline[len(inline) - 1 - inline[::-1].index(tag)]
                continue
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                close(depth)
                inline.clear()
            continue
        if tag == "br":
            parts.append("\n")
            continue
        if tag in INLINE:
            if tag not in VOID:
                inline.append(tag)
            continue
        if tag in ENDS_P and (depth := open_at({"p"}, SCOPES)):
            close(depth)
        if tag in CLOSES and (depth := open_at(CLOSES[tag], SCOPES - {"td", "th"} if tag == "tr" else SCOPES - CLOSES[tag])):
            close(depth)
        flush()
        if tag in VOID:
            continue
        label, aside, least, why = _marks(tag, token["rest"], stack[-1])
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
            continue
        stack.append(_Element(tag, label, stack[-1], aside or stack[-1].aside, least, why))
    flush()
    return blocks


def _ratios(blocks: list[_Block]) -> tuple[np.ndarray, np.ndarray]:
    """Per block: text length outside links and punctuation marks (and one) per block on its path."""
    text: dict[str, int] = defaultdict(int)
    marks: dict[str, int] = defaultdict(int)
    count: dict[str, int] = defaultdict(int)
    for b in blocks:
        path = b.owner.path
        text[path] += max(len(b.text) - b.linked, 0)
        marks[path] += len(MARKS.findall(b.text))
        count[path] += 1
    lengths = np.array([text[b.owner.path] / count[b.owner.path] for b in blocks])
    points = np.array([1 + marks[b.owner.path] / count[b.owner.path] for b in blocks])
    return lengths, points


def _around(element: _Element | None) -> list[_Element]:
    """The element and those around it."""
    found = []
    while element is not None:
        found.append(element)
        element = element.parent
    return found


def _unmarked(blocks: list[_Block]) -> list[_Block]:
    """The blocks outside marked elements and those in marked elements whose text outweighs the mark."""
    groups: dict[_Element, list[int]] = defaultdict(list)  # by the innermost marked element
    free: list[int] = []
    for i, b in enumerate(blocks):
        (free if b.owner.marked is None else groups[b.owner.marked]).append(i)
    if not groups:
        return blocks
    lengths, points = _ratios(blocks)
    size = [len(b.text) for b in blocks]
    worth = [n * r for n, r in zip(size, (lengths * points).tolist())]
    held: dict[_Element, float] = defaultdict(float)
    heads: dict[_Element, int] = defaultdict(int)  # blocks in articles and headings
    for b, value in zip(blocks, worth):
        e = b.owner.marked
        while e is not None:
            held[e] += value
            heads[e] += b.owner.head
            e = e.parent.marked
    n_heads, total, kept = sum(b.owner.head for b in blocks), sum(worth), list(free)

    def mean(at: list[int]) -> float:
        return sum(worth[i] for i in at) / sum(size[i] for i in at)

    for n_marks in sorted({e.n_marks for e in groups}):
        alike: dict[tuple, list[_Element]] = defaultdict(list)
        for e in groups:
            if e.n_marks == n_marks:
                alike[e.least, e.words].append(e)
        # Where nothing has fewer marks, the groups are held against each other.
        usual, bare = (mean(kept), False) if kept else (mean([i for es in alike.values() for e in es for i in groups[e]]), True)
        for (least, _), es in alike.items():
            own = [i for e in es for i in groups[e]]
            most = any(2 * held[e] > total and heads[e] == n_heads for e in es)
            if most or mean(own) >= (SECTION_RATIO if bare else least) * usual:
                kept += own
    return [blocks[i] for i in sorted(kept)]


def _content(blocks: list[_Block]) -> list[_Block]:
    """Blocks on content paths, by fused ratios."""
    lengths, points = _ratios(blocks)
    weight = np.convolve(np.ones(len(blocks)), SMOOTHING, "full")[2:-2]
    fused = np.convolve(lengths, SMOOTHING, "full")[2:-2] / weight * (np.convolve(points, SMOOTHING, "full")[2:-2] / weight)
    fused = np.where(lengths > 0, fused, 0.0)  # nothing but links
    limit = min(float(fused.std()), float(fused.mean()))
    return [b for b, f in zip(blocks, fused) if f >= limit and f > 0]


def main_text(html: str | None) -> str:
    """The text of the content element, blocks joined by one space."""
    blocks = _unmarked([b for b in blocks_of(html or "") if not b.owner.aside])
    content = _content(blocks) if blocks else []
    if not content:
        # Nothing but links: those of an article are its text.
        return " ".join(b.text for b in blocks if any(e.tag in ("article", "main") for e in _around(b.owner)))
    held: dict[int, int] = defaultdict(int)
    elements: dict[int, _Element] = {}
    for b in content:
        element = b.owner
        while element is not None:
            held[id(element)] += len(b.text)
            elements[id(element)] = element
            element = element.parent
    total = sum(len(b.text) for b in content)
    home = max((elements[i] for i, n in held.items() if n >= HELD_SHARE * total), key=lambda e: e.depth)
    while home.tag in TEXT_TAGS and home.parent is not None:
        home = home.parent  # a single paragraph or list: its heading is beside it
    home = next((e for e in _around(home) if e.tag == "article"), home)

    def inside(element: _Element | None) -> bool:
        while element is not None and element is not home:
            element = element.parent
        return element is home

    chosen = {id(b) for b in content}
    whole = home.tag not in ("", "html", "body")
    kept = [id(b) in chosen or inside(b.owner) and (whole or b.owner.tag == "p" or b.owner.tag in HEADINGS) for b in blocks]
    for i in range(len(blocks) - 2, -1, -1):  # the headings of what is kept
        kept[i] = kept[i] or kept[i + 1] and blocks[i].owner.tag in HEADINGS
    return " ".join(b.text for b, keep in zip(blocks, kept) if keep)


def main_texts(html: Column) -> Column:
    """The main text of each page."""

    @F.arrow_udf(T.StringType())
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(page) for page in pages.to_pylist()], pa.string())

    return extract(html)
