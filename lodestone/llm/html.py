"""Main text of web pages by a maximum-scoring contiguous region.

A page becomes a row of tokens: words score positive and tags negative, so that prose stands out from menus. What is known
about a word's place is a feature of its score and nothing else: whether the page marks its content (article, main) and the
word stands in it or beside it, whether it's in a link, a heading, an element that isn't content as a rule (nav, footer, aside,
form, ...) or one that is named so in full ("cookie-notice") or in part ("notice-board"). The weights are fitted on pages
made by rule with their content labelled (``html_pages``), by a perceptron over whole pages: a page is extracted with the
current weights, and each feature's weight moves by what was wrongly taken or left.

Extraction: elements that have such evidence and whose words score below zero together are set aside, each counting as one
tag, so that an advert inside an article doesn't end it. One linear scan then finds the contiguous region with the highest
sum on every page, with or without marks; its ends are moved outward over the block they stand in, and over a title just
before it. Scripts, styles, comments, and elements that a browser doesn't show have no text to begin with.

Text: character references are decoded; white space inside a block becomes one space; blocks are trimmed, and joined in
page order by two line feeds; nothing is cut or dropped.

Defined results: null or empty html, or no words, gives the empty text; markup that's left open or cut short is read as
far as it goes, at any depth; equal pages give equal texts; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import slices
from lodestone.session import ship_package

# Elements that start a block of text, whose content is no markup, that aren't shown, that aren't content as
# a rule, and that have no end tag.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
RAW = set("script style noscript template textarea title iframe xmp noembed noframes".split())
UNSEEN = RAW | set("head svg canvas object audio video datalist".split())
APART = set("nav footer aside form button select dialog menu input label fieldset".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SPACED = {"br", "hr"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
INLINE = set("b i em strong code br sup sub span u s small q cite abbr mark time wbr img font a".split())
LIST = set("li ul ol dl dt dd table tr td th tbody thead figure".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note".split())
#: Words of names that elements beside the content have, and words that go with them.
BESIDE = re.compile(
    r"ads?|adsby\w*|adslot|adbox|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menus?|breadcrumbs?|header|masthead|topbar|footer|sidebar\w*|side|"
    r"aside|cookies?|consent|notices?|gdpr|popup|modal|overlay|newsletter|subscri\w*|signup|login|search|share|sharing|social|"
    r"related|recommend\w*|comments?|commentlist|disqus|respond|reply|replies|discussion|toolbar|pagination|pager|widgets?|skip|"
    r"copyright|legal|disclaimer|tags?|paywall|alert",
    re.I,
)
#: Those of them that stand on content as well: on a paragraph they say little.
EITHER = re.compile(r"legal|tags?|side|share|sharing|notices?|alert|related|header|search|skip|reply|respond|copyright", re.I)
NEUTRAL = re.compile(
    r"site|page|main|top|bottom|left|right|bar|box|block|list|items?|area|section|container|wrap|wrapper|inner|outer|posts?|articles?|links?|buttons?|"
    r"slot|unit|thread|form|content|global|sub|primary|secondary|\d*",
    re.I,
)
#: Names of an article's own head, which holds its title.
OWN_HEAD = re.compile(r"(?:article|post|entry|story|content)[_-]?header", re.I)
UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")

#: What is known of a word's place; the features of its score. A word's score is the sum of theirs; by element and named
#: stand alone, as such a part is read the same inside of a mark and beside it.
WORD, INSIDE, OUTSIDE, LINKED, LINKED_INSIDE, HEADING, ELEMENT, NAMED, HALF_NAMED, NAMED_PROSE = range(10)
#: Classes of tags, of which each has one; a content's own mark-up weighs by itself.
PROSE_TAG, INLINE_TAG, LIST_TAG, OTHER_TAG, MARKED_PROSE, MARKED_INLINE, MARKED_LIST, MARKED_TAG, SET_ASIDE = range(10, 19)
FEATURES = (
    "word, inside a mark, outside the marks, linked, linked inside a mark, heading, by element, named, named in part, named prose, prose tag, inline tag, list tag, other tag, "
    "prose tag inside a mark, inline tag inside a mark, list tag inside a mark, other tag inside a mark, set aside"
).split(", ")


@dataclass
class Node:
    """An open element with what its words inherit."""

    name: str
    unseen: bool
    marked: bool  # in an article or main element, or one itself
    linked: bool
    heading: bool
    evidence: int  # 0, or the feature that speaks against its words
    span: int = -1  # its place among the spans, if it has evidence of its own


@dataclass
class Item:
    """A token of the scan: a run of words of one block, or a tag."""

    kind: str
    text: str = ""
    words: int = 0
    marked: bool = False
    linked: bool = False
    heading: bool = False
    evidence: int = 0
    block: int = 0


@dataclass
class Page:
    items: list[Item] = field(default_factory=list)
    spans: list[list[int]] = field(default_factory=list)  # first and end item of each element with evidence, outer ones first
    marked: bool = False  # has words in an article or main element


def _attributes(tag: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(tag):
        out.setdefault(name.lower(), entities.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return out


def _named(value: str) -> int:
    """What a name says of being beside the content: 3 in full, 2 in full by words that stand on content as well, 1 in part."""
    found = 0
    for name in OWN_HEAD.sub("head", value).split():
        parts = re.split(r"[_\W]+|(?<=[a-z])(?=[A-Z])", name)
        hits = [p for p in parts if BESIDE.fullmatch(p)]
        if hits:
            whole = all(BESIDE.fullmatch(p) or NEUTRAL.fullmatch(p) for p in parts)
            found = max(found, 1 if not whole else 2 if all(map(EITHER.fullmatch, hits)) else 3)
    return found


def _evidence(name: str, attributes: dict[str, str], marked: bool) -> int:
    """The feature of the words of an element by itself, 0 if nothing speaks against them."""
    if name in APART or name == "header" and not marked or attributes.get("role", "").lower() in ROLES:
        return ELEMENT
    if name in ("body", "html", "main"):
        return 0
    found = max((_named(attributes[k]) for k in ("class", "id") if k in attributes), default=0)
    if name == "article":
        return NAMED if found and re.search(r"comment|reply", attributes.get("class", "") + attributes.get("id", ""), re.I) else 0
    if name in PROSE:
        return NAMED if found == 3 else NAMED_PROSE if found else 0
    return 0 if not found else NAMED if found >= 2 else HALF_NAMED


def tokens(html: str) -> Page:
    """Items of a page in order. Time and memory follow its length."""
    page, stack, block = Page(), [], 0
    opened: dict[str, list[int]] = {}  # by name, where in the stack its open elements are
    at, stop = 0, len(html)
    find = TOKEN.match

    def close(depth: int) -> Node:
        was = stack[depth]
        for node in stack[depth:]:
            opened[node.name].pop()
            if node.span >= 0:
                page.spans[node.span][1] = len(page.items)
        del stack[depth:]
        return was

    root = Node("", False, False, False, False, 0)
    while at < stop:
        m = find(html, at)
        piece = m[0]
        at = m.end()
        top = stack[-1] if stack else root
        if piece[0] != "<" or piece == "<":
            if not top.unseen:
                text = entities.unescape(piece)
                n = len(text.split())
                page.items.append(Item("words", text, n, top.marked, top.linked, top.heading, top.evidence, block))
                page.marked = page.marked or top.marked and n > 0
            continue
        if piece.startswith(("<!", "<?")):
            continue
        tag = TAG.match(piece)
        closing, name = tag[1], tag[2].lower()
        if name in BLOCKS:
            block += 1
        if closing:
            if opened.get(name):
                was = close(opened[name][-1])
                if not was.unseen:
                    page.items.append(Item("/" + name, "", 0, stack[-1].marked if stack else False, block=block))
                    if was.span >= 0:
                        page.spans[was.span][1] = len(page.items)
            continue
        attributes = _attributes(piece[tag.end() :].rstrip("/>")) if "=" in piece or " hidden" in piece else {}
        if name in CLOSES and stack and stack[-1].name in CLOSES[name]:
            while stack and stack[-1].name in CLOSES[name]:
                close(len(stack) - 1)
            top = stack[-1] if stack else root
        unseen = top.unseen or name in UNSEEN or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(UNSHOWN.search(attributes.get("style", "")))
        own = 0 if unseen else _evidence(name, attributes, top.marked)
        # A mark counts unless what surrounds it speaks of other writers or of teasers; a form may hold a whole page.
        mark = (name in ("article", "main") or attributes.get("role", "").lower() in ("main", "article")) and not own
        clear = mark and (name == "main" or not top.evidence or any(s.name == "form" for s in stack[-1:]))
        marked = top.marked or clear
        evidence = 0 if clear else own or top.evidence
        if not unseen:
            page.items.append(Item(name, " " if name in SPACED else "", 0, top.marked, block=block))
        if name in VOID or piece.endswith("/>") and name not in RAW:
            if name in BLOCKS:
                block += 1
            continue
        node = Node(name, unseen, marked, top.linked or name == "a", top.heading or name in ("h1", "h2"), evidence)
        if own and not unseen:
            node.span = len(page.spans)
            page.spans.append([len(page.items) - 1, -1])  # its own tags go with it
        opened.setdefault(name, []).append(len(stack))
        stack.append(node)
        if name in RAW:  # nothing in it is markup but its own end
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)", re.I).search(html, at)
            at = end.start() if end else stop
    for span in page.spans:
        if span[1] < 0:
            span[1] = len(page.items)
    return page


# ---------------------------------------------------------------- scores


def features(item: Item, page: Page) -> list[int]:
    """The features of a token; a run of words has them once per word."""
    if item.kind == "words":
        if item.evidence in (ELEMENT, NAMED):
            return [item.evidence]
        out = [WORD]
        if page.marked:
            out.append(INSIDE if item.marked else OUTSIDE)
        if item.linked:
            out.append(LINKED_INSIDE if item.marked else LINKED)
        if item.heading:
            out.append(HEADING)
        if item.evidence:
            out.append(item.evidence)
        return out
    name = item.kind.lstrip("/")
    if name == "a":  # its words say so
        return []
    if name in PROSE:
        return [MARKED_PROSE if item.marked else PROSE_TAG]
    if name in INLINE:
        return [MARKED_INLINE if item.marked else INLINE_TAG]
    if name in LIST:
        return [MARKED_LIST if item.marked else LIST_TAG]
    return [MARKED_TAG if item.marked else OTHER_TAG]


def best_region(scores: list[float]) -> tuple[int, int]:
    """(first, end) of the contiguous run with the highest sum, in one pass; the longest of equal ones, (0, 0) if none is above zero."""
    best, first, end, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or (total == best and best > 0 and i + 1 - start > end - first):
            best, first, end = total, start, i + 1
    return first, end


def chosen(page: Page, weights: list[float]) -> tuple[int, int, list[bool]]:
    """(first, end) of a page's region, and of each item whether it's set aside."""
    items = page.items
    scores = [sum(weights[f] for f in features(i, page)) * (i.words if i.kind == "words" else 1) for i in items]
    aside = [False] * len(items)
    if page.spans:
        sums = [0.0]  # of words alone: its tags don't set an element aside
        for i, s in zip(items, scores, strict=True):
            sums.append(sums[-1] + (s if i.words else 0.0))
        done = 0
        for first, end in page.spans:
            if first >= done and end > first and sums[end] - sums[first] < 0:
                aside[first:end] = [True] * (end - first)
                scores[first:end] = [0.0] * (end - first)
                scores[first] = weights[SET_ASIDE]
                done = end
    first, end = best_region(scores)
    if first == end:
        return 0, 0, aside
    # A title that only tags part from the region belongs to it.
    before = next((k for k in range(first - 1, -1, -1) if items[k].words and not aside[k]), None)
    if before is not None and items[before].heading and not items[before].linked:
        first = before
    while first > 0 and items[first - 1].block == items[first].block and not aside[first - 1]:
        first -= 1
    while end < len(items) and items[end].block == items[end - 1].block and not aside[end]:
        end += 1
    return first, end, aside


# ---------------------------------------------------------------- weights


def _labelled(html: str) -> tuple[Page, list[bool]]:
    """A page without its marks, and of each item whether it's content (of a tag: whether content stands around it)."""
    page = tokens(html)
    within, truth = False, []
    for item in page.items:
        if item.kind != "words":
            truth.append(within)
            continue
        inside = within
        for mark in re.findall("[⟦⟧]", item.text):
            within = mark == "⟦"
            inside = inside or within
        item.text = re.sub("[⟦⟧]", "", item.text)
        item.words = len(item.text.split())
        truth.append(inside and item.words > 0 or inside and within)
    return page, truth


#: A tag weighs as much as so many words at most; one inside of a mark far less, as a page's own mark says that it's content: a
#: hundred of them don't outweigh a word.
TAG_WORDS = 4.0
MARKED_WORDS = 0.01


def fit_weights(pages: list[str], rounds: int = 6) -> list[float]:
    """Weights by an averaged perceptron over whole pages; plain words stay at zero or above, tags between zero and minus TAG_WORDS words."""
    rows = [_labelled(p) for p in pages]
    found = [[features(i, page) for i in page.items] for page, _ in rows]
    w = np.zeros(len(FEATURES))
    w[WORD], w[PROSE_TAG:], w[MARKED_PROSE:SET_ASIDE], w[SET_ASIDE] = 1.0, -1.0, -MARKED_WORDS, -0.1
    total, steps = np.zeros_like(w), 0
    for k in range(rounds):
        rate = 0.2 / (1 + k)
        for (page, truth), own in zip(rows, found, strict=True):
            first, end, aside = chosen(page, w.tolist())
            wrong = np.zeros_like(w)
            for n, (item, right, which) in enumerate(zip(page.items, truth, own, strict=True)):
                taken = first <= n < end and not aside[n]
                if taken != right:
                    for f in which:
                        wrong[f] += (1 if right else -1) * (item.words if item.kind == "words" else 1)
            w += rate * np.sign(wrong) * np.sqrt(np.abs(wrong))
            w[WORD] = max(w[WORD], 0.0)
            w[PROSE_TAG:] = np.clip(w[PROSE_TAG:], -TAG_WORDS * max(w[WORD], 1.0), 0.0)
            w[MARKED_PROSE:SET_ASIDE] = np.maximum(w[MARKED_PROSE:SET_ASIDE], -MARKED_WORDS * max(w[WORD], 1.0))
            total += w
            steps += 1
    return (total / max(steps, 1)).tolist()


@cache
def default_weights() -> tuple[float, ...]:
    """Fitted on 600 labelled pages; the same on every machine."""
    from lodestone.llm.html_pages import labelled_pages

    return tuple(fit_weights(labelled_pages(600)))


# ---------------------------------------------------------------- texts


def main_text(html: str | None, weights: list[float] | tuple[float, ...] | None = None) -> str:
    """The main text of one page."""
    page = tokens(html or "")
    first, end, aside = chosen(page, weights or default_weights())
    blocks: dict[int, list[str]] = {}
    for k in range(first, end):
        if page.items[k].text and not aside[k]:
            blocks.setdefault(page.items[k].block, []).append(page.items[k].text)
    texts = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(t for t in texts if t)


def _extracted(weights: tuple[float, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, pages in slices(batches, "__html"):
            texts = [main_text(p, weights) for p in pages]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*part.schema.names[:-1], "text", "n_chars"],
            )

    return run


def extract(df: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", weights: list[float] | None = None) -> DataFrame:
    """The columns to keep, with text and n_chars. The weights are fitted on the driver, unless given, and sent along."""
    ship_package(df.sparkSession)
    narrow = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").alias("__html"))
    kinds = ", ".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep)
    return narrow.mapInArrow(_extracted(tuple(weights or default_weights())), f"{kinds}, text string, n_chars long")
