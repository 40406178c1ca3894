"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags. Pass one classifies each block on its own by stop-word
density, length and link density as good, bad or short (undecided); blocks that the markup places in
navigation, headers, footers, asides, forms, notices, adverts or comments are bad. Pass two lets the
undecided blocks inherit the label of the nearest decided neighbour; neighbours within the same container
count before others, and good wins a tie.

A form with more than half of the page's unlinked text is the page's own layout and no furniture; so is an
element with a furniture name that besides holds an article, a main element or a first-level heading
(reader comments excepted). Class names that only tell a state (``with-sidebar``, ``comments-open``) name
no furniture. On a page whose larger blocks have hardly any stop word, the language isn't listed: there
length, link density and sentence marks alone decide.

Null or empty html gives an empty text. Unclosed, crossed and unknown tags are tolerated; repeated rows
give repeated results. Each page is one row's work, so a page is the unit of memory. The page is read once from left to right: a tag
without its ``>`` is text, and a tag with an unclosed quote ends at the next ``>``.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votesel.llm.common import arrow_schema

#: Frequent function words of the languages in use.
STOP_WORDS = frozenset(
    """the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which
    der die das und in den von zu ist mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am
    de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou son
    el los y del se las por con para una su al lo como más pero sus le ya o este sí porque esta entre""".split()
)

#: Elements without text of their own, elements that end a block, and page furniture.
SKIPPED = frozenset("script style noscript template svg math iframe object embed canvas audio video head title select option textarea button".split())
#: Skipped elements whose content is markup: one without a closing tag doesn't take the rest of the page.
MARKUP_INSIDE = frozenset("template svg math object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    """address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
FURNITURE = frozenset("nav footer aside menu dialog search".split())
FORMS = frozenset("form fieldset".split())
MAIN = frozenset("article main".split())
FURNITURE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|footer|sidebar|side|aside|widget|cookies?|consent|gdpr|notice|alert|popup|modal|"
    r"ads?|advert\w*|sponsor\w*|promo\w*|comments?|commentlist|respond|reply|replies|disqus|share|sharing|social|related|recommend\w*|newsletter|"
    r"subscribe|signup|login|search|pagination|pager|toolbar|skip)(?:$|[\s_-])",
    re.I,
)
HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|masthead|banner|topbar)(?:$|[\s_-])", re.I)  # outside an article only
STATE_NAMES = re.compile(r"(?:with|without|has|no|is|not|hide|show)[_-].+|.+[_-](?:open|closed|enabled|disabled|on|off|left|right|active|visible)", re.I)
COMMENT_NAMES = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|respond|reply|replies|disqus)(?:$|[\s_-])", re.I)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())

TAG_START = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTES = re.compile(r"(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+")
ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-hidden|hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORD = re.compile(r"\w+")

SENTENCE = re.compile(r"[.!?…。！？।؟]")
WIDE = re.compile(r"[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff]")  # scripts that say more per character
MOST = 0.5  # share of the page's unlinked text that makes an element its layout

SHORT, LONG, MUCH_LINK, LOW_STOP, HIGH_STOP = 70, 200, 0.3, 0.05, 0.12


@dataclass
class Block:
    text: str
    linked: int
    furniture: bool
    main: int  # number of the enclosing article or main element, -1 if none
    heading: bool
    label: str = ""
    within: int = -1  # innermost element that is furniture unless it holds most of the page, -1 if none


@dataclass
class Doubtful:
    """An element that is furniture unless it holds most of the page's text."""

    parent: int
    form: bool
    comments: bool
    titled: bool = False  # holds an article, a main element or a first-level heading
    unlinked: int = 0
    furniture: bool = True


@dataclass
class Tag:
    closing: bool
    name: str  # empty for comments, declarations and character data
    attributes: str
    text: str  # character data
    stop: int


class Tags:
    """Tags of a page from left to right. What is known to be missing is not looked for again, so the
    work is linear in the page."""

    def __init__(self, html: str):
        self.html = html
        self.last_end = html.rfind(">")
        self.unquoted = -1  # up to here an unclosed quote is in the way: tags end at the next ">"

    def next(self, at: int) -> tuple[int, Tag] | None:
        """Start and tag of the first tag at or after a place."""
        html = self.html
        while (m := TAG_START.search(html, at)) is not None:
            after = m.end()
            if m[1]:
                end = COMMENT_END.search(html, after)
                return m.start(), Tag(False, "", "", "", end.end() if end else len(html))
            if m[2]:
                end = html.find("]]>", after)
                return m.start(), Tag(False, "", "", html[after : end if end >= 0 else len(html)], end + 3 if end >= 0 else len(html))
            if after > self.last_end:
                at = after
                continue
            if m[3]:
                return m.start(), Tag(False, "", "", "", html.index(">", after) + 1)
            stop = -1
            if m.start() >= self.unquoted:
                stop = ATTRIBUTES.match(html, after).end()
                if stop >= len(html) or html[stop] != ">":
                    self.unquoted, stop = stop, -1
            if stop < 0:
                stop = html.index(">", after)
            return m.start(), Tag(bool(m[4]), m[5].lower(), html[after:stop], "", stop + 1)
        return None


def _kind(tag: str, attributes: str, in_main: bool) -> str:
    """``furniture``, or ``form``, ``named`` or ``comments`` where the text inside has a say, or nothing."""
    if tag in FURNITURE or tag == "header" and not in_main:
        return "furniture"
    kind = "form" if tag in FORMS else ""
    if "=" not in attributes and "hidden" not in attributes or tag in ("html", "body", "article", "main"):
        return kind
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            for token in value.split():
                if STATE_NAMES.fullmatch(token):
                    continue
                if COMMENT_NAMES.search(token):
                    return "comments"
                if FURNITURE_NAMES.search(token) or not in_main and HEADER_NAMES.search(token):
                    kind = "named"
        elif name == "role":
            if value.lower() in FURNITURE_ROLES:
                kind = kind or ("form" if value.lower() == "form" else "named")
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            return "furniture"
    return kind


def closed_elements(html: str, tag: str) -> dict[int, int]:
    """Start of each start tag of a kind -> end of its closing tag, of the elements that are closed."""
    found, starts = {}, []
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>])([^>]*)>?", html, re.I):
        if not m[1]:
            if not m[2].rstrip().endswith("/"):
                starts.append(m.start())
        elif starts:
            found[starts.pop()] = m.end()
    return found


def blocks_of(html: str) -> list[Block]:
    """Blocks with text, in page order."""
    found: list[Block] = []
    doubtful: list[Doubtful] = []
    open_tags: list[tuple[str, bool, int, int]] = []  # tag, furniture, innermost doubtful element, enclosing main element
    n_open: Counter = Counter()
    outside = ("", False, -1, -1)
    state, links, heading, n_main = outside, 0, 0, 0
    parts: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            found.append(Block(text, linked, state[1], state[3], heading > 0, within=state[2]))
        parts.clear()
        linked = 0

    tags, closed, missing = Tags(html), {}, set()

    def after_closing(pattern: str, at: int) -> re.Match | None:
        """The next match of a pattern, which is not looked for again once it is missing."""
        m = None if pattern in missing else re.compile(pattern, re.I).search(html, at)
        if m is None:
            missing.add(pattern)
        return m

    at = 0
    while at < len(html):
        hit = tags.next(at)
        raw = html[at : hit[0] if hit else len(html)]
        parts.append(raw)
        if links:
            linked += len(raw.strip())
        if hit is None:
            break
        start, tag = hit
        at, name, attributes = tag.stop, tag.name, tag.attributes
        if not name:
            parts.append(entities.escape(tag.text))
            continue
        if name in SKIPPED and name not in VOID:
            if name == "head":
                body = None if tag.closing else after_closing(r"</head\s*>|<body\b", at)
                at = (body.end() if body[0].startswith("</") else body.start()) if body else at
            elif not tag.closing and name in MARKUP_INSIDE:
                if name not in closed:
                    closed[name] = closed_elements(html, name)
                at = closed[name].get(start, at)
            elif not tag.closing and not attributes.rstrip().endswith("/"):
                end = after_closing(rf"</{name}\s*>", at)
                at = end.end() if end else at if name in ("select", "option", "button", "title") else len(html)
            if name in ("button", "select", "textarea"):
                parts.append(" ")
            continue
        if name in BLOCKS:
            close()
        if name == "a":
            links = 0 if tag.closing else 1
        elif name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = 0 if tag.closing else 1
        if name in VOID or name not in BLOCKS and name != "span":
            continue
        now = open_tags[-1] if open_tags else outside
        if name == "p" and not tag.closing:  # a paragraph ends where the next begins
            while open_tags and open_tags[-1][0] == "p":
                n_open[open_tags.pop()[0]] -= 1
            now = open_tags[-1] if open_tags else outside
        if tag.closing:
            if n_open[name]:
                while n_open[last := open_tags.pop()[0]] and last != name:
                    n_open[last] -= 1
                n_open[name] -= 1
            now = open_tags[-1] if open_tags else outside
        else:
            main = now[3]
            if name in MAIN and main < 0:
                main, n_main = n_main, n_main + 1
            kind = _kind(name, attributes, main >= 0)
            within = now[2]
            if (name in MAIN or name == "h1") and within >= 0:
                doubtful[within].titled = True
            if kind and kind != "furniture":
                doubtful.append(Doubtful(within, kind == "form", kind == "comments"))
                within = len(doubtful) - 1
            now = (name, now[1] or kind == "furniture", within, main)
            open_tags.append(now)
            n_open[name] += 1
        if name == "span" and state[1:3] != now[1:3]:
            close()
        state = now
    close()
    settle(found, doubtful)
    return found


def settle(blocks: list[Block], doubtful: list[Doubtful]) -> None:
    """Decides which doubtful elements are furniture, by their share of the page's unlinked text."""
    total = 0
    for b in blocks:
        if not b.furniture:
            total += len(b.text) - min(b.linked, len(b.text))
            if b.within >= 0:
                doubtful[b.within].unlinked += len(b.text) - min(b.linked, len(b.text))
    for d in reversed(doubtful):  # inner elements follow their outer ones
        if d.parent >= 0:
            doubtful[d.parent].unlinked += d.unlinked
            doubtful[d.parent].titled |= d.titled
    for d in doubtful:
        layout = d.unlinked > MOST * total and not d.comments and (d.form or d.titled)
        d.furniture = not layout or d.parent >= 0 and doubtful[d.parent].furniture
    for b in blocks:
        b.furniture = b.furniture or b.within >= 0 and doubtful[b.within].furniture


def decidable(block: Block) -> bool:
    """Whether the block's own words say anything: neither furniture, nor links, nor short."""
    return not block.furniture and not (block.main < 0 and block.linked / len(block.text) > MUCH_LINK) and weight(block.text) >= SHORT


def weight(text: str) -> int:
    return len(text) + 2 * len(WIDE.findall(text))


def stop_words(text: str) -> tuple[int, int]:
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def listed_language(blocks: list[Block]) -> bool:
    """Whether the page's larger blocks have the stop words of a listed language."""
    counts = [stop_words(b.text) for b in blocks if decidable(b)]
    return not counts or sum(c[0] for c in counts) >= LOW_STOP * sum(c[1] for c in counts)


def classify(block: Block, listed: bool = True) -> str:
    """Pass one: the block on its own."""
    if block.furniture:
        return "bad"
    if block.main < 0 and block.linked / len(block.text) > MUCH_LINK:
        return "bad"
    length = weight(block.text)
    if length < SHORT:
        return "short"
    if not listed:
        return "good" if length >= LONG and SENTENCE.search(block.text) else "near"
    found, words = stop_words(block.text)
    density = found / max(words, 1)
    if density >= HIGH_STOP or length >= LONG and density >= LOW_STOP:
        return "good"
    return "near" if density >= LOW_STOP else "low"


def label_blocks(blocks: list[Block]) -> list[Block]:
    """Pass two: undecided blocks take the label of the nearest decided neighbour."""
    listed = listed_language(blocks)
    labels = [classify(b, listed) for b in blocks]
    n = len(blocks)
    before, after = [-1] * n, [-1] * n
    last = -1
    for i in range(n):
        before[i] = last
        last = i if labels[i] in ("good", "bad") else last
    last = -1
    for i in range(n - 1, -1, -1):
        after[i] = last
        last = i if labels[i] in ("good", "bad") else last
    for i, b in enumerate(blocks):
        if labels[i] in ("good", "bad"):
            b.label = labels[i]
            continue
        near = [(blocks[k].main != b.main, abs(k - i), labels[k] != "good", labels[k]) for k in (before[i], after[i]) if k >= 0]
        if near and not (b.main >= 0 and min(near)[0]):
            b.label = min(near)[3]
        else:  # no decided neighbour in its article: the article itself decides
            b.label = "good" if b.main >= 0 else min(near)[3] if near else "bad"
    return blocks


def main_text(html: str | None) -> str:
    """Text of the good blocks, joined by one space."""
    return " ".join(b.text for b in label_blocks(blocks_of(html or "")) if b.label == "good")


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per page. One narrow pass without a shuffle."""
    schema = "page_id long, url string, text string, n_chars long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500).to_pydict()
                texts = [main_text(h) for h in part["html"]]
                yield pa.RecordBatch.from_pydict({"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]}, schema=arrow)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, schema)
