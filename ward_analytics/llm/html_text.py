"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Menus, forms, adverts and the like go by what their elements are called. The first
pass decides on the other blocks by length, link density and the density of stop words; short and doubtful ones stay open. In the
second, an open block takes the label of its nearest decided neighbours. Where a page marks its article, only blocks inside count, unless
the first pass finds more text outside.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by what they mean here, and the words that mark furniture in names of classes and ids.
BLOCKS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td"
    " tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("aside button canvas datalist dialog footer form head iframe menu nav noscript object option select svg template textarea title".split())
RAW = "script|style|noscript|template|textarea|title|svg|iframe|select|math"
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMES = frozenset(
    "ad ads advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr"
    " header login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination paywall popup promo promotion recommended"
    " related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar topbar widget widgets".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOT_NAMES = frozenset("has is no not with without".split())
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were what which"
    " with you"
    " als am auch auf aus bei das dass dem den der des die durch ein eine einen einer er es für im ist mit nach nicht oder sich sie sind über um"
    " und von vor war wie wird zu zum zur"
    " au aux avec ce cette dans de du elle en est et eux il ils je la le les leur mais ne nous on ou où par pas pour qu que qui sa se ses son sur"
    " un une vous y"
    " al como con del el ella entre era esta este ha la las lo los más muy no o para pero por porque se si sin sobre su sus también una ya".split()
)

ARTICLE_SHORT = 25
SHORT = 70
LONG = 200
STOP_LOW = 0.12
STOP_HIGH = 0.2
LINKS = 0.33
ARTICLE_LINKS = 0.5

# What has been read is never given back (possessive quantifiers), a tag ends at the next "<" at the latest, and a quote that nothing closes is a
# character like others, so the time grows with the page and not with its square.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{RAW})\b[^<>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s<>/]*+)(?P<attributes>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|(?=<)|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)|(?P<text>[^<]++|<)",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")


@dataclass
class Block:
    article: bool
    pieces: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    text: str = ""
    label: bool | None = None


@dataclass
class _Element:
    tag: str
    furniture: bool = False
    article: bool = False
    header: bool = False
    link: bool = False
    in_heading: bool = False
    in_furniture: bool = False
    #: Of a block: the open inline elements inside it, by tag.
    inline: Counter = field(default_factory=Counter)


class _Stack:
    """Open elements. Each end tag takes away what it closes, or is known to close nothing without a look at the stack."""

    def __init__(self) -> None:
        self.elements = [_Element("")]
        self.blocks = [0]
        self.open = Counter()

    @property
    def top(self) -> _Element:
        return self.elements[-1]

    @property
    def block(self) -> _Element:
        return self.elements[self.blocks[-1]]

    def push(self, element: _Element) -> None:
        if element.tag in BLOCKS:
            self.blocks.append(len(self.elements))
            self.open[element.tag] += 1
        else:
            self.block.inline[element.tag] += 1
        self.elements.append(element)

    def _pop(self) -> str:
        element = self.elements.pop()
        if element.tag in BLOCKS:
            self.blocks.pop()
            self.open[element.tag] -= 1
        else:
            self.block.inline[element.tag] -= 1
        return element.tag

    def close_block(self) -> None:
        """The innermost block and what is open inside."""
        while self._pop() not in BLOCKS:
            pass

    def close(self, tag: str) -> None:
        """An end tag; that of an inline element closes no block."""
        if (self.open if tag in BLOCKS else self.block.inline)[tag] > 0:
            while self._pop() != tag:
                pass


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)}


def _named_furniture(attributes: dict[str, str]) -> bool:
    if attributes.get("role", "").lower() in ROLES:
        return True
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        parts = re.split(r"[-_]+", name)
        if parts[0] not in NOT_NAMES and not NAMES.isdisjoint((parts[0], parts[-1])):
            return True
    return False


def blocks(page: str, names_inside: bool = True) -> list[Block]:
    """Blocks of text outside of furniture, in page order. ``names_inside``: whether classes and ids mark furniture within an article, too."""
    found, stack, now = [], _Stack(), None
    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            top = stack.top
            if top.furniture or top.header and not top.in_heading:
                continue
            if now is None:
                now = Block(top.article)
                found.append(now)
            now.pieces.append(text)
            if top.link:
                now.links.append(text)
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag in BLOCKS:
            now = None
        elif tag == "br" and now is not None:
            now.pieces.append(" ")
        if m["end"]:
            stack.close(tag)
            continue
        if tag in BLOCKS and (stack.block.tag == "p" or stack.block.tag == tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option")):
            stack.close_block()
        if tag in VOID or m["attributes"].rstrip().endswith("/") and tag not in BLOCKS:
            continue
        top, attributes = stack.top, _attributes(m["attributes"]) if m["attributes"] else {}
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(_HIDDEN.search(attributes.get("style", "")))
        named = tag not in ("html", "body") and bool(attributes) and (names_inside or not top.article) and _named_furniture(attributes)
        opens = (tag in ("article", "main") or attributes.get("role") == "main" or attributes.get("itemprop") == "articleBody") and not named
        furniture = hidden or tag in FURNITURE or (top.furniture and not (opens and not top.in_furniture)) or named and not opens
        header = (top.header and not opens) or tag == "header"
        article = top.article or opens and not furniture
        if named and top.article and not hidden and attributes.get("role", "") not in ROLES and "header" in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower():
            furniture, header = top.furniture, True  # the head of the article itself: its headings stay
        stack.push(_Element(tag, furniture, article, header, top.link or tag == "a", top.in_heading or tag in HEADINGS, top.in_furniture or tag in FURNITURE))
    for block in found:
        block.text = _SPACE.sub(" ", html.unescape("".join(block.pieces))).strip()
    return [b for b in found if b.text]


def stop_density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _decide(block: Block) -> bool | None:
    """First pass: text, furniture or open."""
    size = len(block.text)
    linked = len(_SPACE.sub(" ", html.unescape("".join(block.links))).strip()) / size
    if linked > (ARTICLE_LINKS if block.article else LINKS):
        return False
    if block.article:
        return True if size >= ARTICLE_SHORT else None
    if size < SHORT:
        return False if linked else None
    stops = stop_density(block.text)
    if stops >= STOP_HIGH:
        return True if size > LONG else None
    # Without links a lack of stop words proves nothing: the text may be a table, or in another language than theirs.
    return None if stops >= STOP_LOW or not linked else False


def classify(found: list[Block]) -> list[Block]:
    """The blocks of the main text. Labels are set by both passes. Blocks outside of a marked article count where the first pass finds more
    text among them than inside, for then the mark is that of a teaser."""
    first = [_decide(b) for b in found]
    if not any(first):  # no stop words that are known here: long blocks without links are text in any language
        first = [True if label is None and not b.links and len(b.text) > LONG else label for b, label in zip(found, first, strict=True)]
    inside = sum(len(b.text) for b, label in zip(found, first, strict=True) if b.article and label is not False)
    outside = sum(len(b.text) for b, label in zip(found, first, strict=True) if not b.article and label)
    if any(b.article for b in found) and inside >= outside:
        first = [label for b, label in zip(found, first, strict=True) if b.article]
        found = [b for b in found if b.article]
    known = [i for i, label in enumerate(first) if label is not None]
    before, after = -1, 0
    for i, block in enumerate(found):
        block.label = first[i]
        if first[i] is not None:
            before = i
            continue
        while after < len(known) and known[after] < i:
            after += 1
        behind = before if before >= 0 else None
        ahead = known[after] if after < len(known) else None
        if behind is None or ahead is None:
            near = behind if ahead is None else ahead
            block.label = True if near is None else first[near]
        elif first[behind] == first[ahead]:
            block.label = first[behind]
        elif block.article or stop_density(block.text) >= STOP_HIGH:
            block.label = True
        else:
            block.label = first[behind] if i - behind < ahead - i else first[ahead] if ahead - i < i - behind else False
    return [b for b in found if b.label]


def main_text(page: str | None) -> str:
    """A marked article that would be empty is read once more without regard to the names inside: they can't mean furniture there."""
    kept = classify(blocks(page or "")) or [b for b in classify(blocks(page or "", names_inside=False)) if b.article]
    return "\n".join(b.text for b in kept)


def extract(pages: DataFrame, page: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (page_id and url by default), text and n_chars, its code points.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by a line feed.
    A null or empty page, or one without main text, has an empty text. Broken and cut-off markup is read as far as it
    goes. Pages are independent of one another: repeated ids, ties and other columns don't matter.
    """
    keep = ["page_id", "url"] if keep is None else keep
    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema.names
            )

    return pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(page).alias("page")).mapInArrow(run, schema)
