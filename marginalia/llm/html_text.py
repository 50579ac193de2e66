"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags, in one pass whose time grows with the page, however broken it is. Pass 1
looks at each block by itself: where it stands (in a menu, footer, advert, form and so on, or beside the page's article)
can make it bad; else its length, its share of stop words and its share of link text make it good, bad or undecided.
Pass 2 gives each undecided block the label of its nearest decided neighbours, in an article of those in it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import column_of, text_slices

# Tags and words.
BLOCK_TAGS = set("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = set("script style noscript template textarea title iframe svg noembed noframes".split())
BAD_TAGS = set("nav header footer aside form menu button select fieldset head dialog search".split())
BAD_NAMES = set("ad ads advert advertisement adverts banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments reply replies respond disqus cookie cookies consent notice gdpr popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login widget toolbar copyright disclaimer pagination pager".split())
BAD_ROLES = set("navigation banner contentinfo complementary search form alert dialog menu".split())
STOP_WORDS = set(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so said what up its about into than them can only other time new some could these two may first then do any my now such like our over"
    " le la les de des du et un une en que qui est dans pour par sur pas au aux ce il elle ne se plus avec son sa ses mais ou nous vous ils sont cette"
    " der die das und ist von zu den mit im des ein eine auf für nicht sich dem es an als auch er sie aus bei nach wie dass wir ich werden oder"
    " el los las una que del y por con para se su al lo como más o pero sus ya es son fue este sin sobre".split()
)

_TAG_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*+)")
# What follows a tag's name up to its end; a quote counts behind an equals sign, if it is closed.
_TAG_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?)*+""")
_CLOSE = {tag: re.compile(rf"</{tag}(?![a-z0-9:-])", re.I) for tag in RAW_TAGS}
_NAMES = set("ad ads advert advertisement adverts banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments reply replies respond disqus cookie cookies consent notice gdpr popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login widget toolbar copyright disclaimer pagination pager".split())
BAD_ROLES = set("navigation banner contentinfo complementary search form alert dialog menu".split())
STOP_WORDS = set(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so said what up its about into than them can only other time new some could these two may first then do any my now such like our over"
    " le la les de des du et un une en que qui est dans pour par sur pas au aux ce il elle ne se plus avec son sa ses mais ou nous vous ils sont cette"
    " der die das und ist von zu den mit im des ein eine auf für nicht sich dem es an als auch er sie aus bei nach wie dass wir ich werden oder"
    " el los las una que del y por con para se su al lo como más o pero sus ya es son fue este sin sobre".split()
)

_TAG = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD_PARTS = re.compile(r"[a-z]+")
_WORDS = re.compile(r"[^\W\d_]+")
_CONTAINERS = set("article aside body div footer header html main nav section table td th li ul ol form dd blockquote".split())

#: Shorter blocks outside of an article are undecided, unless they hold links.
SHORT_CHARS = 70
#: Longer blocks with the higher share of stop words are good.
LONG_CHARS = 200
STOP_LOW, STOP_HIGH = 0.15, 0.30
#: A larger share of link text makes a block bad.
MOST_LINKS = 0.33


@dataclass
class Block:
    text: str
    link_chars: int
    bad_place: bool
    in_article: bool
    heading: bool
    label: str = ""


def _attributes(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether the place is bad by its tag, names or role; and whether it is an article."""
    if tag in BAD_TAGS:
        return True, False
    if not attributes:
        return False, tag in ("article", "main")
    bad, article = False, tag in ("article", "main")
    for name, *values in _NAMES.findall(attributes):
        value = "".join(values).lower()
        if name.lower() in ("class", "id"):
            bad |= tag not in ("body", "html", "article", "main") and not BAD_NAMES.isdisjoint(_WORD_PARTS.findall(value))
        elif name.lower() == "role":
            bad |= value in BAD_ROLES
            article |= value in ("main", "article")
        elif name.lower() == "aria-hidden":
            bad |= value == "true"
    return bad, article


def blocks_of(page: str) -> list[Block]:
    blocks: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, bad place, in an article: as inherited
    opened: Counter[str] = Counter()
    parts: list[str] = []
    link_chars, links, at, heading = 0, 0, 0, False

    def end_block() -> None:
        nonlocal parts, link_chars
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                bad, article = stack[-1][1:] if stack else (False, False)
                blocks.append(Block(text, link_chars, bad, article, heading))
        parts, link_chars = [], 0

    def close_last() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    def add(raw: str) -> None:
        nonlocal link_chars
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            link_chars += len(text.strip())

    end = len(page)
    while at < end:
        found = page.find("<", at)
        if found < 0:
            add(page[at:])
            break
        if found > at:
            add(page[at:found])
        named = _TAG_NAME.match(page, found + 1)
        if named is None:
            at = found + 1
            if page.startswith("![CDATA[", at) and (stop := page.find("]]>", at)) >= 0:
                add(page[at + 8 : stop])
                at = stop + 3
            elif page.startswith("!--", at):
                stop = page.find("-->", at + 1)
                at = stop + 3 if stop >= 0 else end
            elif page[at : at + 1] in ("!", "?", "/"):
                stop = page.find(">", at)
                at = stop + 1 if stop >= 0 else end
            else:
                add("<")
            continue
        rest = _TAG_REST.match(page, named.end())
        at = rest.end() + 1
        if at > end:
            break  # the page ends within a tag
        tag, closing, attributes = named[1].lower(), named[0][0] == "/", rest[0]
        if not closing and tag in RAW_TAGS:
            if not attributes.endswith("/"):
                close = _CLOSE[tag].search(page, at)
                stop = page.find(">", close.end()) if close else -1
                at = stop + 1 if stop >= 0 else end
            if tag == "title":
                end_block()
            continue
        if tag in BLOCK_TAGS:
            end_block()
        if tag in VOID_TAGS:
            continue
        if closing:
            if opened[tag]:
                while close_last() != tag:
                    pass
            if tag == "a":
                links = 0
            if tag[0] == "h" and tag[1:].isdigit():
                heading = False
            continue
        if tag in BLOCK_TAGS:  # an open paragraph, item or cell ends where the next begins
            same = {"li": "li", "td": "td", "th": "th", "tr": "tr", "dd": "dd", "dt": "dt", "option": "option"}.get(tag, "p")
            for i in range(len(stack) - 1, -1, -1) if opened[same] else ():
                if stack[i][0] == same:
                    while len(stack) > i:
                        close_last()
                    break
                if stack[i][0] in _CONTAINERS:
                    break
        bad, article = _attributes(tag, attributes)
        if stack:
            bad, article = bad or stack[-1][1], article or stack[-1][2]
        if tag == "a":
            links = 1
        if tag[0] == "h" and tag[1:].isdigit():
            heading = True
        stack.append((tag, bad, article))
        opened[tag] += 1
    end_block()
    return blocks


def stop_share(text: str) -> float:
    words = _WORDS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def _nearest(decided: list[bool]) -> tuple[list[int], list[int]]:
    """For each place the nearest marked one before it and behind it, -1 where there is none."""
    n, last, following = len(decided), -1, -1
    before, after = [-1] * n, [-1] * n
    for i in range(n):
        before[i] = last
        last = i if decided[i] else last
    for i in range(n - 1, -1, -1):
        after[i] = following
        following = i if decided[i] else following
    return before, after


def label_blocks(blocks: list[Block]) -> None:
    """Pass 1 by each block itself, pass 2 by neighbours."""
    has_article = any(b.in_article and not b.bad_place for b in blocks)
    for b in blocks:
        n, share = len(b.text), stop_share(b.text)
        if b.bad_place or b.link_chars / n > MOST_LINKS or (has_article and not b.in_article):
            b.label = "bad"
        elif n < SHORT_CHARS:
            b.label = "bad" if b.link_chars and not has_article else ""
        elif share >= (STOP_LOW if n > LONG_CHARS else STOP_HIGH):
            b.label = "good"
        elif share < STOP_LOW:
            b.label = "bad" if b.link_chars and not has_article else ""
        else:
            b.label = "" if has_article else "good"
    labels = [b.label for b in blocks]
    # inside an article only decided neighbours inside of it count
    before, after = _nearest([label != "" and (not has_article or (b.in_article and not b.bad_place)) for b, label in zip(blocks, labels)])
    for i, b in enumerate(blocks):
        if labels[i]:
            continue
        one, other = before[i], after[i]
        sides = {labels[j] for j in (one, other) if j >= 0}
        if len(sides) < 2:
            b.label = next(iter(sides), "good")
        elif b.heading:  # a heading goes with what follows
            b.label = labels[other]
        else:  # the nearer side; where both are as near, the one behind in an article, else the one before
            b.label = labels[other if other - i < i - one or (has_article and other - i == i - one) else one]


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    label_blocks(blocks)
    return " ".join(b.text for b in blocks if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (main text, empty if none), n_chars (its code points) for every row.

    A null html is an empty page; null ids and urls are kept; repeated rows give repeated results; an
    empty table gives an empty one. Tags that are never closed, closed twice or crossed don't fail.
    Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "html"):
            texts = [main_text(x) if x else "" for x in column_of(part, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays([column_of(part, "page_id"), column_of(part, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
