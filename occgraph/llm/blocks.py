"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block-level tags. The first pass judges each
block by itself: where it stands (menu, header, footer, form and so on), the
share of its characters in links, its length and its density of stop words.
Short or middling blocks stay undecided. The second pass gives those the label
of their nearest decided neighbours; the limits of an article count as decided
neighbours inside it, the limits of the page as decided against outside it.

Each row is judged by itself. Defined cases: null and empty pages give empty
text; a page without a block that is kept gives empty text; a page cut off in
the middle is read as far as it goes; repeated rows give equal results.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frequent function words of four languages.
STOP_WORDS = frozenset("""
a an and are as at be been but by for from had has have he her his i if in is it its may more not of on one or our she so than that the their them
there they this to was we were what when which who will with you your
de la le et les des en un une du que qui dans pour est par sur pas plus au aux ce ces ne se avec il elle nous vous son sa ses ou mais on leur
der die und das den von zu mit sich dem nicht ein eine als auch es werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über
el y los las con no una su para al lo como mas pero sus le ya este cuando muy sin sobre entre
""".split())

#: Elements whose text is never part of the page's text.
DROPPED = frozenset("script style noscript template svg math iframe object head canvas audio video map".split())
#: Elements around what isn't the article.
ASIDE = frozenset("nav header footer aside form menu button select textarea fieldset dialog option label".split())
ARTICLE = frozenset(["article", "main"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
INLINE = frozenset("""
a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr
""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class and id names, and roles, that name a place outside the article.
MARKS = frozenset("""
ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay newsletter
subscribe signup nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar widget related recommended share sharing social comment comments
disqus respond replies login search toolbar pagination pager skip copyright legal disclaimer alert paywall
""".split())
#: Outside an article only.
OUTER_MARKS = frozenset(["header", "top", "form"])
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.S)
_NAME_PART = re.compile(r"[^a-z0-9]+")
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Limits:
    max_link_share: float = 0.5
    short: int = 70  # characters
    long: int = 200
    stop_low: float = 0.08
    stop_high: float = 0.16


@dataclass
class Block:
    parts: list[str]
    aside: bool
    region: int  # 0: outside any article
    heading: bool
    link_chars: int = 0
    text: str = ""


def _outside(tag: str, attributes: str, in_article: bool) -> bool:
    """Does this element start a place that doesn't belong to the article?"""
    if tag in ASIDE and not (in_article and tag == "header"):
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and tag not in ("body", "html"):
            parts = set(_NAME_PART.split(value))
            if parts & MARKS or not in_article and parts & OUTER_MARKS:
                return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def page_blocks(page: str) -> list[Block]:
    """The page's blocks in order, with where they stand and how much of them is link text."""
    found: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # open containers: tag, outside the article, region
    aside, region, regions, links, breaks = False, 0, 0, 0, 0
    heading = ""
    block = Block([], False, 0, False)

    def cut() -> None:
        nonlocal block
        if block.parts:
            found.append(block)
        block = Block([], aside, region, bool(heading))

    at, end = 0, len(page)
    while at < end:
        mark = _TOKEN.search(page, at)
        upto = mark.start() if mark else end
        if upto > at:
            text = page[at:upto]
            block.parts.append(text)
            if links:
                block.link_chars += len(text)
            if not text.isspace():
                breaks = 0
        if not mark:
            break
        at = max(mark.end(), upto + 1)
        tag = mark["tag"]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(mark["end"])
        if tag in DROPPED:
            if not closing and not mark["attributes"].endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if close:
                    at = close.end()
                elif tag != "head":
                    at = end
            cut()
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag == "br":
            breaks += 1
            block.parts.append(" ")
            if breaks == 2:
                cut()
            continue
        if tag in INLINE:
            if not closing and tag != "img" and _outside(tag, mark["attributes"], region > 0):
                tag = "inline " + tag  # a container after all
            elif closing and any(x[0] == "inline " + tag for x in stack):
                tag = "inline " + tag
            else:
                continue
        links = 0 if tag not in ("li", "div", "span", "p") else links
        if closing:
            if any(x[0] == tag for x in stack):
                while stack.pop()[0] != tag:
                    pass
        elif tag not in VOID and tag != "p" and not mark["attributes"].endswith("/"):
            if tag in ARTICLE:
                while stack and stack[-1][0] in ("nav", "header", "footer", "form", "ul", "li", "a"):
                    stack.pop()  # left open before the article
                nested = any(x[2] and x[0] == "article" for x in stack)  # an article in an article is a comment on it
                regions += 1
                stack.append((tag, (stack[-1][1] if stack else False) or (nested and tag == "article") or _outside(tag, mark["attributes"], True), regions))
            else:
                within = stack[-1] if stack else ("", False, 0)
                stack.append((tag, within[1] or _outside(tag, mark["attributes"], within[2] > 0), within[2]))
        aside, region = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
        heading = tag if tag in HEADINGS and not closing else ""
        breaks = 0
        cut()
    cut()
    return found


def first_label(block: Block, has_article: bool, limits: Limits) -> str:
    """good, bad, or undecided: near (rather good) or short."""
    if block.aside or has_article and not block.region:
        return "bad"
    chars = len(block.text)
    link_share = min(1.0, block.link_chars / chars)
    if link_share > limits.max_link_share:
        return "bad"
    if not block.region and ("©" in block.text or "™" in block.text) and chars < limits.long:
        return "bad"
    if block.heading:
        return "near"
    if chars < limits.short:
        return "bad" if block.link_chars and not block.region else "short"
    words = [w.lower() for w in _WORD.findall(block.text)]
    density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if density >= limits.stop_high:
        return "good" if chars >= limits.long else "near"
    if density >= limits.stop_low or block.region:
        return "near"
    return "bad" if chars >= limits.long else "short"


def second_labels(blocks: list[Block], labels: list[str]) -> list[bool]:
    """Decide the undecided by the nearest decided blocks before and after in the same region."""
    n = len(blocks)
    before, after = [""] * n, [""] * n
    for order, out in ((range(n), before), (range(n - 1, -1, -1), after)):
        known: dict[int, str] = {}
        for i in order:
            region = blocks[i].region
            out[i] = known.get(region, "good" if region else "bad")
            if labels[i] in ("good", "bad") and not blocks[i].aside:  # what stands aside says nothing about the text around it
                known[region] = labels[i]
    kept = []
    for i, label in enumerate(labels):
        if label in ("good", "bad"):
            kept.append(label == "good")
        elif blocks[i].heading and not blocks[i].region:
            kept.append(after[i] == "good")
        else:
            sides = (before[i] == "good") + (after[i] == "good")
            kept.append(sides == 2 or sides == 1 and (label == "near" or blocks[i].region > 0))
    return kept


def main_text(page: str, limits: Limits = Limits()) -> str:
    """The page's main text: its kept blocks, white space as one space, joined by line feeds."""
    blocks = []
    for block in page_blocks(page):
        block.text = " ".join(references.unescape("".join(block.parts)).split())
        if block.text:
            blocks.append(block)
    has_article = any(b.region and not b.aside for b in blocks)
    labels = [first_label(b, has_article, limits) for b in blocks]
    return "\n".join(b.text for b, keep in zip(blocks, second_labels(blocks, labels), strict=True) if keep)


def extract_main_text(page: Column, limits: Limits = Limits()) -> Column:
    """``main_text`` of a column of pages, in Arrow batches."""

    @F.pandas_udf("string")
    def extracted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in parts:
            yield pd.Series([main_text(x or "", limits) for x in column], dtype=object)

    return extracted(page)
