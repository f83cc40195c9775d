"""Main-text extraction from HTML by two passes over blocks.

Pass one classifies each block by the density of its stop words, its length and the density of its links:
long blocks with stop words are good, linked ones bad, short ones undecided or nearly good. Pass two gives the
ambiguous blocks the label of the nearest decided neighbours. What the markup itself names as
menu, header, footer, sidebar, notice, advert, form or comments is bad whatever its words; within an article or
main element, a short block beside good ones is kept.

A page is one row and stays in its task. Defined results: a null or empty page has the empty text;
unclosed and crossing tags, cut-off references and pages of any length are read to their end.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.common import small_batches

#: Frequent words of the corpus's languages, lower case.
STOP_WORDS = frozenset(
    """a about after all an and any are as at be been but by can for from had has have he her his if in into is it its more no not of on one or our she so some that the their them there they this to up was we were what when which who will with would you
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous
    aber als am an auf aus bei das dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so um und von vor war wie wir zu zum zur
    al con del el ella en entre era es esta este ha la las le lo los mas me mi muy no o para pero por que se si sin sobre su sus un una y ya""".split()
)
#: Elements that begin a block, whose text is never shown, and that hold no main text.
BLOCKS = frozenset("address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object embed applet canvas audio video map textarea select button datalist noframes".split())
ASIDE = frozenset("nav header footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that name what is around the text.
NAMES = frozenset("ad ads adsbygoogle advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice pagination pager popup promo promoted promotion related replies reply share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split())
ARTICLE = frozenset("article main".split())
#: An inline end tag closes nothing beyond these.
WALLS = frozenset("table article main body".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "noframes", "svg", "math")}
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")
SPLIT_NAME = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")

#: Production thresholds: characters of a short and a long block, link density, stop-word densities.
SHORT, LONG, LINKS, STOP_LOW, STOP_HIGH = 70, 200, 0.33, 0.15, 0.25


def _named_aside(attributes: str) -> bool:
    """Does class, id or role name something around the text, or is the element hidden?"""
    for name, value in NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" and value in ("", "hidden"):
            return True
        if name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id", "role") and not NAMES.isdisjoint(SPLIT_NAME.split(value)):
            return True
    return False


class Block:
    __slots__ = ("aside", "heading", "inside", "label", "linked", "text")

    def __init__(self, text: str, linked: int, aside: bool, inside: bool, heading: bool):
        self.text, self.linked, self.aside, self.inside, self.heading, self.label = text, linked, aside, inside, heading, ""


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, with white space made single."""
    found: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, whether it is aside, whether it is an article
    places: dict[str, list[int]] = {}  # where each tag stands in the stack
    walls: list[int] = []  # where those stand that an inline end tag doesn't close
    endless: set[str] = set()  # hidden tags of which no end follows
    aside = inside = links = linked = 0
    heading = False

    def close_block() -> None:
        nonlocal parts, linked, heading
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                found.append(Block(text, linked, aside > 0, inside > 0, heading))
            parts = []
        linked = 0

    def pop_to(at: int) -> None:
        nonlocal aside, inside, links
        while len(stack) > at:
            tag, was_aside, was_inside = stack.pop()
            aside -= was_aside
            inside -= was_inside
            links -= tag == "a"
            places[tag].pop()
            if walls and walls[-1] == len(stack):
                walls.pop()

    at, n = 0, len(page)
    for m in TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if links:
                linked += len(piece.strip())
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if not m[1]:
            if tag in HIDDEN:
                if tag in RAW_END and not m[3].rstrip().endswith("/"):
                    end = RAW_END[tag].search(page, at)
                    at = end.end() if end else n
                elif tag not in VOID and tag != "head" and tag not in endless:
                    end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = end.end() if end else at
                    if end is None:
                        endless.add(tag)
                parts.append(" ")
                continue
            if tag in BLOCKS:
                close_block()
                heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
                if tag == "p" and stack and stack[-1][0] == "p":
                    pop_to(len(stack) - 1)
                elif tag == "li" and stack and stack[-1][0] == "li":
                    pop_to(len(stack) - 1)
            elif tag == "br":
                parts.append(" ")
            if tag not in VOID and not m[3].rstrip().endswith("/"):
                is_aside = tag in ASIDE and not (tag == "header" and inside) or _named_aside(m[3]) and tag not in ("html", "body")
                is_article = tag in ARTICLE
                places.setdefault(tag, []).append(len(stack))
                if tag in WALLS:
                    walls.append(len(stack))
                stack.append((tag, is_aside, is_article))
                aside += is_aside
                inside += is_article
                links += tag == "a"
        else:
            if tag in BLOCKS:
                close_block()
                heading = False
            opened = places.get(tag)
            if opened and (tag in BLOCKS or not walls or walls[-1] <= opened[-1]):
                pop_to(opened[-1])
    if at < n:
        parts.append(page[at:])
    close_block()
    return found


def _first_pass(b: Block) -> str:
    size = len(b.text)
    if b.aside or "©" in b.text and size < LONG:
        return "bad"
    if b.linked > LINKS * size:
        return "bad"
    words = [w.lower() for w in WORD.findall(b.text)]
    stop = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if size < SHORT:
        return "short"
    if stop >= STOP_HIGH:
        return "good" if size > LONG else "near"
    return "near" if stop >= STOP_LOW else "good" if b.inside and not b.linked else "bad"


def _nearest(found: list[Block], labels: list[str], has_article: bool, order) -> list[str]:
    """For each block the decided label that comes last before it in ``order``, a sweep over all blocks. Before the first one, and where an article begins
    or ends, stands what the block's side of it is taken for."""
    out, label, side = [""] * len(found), "bad", None
    for i in order:
        inside = has_article and found[i].inside
        if inside != side:
            label, side = "good" if inside else "bad", inside
        out[i] = label
        if labels[i] in ("good", "bad"):
            label = labels[i]
    return out


def _second_pass(found: list[Block], labels: list[str], has_article: bool) -> list[str]:
    """Labels with the ambiguous ones decided by the nearest decided neighbours on both sides."""
    n = len(found)
    behind, ahead = _nearest(found, labels, has_article, range(n)), _nearest(found, labels, has_article, range(n - 1, -1, -1))
    second = list(labels)
    for i, label in enumerate(labels):
        if label not in ("short", "near"):
            continue
        sides = {behind[i], ahead[i]}
        if sides == {"good"} or label == "near" and "good" in sides:
            second[i] = "good"
        elif sides == {"bad"}:
            second[i] = "good" if label == "near" and (found[i].inside or not has_article) else "bad"
        else:  # between good and bad: headings go with what follows, others with an article around them
            second[i] = "good" if found[i].inside or found[i].heading and ahead[i] == "good" else "bad"
    return second


def main_text(page: str | None) -> str:
    """The page's article, blocks joined by two line ends."""
    if not page:
        return ""
    found = blocks_of(page)
    # what no article holds can't decide within one
    has_article = any(b.inside and not b.aside for b in found)
    second = _second_pass(found, [_first_pass(b) for b in found], has_article)
    kept = [b.text for b, label in zip(found, second, strict=True) if label == "good" and (b.inside or not has_article)]
    return "\n\n".join(kept)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row a page: page_id, url, text and its code points."""
    small_batches(pages.sparkSession)

    def work(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema[key].dataType.simpleString()
    out = pages.select(key, url, html).mapInArrow(work, f"page_id {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("page_id", key).withColumnRenamed("url", url)
