"""Main text of web pages by block rules in two passes.

The page is read as a sequence of blocks, the text between block-level tags.  A block carries its length, the
share of its characters in links, the share of its words that are stop words, and whether an element around it
is boilerplate by its tag, role, class or id.

Pass 1 decides blocks on their own: *bad* inside boilerplate, outside the page's article if it marks one, or
mostly links; *good* if long enough with few links and enough stop words.  Everything else is *short* (too few
words to tell) or *unsure*.  Pass 2 gives these the label of their nearest decided neighbours of the same
container: equal neighbours give theirs, unequal ones the nearer, a tie counts as bad unless the page marks an
article; a heading takes that of the next.  With no decided neighbour in the container, or no good block on an
unmarked page, such blocks are good: there is nothing else to be the main text.

Defined results: null and empty html have the empty text; unclosed and mismatched tags end with the element
around them; a cut tag at the end of the page is dropped; equal pages have equal texts.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose text is never shown as text of the page.
SKIPPED = frozenset("head script style noscript template svg math iframe object embed audio video canvas textarea select option datalist title button".split())
# Those whose text runs to the end of the page if nothing ends them.
RAW = frozenset("script style textarea title".split())
# Elements of which HTML defines that they have no content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that start and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog search fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form note status".split())
# Parts of class and id names that mark boilerplate.
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot adsense banner breadcrumb breadcrumbs byline comment comments commentlist consent contact "
    "cookie cookies copyright crumbs dfp discussion disqus dropdown footer footnav gdpr hidden legal login masthead menu menubar meta modal nav navbar navigation "
    "newsletter notice notices notification offcanvas overlay pager pagination paywall popup privacy promo promotion promoted related recommended replies reply respond responses "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags tagcloud teaser toc toolbar topbar "
    "widget widgets".split()
)
ARTICLE_NAMES = frozenset("article articlebody articletext content entry maincontent post postbody posttext story storybody".split())
# Frequent words of four languages.
STOP_WORDS = frozenset(
    (
        "the of and a to in is it that for on with as be by this are was or from at an not have has he his they you we but which their "
        "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie "
        "le la les de des et un une du en que est pour qui dans sur par plus pas au avec son il ce se ne sa aux ou sont cette mais "
        "el los las y en del que por con se para una no es al lo como más su sus o este ha pero "
    ).split()
)

_LOWER = {i: i + 32 for i in range(65, 91)}


def _ascii_lower(page: str) -> str:
    """Lower case of A to Z alone, so that places stay the same."""
    return page.translate(_LOWER)


SHORT_WORDS = 6
GOOD_WORDS = 10
STOP_SHARE = 0.12
LINK_SHARE = 0.5

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"']|\Z)""", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"\S+")


@dataclass
class Element:
    tag: str
    bad: bool
    article: int  # number of the article around it, 0 for none


@dataclass
class Block:
    text: str
    bad: bool
    article: int
    heading: bool
    link_chars: int
    order: int = 0
    label: str = ""


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def _names(found: dict[str, str]) -> tuple[set[str], set[str]]:
    """Parts of the class and id names in lower case, and the whole names without punctuation."""
    whole, parts = set(), set()
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        pieces = [p.lower() for p in _NAME_PARTS.findall(name)]
        parts.update(pieces)
        whole.add("".join(pieces))
    return parts, whole


def _is_boilerplate(tag: str, found: dict[str, str], inside_article: bool) -> bool:
    if tag in BOILERPLATE_TAGS or tag == "header" and not inside_article:
        return True
    if not found:
        return False
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True
    if found.get("role", "").lower() in BOILERPLATE_ROLES:
        return True
    if tag in ("html", "body", "main", "article"):
        parts, _ = _names(found)
        return tag == "article" and bool(parts & {"comment", "comments", "reply", "related", "teaser", "promo", "ad", "sponsored"})
    parts, whole = _names(found)
    if "header" in parts and not inside_article and not parts & {"article", "entry", "post", "story"}:
        return True
    return bool((parts | whole) & BOILERPLATE_NAMES) and not whole & ARTICLE_NAMES


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, with what is around them."""
    found: list[Block] = []
    stack: list[Element] = [Element("", False, 0)]
    text: list[str] = []
    state = {"links": 0, "in_link": 0, "articles": 0}
    lower = None
    # what is open is counted, so that end tags of nothing and implied ends cost no walk through the stack
    block_places: list[int] = []
    open_blocks: Counter[str] = Counter()
    inline: list[Counter[str]] = [Counter()]  # since each open block began
    absent: set[str] = set()

    def close(i: int) -> None:
        inside = 0  # of blocks that close too, whose counts go as a whole
        for e in stack[i:]:
            if e.tag in BLOCKS:
                open_blocks[e.tag] -= 1
                inside += 1
            elif not inside:
                inline[bisect_left(block_places, i)][e.tag] -= 1
        if inside:
            del block_places[-inside:], inline[-inside:]
        del stack[i:]

    def seek(what: str) -> int:
        """The next place of what, which is not sought again once there is none."""
        place = -1 if what in absent else lower.find(what, at)
        if place < 0:
            absent.add(what)
        return place

    def add(raw: str) -> None:
        if raw:
            text.append(raw)
            if state["in_link"]:
                state["links"] += len(raw.strip())

    def end_block() -> None:
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if whole:
                top = stack[-1]
                found.append(Block(whole, top.bad, top.article, any(e.tag in HEADINGS for e in stack[-3:]), state["links"], len(found)))
        state["links"] = 0

    at = 0
    while m := _TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            add(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if m[0][1] in "!?":
            continue
        closing, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not m[0].endswith(">"):
            continue  # a tag cut by the end of the page
        tag = tag.lower()
        if closing:
            if tag == "a":
                state["in_link"] = 0
            if tag in BLOCKS:
                end_block()
            # an inline end tag closes nothing outside its block
            if (open_blocks if tag in BLOCKS else inline[-1])[tag]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag in SKIPPED and tag not in VOID:
            if raw.endswith("/"):
                continue
            lower = lower if lower is not None else page.lower() if page.isascii() else _ascii_lower(page)
            ends = [x for x in (seek(f"</{tag}"), seek("<body") if tag == "head" else -1) if x >= 0]
            if ends:
                at = min(ends)  # the end tag itself is read next, and closes nothing
            elif tag in RAW:
                at = len(page)
                break
            continue
        if tag == "br":
            add("\n")
            continue
        if tag in BLOCKS:
            end_block()
            if tag == "p" or tag in ("li", "td", "th", "tr", "dd", "dt"):
                if block_places and stack[block_places[-1]].tag == tag:
                    close(block_places[-1])
        if tag in VOID:
            continue
        around, known = stack[-1], _attributes(raw)
        article = around.article
        bad = around.bad or _is_boilerplate(tag, known, bool(article))
        if not bad and not article and (tag in ("article", "main") or known.get("role", "").lower() in ("main", "article")):
            state["articles"] += 1
            article = state["articles"]
        if tag == "a":
            state["in_link"] = 1
        if not raw.endswith("/") or tag in BLOCKS:
            stack.append(Element(tag, bad, article))
            if tag in BLOCKS:
                block_places.append(len(stack) - 1)
                open_blocks[tag] += 1
                inline.append(Counter())
            else:
                inline[-1][tag] += 1
    add(page[at:])
    end_block()
    return found


def _alone(block: Block, marked: bool) -> str:
    """Pass 1."""
    if block.bad or marked and not block.article:
        return "bad"
    n_chars = len(block.text)
    if block.link_chars > LINK_SHARE * n_chars:
        return "bad"
    found = _WORD.findall(block.text)
    if len(found) < SHORT_WORDS or block.heading:
        return "short"
    stops = sum(w.strip(".,;:!?\"'()*#$%&").lower() in STOP_WORDS for w in found)
    if len(found) >= GOOD_WORDS and block.link_chars <= 0.2 * n_chars and stops >= STOP_SHARE * len(found):
        return "good"
    return "unsure"


def classify(found: list[Block]) -> list[Block]:
    """Labels every block good or bad, in place."""
    marked = any(b.article and not b.bad for b in found)
    for b in found:
        b.label = _alone(b, marked)
    decided = ("good", "bad")
    any_good = any(b.label == "good" for b in found)
    before: list[tuple[int, str, int] | None] = []
    last: tuple[int, str, int] | None = None
    for i, b in enumerate(found):
        before.append(last)
        if b.label in decided and not (marked and not b.article):
            last = (i, b.label, b.article)
    following: tuple[int, str, int] | None = None
    labels = [b.label for b in found]
    for i in range(len(found) - 1, -1, -1):
        b = found[i]
        if b.label not in decided:
            near = [x for x in (before[i], following) if x and x[2] == b.article]
            if b.heading and following and following[2] == b.article:
                labels[i] = following[1]  # a heading belongs to what it stands above
            elif not near or not b.article and not any_good:
                labels[i] = "good"
            elif len({x[1] for x in near}) == 1:
                labels[i] = near[0][1]
            else:
                gaps = [abs(i - x[0]) for x in near]
                labels[i] = near[gaps.index(min(gaps))][1] if gaps[0] != gaps[1] else ("good" if b.article else "bad")
            if b.article and b.label == "short" and not b.link_chars:
                labels[i] = "good"  # a page's own article may hold headings and one-word paragraphs beside a list of links
        elif not (marked and not b.article):
            following = (i, b.label, b.article)
    for b, label in zip(found, labels, strict=True):
        b.label = label
    return found


def main_text(page: str | None) -> str:
    """Texts of the good blocks, joined by two newlines."""
    return "\n\n".join(b.text for b in classify(blocks(page)) if b.label == "good") if page else ""


def extract(df: DataFrame, key: str = "page_id", page: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """key, the columns of ``keep``, text, n_chars: one row for each row of df."""

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [key, *keep, "text", "n_chars"])

    of = df.select(*[F.col(f"`{c}`").alias(c) for c in (key, *keep)], F.col(f"`{page}`").alias("_html"))
    kinds = dict(of.dtypes)
    return of.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in (key, *keep)) + ", text string, n_chars long")
