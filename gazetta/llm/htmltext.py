"""Main text of web pages by two passes over blocks.

The page is cut into blocks at block-level tags by one linear scan; scripts, styles, comments and the like go first.

The first pass decides blocks by what they hold: the share of their characters in links, their length, and the density of
stop words. Many links are bad, and so are some links among few stop words; long prose is good; short blocks, headings, and
those whose density is in between or low stay undecided. Inside an article or main element half the length is enough to
be good. The second pass gives undecided blocks the label of the nearest decided one: of the two on either side the one
in the smaller common container, then the nearer one; a heading goes with what follows it. A page that marks an article
with prose keeps to it, and to prose elsewhere that stands for itself.

Tags and names of containers (menus, forms, page footers, sidebars, adverts) are a prior: what they mark is bad, unless the
page speaks against it. A mark does not count if it would take nearly all of the page's prose and most of its text. Comments also go if
only a heading names them.

Defined results: null, empty or text-less pages have empty text; unclosed comments and scripts reach to the end; a
tag without an end is text only if no ">" follows; a quote that is never closed is no quote; white space (as Unicode has
it) inside a block is one space, line breaks too; a head ends where a tag of the body begins; repeated rows repeat their result. Time follows the page's length, whatever it holds.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

from pyspark.sql import DataFrame

from gazetta.llm.common import map_texts

#: Frequent function words of the languages served.
STOP_WORDS = {
    "en": "a about after all also an and are as at be because been but by can could did do for from had has have he her his how i if in into is it its just like more my no not of on one only or other our out over she so some than that the their them then there these they this to up was we were what when which who will with would you your",
    "de": "aber als am an auch auf aus bei bin bis da das dass dem den der des die doch du ein eine einem einen einer eines er es für hat ich ihr im in ist kein man mehr mit nach nicht noch nur ob oder sich sie sind so um und von vor war was wenn wer wie wir wird zu zum zur über",
    "fr": "à au aussi aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais me même ne nous on ou où par pas plus pour qu que qui sa se ses si son sont sur tout très tu un une vous",
    "es": "a al como con de del desde donde el ella ellos en entre era es esta este ha hay la las le lo los más me mi muy no nos o para pero por porque que se ser si sin sobre son su sus también un una y ya yo",
}
#: Tags that begin and end blocks; elements whose content is never text; containers that are never main text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
RAW_TAGS = "script style noscript template title textarea iframe svg math object canvas audio video select datalist noframes".split()
OUT_TAGS = frozenset("nav aside form footer menu dialog button head fieldset".split())
#: Those of them that are hardly ever put around a whole page; what may stand in a head.
SURE_TAGS = frozenset("nav aside footer menu".split())
HEAD_TAGS = frozenset("head title meta link base script style noscript template".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Block tags that may stay open.
LOOSE_TAGS = frozenset("p hr li dt dd tr td th option col".split())
#: Words in a container's class, id or role that say it holds no main text.
OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus donate footer form gdpr header legal login masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination popup popular promo promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tag tags teaser toc toolbar trending widget widgets complementary contentinfo search".split()
)
IN_ARTICLE = frozenset(("header", "byline"))
#: Those of them that hardly ever name a whole article; words that say the next one is only near; headings of comments.
SURE_NAMES = frozenset(
    "breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright discussion disqus footer gdpr menu menus nav navbar navigation newsletter pagination pager replies respond sidebar".split()
)
NEAR_NAMES = frozenset("with has no without".split())
COMMENTS = re.compile(r"\W*(?:\d+\s+)?(?:reader |user |leser)?(?:comments?|replies|kommentare?|commentaires?|comentarios?)(?:\s*\(?\d*\)?)?\W*", re.I)
#: The first pass: characters of a short block and of one that is long enough to be good; shares of characters in links
#: that are too many, and too many for text with few stop words; densities from which text may be prose, and from which it is.
SHORT, LONG, LINKS, FEW_LINKS, STOPS_LOW, STOPS_HIGH = 70, 140, 0.33, 0.05, 0.12, 0.2
#: A mark does not count if the prose elsewhere is less than this share of what it holds (a sure one: less than the second),
#: and it holds at least the third of the page's text.
ELSEWHERE, ELSEWHERE_SURE, MOST_TEXT = 0.25, 0.05, 0.5

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW_TAGS}
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PIECES = re.compile(r"[a-z]+|[A-Z][a-z]*")
_WORD = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    linked: int
    #: The innermost mark that the block stands in (-1: none).
    mark: int
    main: int
    heading: bool
    #: Containers that the block shares with the one before it, and those it stands in.
    shared: int = 0
    depth: int = 0
    label: str = ""
    out: bool = False


@cache
def stop_words() -> frozenset[str]:
    return frozenset(w for words in STOP_WORDS.values() for w in words.split())


@lru_cache(4096)
def _named_out(attributes: str, inside: bool = False) -> int:
    """Whether a name says that there is no main text: 2 surely, 1 perhaps, 0 no. Inside an article, its own header and byline are part of it."""
    names = OUT_NAMES - IN_ARTICLE if inside else OUT_NAMES
    found = 0
    for m in _NAMED.finditer(attributes):
        for group in (m[1] or m[2] or m[3] or "").split():
            near = False
            for word in re.split(r"[_-]+", group):
                words = {word.lower(), *(p.lower() for p in _PIECES.findall(word) if len(p) > 3)}
                if not near and words & names:
                    found = max(found, 2 if words & SURE_NAMES else 1)
                near = word.lower() in NEAR_NAMES
    return found


class Tags:
    """The tags of a page and the text between them, by one scan from left to right."""

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.quotes = True

    def end_of(self, at: int) -> int:
        """The place of the ">" that ends the tag whose name ends at at; quoted values may hold others."""
        page, i = self.page, at
        while self.quotes:
            m = _STOP.search(page, i)
            if m is None:
                self.quotes = False  # all others are inside quotes: from here on quotes do not count, so this scan is made once
                break
            i = m.end()
            if m[0] == ">":
                return m.start()
            k = m.start() - 1
            while page[k].isspace():
                k -= 1
            if page[k] == "=":
                close = page.find(m[0], i)
                i = close + 1 if close >= 0 else i
        return page.find(">", at)

    def __iter__(self) -> Iterator[tuple[str, bool, str]]:
        """Texts as ("", False, text), tags as (name, closing, attributes); comments and raw elements do not come."""
        page, n, at = self.page, len(self.page), 0
        while at < n:
            lt = page.find("<", at)
            if lt < 0 or lt > self.last:
                lt = n if lt < 0 or not page.startswith("<!--", lt) else lt
            if lt > at:
                yield "", False, page[at:lt]
            if lt >= n:
                return
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                yield "", False, " "
                continue
            if page[lt + 1] in "!?":
                at = page.find(">", lt) + 1
                yield "", False, " "
                continue
            closing = page[lt + 1] == "/"
            m = _NAME.match(page, lt + 1 + closing)
            if m is None:
                yield "", False, "<"
                at = lt + 1
                continue
            end = self.end_of(m.end())
            name, at = m[0].lower(), end + 1
            if name in _RAW_END and not closing:
                close = _RAW_END[name].search(page, at)
                at = n if close is None else (page.find(">", close.end()) + 1 or n)
                yield "", False, " "
                continue
            yield name, closing, page[m.end() : end]


class Open:
    """The open containers, with the innermost mark and article that each stands in. Closing looks only at tags that are open."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int]] = []
        self.names: dict[str, int] = {}
        self.low = 0  # fewest containers open since the last block
        #: The mark around each mark (-1: none), and whether it is sure.
        self.marks: list[tuple[int, bool]] = []

    def push(self, name: str, sure: int, main: int) -> None:
        """sure: 2 and 1 make a mark, 0 does not."""
        mark = self.state()[0]
        if sure:
            self.marks.append((mark, sure > 1))
            mark = len(self.marks) - 1
        self.stack.append((name, mark, main))
        self.names[name] = self.names.get(name, 0) + 1

    def close(self, name: str) -> None:
        while self.names.get(name):
            top = self.stack.pop()[0]
            self.names[top] -= 1
            self.low = min(self.low, len(self.stack))
            if top == name:
                return

    def top(self) -> str:
        return self.stack[-1][0] if self.stack else ""

    def state(self) -> tuple[int, int]:
        return self.stack[-1][1:] if self.stack else (-1, 0)


def blocks_of(page: str) -> tuple[list[Block], list[tuple[int, bool]]]:
    """The blocks of a page, undecided, and its marks; main is the number of the article or main element they stand in (0: none)."""
    blocks: list[Block] = []
    parts: list[str] = []
    held = Open()
    linked, in_link, mains, heading = 0, False, 0, False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                blocks.append(Block(text, linked, *held.state(), heading, held.low, len(held.stack)))
                held.low = len(held.stack)
            parts.clear()
        linked = 0

    for name, closing, rest in Tags(page):
        if not name:
            parts.append(rest)
            if in_link:
                linked += len(_SPACE.sub(" ", html.unescape(rest)).strip())
            continue
        if held.names.get("head") and name not in HEAD_TAGS and not closing:
            flush()
            held.close("head")
        main = held.state()[1]
        if name == "a":
            in_link = not closing
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in BLOCK_TAGS and name not in OUT_TAGS:
            if not closing and name not in VOID_TAGS and not rest.endswith("/") and rest and (sure := _named_out(rest, main > 0)):
                flush()
                held.push(name, sure, main)
            elif closing and held.top() == name:
                flush()
                held.close(name)
            continue
        flush()
        title = name[0] == "h" and name[1:].isdigit()
        heading = title and not closing
        if title or name in LOOSE_TAGS:
            in_link = False
            # these end without their end tags, so they hold no place unless their name says what they are
            if not closing and rest and held.top() != name and (sure := _named_out(rest, main > 0)):
                held.push(name, sure, main)
            elif held.top() == name:
                held.close(name)
            continue
        if closing:
            held.close(name)
            in_link = False
            continue
        sure = _named_out(rest, main > 0) if rest and name not in ("body", "html", *MAIN_TAGS) else 0
        if name == "article" and re.search("comment|reply", rest, re.I):
            sure = 2
        if name in OUT_TAGS or name == "header" and not main:
            sure = max(sure, 2 if name in SURE_TAGS else 1)
        if name in MAIN_TAGS and not sure:
            mains += 1
            main = mains
        held.push(name, sure, main)
    flush()
    return blocks, held.marks


def density(text: str) -> float:
    """The share of stop words among the words."""
    words = _WORD.findall(text.lower())
    return sum(map(stop_words().__contains__, words)) / len(words) if words else 0.0


def decide(block: Block) -> str:
    """The first pass, by what a block holds: good, bad, or undecided: short, near (some stop words) or thin (few)."""
    n, links = len(block.text), block.linked / len(block.text)
    if links > LINKS:
        return "bad"
    if not block.main and ("©" in block.text or "™" in block.text):
        return "bad"
    if n < SHORT or block.heading:
        return "short"
    stops = density(block.text)
    if stops >= STOPS_HIGH and n >= (LONG // 2 if block.main else LONG):
        return "good"
    if stops >= STOPS_LOW:
        return "near"
    return "bad" if links > FEW_LINKS and not block.main else "thin"


def without_comments(blocks: list[Block]) -> list[Block]:
    """The blocks but for those from a heading of comments to another heading or the end of its container, which are bad."""
    kept, depth, shared = [], -1, 1 << 30
    for b in blocks:
        if depth >= 0 and (b.shared < depth or b.heading):
            depth = -1
        if b.heading and COMMENTS.fullmatch(b.text):
            depth = b.depth
        shared = min(shared, b.shared)
        if depth >= 0:
            b.label = "bad"
        else:
            b.shared, shared = shared, 1 << 30
            kept.append(b)
    return kept


def standing(blocks: list[Block], marks: list[tuple[int, bool]]) -> None:
    """Sets out for blocks in a mark that counts. What an article element holds is prose too.

    Sure marks are tried first; the prose in those that count is no prose for the others.
    """
    if not marks:
        return
    counts = [True] * len(marks)
    inner: list[bool] = []
    for turn in (True, False):
        prose, text = [0] * (len(marks) + 1), [0] * (len(marks) + 1)
        for b in blocks:
            if turn or not (b.mark >= 0 and inner[b.mark]):
                n = len(b.text) - b.linked
                text[b.mark] += max(0, n)
                prose[b.mark] += n if b.label == "good" or b.main and b.label != "bad" else 0
        # a mark's number is above that of the one around it; -1, outside all, is the last place
        for i in range(len(marks) - 1, -1, -1):
            prose[marks[i][0]] += prose[i]
            text[marks[i][0]] += text[i]
        for i, (_, sure) in enumerate(marks):
            if sure == turn:
                least = ELSEWHERE_SURE if sure else ELSEWHERE
                counts[i] = not (prose[i] and prose[-1] - prose[i] < least * prose[i] and text[i] >= MOST_TEXT * text[-1])
        inner = []
        for i, (around, sure) in enumerate(marks):
            inner.append((counts[i] and (sure or not turn)) or (around >= 0 and inner[around]))
    for b in blocks:
        b.out = b.mark >= 0 and inner[b.mark]


def classify(page: str) -> list[Block]:
    """All blocks of a page, labelled good or bad."""
    every, marks = blocks_of(page)
    for b in every:
        b.label = decide(b)
    standing(every, marks)
    blocks = without_comments(every)
    for b in blocks:
        b.label = "bad" if b.out else b.label
    if not any(b.label == "good" for b in blocks):
        # no prose that stands for itself: blocks in an article decide, else those in between, else all that is undecided
        some = [b for b in blocks if b.main and b.label != "bad"] or [b for b in blocks if b.label == "near"] or [b for b in blocks if b.label != "bad"]
        for b in some:
            b.label = "good"
    if any(b.label == "good" and b.main for b in blocks):
        for b in blocks:
            if not b.main and b.label != "good":
                b.label = "bad"
    inherit(blocks)
    return every


def inherit(blocks: list[Block]) -> None:
    """The second pass: undecided blocks take the label of the nearest decided one, headings that of what follows them.

    Of the decided blocks on either side the one in the smaller common container counts, then the nearer one, then, but
    for thin blocks, the good one. Without any decided block all are bad.
    """
    n = len(blocks)
    # of the nearest decided block before (behind) each: how many containers they share, the distance as a negative, its label
    before: list[tuple[int, int, str] | None] = [None] * n
    behind: list[tuple[int, int, str] | None] = [None] * n
    for sides, order, turn in ((before, range(n), 0), (behind, range(n - 1, -1, -1), 1)):
        last, shared = -1, 0
        for i in order:
            step = blocks[i].shared if not turn else blocks[i + 1].shared if i + 1 < n else 0
            shared = min(shared, step)
            if last >= 0:
                sides[i] = (shared, -abs(i - last), blocks[last].label)
            if blocks[i].label in ("good", "bad"):
                last, shared = i, 1 << 30
    labels = [b.label for b in blocks]
    for i, b in enumerate(blocks):
        if b.label not in ("good", "bad"):
            near = [x for x in (before[i], behind[i]) if x is not None]
            first = "bad" if b.label == "thin" else "good"
            labels[i] = max(near, key=lambda x: (x[0], x[1], x[2] == first))[2] if near else "bad"
    follows = ""
    for i in range(n - 1, -1, -1):
        b = blocks[i]
        if b.heading and b.label not in ("good", "bad"):
            labels[i] = follows or labels[i]
        else:
            follows = labels[i]
    for b, label in zip(blocks, labels, strict=True):
        b.label = label


def main_text(page: str) -> str:
    return "\n\n".join(b.text for b in classify(page) if b.label == "good")


def html_blocks(pages: DataFrame, column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep's columns and blocks: each block's text, the characters of it in links, and its label, in page order."""

    def one(x: str) -> tuple:
        return ([{"text": b.text, "linked": b.linked, "label": b.label} for b in classify(x)],)

    return map_texts(pages, column, list(keep), lambda: one, "blocks array<struct<text:string,linked:long,label:string>>")


def extract_text(pages: DataFrame, column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep's columns, text (the main text; blocks apart by an empty line) and n_chars (its code points)."""

    def one(x: str) -> tuple:
        text = main_text(x)
        return text, len(text)

    return map_texts(pages, column, list(keep), lambda: one, "text string, n_chars long")
