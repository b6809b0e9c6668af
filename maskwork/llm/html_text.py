"""Main text of HTML pages by two-pass block rules.

Pass one decides blocks on their own: length, share of stop words, share of characters in links, and
what their elements say (navigation, footers, forms, adverts, comments and the like are never
text; an article element speaks for its blocks). Pass two gives each undecided block, mostly short
ones, the label of its nearest decided neighbours.

Text in a script or language without stop words here is judged by length and links alone. A form, or an
element named like a sidebar, that wraps the page's main text is a wrapper, and its tag and name say nothing.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of five languages.
STOP_WORDS = {
    "en": "a about after all also an and are as at be been but by can could do for from had has have he her his how i if in into is it its "
          "more my no not of on one or other our out she so some than that the their them then there they this to up was we were what when "
          "which who will with would you your",
    "de": "aber als am an auch auf aus bei bis da das dass dem den der des die dies durch ein eine einem einen einer er es für hat haben "
          "ich ihr im in ist ja kann man mehr mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war wenn "
          "werden wie wir wird zu zum zur",
    "fr": "à au aussi aux avec ce ces cette comme dans de des du elle elles en est et été être eux il ils je la le les leur lui mais même "
          "ne nous on ont ou où par pas plus pour qu que qui sa se ses si son sont sur tout un une vous y",
    "es": "a al como con cuando de del desde donde el ella en entre era es esta este está esto fue ha han hasta la las le les lo los más me "
          "muy no nos o para pero por porque que se ser si sin sobre son su sus también un una uno y ya",
    "it": "a al alla anche che chi ci come con da dal dalla dei del della delle di e è gli ha i il in io la le lo ma mi nei nel nella non o "
          "per più quando se si sono su sua suo tra un una uno",
}
# Elements by their part in a page.
RAW = "script style noscript template svg math iframe object canvas textarea select title"
AWAY = "nav aside footer form menu dialog button"
BLOCK = ("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
         "head header hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul")
VOID = "area base br col embed hr img input link meta param source track wbr"
CELLS = "td th"
# Parts of class, id and role names.
COMMENT_NAMES = "comment comments commentlist respond reply replies disqus discussion"
AWAY_NAMES = ("ad ads adbox advert advertisement advertising banner breadcrumb breadcrumbs consent contentinfo cookie cookies copyright "
              "disclaimer footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification outbrain overlay pager "
              "pagination popup privacy promo promoted promotion recommendations recommended related share sharing sidebar signup skip "
              "social sponsor sponsored subscribe taboola toolbar topbar widget widgets")
PAGE_NAMES = "header"
NEGATIONS = "has with no without"

_RAW, _AWAY, _BLOCK, _VOID, _CELLS = (frozenset(x.split()) for x in (RAW, AWAY, BLOCK, VOID, CELLS))
_COMMENTS, _NAMES, _PAGE, _NOT = (frozenset(x.split()) for x in (COMMENT_NAMES, AWAY_NAMES, PAGE_NAMES, NEGATIONS))

SHORT, LONG = 70, 200
FEW_STOPS, MANY_STOPS = 0.12, 0.25
LINKED = 0.33
WRAPPED = 0.5  # of the page's running text, in an element that is a wrapper

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>" + "|".join(sorted(_RAW)) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)",
    re.S | re.I)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
_WORD = re.compile(r"[^\W\d_]+")
_LATIN = re.compile(r"[A-Za-z\u00c0-\u024f\u1e00-\u1eff]")
_DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3\U00020000-\U0003ffff]")  # a character is about a word


class _Block:
    __slots__ = ("text", "linked", "away", "article", "heading", "label", "claims", "main", "share", "blind")

    def __init__(self, text: str, linked: int, away: bool, article: bool, heading: bool, claims: tuple = (), main: int = 0) -> None:
        self.text, self.linked, self.away, self.article, self.heading = text, linked, away, article, heading
        self.claims, self.main = claims, main
        self.label, self.share, self.blind = "", -1.0, False

    def stops(self, stops: list[frozenset]) -> float:
        if self.share < 0:
            self.share = stop_share(self.text, stops)
        return self.share

    @property
    def foreign(self) -> bool:
        """Whether most letters are of no script that a listed language has."""
        if self.text.isascii():
            return False
        letters = sum(map(len, _WORD.findall(self.text)))
        return letters > 2 * len(_LATIN.findall(self.text))

    @property
    def size(self) -> int:
        return len(self.text) + 2 * len(_DENSE.findall(self.text)) if self.blind else len(self.text)

    def running(self, stops: list[frozenset]) -> bool:
        """Long enough and with few links, and with stop words if it can have any."""
        if self.linked > LINKED * len(self.text) or self.size < SHORT:
            return False
        return self.blind or self.stops(stops) >= FEW_STOPS


def _said(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, bool, bool, bool]:
    """(away, away for articles inside too, article, hidden, comments) of an element by its names."""
    names: set[str] = set()
    hidden = main = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = values[0] or values[1] or values[2], name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif name in ("role", "itemprop"):
            main |= value.lower() in ("main", "articlebody")
            names.add(value.lower())
        elif name in ("class", "id"):
            for part in value.split():
                words = [w.lower() for w in _NAME.findall(part)]
                names.update(w for before, w in zip(["", *words], words) if before not in _NOT)
    comments = bool(names & _COMMENTS)
    away = bool(names & _NAMES) or not inside and bool(names & _PAGE)
    return hidden or comments or away, hidden or comments or "related" in names or "sidebar" in names, main, hidden, comments


def blocks_of(page: str, wrappers: frozenset = frozenset()) -> list[_Block]:
    """The page's blocks with text, in order. The tags and names of ``wrappers`` (numbers of elements) say nothing.

    A block's ``claims`` are the elements around it that send it away but may be wrappers, as (number, comments);
    its ``main`` is the number of the article around it, or 0. Hidden blocks have no claims.
    """
    found: list[_Block] = []
    # tag, away, strongly, article, claims, article's number
    stack: list[tuple[str, bool, bool, bool, tuple | None, int]] = [("", False, False, False, (), 0)]
    number = 0
    opened: dict[str, int] = {}
    pieces: list[str] = []
    state = {"linked": 0, "breaks": 0, "heading": False}

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        if text:
            _, away, _, article, claims, main = stack[-1]
            found.append(_Block(text, state["linked"], away, article, state["heading"], claims or (), main))
        pieces.clear()
        state["linked"] = state["breaks"] = 0

    def close(tag: str) -> None:
        while len(stack) > 1:
            top = stack.pop()[0]
            opened[top] -= 1
            if top == tag:
                break

    def add(text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        pieces.append(text)
        if not text.isspace():
            state["breaks"] = 0
            if opened.get("a"):
                state["linked"] += len(" ".join(text.split()))

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            pieces.append(" ")
            state["breaks"] += 1
            if state["breaks"] == 2:
                flush()
            continue
        if tag in _CELLS:
            pieces.append(" ")
        if tag in _BLOCK:
            flush()
            if opened.get("p") and not token["end"]:
                close("p")  # a block ends an open paragraph
            if tag == "li" and not token["end"] and opened.get("li") and stack[-1][0] == "li":
                close("li")
        if token["end"]:
            if opened.get(tag):
                close(tag)
        elif tag not in _VOID and not token["attr"].endswith("/"):
            _, away, strong, article, claims, inner = stack[-1]
            number += 1
            own, own_strong, main, hidden, comments = _said(tag, token["attr"], article) if token["attr"] else (False,) * 5
            sent = tag in _AWAY
            if number in wrappers:
                own = own_strong = sent = False
            elif hidden or sent and tag != "form":
                claims = None  # nothing inside can make these a wrapper
            elif claims is not None and (own or own_strong or sent) and tag not in ("html", "body"):
                claims += ((number, comments),)
            if (tag in ("article", "main") or main) and not own_strong:
                inner = number
            if tag in ("article", "main") or main:
                strong |= own_strong
                away, article = strong, not strong
            elif tag not in ("html", "body"):
                away |= own or sent or tag == "header" and not article
                strong |= own_strong or sent
            stack.append((tag, away, strong, article, claims, inner))
            opened[tag] = opened.get(tag, 0) + 1
        state["heading"] = tag in ("h1", "h2", "h3", "h4", "h5", "h6") and not token["end"]
    if at < len(page):
        add(page[at:])
    flush()
    return found


def stop_share(text: str, stops: list[frozenset]) -> float:
    """Share of stop words, in the language that has most of them."""
    words = _WORD.findall(text.lower())
    return max(sum(w in s for w in words) for s in stops) / len(words) if words else 0.0


def _blind(blocks: list[_Block], stops: list[frozenset]) -> None:
    """Marks the blocks that stop words cannot judge: those of other scripts, and all if no listed language
    has a usable share over the page's longer blocks."""
    told = size = 0.0
    for block in blocks:
        block.blind = block.foreign
        if not block.blind and not block.away and len(block.text) >= SHORT and block.linked <= LINKED * len(block.text):
            told += block.stops(stops) * len(block.text)
            size += len(block.text)
    if size and told < FEW_STOPS * size:
        for block in blocks:
            block.blind = True


def wrappers_of(blocks: list[_Block], stops: list[frozenset]) -> frozenset:
    """Numbers of elements whose tag or name would send the page's main text away.

    Such an element holds half of the running text or more: in an article inside it, where no other article
    has running text; or, if nothing else of the page is left, anywhere but in comments. One named like comments
    counts only if nothing else is left.
    """
    if not any(b.claims for b in blocks):
        return frozenset()
    running = [b for b in blocks if b.running(stops)]
    least = WRAPPED * sum(b.size for b in running)
    claims = {c for b in running for c in b.claims}
    alone = all(b.away for b in running)
    found, spare = set(), set()
    for number, comments in claims:
        mine = [b for b in running if (number, comments) in b.claims]
        inside = [b for b in mine if b.main > number]
        elsewhere = any(b.main and b not in mine and not b.away for b in running)
        if inside and not elsewhere and (alone or not comments) and sum(b.size for b in inside) >= least:
            found.add(number)
        elif alone and not comments and sum(b.size for b in mine) >= least:
            spare.add(number)
    return frozenset(found or spare)


def _decide(block: _Block, stops: list[frozenset]) -> str:
    size = block.size
    if block.away or block.linked > LINKED * len(block.text):
        return "bad"
    if size < SHORT:
        return "bad" if block.linked and not block.article else "short"
    if block.blind:
        return "good" if size >= LONG else "near"
    share = block.stops(stops)
    if block.article:
        return "good" if share >= FEW_STOPS or size >= LONG else "near"
    if share >= MANY_STOPS and size >= LONG:
        return "good"
    return "near" if share >= FEW_STOPS else "bad"


def _fate(block: _Block, near: list[tuple[int, bool, _Block]]) -> str:
    """Label of an undecided block from its nearest decided neighbours (distance, whether after, block)."""
    if not near:
        return "good" if block.article else "bad"
    labels = {n[2].label for n in near}
    if len(labels) == 1:
        return labels.pop()
    if block.label == "near" or block.article:
        return "good"
    if block.heading:
        return near[-1][2].label  # a heading goes with what follows
    least = min(n[0] for n in near)
    closest = [n[2] for n in near if n[0] == least]
    # between two at one distance, a part of the page's frame does not pull
    return "bad" if any(n.label == "bad" and not n.away for n in closest) or len(closest) == 1 and closest[0].label == "bad" else "good"


def label(blocks: list[_Block], stops: list[frozenset]) -> None:
    """Pass one, then pass two: longer undecided blocks first, so that short ones can follow them."""
    for block in blocks:
        block.label = _decide(block, stops)
    for kind in ("near", "short"):
        decided = [b.label in ("good", "bad") for b in blocks]
        around: list[list[tuple[int, bool, _Block]]] = [[] for _ in blocks]
        for after, order in ((False, range(len(blocks))), (True, range(len(blocks) - 1, -1, -1))):
            last: dict[bool, int] = {}  # a neighbour on the other side of an article's edge has no say
            for i in order:
                if decided[i]:
                    last[blocks[i].article] = i
                elif blocks[i].article in last:
                    j = last[blocks[i].article]
                    around[i].append((abs(j - i), after, blocks[j]))
        fates = [(b, _fate(b, near)) for b, near in zip(blocks, around) if b.label == kind]
        for block, fate in fates:
            block.label = fate


def main_text(page: str | None, stops: list[frozenset] | None = None) -> str:
    """The good blocks, joined by newlines; empty for a null or empty page."""
    if not page:
        return ""
    stops = stops or [frozenset(v.split()) for v in STOP_WORDS.values()]
    blocks = blocks_of(page)
    _blind(blocks, stops)
    if wrappers := wrappers_of(blocks, stops):
        blocks = blocks_of(page, wrappers)
        _blind(blocks, stops)
    label(blocks, stops)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row, in one pass. Null ids and addresses stay; other columns are ignored."""

    def run(batches):
        stops = [frozenset(v.split()) for v in STOP_WORDS.values()]
        for batch in batches:
            texts = [main_text(page, stops) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return narrow.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
