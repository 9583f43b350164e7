"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags. In the first pass each block is
judged by where it stands, its stop-word density, its length and its link
density: good, bad, or undecided where it is short. In the second pass
undecided blocks take the label of the nearest decided neighbours. Good blocks
are the text. Outside a main element, long blocks of few stop words are
undecided; where no block of the page has enough of them, no list fits its
language and length and link density decide.

Cases: null or empty html gives an empty text; broken or unclosed tags end
where the next tag or the page ends; of elements without text, one that is not
closed ends at the next block tag, and such a head is read tag by tag; a page
without an article element is judged by its blocks alone; repeated rows are
extracted each; other columns are not looked at.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Function words of the languages that the block rules know. Fixed values.
STOP_WORDS = {
    "en": "the of and to a in is it that for on with as was be by are this at from or an have not but they his her you which were their has had will would there been who she he we all can more when what if so no than into its only other out up then them these some about".split(),
    "fr": "de la le les et des un une en du que qui est dans pour par sur pas au plus ne se ce il elle avec sont aux ou mais comme nous vous leur ses son sa cette été être fait a ont on tout".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde".split(),
}
#: Block-level elements, elements whose content is never text, elements around the main text. Fixed values.
BLOCKS = "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noframes ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
SILENT = "script style template noscript svg math canvas object applet iframe audio video head title select textarea button datalist map".split()
OUTSIDE = "nav header footer aside form menu dialog fieldset".split()
MAIN = ("article", "main")
#: Words of class, id or role names of parts that are not main text; chosen here after common page layouts.
OUTSIDE_NAMES = re.compile(
    r"ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pager|pagination|popup|promo\w*|related|replies|respond|search|share|sharing|sidebar|side|skip|social|sponsor\w*|subscribe|subscription|toolbar|widget\w*|contentinfo|complementary|alert", re.I
)
#: A name that begins so says something of its element's layout, not that it is a part of its own.
LAYOUT = frozenset("has no with without is not show hide".split())
#: Headers that are named after the article are its own, as are those inside the main element.
ARTICLE = frozenset("page entry post article content".split())
HEADINGS = frozenset(("header", "masthead", "banner"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Thresholds of the block rules: characters, and shares of words or characters.
SHORT, LONG, LINKS, FEW, MANY, FIT = 70, 200, 0.2, 0.10, 0.20, 0.15

#: Outside parts around a block that are told apart.
NESTED = 8

_STOP = frozenset(w for words in STOP_WORDS.values() for w in words)
_BLOCKS, _SILENT, _OUTSIDE = frozenset(BLOCKS), frozenset(SILENT), frozenset(OUTSIDE)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "select", "canvas", "object", "video", "audio", "button")}
_NEXT_BLOCK = re.compile(rf"(?=</?(?:{'|'.join(t for t in BLOCKS if t not in ('option', 'optgroup', 'legend', 'caption', 'title'))})(?![^\s/>]))", re.I)


class _Block:
    __slots__ = ("heading", "linked", "main", "outside", "paragraph", "parts", "text")

    def __init__(self, text: str, linked: int, parts: tuple, main: bool, heading: bool, paragraph: bool):
        self.text, self.linked, self.parts, self.main, self.heading, self.paragraph = text, linked, parts, main, heading, paragraph
        self.outside = bool(parts)


def _names_outside(attributes: str, main: bool) -> bool:
    """Whether a class, id or role names a part that is not main text."""
    for found in _NAMES.findall(attributes):
        for name in "".join(found).lower().split():
            words = re.split(r"[_-]+", name)
            if words[0] in LAYOUT:
                continue
            if any(OUTSIDE_NAMES.fullmatch(w) and not ((main or words[0] in ARTICLE) and w in HEADINGS) for w in words):
                return True
    return False


def _spare_wrappers(found: list[_Block], loose: set[int]) -> None:
    """Parts that are named or tagged as outside but hold the page's text are not: those around the main element, or around nearly all text where there is none."""
    has_main = any(b.main for b in found)
    total, of = 0, dict.fromkeys(loose, 0)
    for b in found:
        n = len(b.text) if not has_main or b.main else 0
        total += n
        for k in b.parts:
            if k in of:
                of[k] += n
    spared = {k for k, n in of.items() if total and n > (0.5 if has_main else 0.8) * total}
    if spared:
        for b in found:
            b.parts = tuple(k for k in b.parts if k not in spared)
            b.outside = bool(b.parts)


def blocks(page: str) -> list[_Block]:
    """The blocks with text, in page order."""
    out: list[_Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, tuple, bool]] = []  # tag, outside parts and main from here on
    # tags on the stack since each part was opened, so that the end tag of one that is not there is passed over at once
    opened: list[dict[str, int]] = [{}]
    outside: tuple = ()
    main = heading = paragraph = False
    in_link = number = 0
    loose: set[int] = set()  # outside parts that may turn out to hold the text

    def flush() -> None:
        nonlocal heading
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(_Block(text, len(" ".join("".join(linked).split())) if linked else 0, outside, main, heading, paragraph))
            parts.clear()
            linked.clear()

    def say(raw: str) -> None:
        if raw:
            text = _html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked.append(text)

    at, n = 0, len(page)
    while at < n:
        found = page.find("<", at)
        if found < 0:
            say(page[at:])
            break
        token = _TOKEN.match(page, found)
        if token is None:  # a lone <, or a quote that does not end
            token = _LOOSE.match(page, found)
        if token is None:
            say(page[at : found + 1])
            at = found + 1
            continue
        say(page[at:found])
        at = token.end()
        tag = token[2]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(token[1])
        if tag in _BLOCKS:
            flush()
            if tag[0] == "h" and tag[1:].isdigit():
                heading = not closing
            elif tag != "br":
                heading = False
            if tag != "br":
                paragraph = tag == "p" and not closing
        if not closing and tag in _SILENT:
            # raw content up to its end tag; head is only left at its end or at body
            if tag == "head":
                end = re.compile(r"</head\b[^>]*>|(?=<body\b)", re.I).search(page, at)
            else:
                end = (_RAW_END.get(tag) or re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I)).search(page, at)
            if not token[3].rstrip().endswith("/"):
                # an unclosed head is left by reading on: what is silent in it is skipped by itself
                if not end and tag != "head":
                    end = _NEXT_BLOCK.search(page, at)
                at = end.end() if end else at if tag == "head" else n
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in VOID:
            continue
        if closing:
            if opened[-1].get(tag):  # a stray end tag does not close the parts around it
                name = ""
                while name != tag:
                    name = stack.pop()[0]
                    opened[-1][name] -= 1
                    if name in _OUTSIDE or name in MAIN:
                        opened.pop()
            around = stack[-1][1:] if stack else ((), False)
            if around != (outside, main):
                flush()  # an inline element ends no block, unless it was a part of its own
            outside, main = around
        elif tag in _BLOCKS or tag in MAIN or token[3]:
            own = sure = tag in _OUTSIDE and not (tag == "header" and main)
            if tag in ("form", "fieldset"):
                sure = False
            if token[3] and tag not in ("body", "html", *MAIN):
                hidden = bool(_HIDDEN.search(token[3]))
                own, sure = own or hidden or _names_outside(token[3], main), sure or hidden
            if own and not outside:
                flush()
            if tag == "p":
                while stack and stack[-1][0] == "p":
                    opened[-1]["p"] -= 1
                    stack.pop()
                outside, main = stack[-1][1:] if stack else ((), False)
            if own:
                number += 1
                if len(outside) < NESTED:
                    outside = (*outside, number)
                    if not sure:
                        loose.add(number)
                elif outside[-1]:
                    outside = (*outside, 0)  # outside for good
            main = main or tag in MAIN
            stack.append((tag, outside, main))
            if tag in _OUTSIDE or tag in MAIN:
                opened.append({})
            opened[-1][tag] = opened[-1].get(tag, 0) + 1
    flush()
    _spare_wrappers(out, loose)
    return out


def _density(block: _Block) -> float:
    """The share of stop words."""
    words = block.text.lower().split(" ")
    return sum(map(_STOP.__contains__, words)) / len(words)


def _first_pass(block: _Block, has_main: bool, fits: bool) -> str:
    if block.outside or (has_main and not block.main):
        return "bad"
    n = len(block.text)
    if block.linked > LINKS * n and not (has_main and (block.paragraph or block.linked <= 0.5 * n)):
        return "bad"
    if n < SHORT:
        return "short"
    density = _density(block)
    if density >= MANY:
        return "good" if n > LONG else "near-good"
    if density >= FEW:
        return "near-good"
    if has_main or fits:
        return "short"
    return "good" if n > LONG else "near-good"


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    has_main = any(b.main and not b.outside for b in found)
    # over all long blocks, as a list of another language meets single blocks by chance
    long = [b for b in found if len(b.text) >= SHORT and not b.outside]
    fits = has_main or sum(_density(b) * len(b.text) for b in long) >= FIT * sum(len(b.text) for b in long)
    label = [_first_pass(b, has_main, fits) for b in found]
    n = len(found)
    # nearest decided neighbour on each side; undecided blocks follow both, or the good one inside the main element
    before, after, last = ["edge"] * n, ["edge"] * n, "edge"
    decided = {"good": "good", "near-good": "good" if has_main else "near-good", "bad": "bad"}
    for k in range(n):
        before[k] = last
        last = decided.get(label[k], last)
    last = "edge"
    for k in range(n - 1, -1, -1):
        after[k] = last
        last = decided.get(label[k], last)
    kept = []
    for k, b in enumerate(found):
        sides = {before[k], after[k]}
        if label[k] == "good":
            keep = True
        elif label[k] == "near-good":
            keep = has_main or not (sides <= {"bad"})
        elif label[k] == "short":
            if has_main:
                keep = True  # nothing but main text and what is inside it stands between
            else:
                keep = (sides == {"edge"} or after[k] in ("good", "near-good")) if b.heading else "bad" not in sides
        else:
            keep = False
        if keep:
            kept.append(b.text)
    return "\n".join(kept)


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per page row: key, url, text and n_chars (its code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["key", "url", "text", "n_chars"])

    narrow = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("page"))
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}
    return narrow.mapInArrow(run, f"key {kinds[key]}, url {kinds[url]}, text string, n_chars long").withColumnRenamed("key", key).withColumnRenamed("url", url)
