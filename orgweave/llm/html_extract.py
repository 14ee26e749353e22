"""Main-text extraction by line-block distribution.

A page's markup is stripped to lines, one for each block element, in page order. Comments,
scripts, styles and form controls go with their content; so do containers whose tag, role
or class names say that they are menus, page headers, footers, sidebars, notices, adverts,
forms or reader comments. A class name counts as a whole: `sidebar` and `cookie-bar` are
noise, `no-sidebar`, `ad-free` and `search-result-article` are not, and neither is a container
around the page's `article` or `main`. Within an article a class name alone decides only about
reader comments; any other container that it names goes if its weight agrees: less than half of
the article's text lies in it, or most of its own text is links. Ids within an article are
anchors and say nothing, but for reader comments.

A line's weight is its text outside links; only an anchor with an address is a link, and the end
of a block or the next anchor closes it. Weights are summed over sliding windows of WINDOW
lines. A run goes from where the sum leaves nothing (after WINDOW lines without text) to the
dive point where it is nothing again. A run surges if a sum of it reaches SURGE; if none does, the
heaviest run counts. On a page that marks an `article` or `main`, lines outside weigh nothing, and
each marked zone with a run that counts is kept from its first heading or text to its last text.
On other pages a run that counts is kept from the surge point, its first sentence or its first line
that by itself has a window line's share of SURGE (headings right before it included), to its dive;
lines at its end that are no sentence and have less are a footer, and so are lines that say nothing
but a copyright. Behind the first such run, short runs of paragraphs that are sentences stay too.

Defined cases: null and empty html and pages without text give an empty text; character
references are decoded once; white space in a block becomes one space; `br` is white space;
unclosed elements end with their container; repeated rows are extracted each; of the other columns
those named are kept, but for columns that are called like the results.
"""

from __future__ import annotations

import html as html_lib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orgweave.llm.common import read

WINDOW = 3
SURGE = 80
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?][^>]*+>""",
    re.DOTALL,
)
_HINTS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PART = re.compile(r"[-_]+|(?<=[a-z0-9])(?=[A-Z])")
# elements whose content is raw text or a control
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "svg", "iframe", "object", "canvas", "select", "button", "audio", "video", "math", "xmp"}
_NOISE = {"nav", "footer", "aside", "form", "menu", "dialog", "head"}
_MAIN = {"article", "main"}
_BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr",
    "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
_CONTAINERS = _BLOCKS - {"p", "li", "dd", "dt", "hr", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "html", "body"} | {"span", "td", "th"}
_NOISE_HINTS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter",
    "subscribe", "subscription", "signup", "sidebar", "sidenav", "menu", "menubar", "nav", "navbar", "navigation", "breadcrumb",
    "breadcrumbs", "pagination", "pager", "footer", "masthead", "topbar", "comment", "comments", "commentlist", "disqus", "replies",
    "respond", "related", "recommended", "share", "sharing", "social", "widget", "toolbar", "login", "search", "form", "complementary",
    "contentinfo", "disclaimer", "copyright",
}
# words that turn a compound name's meaning round, and last parts of a compound that say nothing by themselves
_NOT = {"no", "not", "has", "have", "with", "without", "free", "hide", "hidden", "is", "left", "right", "two", "one", "below", "after", "before"}
_NEUTRAL = {
    "list", "box", "bar", "wrap", "wrapper", "container", "section", "area", "block", "slot", "unit", "panel", "link", "links", "inner",
    "outer", "item", "items", "row", "zone", "module", "holder", "top", "bottom", "main", "primary", "secondary", "thread", "form",
}
# noise that may itself hold article elements
_REPLIES = {"comment", "comments", "commentlist", "disqus", "replies", "respond", "related", "recommended"}
# noise wherever it stands, whatever its weight
_COMMENTS = {"comment", "comments", "commentlist", "disqus", "replies", "respond"}
_HREF = re.compile(r"\bhref\s*=", re.IGNORECASE)
_SENTENCE = re.compile(r"[.!?…:;。！？](?:[\"'”’»)\]]|\s)*$")
_PARAGRAPHS = {"p", "blockquote", "pre", "dd", "li"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_COPYRIGHT = re.compile(r"^(?:copyright\b)?\W*(?:(?:©|\(c\)).{0,80}|(?<=copyright )\d{4}.{0,80}|.{0,60}\ball rights reserved\b.{0,40})$", re.IGNORECASE)


def _names_noise(name: str, in_main: bool) -> str:
    """The noise word that a class name, id or role stands for; empty if it stands for none."""
    hints = _NOISE_HINTS if in_main else _NOISE_HINTS | {"header"}
    if name.lower() in hints:
        return name.lower()
    parts = [x.lower() for x in _PART.split(name) if x]
    if len(parts) < 2 or _NOT & set(parts):
        return ""
    if parts[-1] in hints and parts[-1] != "form":
        return parts[-1]
    return parts[0] if parts[0] in hints and all(x in _NEUTRAL or x in hints or x.isdigit() for x in parts[1:]) else ""


def _noise(tag: str, attributes: str, in_main: bool) -> str:
    """Why a container's content is not main text: `tag`, a noise word, or nothing."""
    if tag in _NOISE or (tag == "header" and not in_main):
        return "tag"
    if attributes and tag not in ("body", "html"):
        for kind, *values in _HINTS.findall(attributes):
            for name in "".join(values).split():
                found = _names_noise(name, in_main)
                anchor = in_main and kind.lower() == "id" and found not in _COMMENTS
                if found and not anchor and (tag not in _MAIN or found in _REPLIES):
                    return found
    return ""


class Line(NamedTuple):
    text: str
    weight: int  # characters outside links, without spaces
    zone: int  # which outermost article or main it is in, from 1 on; 0 for none
    heading: bool
    paragraph: bool
    doubtful: int  # which container within the zone it is in that a class name calls noise, from 1 on; 0 for none


def lines(page: str) -> list[Line]:
    """The blocks of text of a page that lie in no noise; those in doubtful containers are marked."""
    out: list[Line] = []
    parts: list[str] = []
    linked = links = 0
    # tag, the noise word it adds, whether it is an article or main, noise words that it suspends, whether it is doubtful
    open_tags: list[tuple[str, str, bool, list[str], bool]] = []
    noise: list[str] = []
    zones = main = at = doubts = 0
    doubtful: list[int] = []
    heading, paragraph, lowered = False, False, None

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                out.append(Line(text, max(0, len(text) - text.count(" ") - linked), zones if main else 0, heading, paragraph, doubtful[0] if doubtful else 0))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not noise:
            parts.append(text)
            if links:
                linked += len("".join(html_lib.unescape(text).split()))

    while True:
        found = _TAG.search(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(found[1] or found[4]), found[3] or found[6] or ""
        if tag in _RAW and not closing:
            if not attributes.endswith("/"):
                lowered = page.lower() if lowered is None else lowered
                end = lowered.find(f"</{tag}", at) if len(lowered) == len(page) else page.find(f"</{tag}", at)
                at = len(page) if end < 0 else end
            continue
        if tag in ("br", "td", "th"):
            add(" ")
        elif tag in _BLOCKS:
            flush()
            heading, paragraph = tag in _HEADINGS and not closing, tag in _PARAGRAPHS and not closing
            if closing:
                links = 0
        elif tag == "a":
            links = int(not closing and bool(_HREF.search(attributes)))
        if tag not in _CONTAINERS:
            continue
        if not closing:
            word, is_main = _noise(tag, attributes, main > 0), tag in _MAIN
            doubt = bool(word) and main > 0 and not noise and word != "tag" and word not in _COMMENTS
            if doubt:
                word = ""
            if (word or doubt) and not noise:
                flush()
            if not attributes.endswith("/"):
                # a layout's class around the first article says nothing about that
                held = noise[:] if is_main and not word and not zones and "tag" not in noise and not _REPLIES & set(noise) else []
                open_tags.append((tag, word, is_main, held, doubt))
                if held:
                    noise.clear()
                if word:
                    noise.append(word)
                if doubt:
                    doubts += 1
                    doubtful.append(doubts)
                if is_main and not noise:
                    zones += not main
                    main += 1
                elif is_main:
                    open_tags[-1] = (tag, word, False, held, doubt)
        elif any(t[0] == tag for t in open_tags):
            while True:
                popped, word, was_main, held, doubt = open_tags.pop()
                if word:
                    parts.clear()
                    noise.pop()
                if was_main or doubt:
                    flush()
                if was_main:
                    main -= 1
                if doubt:
                    doubtful.pop()
                noise.extend(held)
                if popped == tag:
                    break
    flush()
    return out


def without_doubtful(blocks: list[Line]) -> list[Line]:
    """Without the containers that a class name calls noise and whose weight agrees: under half of their zone's, or mostly links."""
    if not any(b.doubtful for b in blocks):
        return blocks
    zone_weight: dict[int, int] = {}
    own: dict[int, list[int]] = {}
    for b in blocks:
        zone_weight[b.zone] = zone_weight.get(b.zone, 0) + b.weight
        if b.doubtful:
            sums = own.setdefault(b.doubtful, [0, 0, b.zone])
            sums[0] += b.weight
            sums[1] += len(b.text) - b.text.count(" ")
    gone = {k for k, (weight, size, zone) in own.items() if 2 * weight < zone_weight[zone] or 2 * weight < size}
    return [b for b in blocks if b.doubtful not in gone]


def window_sums(weights: list[int]) -> list[int]:
    """The weight of the WINDOW lines from each line on."""
    return [sum(weights[i : i + WINDOW]) for i in range(len(weights))]


def runs(weights: list[int]) -> list[tuple[int, int, int]]:
    """(first line, end, largest window sum) of each stretch between a rise from nothing and the dive to nothing."""
    out, begin, peak = [], -1, 0
    for i, total in enumerate([*window_sums(weights), 0]):
        if total and begin < 0:
            begin, peak = i, total
        elif total:
            peak = max(peak, total)
        elif begin >= 0:
            # windows reach back over lines without weight
            while not weights[begin]:
                begin += 1
            out.append((begin, i, peak))
            begin = -1
    return out


def _bounds(blocks: list[Line], weights: list[int], first: int, end: int) -> tuple[int, int]:
    """The first line and the end of a run on an unmarked page, without the menu before it and the footer behind it."""
    heavy = [weights[i] * WINDOW >= SURGE for i in range(len(blocks))]
    said = lambda i: heavy[i] or (weights[i] > 0 and bool(_SENTENCE.search(blocks[i].text)))
    inside = [i for i in range(first, end) if said(i)]
    if not inside:
        return first, end
    begin, last = inside[0], inside[-1] + 1
    while begin > 0 and blocks[begin - 1].heading:
        begin -= 1
    return begin, last


def extract(page: str | None) -> str:
    """The main text of one page, blocks joined by two line ends."""
    blocks = without_doubtful(lines(page or ""))
    marked = any(b.zone for b in blocks)
    if not marked:
        blocks = [b for b in blocks if not _COPYRIGHT.match(b.text)]
    weights = [b.weight if b.zone or not marked else 0 for b in blocks]
    found = runs(weights)
    if not found:
        return "\n\n".join(b.text for b in blocks if b.zone or not marked)
    counted = [r for r in found if r[2] >= SURGE] or [max(found, key=lambda r: sum(weights[r[0] : r[1]]))]
    if marked:
        zones = {blocks[i].zone for first, end, _ in counted for i in range(first, end)} - {0}
        kept: list[int] = []
        for zone in sorted(zones):
            own = [i for i, b in enumerate(blocks) if b.zone == zone]
            texts = [i for i in own if weights[i]]
            begin = min([i for i in own if blocks[i].heading] + texts[:1])
            kept += [i for i in own if begin <= i <= texts[-1]]
        return "\n\n".join(blocks[i].text for i in kept)
    chosen: set[int] = set()
    for first, end, peak in counted:
        chosen.update(range(*(_bounds(blocks, weights, first, end) if peak >= SURGE else (first, end))))
    behind = counted[0][1]
    for first, end, peak in found:
        if first >= behind and peak < SURGE and counted[0][2] >= SURGE:
            chosen.update(i for i in range(first, end) if weights[i] and blocks[i].paragraph and _SENTENCE.search(blocks[i].text))
    return "\n\n".join(blocks[i].text for i in sorted(chosen))


def extract_pages(pages: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep`, text and n_chars of every row of pages, from its whole html."""
    keep = tuple(c for c in keep if c not in ("text", "n_chars"))
    kept = pages.select(F.struct(*[pages[c] for c in keep]).alias("row"), pages["html"].alias("html"))
    schema = StructType([kept.schema["row"]]).add("text", "string").add("n_chars", "long")

    def run(batches):
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "n_chars"])

    return kept.mapInArrow(run, schema).select(*[F.col("row")[c].alias(c) for c in keep], "text", "n_chars")


def op5(spark, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"), "page_id", "url")
