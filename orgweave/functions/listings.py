"""Cards of exhibitor lists: one row a card. Markup needs a tree, so pages are read one by one in Arrow batches or by a table function.

Two layouts are known: `stands`, blocks with a company and its hall and stand inside a link to its site,
and `brands`, links to a profile with name, country, location and brands.
"""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import urljoin

from orgweave.functions.markup import Element, clean, tree

FIELDS = ("company", "listed_website", "country", "profile_url", "hall", "stand", "brands")
# Hosts that a card's link may lead to without being the company's.
NO_WEBSITE = ("metalexpo.com.tr", "linkedin.com", "instagram.com", "facebook.com", "youtube.com", "twitter.com", "x.com", "wa.me")
COUNTRY = "Türkiye"


def folded(value: str) -> str:
    plain = unicodedata.normalize("NFKD", clean(value)).casefold()
    return "".join(c for c in plain if not unicodedata.combining(c)).replace("ı", "i")


def website(value: str) -> str:
    value = clean(value)
    return "" if not value else f"https:{value}" if value.startswith("//") else value if "://" in value else f"https://{value}"


def _stand(block: Element) -> tuple[str, ...] | None:
    fields = [clean(x.text()) for x in block.walk() if x.has_class("text")]
    if not fields or not fields[0]:
        return None
    place = fields[1] if len(fields) > 1 else ""
    link = block.above(lambda x: x.tag == "a" and "href" in x.attributes)
    site = website(link.attributes["href"]) if link else ""
    if any(h in site.casefold() for h in NO_WEBSITE):
        site = ""
    stand = re.sub(r"^\s*HALL\s*[0-9]+\s*/?\s*", "", place, flags=re.IGNORECASE)
    hall = re.search(r"\bHALL\s*([0-9]+)\b", place, re.IGNORECASE) or re.search(r"\b([0-9]+)[A-Z]\s*[-/]", stand, re.IGNORECASE)
    return fields[0], site, "", "", hall[1] if hall else "", stand, ""


def _brands(card: Element) -> str:
    """Brands behind the card's own heading for them, up to the next heading or button."""
    heading = next((x for x in card.walk() if x.tag == "h3" and x.has_class("brand-desc-title") and folded(x.text()) == "markalar"), None)
    if heading is None:
        return ""
    values, pending = [], []
    siblings = heading.parent.parts
    for x in siblings[next(i for i, y in enumerate(siblings) if y is heading) + 1 :]:
        tag = x.tag if isinstance(x, Element) else ""
        if tag == "button" or tag.startswith("h"):
            break
        if tag == "br":
            values.append(clean(" ".join(pending)))
            pending = []
        else:
            pending.append(x.text() if isinstance(x, Element) else x)
    values.append(clean(" ".join(pending)))
    return "; ".join(dict.fromkeys(v.rstrip(",;") for v in values if v))


def _brand(card: Element, base: str) -> tuple[str, ...] | None:
    first = lambda name: next((x for x in card.walk() if x.has_class(name)), None)
    name, href = first("brand-name"), card.attributes.get("href", "")
    company = clean(name.text()) if name else ""
    if not company or not href:
        return None
    country, places = first("brand-country"), [clean(x.text()) for box in card.walk() if box.has_class("brand-location-info") for x in box.walk() if x.has_class("location-item")]
    said = lambda word: next((clean(p.split(":", 1)[1]) for p in reversed(places) if folded(p).startswith(word)), "")
    return company, "", clean(country.text()) if country else COUNTRY, urljoin(base, href), said("salon:"), said("stant:"), _brands(card)


def cards(html: str | None, base: str | None) -> list[tuple[str, ...]]:
    """FIELDS of every card of a page, in page order."""
    out = []
    for x in tree(html).walk():
        if x.has_class("katilimci-text"):
            out.append(_stand(x))
        elif x.tag == "a" and x.has_class("brand-link") and (x.attributes.get("href", "").startswith("brand/") or "/brand/" in x.attributes.get("href", "")):
            out.append(_brand(x, base or ""))
    return [x for x in out if x]
