"""Table functions over pages: claims, contacts, links. Markup needs a parser, so rows are read in Arrow batches.

Each function takes pages (page_id, url, html), handles null or broken markup as a page
without findings, and gives rows in page order (`n` counts from 0 in each page).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.functions.contact import EMAIL, PHONE
from orgweave.operators.candidates import top_k

_HIDDEN = {"script", "style", "noscript", "template", "title"}
# elements that do not end a word; all others do
_INLINE = {"a", "abbr", "b", "em", "font", "i", "mark", "small", "span", "strong", "sub", "sup", "u"}


class _Page(HTMLParser):
    """Anchors, JSON-LD, item properties, hidden addresses and visible text of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.anchors: list[tuple[str, str]] = []
        self.documents: list[str] = []
        self.properties: list[tuple[str, str]] = []
        self.hidden: list[str] = []
        self.text: list[str] = []
        self.address: list[str] = []
        self._href: str | None = None
        self._label: list[str] = []
        self._json: list[str] | None = None
        self._property: str | None = None
        self._depth = self._in_address = 0

    def handle_starttag(self, tag, attrs):
        self._part(tag)
        a = dict(attrs)
        if tag == "script" and (a.get("type") or "").lower() == "application/ld+json":
            self._json = []
        elif tag in _HIDDEN:
            self._depth += 1
        elif tag == "a" and a.get("href"):
            self._close_anchor()
            self._href = a["href"].strip()
        elif tag == "address":
            self._in_address += 1
        name = a.get("itemprop") or a.get("property")
        if name:
            value = a.get("content") or (a.get("href") if tag in ("a", "link") else None)
            self._property = None if value else name
            if value:
                self.properties.append((name, value.strip()))
        if a.get("data-cfemail"):
            self.hidden.append(decode_xor(a["data-cfemail"]))

    def _close_anchor(self):
        if self._href is not None:
            self.anchors.append((self._href, " ".join("".join(self._label).split())))
        self._href, self._label = None, []

    def _part(self, tag):
        if tag not in _INLINE:
            self.text.append(" ")
            if self._in_address:
                self.address.append(" ")

    def handle_endtag(self, tag):
        self._part(tag)
        if tag == "script" and self._json is not None:
            self.documents.append("".join(self._json))
            self._json = None
        elif tag in _HIDDEN:
            self._depth = max(0, self._depth - 1)
        elif tag == "a":
            self._close_anchor()
        elif tag == "address":
            self._in_address = max(0, self._in_address - 1)

    def handle_data(self, data):
        if self._json is not None:
            self._json.append(data)
        elif not self._depth:
            self.text.append(data)
            if self._href is not None:
                self._label.append(data)
            if self._in_address:
                self.address.append(data)
            if self._property and data.strip():
                self.properties.append((self._property, " ".join(data.split())))
                self._property = None


def decode_xor(value: str) -> str:
    """An address hidden as hexadecimal bytes, the first of which masks the others; empty if it is none."""
    try:
        raw = bytes.fromhex(value)
        return bytes(b ^ raw[0] for b in raw[1:]).decode() if raw else ""
    except ValueError:
        return ""


def parse(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    page._close_anchor()
    return page


def _walk(node) -> Iterator[dict]:
    """All objects of a JSON document, outer ones first."""
    todo = [node]
    while todo:
        x = todo.pop(0)
        if isinstance(x, dict):
            yield x
            todo = [*x.values(), *todo]
        elif isinstance(x, list):
            todo = [*x, *todo]


# Fields read from structured data, and labelled identifiers in text.
FIELDS = {"legalName": "legal_name", "name": "name", "telephone": "phone", "email": "email", "url": "url", "sameAs": "same_as", "taxID": "tax_id", "vatID": "tax_id"}
OWNERS = {"Organization", "Corporation", "LocalBusiness", "Store", "Manufacturer"}
IDENTIFIERS = (("mersis", r"(?i)\bmersis\s*(?:no|numaras[ıi])?\s*[:.]?\s*([0-9]{16})\b"), ("tax_id", r"(?i)\bvergi\s*(?:no|numaras[ıi])\s*[:.]?\s*([0-9]{10})\b"), ("registry", r"(?i)\bticaret\s*sicil\s*(?:no|numaras[ıi])?\s*[:.]?\s*([0-9-]{4,12})"))
# the form of a legal name is a word: "Inch" is none
LEGAL_NAME = r"((?:[A-ZÇĞİÖŞÜ][\w.&-]*\s+){1,8}(?:A\.?\s?Ş\.?|LTD\.?\s*(?:ŞTİ\.?|STI\.?)|Ltd\.?\s*Şti\.?|GmbH|Inc\.?)(?!\w))"


def _claims(url: str | None, html: str | None) -> list[tuple[str, str, str]]:
    page, out = parse(html), []
    for document in page.documents:
        try:
            content = json.loads(document)
        except ValueError:
            continue
        for node in _walk(content):
            kinds = node.get("@type")
            if not {*(kinds if isinstance(kinds, list) else [kinds])} & OWNERS:
                continue
            for name, field in FIELDS.items():
                values = node.get(name)
                for v in values if isinstance(values, list) else [values]:
                    if isinstance(v, str | int) and str(v).strip():
                        out.append((field, str(v).strip(), "json_ld"))
    out += [(FIELDS[n.split(":")[-1]], v, "item_property") for n, v in page.properties if n.split(":")[-1] in FIELDS]
    text = " ".join("".join(page.text).split())
    out += [(field, m, "labelled") for field, pattern in IDENTIFIERS for m in re.findall(pattern, text)]
    out += [("legal_name", " ".join(m.split()), "text") for m in re.findall(LEGAL_NAME, text)]
    address = " ".join("".join(page.address).split())
    return out + ([("address", address, "address")] if address else [])


def _contacts(url: str | None, html: str | None) -> list[tuple[str, str, str]]:
    page, out = parse(html), []
    for href, label in page.anchors:
        kind, _, value = href.partition(":")
        if kind.lower() in ("mailto", "tel"):
            value = unquote(value.split("?")[0]).strip()
            if value:
                out.append(("email" if kind.lower() == "mailto" else "phone", value.lower(), label))
    out += [("email", e.lower(), "hidden") for e in page.hidden if e]
    text = " ".join("".join(page.text).split())
    for kind, pattern in (("email", EMAIL), ("phone", PHONE)):
        for m in re.finditer(pattern, text):
            out.append((kind, m[0].lower(), text[max(0, m.start() - 40) : m.start()].strip()))
    return out


# Words that make a link a likely way to contact data, best first.
WAYS = (("contact", 100), ("iletisim", 100), ("kontakt", 90), ("bize-ulasin", 90), ("about", 60), ("hakkimizda", 60), ("kurumsal", 55), ("imprint", 50), ("kvkk", 40))


def site(url: str | None) -> str | None:
    """The host of an address without www; None where the address cannot be read."""
    try:
        return urlsplit(url or "").netloc.lower().removeprefix("www.")
    except ValueError:
        return None


def _links(url: str | None, html: str | None) -> list[tuple[str, str, int, bool, bool]]:
    """(target, label, score, same site, document)"""
    out, own = [], site(url)
    for href, label in parse(html).anchors:
        try:
            target = urljoin(url or "", href)
        except ValueError:
            continue
        host = site(target)
        if host is None or urlsplit(target).scheme not in ("http", "https"):
            continue
        seen = f"{target} {label}".lower()
        score = max((s for w, s in WAYS if w in seen), default=0)
        same = bool(own) and (host == own or host.endswith("." + own))
        out.append((target.split("#")[0], label, score, same, bool(re.search(r"(?i)\.(pdf|docx?|xlsx?)($|\?)", target))))
    return out


#: Pages that are read at once.
STEP = 64


def _read(batches, f: Callable, names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """f's rows of the pages, a few pages at a time: a whole batch's html and findings would lie in a worker as Python objects."""
    for batch in (b.slice(k, STEP) for b in batches for k in range(0, b.num_rows, STEP)):
        rows = [
            (i, n, *found)
            for i, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)
            for n, found in enumerate(f(url, html))
        ]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.int64(), *kinds])], names=names)


def _table(pages: DataFrame, f: Callable, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    names = ["page_id", "n", *[x.split()[0] for x in schema.split(", ")]]
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return own.mapInArrow(lambda batches: _read(batches, f, names, kinds), f"page_id long, n long, {schema}")


def organization_claims(pages: DataFrame) -> DataFrame:
    """(field, value, method) from JSON-LD, item properties, labelled identifiers, legal names and address elements."""
    return _table(pages, _claims, "field string, value string, method string", [pa.string()] * 3)


def contact_records(pages: DataFrame) -> DataFrame:
    """(kind, value, label) of mail and telephone links, hidden addresses and addresses in the text."""
    return _table(pages, _contacts, "kind string, value string, label string", [pa.string()] * 3)


def page_links(pages: DataFrame) -> DataFrame:
    """(target, label, score, same_site, is_document) of every link to a page."""
    return _table(pages, _links, "target string, label string, score int, same_site boolean, is_document boolean", [pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_()])


def contact_links(pages: DataFrame, k: int = 5) -> DataFrame:
    """The k links of a page's own site that most likely lead to contact data (a ranking with a limit)."""
    links = page_links(pages).where("same_site and score > 0 and not is_document")
    best = links.groupBy("page_id", "target").agg(F.max("score").alias("score"), F.min("n").alias("n"))
    return top_k(best, ["page_id"], [F.desc("score"), F.asc("n")], k).select("page_id", "target", "score", F.col("rank").cast("long").alias("rank"))


def site_map(pages: DataFrame) -> DataFrame:
    """Distinct targets of a page's own site, with their first place."""
    return page_links(pages).where("same_site").groupBy("page_id", "target").agg(F.min("n").alias("n"), F.max("score").alias("score"), F.max("is_document").alias("is_document"))


def dedupe_claims(claims: DataFrame) -> DataFrame:
    """The first of equal claims on a page: same field, value without case and white space, and method."""
    from orgweave.operators.records import first_wins

    keyed = claims.withColumn("__v", F.lower(F.regexp_replace("value", r"\s+", " ")))
    return first_wins(keyed, ["page_id", "field", "__v", "method"], [F.col("n")]).drop("__v")
