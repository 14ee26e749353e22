"""Values and pages as evidence: claims, golden values, page predicates, proofs of listed sites. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orgweave.functions import contact as C
from orgweave.functions import text as T
from orgweave.functions import url as U
from orgweave.functions.names import _listed

# Kinds of identifiers that prove a legal entity, words of company types, words left out of acronyms.
LEGAL_IDENTIFIERS = ("mersis", "vkn", "taxid", "vatid", "leicode", "iso6523code", "globallocationnumber", "trade_registry")
COMPANY_TYPES = {
    "limited": (" limited ", " ltd ", " limited sirket "),
    "joint_stock": (" anonim ", " a s ", " joint stock "),
    "corporation": (" corporation ", " inc ", " incorporated "),
}
SHELL_MARKERS = ('id="root"', "id='root'", 'id="app"', "id='app'", "__next", "<app-root", "<router-outlet", "<app-")
SCRIPT_MARKERS = (
    "javascript must be enabled", "enable javascript", "javascript is required", "javascript acik olmalidir", "javascript açık olmalıdır",
    "bu sayfayi goruntulemek icin javascript", "bu sayfayı görüntülemek için javascript",
)
INTERSTITIAL_MARKERS = (
    "ta strona stanowi zagro", "deceptive site ahead", "this site may contain malicious software", "privacy error", "just a moment",
    "cloudflare ray id", "cf-chl-", "attention required",
)


def company_types(names: Column) -> Column:
    """Types that any of the names says, in order."""
    padded = F.transform(names, lambda n: F.concat(F.lit(" "), T.normalize(n), F.lit(" ")))
    return F.array_compact(F.array(*[F.when(F.exists(padded, lambda n: T.has_any(n, marks)), F.lit(kind)) for kind, marks in COMPANY_TYPES.items()]))  # noqa: B023


def legal_identifiers(values: Column) -> Column:
    """kind:value of the strong identifiers among `kind:value` strings, normalised, sorted and distinct."""
    parted = F.transform(values, lambda v: F.struct(F.regexp_replace(T.normalize(F.substring_index(v, ":", 1)), " ", "").alias("kind"), F.when(F.contains(v, F.lit(":")), T.normalize(F.regexp_replace(v, "^[^:]*:", ""))).otherwise("").alias("value")))
    strong = F.filter(parted, lambda p: p["kind"].isin(*LEGAL_IDENTIFIERS) & (p["value"] != ""))
    return F.array_sort(F.array_distinct(F.transform(strong, lambda p: F.concat_ws(":", p["kind"], p["value"]))))


def claim(field: Column, value: Column, url: Column, method: Column, html: Column | None = None, first_party: bool = True, kind: str = "first_party") -> Column:
    """An auditable claim: the value as found and normalised by its field, its source and page, and what it is independent of."""
    text = F.trim(T.text_or_empty(value))
    domain = U.host(url)
    normal = F.when(field.isin("telephone", "phone"), F.regexp_replace(text, "[^0-9]", "")).when(field.isin("email", "kep"), F.lower(text)).otherwise(T.normalize(text))
    return F.struct(
        field.alias("field"), text.alias("value"), normal.alias("normalized_value"), url.alias("source_url"), domain.alias("source_domain"),
        F.lit(kind).alias("source_kind"), U.page_scope(url).alias("page_scope"), method.alias("method"),
        (F.concat(F.lit("first_party_domain:"), domain) if first_party else F.lit(kind)).alias("independence_key"),
        (F.when(F.length(html) > 0, F.sha2(html, 256)) if html is not None else F.lit(None).cast("string")).alias("source_content_sha256"),
    )


def js_shell(html: Column, visible: Column) -> Column:
    """Whether a page is an empty shell that a script fills. visible: its text without scripts and styles."""
    return (F.length(F.trim(F.regexp_replace(visible, r"\s+", " "))) < 300) & T.has_any(F.lower(T.text_or_empty(html)), SHELL_MARKERS)


def needs_render(html: Column, visible: Column) -> Column:
    """Whether a contact page has to be rendered: no contacts, and a shell or a demand for scripts."""
    bare = (F.size(C.emails(html)) == 0) & (F.size(C.phones(html)) == 0)
    return bare & (js_shell(html, visible) | T.has_any(F.lower(F.regexp_replace(visible, r"\s+", " ")), SCRIPT_MARKERS))


def interstitial(html: Column) -> Column:
    return T.has_any(F.lower(F.regexp_replace(F.regexp_replace(T.text_or_empty(html), "<[^>]+>", " "), r"\s+", " ")), INTERSTITIAL_MARKERS)


def split_values(c: Column) -> Column:
    return F.filter(F.transform(F.split(T.text_or_empty(c), r"[\n;,|]+"), lambda p: F.trim(p)), lambda p: p != "")


def golden_hosts(c: Column) -> Column:
    return F.filter(F.array_distinct(F.transform(split_values(c), U.host)), lambda h: h != "")


def golden_emails(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(T.text_or_empty(c)), F.lit(r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"), F.lit(0))


def golden_phones(c: Column) -> Column:
    """Numbers of a cell; `... 12 - 13` at the end of a number of 10 digits or more stands for two."""

    def variants(part: Column) -> Column:
        base, last = (F.regexp_extract(part, r"^(.+\b\d{1,2})\s*-\s*(\d{1,2})$", i) for i in (1, 2))
        is_range = F.length(C.digits(base)) >= 10
        return F.when(is_range, F.array(base, F.concat(F.regexp_replace(base, r"\d{1,2}\s*$", ""), last))).otherwise(F.array(part))

    def normal(v: Column) -> Column:
        digits = C.digits(v)
        return F.coalesce(C.normalize_phone(v), F.when(F.length(digits) == 10, F.concat(F.lit("0"), digits)).when(digits != "", digits))

    return F.array_distinct(F.array_compact(F.transform(F.flatten(F.transform(split_values(c), variants)), normal)))


def acronym(words: Column, core: Column) -> Column:
    """core if it is made of the first letter or two of each of two to four words, with three letters or more; else empty.

    words: those of the name that count. All 16 combinations at most are made and looked up.
    """
    four = F.filter(words, lambda w: F.length(w) >= 2)
    used = F.slice(four, 1, 4)
    widths = lambda made, w: F.flatten(F.transform(made, lambda p: F.array(F.concat(p, F.substring(w, 1, 1)), F.concat(p, F.substring(w, 1, 2)))))
    made = F.aggregate(used, F.array(F.lit("")), widths)
    return F.when(F.size(used).between(2, 4) & (F.length(core) >= 3) & F.array_contains(made, core), core).otherwise("")


def domain_token(values: Column, tokens_of, core: Column) -> Column:
    """The first word, of 3 letters or more, of the first value that has one in the domain (or the domain in it); null if none."""
    fits = lambda t: (F.length(t) >= 3) & (F.contains(core, t) | F.contains(t, core))
    return F.when(core != "", F.get(F.filter(F.flatten(F.transform(values, tokens_of)), fits), F.lit(0)))


def identity_values(company: Column, *lists: Column) -> Column:
    """A company's name and the parts of its lists of brands and representations."""
    parts = [F.filter(F.transform(F.split(T.text_or_empty(x), "[;,]"), lambda p: F.trim(p)), lambda p: p != "") for x in lists]
    return F.concat(F.array(T.text_or_empty(company)), *parts)


def is_usable_host(h: Column, excluded: tuple[str, ...]) -> Column:
    """A valid host that is neither excluded nor another country's."""
    return U.is_valid_host(h) & ~F.exists(U.suffixes(h), lambda s: F.array_contains(_listed(excluded), s)) & ~U.is_foreign(h)
