"""Candidates evaluated by the pages of their sites: observations, reasons, score, assessment and the fingerprint's columns.

A page is read once for each candidate of its site. What it shows is a small struct of flags and of
words found, and pages are put together by sums, maxima and sets of these, so a site of any size is
never gathered in one row. Rules then read one row a candidate. A page's whole html is read, where
the reference reads its first 50,000 characters; a name must stand on one page, not across two.

Defined cases: null html is an empty page; a candidate without pages is unreachable and scores 0; a
null name has no words and proves nothing; repeated pages count as pages of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.functions import contact as C
from orgweave.functions import evidence as E
from orgweave.functions import fuzzy
from orgweave.functions import names as N
from orgweave.functions import text as T
from orgweave.functions import url as U
from orgweave.functions import words as W
from orgweave.operators.fingerprint import EXCLUDED_ROLES, FLAGS, STRENGTHS
from orgweave.sources.shared import Scratch, spread, written

#: Pages of a site whose visible words say what kind of business it is.
KIND_PAGES = 8
_MARKERS = {m: kind for kind, markers in W.TAXONOMY.items() for m in markers}
_ALIASES = {name: sorted({" ".join(a.split()) for a in aliases}) for name, aliases in W.CONTEXTS.items()}
# what the rules read of a claim, by its field
_CLAIMED = {"names": ("name",), "brand_names": ("brand_name",), "legal_names": ("legal_name",), "related": ("related", "ownership"), "addresses": ("address",), "phones": ("phone",)}
_STRONG = {"mersis": "mersis", "tax_id": "taxid", "registry": "trade_registry"}


def visible_text(html: Column | str) -> Column:
    """A page's text without scripts, styles and tags, white space as one space."""
    no_code = F.regexp_replace(T.text_or_empty(html), r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(no_code, "<[^>]*>", " "), r"\s+", " "))


def _grams(words: Column, longest: int) -> Column:
    """Runs of 1 to `longest` words; words: a variable, as each run reads it. Runs beyond the end are null."""
    def run(n: int) -> Column:
        return F.transform(words, lambda w, i: F.concat(w, *[x for k in range(1, n) for x in (F.lit(" "), F.get(words, i + k))]))

    return F.concat(words, *[run(n) for n in range(2, longest + 1)])


def business_markers(text: Column, words: Column) -> Column:
    """Markers of the taxonomy that stand in a normalised text as words: looked up among its runs of one and two words."""
    near = T.let(words, lambda w: F.array_intersect(_grams(w, 2), N._listed(_MARKERS)))
    return F.filter(near, lambda m: F.regexp_like(text, F.concat(F.lit("(?<![a-z0-9])"), m, F.lit("(?![a-z0-9])"))))


def business_kinds(markers: Column, least: int) -> Column:
    """Kinds with `least` markers or more, in the taxonomy's order."""
    return F.array_compact(F.array(*[F.when(F.size(F.array_intersect(markers, N._listed(own))) >= least, F.lit(kind)) for kind, own in W.TAXONOMY.items()]))


def kind_decision(expected: Column, found: Column) -> Column:
    """match, conflict or unknown; a match outweighs a conflict."""
    against = F.lit(False)
    for one, others in W.INCOMPATIBLE.items():
        against = against | (F.array_contains(expected, one) & F.arrays_overlap(found, N._listed(others))) | (F.array_contains(found, one) & F.arrays_overlap(expected, N._listed(others)))
    return F.when(F.arrays_overlap(expected, found), "match").when(against, "conflict").otherwise("unknown")


def target(name: Column, about: Column) -> Column:
    """What the rules look for, once a candidate: words of the name and contexts of its record."""
    legal, brand = T.legal_tokens(name), N.primary_brand(name)
    padded = F.concat(F.lit(" "), F.array_join(T.tokens(about), " "), F.lit(" "))
    contexts = F.array_compact(F.array(*[F.when(T.has_any(padded, tuple(f" {a} " for a in aliases)), F.lit(c)) for c, aliases in _ALIASES.items()]))
    said = F.filter(T.tokens(name), lambda t: F.array_contains(N._listed(W.CONTEXT_WORDS), t))
    whole = T.normalize(F.concat_ws(" ", name, about))
    kinds = T.let(whole, lambda x: business_kinds(business_markers(x, T.tokens(x)), 1))
    return F.struct(
        T.distinctive_tokens(name).alias("distinctive"), brand.alias("brand"), N.brand_vocabulary(brand).alias("vocabulary"), legal.alias("legal"),
        said.alias("contexts"), contexts.alias("about"), kinds.alias("kinds"),
    )


def page_signals(t: Column, html: Column, for_kind: Column) -> Column:
    """What one page shows of a target; for_kind: whether its words tell the kind of business."""

    def read(p: Column) -> Column:
        text, words, joined, legal = (p[k] for k in ("text", "words", "joined", "legal"))
        stands = lambda needle: (F.size(needle) > 0) & F.contains(legal, F.concat(F.lit(" "), F.array_join(needle, " "), F.lit(" ")))
        hits = N.brand_hits_in(t["brand"], words)
        # occurrences are counted for the few aliases that stand in the text at all
        counts = [
            F.aggregate(F.array_intersect(p["aliases"], N._listed(aliases)), F.lit(0).cast("long"), lambda n, a: n + T.phrase_count(joined, a)).alias(c) for c, aliases in _ALIASES.items()
        ]
        return F.struct(
            F.filter(t["distinctive"], lambda w: F.contains(text, w)).alias("parts"),
            F.array_intersect(t["vocabulary"], words).alias("seen"),
            F.coalesce((F.size(t["brand"]) > 0) & (hits["matched"] == F.size(t["brand"])), F.lit(False)).alias("full"),
            F.coalesce(F.contains(text, F.get(t["brand"], F.lit(0))), F.lit(False)).alias("primary"),
            N.ownership_in(t["legal"], joined).alias("owned"),
            stands(t["legal"]).alias("whole"), stands(F.slice(t["legal"], 1, 4)).alias("phrase"),
            p["phone"].alias("phone"),
            text.rlike(r"\b(" + "|".join(W.COUNTRY_WORDS) + r")\b").alias("country"),
            F.filter(t["contexts"], lambda w: F.contains(text, w)).alias("contexts"),
            F.struct(*counts).alias("about"),
            p["markers"].alias("markers"),
        )

    none = F.array().cast("array<string>")
    asked = (F.size(t["contexts"]) == 0) & (F.size(t["about"]) > 0)
    every = N._listed(sorted({a for aliases in _ALIASES.values() for a in aliases}))
    whole = T.normalize(html)
    dialled = F.array_join(F.regexp_extract_all(T.text_or_empty(html), F.lit(r"""(?i)href\s*=\s*["']tel:([^"'?]+)"""), F.lit(1)), " ; ")
    shown = T.let(visible_text(html), lambda v: F.struct((F.size(C.national_phones(F.concat_ws(" ; ", v, dialled))) > 0).alias("phone"), F.when(for_kind, T.let(T.normalize(v), lambda n: business_markers(n, T.tokens(n)))).otherwise(none).alias("markers")))
    parsed = T.let(whole, lambda x: F.struct(x.alias("text"), T.tokens(x).alias("words"), shown.alias("shown")))

    def derived(p: Column) -> Column:
        words = p["words"]
        legal = F.concat(F.lit(" "), F.array_join(T._without(words, W.LEGAL_WORDS + W.JOINING_WORDS), " "), F.lit(" "))
        return F.struct(
            p["text"].alias("text"), words.alias("words"), F.array_join(words, " ").alias("joined"), legal.alias("legal"), p["shown"]["phone"].alias("phone"),
            p["shown"]["markers"].alias("markers"), F.when(asked, F.array_intersect(_grams(words, 4), every)).otherwise(none).alias("aliases"),
        )

    with_aliases = T.let(parsed, derived)
    return T.let(with_aliases, read)


def observe(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """candidates (company, node, name, about) with `t` and what all pages of their site show together.

    pages: node, place (from 0, the order in which the pages were read) and html.
    """
    wanted = candidates.select("company", "node", target(F.col("name"), F.col("about")).alias("t"))
    s = page_signals(F.col("t"), F.col("html"), F.col("place") < KIND_PAGES)
    each = wanted.join(pages.select("node", "place", "html"), "node").select("company", "node", s.alias("s"))
    union = lambda c: F.array_distinct(F.flatten(F.collect_set(f"s.{c}"))).alias(c)
    total = lambda c: F.sum(F.col(f"s.{c}").cast("long")).alias(c)
    seen = each.groupBy("company", "node").agg(
        F.count(F.lit(1)).alias("pages"), *[union(c) for c in ("parts", "seen", "contexts", "markers")], *[total(c) for c in ("full", "primary")],
        *[F.max(f"s.{c}").alias(c) for c in ("owned", "whole", "phrase", "phone", "country")], F.struct(*[F.sum(f"s.about.{c}").alias(c) for c in _ALIASES]).alias("about"),
    )
    return wanted.join(seen.select("company", "node", F.struct(*[c for c in seen.columns if c not in ("company", "node")]).alias("site")), ["company", "node"], "left")


def structured(claims: DataFrame) -> DataFrame:
    """node and `claimed`: distinct values of what a site's structured data say, and which are repeated on two pages.

    claims: node, page, field, value.
    """
    value = F.trim(T.text_or_empty("value"))
    plain = F.when(F.col("field") == "phone", C.digits(value)).otherwise(T.normalize(value))
    # a value counts once a site however many pages repeat it
    once = claims.groupBy("node", "field", value.alias("value")).agg(F.min(plain).alias("plain"), F.count_distinct("page").alias("pages"), F.min("page").alias("first"))
    by_plain = claims.where(F.col("field").isin("address", "phone") & (plain != "")).groupBy("node", "field", plain.alias("plain")).agg(F.count_distinct("page").alias("pages"))
    repeated = by_plain.where("pages >= 2").groupBy("node").agg(F.lit(True).alias("corroborated"))
    listed = lambda fields: F.array_sort(F.collect_set(F.when(F.col("field").isin(*fields) & (F.col("value") != ""), F.col("value"))))
    identifier = F.create_map(*[F.lit(x) for kv in _STRONG.items() for x in kv])[F.col("field")]
    strong = F.array_sort(F.collect_set(F.when(identifier.isNotNull() & (F.col("plain") != ""), F.concat_ws(":", identifier, "plain"))))
    found = once.groupBy("node").agg(*[listed(fields).alias(c) for c, fields in _CLAIMED.items()], strong.alias("identifiers"), F.max(F.col("field") == "url").alias("has_url"))
    joined = found.join(repeated, "node", "left")
    fields = [*_CLAIMED, "identifiers", "has_url"]
    return joined.select("node", F.struct(*fields, F.coalesce("corroborated", F.lit(False)).alias("corroborated")).alias("claimed"))


def _counted(prefix: str, hits: Column, of: Column, scope: Column | None = None) -> Column:
    """`prefix:hits/of`, with a scope behind it."""
    base = F.concat(F.lit(prefix + ":"), hits.cast("string"), F.lit("/"), of.cast("string"))
    return base if scope is None else F.concat(base, scope)


def _translated(hits: Column) -> Column:
    return F.when(hits["translated"] > 0, F.concat(F.lit(",translated="), hits["translated"].cast("string"))).otherwise("")


def page_reason(t: Column, site: Column) -> Column:
    """Points and reason for the name's words on the site's pages."""
    n, m = F.size(t["distinctive"]), F.size(t["brand"])

    def judged(x: Column) -> Column:
        hits, brand = x["hits"], x["brand"]
        pages = lambda k: F.concat(F.lit("@scope=public_brand,pages="), k.cast("string"), _translated(brand))
        give = lambda points, reason: F.struct(F.lit(points).alias("points"), reason.alias("reason"))
        every = (m > 0) & (brand["matched"] == m)
        half = (m > 0) & (brand["matched"] * 2 >= m) & (site["primary"] >= 2)
        return (
            F.when(n == 0, give(0, F.lit("no_distinctive_tokens")))
            .when(hits / n >= 0.75, give(14, _counted("page_identity_strong", hits, n)))
            .when(hits / n >= 0.5, give(8, _counted("page_identity_medium", hits, n)))
            .when(every & (site["full"] >= 2), give(14, _counted("page_identity_strong", brand["matched"], m, pages(site["full"]))))
            .when(every | half, give(8, _counted("page_identity_medium", brand["matched"], m, pages(site["primary"]))))
            .when(hits > 0, give(3, _counted("page_identity_weak", hits, n)))
            .otherwise(give(-20, _counted("page_identity_missing", F.lit(0), n)))
        )

    return T.let(F.struct(F.size(F.filter(t["distinctive"], lambda w: F.array_contains(site["parts"], w))).alias("hits"), N.brand_hits_in(t["brand"], site["seen"]).alias("brand")), judged)


def legal_reason(t: Column, site: Column) -> Column:
    n = F.size(t["legal"])
    four = F.least(n, F.lit(4)).cast("string")
    give = lambda points, reason: F.struct(F.lit(points).alias("points"), reason.alias("reason"))
    return (
        F.when(n == 0, give(0, F.lit("legal_name_phrase_unavailable")))
        .when(site["owned"], give(20, F.concat(F.lit("legal_name_ownership_match:"), four)))
        .when((n >= 3) & site["whole"], give(19, F.concat(F.lit("legal_name_full_match:"), n.cast("string"))))
        .when(site["phrase"], give(16, F.concat(F.lit("legal_name_phrase_match:"), four)))
        .otherwise(give(-8, F.concat(F.lit("legal_name_phrase_missing:0/"), four)))
    )


def country_reason(host: Column, has_phone: Column, site: Column) -> Column:
    give = lambda points, reason: F.struct(F.lit(points).alias("points"), F.lit(reason).alias("reason"))
    return (
        F.when(host.endswith(".tr"), give(8, "country_identity_tr_tld"))
        .when(has_phone | site["phone"], give(8, "country_identity_tr_phone"))
        .when(site["country"], give(5, "country_identity_tr_text"))
        .otherwise(give(-10, "country_identity_unproven"))
    )


def context_reason(t: Column, site: Column) -> Column:
    """Support by an activity in the name, else by the record's contexts; other contexts that recur are a conflict."""
    n, m = F.size(t["contexts"]), F.size(t["about"])
    counted = [F.struct(F.lit(c).alias("c"), site["about"][c].alias("n")) for c in _ALIASES]
    hits = F.filter(F.array(*counted), lambda x: F.array_contains(t["about"], x["c"]) & (x["n"] > 0))
    other = F.transform(F.filter(F.array(*counted), lambda x: ~F.array_contains(t["about"], x["c"]) & (x["n"] >= 2)), lambda x: x["c"])
    give = lambda points, reason: F.struct(F.lit(points).alias("points"), reason.alias("reason"))
    return (
        F.when((n > 0) & (F.size(site["contexts"]) > 0), give(4, _counted("context_name_match", F.size(F.filter(t["contexts"], lambda c: F.array_contains(site["contexts"], c))), n)))
        .when(n > 0, give(0, _counted("context_name_not_observed", F.lit(0), n)))
        .when(m == 0, give(0, F.lit("no_context_tokens")))
        .when(F.size(hits) > 0, give(8, _counted("context_match", F.size(hits), m)))
        .when(F.size(other) > 0, give(-20, F.concat(F.lit("metadata_context_conflict:"), F.array_join(t["about"], "+"), F.lit("/"), F.array_join(other, "+"))))
        .otherwise(give(0, _counted("metadata_context_not_observed", F.lit(0), m)))
    )


def structured_reason(name: Column, t: Column, claimed: Column) -> Column:
    """Points and reason for the owner that the site's structured data name."""
    n, m, first = F.size(t["distinctive"]), F.size(t["brand"]), F.get(t["brand"], F.lit(0))
    text = lambda c: F.array_join(claimed[c], " ")
    give = lambda points, reason: F.struct(F.lit(points).alias("points"), reason.alias("reason"))

    def judged(x: Column) -> Column:
        hits, brand = x["hits"], x["brand"]
        scope = lambda s: F.concat(F.lit(f"@scope={s}"), _translated(brand))
        return (
            F.when(hits >= n * 0.75, give(14, _counted("structured_identity_strong", hits, n)))
            .when(hits >= n * 0.5, give(8, _counted("structured_identity_medium", hits, n)))
            .when((m > 0) & (brand["matched"] == m), give(14, _counted("structured_identity_strong", brand["matched"], m, scope("public_brand"))))
            .when((brand["matched"] > 0) & (F.length(first) >= 7), give(8, _counted("structured_identity_medium", brand["matched"], m, scope("public_brand_partial"))))
            .when(hits > 0, give(3, _counted("structured_identity_weak", hits, n)))
            .otherwise(give(0, _counted("structured_identity_unmatched", F.lit(0), n)))
        )

    names = T.let(T.normalize(text("names")), lambda s: T.let(F.struct(F.size(F.filter(t["distinctive"], lambda w: F.contains(s, w))).alias("hits"), N.brand_hits_in(t["brand"], T.tokens(s)).alias("brand")), lambda x: F.when(n == 0, give(0, F.lit("structured_identity_unmatched:0/0"))).otherwise(judged(x))))
    related = (text("related") != "") & (N.legal_phrase(name, text("related")) | N.ownership_statement(name, text("related")))
    return (
        F.when(claimed.isNull(), give(0, F.lit("structured_identity_absent")))
        .when(related, give(14, F.lit("structured_identity_strong:1/1@scope=declared_relationship")))
        .when((text("legal_names") != "") & N.legal_phrase(name, text("legal_names")), give(14, F.lit("structured_identity_strong:1/1@scope=legal_name")))
        .when((F.size(claimed["names"]) == 0) & ~claimed["has_url"], give(0, F.lit("structured_identity_absent")))
        .when(F.size(claimed["names"]) == 0, give(0, F.lit("structured_identity_urls_only")))
        .otherwise(names)
    )


def email_reason(host: Column, email: Column) -> Column:
    site, box = U.compact_core(host), U.compact_core(C.email_domain(email))
    same = (site != "") & (box != "") & (F.contains(site, box) | F.contains(box, site))
    give = lambda points, reason: F.struct(F.lit(points).alias("points"), F.lit(reason).alias("reason"))
    return F.when(T.text_or_empty(email) == "", give(0, "no_email")).when(same, give(10, "email_domain_match")).otherwise(give(-12, "email_domain_mismatch"))


def ambiguous_name(name: Column) -> Column:
    """Names of up to two words that count, or half of whose words are common or short."""
    words = T.distinctive_tokens(name)
    weak = F.size(F.filter(words, lambda t: F.array_contains(N._listed(W.AMBIGUOUS_WORDS), t) | (F.length(t) <= 3)))
    return (F.size(words) <= 2) | (weak >= F.greatest(F.lit(1), F.floor(F.size(words) / 2)))


def with_ratios(candidates: DataFrame, written=written) -> DataFrame:
    """candidates (name, url) with host and the ratios of their host that the domain rules need, written once."""
    hosted = spread(candidates, "name", "url").withColumn("host", U.host("url"))
    pairs = N.ratios_needed("name", F.col("host"))
    pairs = written(hosted.select("*", *[x.alias(f"{k}_{side}") for k, pair in pairs.items() if k != "part" for side, x in zip("ab", pair, strict=True)]), "pairs")
    ratio = lambda k: fuzzy.ratio(F.col(f"{k}_a"), F.col(f"{k}_b")).alias(f"{k}_ratio")
    return written(pairs.select(*hosted.columns, ratio("prefix"), ratio("whole")), "ratios")




def _starts(c: Column, *prefixes: str) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def _level(reason: Column, prefix: str) -> Column:
    """3 for strong, 2 for medium, 1 for weak, else 0."""
    return F.when(reason.startswith(prefix + "strong"), 3).when(reason.startswith(prefix + "medium"), 2).when(reason.startswith(prefix + "weak"), 1).otherwise(0)


def evaluate(candidates: DataFrame, pages: DataFrame, claims: DataFrame) -> DataFrame:
    """One row a candidate: company, node, final_score, reasons, has_contact, gates, the assessment and the fingerprint's columns.

    candidates: company, node, name, about (sector and description), url, role, query, score, reason, official_query, final_url,
    email, email_url, phone, phone_url, places (names and websites of a business listing), listed_phone, website_proof (a profile
    of the company that names this site), verdict (of a recorded arbitration). A node has one row. pages: node, place, html.
    claims: node, page, field, value.
    """
    with Scratch(candidates.sparkSession) as scratch:
        known = with_ratios(candidates, scratch.written)
        seen = observe(known, pages)
        # dealt again: a join's few megabytes are one task, and the rules take long for each row
        joined = spread(known.join(seen, ["company", "node"]).join(structured(claims), "node", "left"), "company", "node")
        c = F.col
        t, site, claimed, host, name = c("t"), c("site"), c("claimed"), c("host"), c("name")
        has_phone = T.text_or_empty("phone") != ""
        # written once: what follows reads each reason many times
        judged = scratch.written(
            joined.select(
                *known.columns, "t", "site", "claimed", page_reason(t, site).alias("page"), legal_reason(t, site).alias("legal"), country_reason(host, has_phone, site).alias("country"),
                context_reason(t, site).alias("context"), structured_reason(name, t, claimed).alias("structured"), email_reason(host, c("email")).alias("mail"),
                N.domain_identity(name, host, c("prefix_ratio"), c("whole_ratio"))["ok"].alias("intrinsic"), N.public_brand_domain(name, host).alias("public_brand"),
                kind_decision(t["kinds"], business_kinds(F.coalesce(site["markers"], F.array().cast("array<string>")), 2)).alias("kind"), T.brand_tokens(name).alias("own_words"),
                U.compact_core(host).alias("core"), F.array_join(T.brand_tokens(name), "").alias("own_core"), ambiguous_name(name).alias("ambiguous"),
                N.activity_qualifiers(name).alias("activities"),
            ),
            "judged",
        )
        return written(_fingerprint(_assessed(_scored(judged))), "evaluations")


def _scored(judged: DataFrame) -> DataFrame:
    """judged with bonus of the context, exact_compound, reasons so far, final_score, has_contact and the two gates."""
    c = F.col
    structured, legal, page = c("structured.reason"), c("legal.reason"), c("page.reason")
    proved = _starts(structured, "structured_identity_medium:", "structured_identity_strong:") | _starts(legal, "legal_name_phrase_match:", "legal_name_full_match:", "legal_name_ownership_match:")
    exact = (F.size("own_words") >= 2) & (c("core") == c("own_core"))
    overridden = (c("context.points") < 0) & exact & proved
    points, context = F.when(overridden, 0).otherwise(c("context.points")), F.when(overridden, "metadata_context_conflict_overridden_by_exact_compound_identity").otherwise(c("context.reason"))
    has_email, has_phone = T.text_or_empty("email") != "", T.text_or_empty("phone") != ""
    base = judged.withColumns({"reachable": c("site.pages").isNotNull(), "context_points": points, "context_reason": context, "exact_compound": exact, "has_contact": has_email | has_phone, "context_failed": points < 0, "email_failed": c("mail.points") < 0})
    total = F.greatest(F.lit(0), F.least(F.lit(100), c("score") + c("page.points") + c("context_points") + c("structured.points") + c("legal.points") + c("country.points")))
    strong_contact = (has_email & (c("mail.points") > 0)) | (has_email & has_phone)
    strong_page = page.startswith("page_identity_strong")
    unresolved_owner = structured.startswith("structured_identity_unmatched:") & ~legal.startswith("legal_name_ownership_match:")
    cap = (
        F.when(~c("ambiguous") | (c("context_reason").startswith("context_match:") & strong_contact), "none")
        .when(strong_page & strong_contact, "safe")
        .when(c("exact_compound") & strong_page & proved & ~unresolved_owner, "resolved")
        .otherwise("review")
    )
    capped = base.withColumn("cap", cap).withColumn("total", total)
    score = F.when(c("cap") == "safe", F.least(c("total"), F.lit(W.SAFE_OK_MIN_SCORE))).when(c("cap") == "review", F.least(c("total"), F.lit(W.REVIEW_SCORE))).otherwise(c("total"))
    listed = F.exists(F.coalesce("places", F.array().cast("array<struct<name:string,website:string>>")), lambda p: N.business_name_identity(c("name"), p["name"]))
    same_phone = C.normalize_phone(T.text_or_empty("listed_phone")) == C.normalize_phone(T.text_or_empty("phone"))
    reasons = F.array(
        T.text_or_empty("reason"), page, c("context_reason"), c("mail.reason"), structured, legal, c("country.reason"),
        F.when(c("cap") == "resolved", "ambiguous_name_risk_resolved_by_exact_compound_identity").when(c("cap") == "review", "ambiguous_name_risk_cap"),
        F.when(~c("has_contact"), "no_tr_contact_or_usable_email"), F.when(c("context_failed"), "context_gate_failed"), F.when(c("email_failed"), "email_gate_failed"),
        F.when(c("places_name") & F.coalesce(same_phone, F.lit(False)), "google_places_first_party_phone_match"),
        F.when(c("kind") == "match", "semantic_entity_type_match").when(c("kind") == "conflict", "context_conflict:semantic_entity_type"),
    )
    done = capped.withColumn("places_name", listed)
    return done.withColumns({"final_score": F.when(c("reachable"), score).otherwise(0), "reasons": F.when(c("reachable"), F.array_compact(reasons)).otherwise(F.array(F.lit("website_fetch_failed")))})


def _assessed(scored: DataFrame) -> DataFrame:
    """scored with supports (independent ones), conflicts, publishable, strong_bundle and provisional."""
    c = F.col
    reasons = c("reasons")
    has = lambda *prefixes: F.exists(reasons, lambda r: _starts(r, *prefixes))
    empty = F.array().cast("array<string>")
    claimed = lambda k: F.coalesce(c("claimed")[k], empty)
    legal, structured = F.when(c("reachable"), c("legal.reason")).otherwise(""), F.when(c("reachable"), c("structured.reason")).otherwise("")
    brand = c("t.brand")
    page_strong, page = has("page_identity_strong:"), has("page_identity_medium:", "page_identity_strong:")
    owned, matched = legal.startswith("legal_name_ownership_match:"), _starts(legal, "legal_name_phrase_match:", "legal_name_full_match:", "legal_name_ownership_match:")
    structured_match = _starts(structured, "structured_identity_medium:", "structured_identity_strong:")
    intrinsic_reason = F.contains("reason", F.lit("domain_hits:")) & ~F.contains("reason", F.lit("search_text_identity:")) & ~F.contains("reason", F.lit("explicit_cross_domain_redirect:"))
    compound = (F.size(brand) >= 2) & (c("core") == F.array_join(brand, ""))
    anchored = F.coalesce(intrinsic_reason, F.lit(False)) | c("intrinsic") | (c("public_brand") & (compound | (page & F.array_contains(reasons, "email_domain_match"))))
    same_site = lambda u: U.registrable(U.host(u)) == U.registrable(c("host"))
    places = F.exists(F.coalesce("places", F.array().cast("array<struct<name:string,website:string>>")), lambda p: N.business_name_identity(c("name"), p["name"]) & (p["website"] != "") & same_site(p["website"]))
    bundle_match = structured.startswith("structured_identity_strong:") | (structured.startswith("structured_identity_medium:") & ~F.contains(structured, F.lit("scope=public_brand_partial")))
    first = F.get(brand, F.lit(0))
    strong_legal = owned | F.coalesce(legal.startswith("legal_name_full_match:") & (F.length(first) >= 4) & c("core").startswith(first), F.lit(False)) | (legal.startswith("legal_name_phrase_match:") & (F.substring_index(legal, ":", -1).try_cast("int") >= 2))
    identifiers = claimed("identifiers")
    two_values = F.size(F.array_distinct(F.transform(identifiers, lambda i: F.substring_index(i, ":", 1)))) < F.size(identifiers)
    number = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    parts = number(page_strong) + number(bundle_match) + number(strong_legal) + number(c("claimed.corroborated")) + number(F.size(identifiers) > 0)
    country = has("country_identity_tr_")
    site_activities = F.array_distinct(F.flatten(F.transform(claimed("names"), N.activity_qualifiers)))
    match = F.get(F.filter(reasons, lambda r: r.startswith("context_match:")), F.lit(0))
    hits, of = (F.split(F.regexp_replace(match, "^context_match:", ""), "/")[i].try_cast("int") for i in range(2))
    partial = F.coalesce((of >= 2) & (hits < of), F.lit(False))
    pre = scored.withColumns(
        {
            "domain_anchored": anchored, "bundle": parts, "site_activities": site_activities, "partial_context": partial, "country_supported": country, "strong_legal": F.coalesce(strong_legal, F.lit(False)),
            "first_party": page | structured_match | matched, "places_domain": places, "owned_name": owned,
        }
    )
    short = (F.size(brand) == 1) & (F.length(first) < 7)
    lone = c("partial_context") & ~F.arrays_overlap("activities", "site_activities") & ~c("domain_anchored") & ~c("strong_legal")
    needed = F.when(F.coalesce(short, F.lit(False)) | lone, 3).otherwise(2)
    enough = (c("bundle") >= needed) & c("country_supported")
    legal_words = ("holding", "group", "grup", "limited", "ltd", "anonim", "corporation", "corp", "inc", "llc", "sirket", "sirketi", "as")
    named_owner = (F.size(claimed("legal_names")) > 0) | F.exists(claimed("names"), lambda x: F.arrays_overlap(F.split(T.normalize(x), r"\s+"), N._listed(legal_words)))
    own_types, site_types = E.company_types(F.array("name")), E.company_types(claimed("legal_names"))
    apart = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b) & ~c("owned_name")
    conflicts = F.array_compact(
        F.array(
            F.when(c("role").isin(*EXCLUDED_ROLES), "excluded_role"), F.when(two_values, "multiple_first_party_legal_identifiers"),
            F.when(structured.startswith("structured_identity_unmatched:") & ~c("owned_name") & named_owner, "structured_owner_mismatch"),
            F.when(apart(own_types, site_types), "structured_company_type_mismatch"), F.when(apart(c("activities"), c("site_activities")), "structured_owner_context_mismatch"),
            F.when(c("partial_context") & ~enough, "partial_business_context"), F.when(has("context_conflict:", "metadata_context_conflict:"), "business_context_conflict"),
        )
    )
    supports = F.array_compact(
        F.array(
            F.when(c("query").isin("verified_entity", "verified_alias", "input_website"), "authority"), F.when(c("domain_anchored"), "domain_identity"),
            F.when(c("first_party"), "first_party_identity"), F.when(c("places_domain"), "places_identity"),
        )
    )
    done = pre.withColumns({"supports": supports, "conflicts": conflicts, "enough": enough})
    strong = c("enough") & ~F.coalesce(c("role").isin(*EXCLUDED_ROLES), F.lit(False)) & (F.size("conflicts") == 0)
    independent = (F.size("supports") >= 2) & (F.size("conflicts") == 0)
    return done.withColumns({"independent": independent, "strong_bundle": strong, "provisional": independent | strong})


def _fingerprint(assessed: DataFrame) -> DataFrame:
    """The columns that the routes read, by the names of FLAGS and STRENGTHS, beside the evaluation."""
    c = F.col
    reasons, core, host = c("reasons"), c("core"), c("host")
    reason = lambda *prefixes: F.get(F.filter(reasons, lambda r: _starts(r, *prefixes)), F.lit(0))
    count = lambda r: F.coalesce(F.nullif(F.regexp_extract(r, r":(\d+)(?:/|$)", 1), F.lit("")).try_cast("int"), F.lit(0))
    legal_reason = reason("legal_name_ownership_match:", "legal_name_full_match:", "legal_name_phrase_match:")
    legal = F.when(legal_reason.startswith("legal_name_ownership"), 4).when(legal_reason.startswith("legal_name_full"), 3).when(legal_reason.startswith("legal_name_phrase"), 2).otherwise(0)
    level = lambda prefix: F.coalesce(_level(reason(prefix), prefix), F.lit(0))
    own = c("t.legal")
    joined, first = F.array_join(own, ""), F.get(c("t.distinctive"), F.lit(0))
    rest = F.filter(F.slice(own, 2, 1000), lambda t: (F.length(t) >= 3) & (t != first))
    mixed = first.rlike("[a-z]") & first.rlike("[0-9]")
    exact = (F.length(joined) >= 7) & (core == joined)
    site_of = lambda u: U.registrable(U.host(u))
    same = lambda u: F.coalesce((T.text_or_empty(u) != "") & (site_of(c(u)) == U.registrable(host)) & (host != ""), F.lit(False))
    final = U.host(F.coalesce("final_url", "url"))
    of_names = lambda k: F.exists(F.coalesce(c("claimed")[k], F.array().cast("array<string>")), lambda x: N.business_name_identity(c("name"), x))
    known = {
        "eligible": ~F.coalesce(c("role").isin(*EXCLUDED_ROLES), F.lit(False)) & ~F.exists(U.suffixes(host), lambda s: F.array_contains(N._listed(W.EXCLUDED_DOMAINS), s)) & ~U.is_public_body(host) & ~U.is_foreign(host),
        "conflict_free": F.size("conflicts") == 0, "publishable": c("provisional"), "country": c("country_supported"), "country_phone_only": F.array_contains(reasons, "country_identity_tr_phone"),
        "page": level("page_identity_"), "structured": level("structured_identity_"), "legal": legal, "legal_count": count(legal_reason), "context_count": count(reason("context_match:", "context_name_match:")),
        "exact_brand": F.exists(N.brand_compounds("name"), lambda x: x == core), "primary_exact": ((F.length(first) >= 5) | mixed) & (core == first), "short_exact": (F.length(first) >= 4) & (core == first),
        "primary_contextual": (F.length(first) >= 5) & F.exists(rest, lambda t: core == F.concat(first, t)), "primary_anchored": (F.length(first) >= 5) & core.startswith(first) & (F.length(core) - F.length(first) >= 2),
        "same_site_contact": same("email_url") | same("phone_url"), "canonical": (final != "") & ((U.registrable(final) == U.registrable(host)) | ((joined != "") & (U.compact_core(final) == joined))),
        "semantic_match": c("kind") == "match", "semantic_conflict": c("kind") == "conflict", "relationship": legal == 4, "query": F.coalesce(c("official_query").cast("int"), F.lit(0)),
        "places_phone": c("places_name") & F.array_contains(reasons, "google_places_first_party_phone_match"), "places_business": c("places_domain"),
        "business_name": of_names("names") | of_names("brand_names") | of_names("legal_names"), "linkedin": F.coalesce("website_proof", F.lit(False)), "arbiter": F.coalesce(c("verdict") == "match", F.lit(False)),
        "sole_word": F.size(own) == 1, "exact": exact,
    }
    kept = ("company", "node", "name", "about", "role", "query_source", "host", "final_score", "reasons", "has_contact", "context_failed", "email_failed", "supports", "conflicts", "independent", "strong_bundle", "verdict", "reachable", "first_party", "public_brand", "intrinsic")
    flat = assessed.withColumn("query_source", c("query")).select(*kept, "exact_compound", "ambiguous", *[(F.coalesce(x, F.lit(False)) if k not in STRENGTHS else x).alias(k) for k, x in known.items()])
    exact_domain = c("exact") & (~c("sole_word") | (c("page") >= 2) | (c("structured") >= 2))
    flat = flat.withColumn("exact_domain", exact_domain)
    direct = ~c("relationship") & ((c("legal") >= 2) | c("exact_domain") | (c("public_brand") & ((c("page") >= 2) | (c("structured") >= 2)) & c("same_site_contact") & c("canonical")))
    flat = flat.withColumn("direct", direct)
    extra = [k for k in kept if k not in FLAGS]
    return flat.select(*extra, "exact_compound", "ambiguous", *FLAGS, *STRENGTHS)
