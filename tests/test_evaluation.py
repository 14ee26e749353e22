"""Candidates evaluated by pages, against plain Python that reads one site after the other."""

import re
from itertools import groupby

from pyspark.sql import functions as F

from orgweave.functions import html
from orgweave.functions import names as N
from orgweave.functions import url as U
from orgweave.functions import words as W
from orgweave.operators import evaluation as V
from orgweave.operators import fingerprint as P
from orgweave.operators import registries
from orgweave.plans import evaluation_queries as Q

FOLD = str.maketrans("çğıöşüÇĞİIÖŞÜ", "cgiosucgiiosu")


def norm(x):
    return (x or "").translate(FOLD).lower()


def toks(x):
    return re.findall("[a-z0-9]+", norm(x))


def legal(x):
    return [t for t in toks(x) if t not in W.LEGAL_WORDS + W.JOINING_WORDS and len(t) > 1]


def distinctive(x):
    narrow = [t for t in toks(x) if t not in W.LEGAL_WORDS + W.SECTOR_WORDS + W.BUSINESS_WORDS and len(t) > 1]
    return narrow or [t for t in toks(x) if t not in W.LEGAL_WORDS and len(t) > 1]


def own_words(x):
    return [t for t in distinctive(x) if t not in W.BRAND_GENERIC_WORDS and len(t) > 1] or distinctive(x)


def phrase(name, text, whole=False):
    needle = legal(name) if whole else legal(name)[:4]
    return bool(needle) and f" {' '.join(needle)} " in f" {' '.join(legal(text))} "


def owned(name, text):
    words, needle = " ".join(toks(text)), " ".join(legal(name)[:4])
    places = [words.find(m) for m in W.OWNERSHIP_MARKERS if m in words]
    return bool(legal(name)) and any(needle in words[max(0, i - 240) : i + 240] for i in places)


def brand_hits(brand, words):
    anchored = bool(brand) and len(brand[0]) >= 5 and brand[0] in words
    exact = [t for t in brand if t in words]
    other = [t for t in brand if t not in words and anchored and set(W.BRAND_EQUIVALENTS.get(t, ())) & set(words)]
    return len(exact) + len(other), len(other)


def visible(x):
    x = re.sub(r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " ", x or "")
    return re.sub(r"\s+", " ", re.sub("<[^>]*>", " ", x)).strip()


def phones(x):
    found = [m for p in (r"\+?\(?[0-9][0-9 ().-]{7,}[0-9]", r"(?<!\d)(?:\+?90|0)(?:[\s().-]*\d){10}(?!\d)", r"(?<!\d)(?:0[\s().-]*)?444(?:[\s().-]*\d){4}(?!\d)") for m in re.findall(p, x)]
    return [n for n in map(phone, found) if n]


def phone(x):
    d = re.sub("^(00)?90(?=[2-58][0-9]{9}$)", "", re.sub("[^0-9]", "", x or ""))
    d = re.sub("^0", "", d)
    return d if re.fullmatch("444[0-9]{4}", d) else "0" + d if re.fullmatch("[2-58][0-9]{9}", d) else None


def markers(text):
    return {m for ms in W.TAXONOMY.values() for m in ms if re.search(rf"(?<![a-z0-9]){m}(?![a-z0-9])", text)}


def kinds(found, least):
    return [k for k, ms in W.TAXONOMY.items() if len(set(ms) & found) >= least]


def host(u):
    m = re.match(r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]+)", (u or "").strip().lower())
    return norm(re.sub(r"^www\.", "", m[1] if m else ""))


def registrable(h):
    parts = h.split(".")
    return ".".join(parts[-3:] if ".".join(parts[-2:]) in W.MULTI_PART_SUFFIXES else parts[-2:])


def compact(h):
    short = re.sub(r"(\.com\.tr|\.net\.tr|\.org\.tr|\.co\.uk)$", "", h)
    return re.sub("[^a-z0-9]", "", short if short != h else re.sub(r"\.[a-z]{2,}$", "", h))


def activities(name):
    family = W.ACTIVITIES | {a: c for c, aliases in W.CONTEXTS.items() for a in aliases if " " not in a}
    known = {*W.SECTOR_WORDS, *W.BUSINESS_WORDS, *W.CONTEXT_WORDS, *family} - set(W.NO_ACTIVITIES)
    return {family.get(t, t) for t in toks(name) if t in known}


def types(names):
    padded = [f" {norm(n)} " for n in names]
    marks = {"limited": (" limited ", " ltd ", " limited sirket "), "joint_stock": (" anonim ", " a s ", " joint stock "), "corporation": (" corporation ", " inc ", " incorporated ")}
    return {k for k, ms in marks.items() if any(m in n for m in ms for n in padded)}


def plain_evaluation(c, pages, claims, same_name, intrinsic, public_brand):
    """(score, reasons, supports, conflicts, evidence) of one candidate; pages: html in order; claims: (page, field, value)."""
    name, texts = c["name"], [norm((h or "")[:50_000]) for h in pages]
    words, brand, h = distinctive(name), distinctive(name)[:2], host(c["url"])
    text, every = " ".join(texts), [set(toks(t)) for t in texts]
    union = set().union(*every) if every else set()
    core, reasons = compact(h), [c["reason"] or ""]

    hits, (matched, translated) = sum(t in text for t in words), brand_hits(brand, union)
    full, primary = sum(bool(brand) and brand_hits(brand, w)[0] == len(brand) for w in every), sum(bool(brand) and brand[0] in t for t in texts)
    more = f",translated={translated}" if translated else ""
    if not words:
        page = 0, "no_distinctive_tokens"
    elif hits / len(words) >= 0.5:
        page = (14, f"page_identity_strong:{hits}/{len(words)}") if hits / len(words) >= 0.75 else (8, f"page_identity_medium:{hits}/{len(words)}")
    elif matched == len(brand) and full >= 2:
        page = 14, f"page_identity_strong:{matched}/{len(brand)}@scope=public_brand,pages={full}{more}"
    elif matched == len(brand) or (matched / len(brand) >= 0.5 and primary >= 2):
        page = 8, f"page_identity_medium:{matched}/{len(brand)}@scope=public_brand,pages={primary}{more}"
    else:
        page = (3, f"page_identity_weak:{hits}/{len(words)}") if hits else (-20, f"page_identity_missing:0/{len(words)}")

    said, padded = [t for t in toks(name) if t in W.CONTEXT_WORDS], f" {' '.join(toks(c['about']))} "
    about = [k for k, aliases in W.CONTEXTS.items() if any(f" {a} " in padded for a in aliases)]
    counts = {k: sum(f" {' '.join(toks(t))} ".count(f" {a} ") for t in texts for a in set(aliases)) for k, aliases in W.CONTEXTS.items()}
    shown, other = [k for k in about if counts[k]], [k for k in W.CONTEXTS if k not in about and counts[k] >= 2]
    if said:
        n = sum(t in text for t in said)
        context = (4, f"context_name_match:{n}/{len(said)}") if n else (0, f"context_name_not_observed:0/{len(said)}")
    elif not about:
        context = 0, "no_context_tokens"
    elif shown:
        context = 8, f"context_match:{len(shown)}/{len(about)}"
    else:
        context = (-20, f"metadata_context_conflict:{'+'.join(about)}/{'+'.join(other)}") if other else (0, f"metadata_context_not_observed:0/{len(about)}")

    n, four = len(legal(name)), min(len(legal(name)), 4)
    if not n:
        law = 0, "legal_name_phrase_unavailable"
    elif any(owned(name, t) for t in texts):
        law = 20, f"legal_name_ownership_match:{four}"
    elif n >= 3 and any(phrase(name, t, True) for t in texts):
        law = 19, f"legal_name_full_match:{n}"
    else:
        law = (16, f"legal_name_phrase_match:{four}") if any(phrase(name, t) for t in texts) else (-8, f"legal_name_phrase_missing:0/{four}")

    listed = lambda *fields: sorted({v.strip() for _, f, v in claims if f in fields and v.strip()})
    names, legal_names, related = listed("name"), listed("legal_name"), " ".join(listed("related", "ownership"))
    found, all_names = sum(t in norm(" ".join(names)) for t in words), norm(" ".join(names))
    b, b_translated = brand_hits(brand, toks(all_names))
    b_more = f",translated={b_translated}" if b_translated else ""
    if related and (phrase(name, related) or owned(name, related)):
        owner = 14, "structured_identity_strong:1/1@scope=declared_relationship"
    elif legal_names and phrase(name, " ".join(legal_names)):
        owner = 14, "structured_identity_strong:1/1@scope=legal_name"
    elif not names:
        owner = 0, "structured_identity_urls_only" if listed("url") else "structured_identity_absent"
    elif words and found / len(words) >= 0.5:
        owner = (14, f"structured_identity_strong:{found}/{len(words)}") if found / len(words) >= 0.75 else (8, f"structured_identity_medium:{found}/{len(words)}")
    elif brand and b == len(brand):
        owner = 14, f"structured_identity_strong:{b}/{len(brand)}@scope=public_brand{b_more}"
    elif brand and b and len(brand[0]) >= 7:
        owner = 8, f"structured_identity_medium:{b}/{len(brand)}@scope=public_brand_partial{b_more}"
    else:
        owner = (3, f"structured_identity_weak:{found}/{len(words)}") if found else (0, f"structured_identity_unmatched:0/{len(words)}")

    dialled = [" ; ".join([visible(x), " ; ".join(re.findall(r"""(?i)href\s*=\s*["']tel:([^"'?]+)""", x or ""))]) for x in pages]
    if h.endswith(".tr"):
        country = 8, "country_identity_tr_tld"
    elif c["phone"] or any(map(phones, dialled)):
        country = 8, "country_identity_tr_phone"
    else:
        country = (5, "country_identity_tr_text") if any(re.search(rf"\b({'|'.join(W.COUNTRY_WORDS)})\b", t) for t in texts) else (-10, "country_identity_unproven")

    box = compact(norm((c["email"] or "").rsplit("@", 1)[-1])) if c["email"] else ""
    mail = (0, "no_email") if not c["email"] else (10, "email_domain_match") if box and core and (box in core or core in box) else (-12, "email_domain_mismatch")

    proved = owner[1].startswith(("structured_identity_medium:", "structured_identity_strong:")) or law[1].startswith(("legal_name_phrase_match:", "legal_name_full_match:", "legal_name_ownership_match:"))
    exact = len(own_words(name)) >= 2 and core == "".join(own_words(name))
    if context[0] < 0 and exact and proved:
        context = 0, "metadata_context_conflict_overridden_by_exact_compound_identity"
    reasons += [page[1], context[1], mail[1], owner[1], law[1], country[1]]
    score = max(0, min(100, c["score"] + page[0] + context[0] + owner[0] + law[0] + country[0]))
    weak = sum(t in W.AMBIGUOUS_WORDS or len(t) <= 3 for t in words)
    contact = bool(c["email"]) and (mail[0] > 0 or bool(c["phone"]))
    if len(words) <= 2 or weak >= max(1, len(words) // 2):
        if context[1].startswith("context_match:") and contact:
            pass
        elif page[1].startswith("page_identity_strong") and contact:
            score = min(score, 85)
        elif exact and page[1].startswith("page_identity_strong") and proved and not (owner[1].startswith("structured_identity_unmatched:") and not law[1].startswith("legal_name_ownership_match:")):
            reasons.append("ambiguous_name_risk_resolved_by_exact_compound_identity")
        else:
            score = min(score, 60)
            reasons.append("ambiguous_name_risk_cap")
    reasons += ["no_tr_contact_or_usable_email"] * (not c["email"] and not c["phone"]) + ["context_gate_failed"] * (context[0] < 0) + ["email_gate_failed"] * (mail[0] < 0)
    places = [(p["website"], same_name) for p in c["places"] or []]
    listed_by = any(ok for _, ok in places)
    if listed_by and phone(c["listed_phone"]) and phone(c["listed_phone"]) == phone(c["phone"]):
        reasons.append("google_places_first_party_phone_match")
    expected = kinds(markers(norm(f"{name} {c['about']}")), 1)
    shown_kinds = kinds(set().union(*(markers(norm(visible(x))) for x in pages[:8])), 2)
    against = any(y in W.INCOMPATIBLE.get(x, ()) or x in W.INCOMPATIBLE.get(y, ()) for x in expected for y in shown_kinds)
    kind = "match" if set(expected) & set(shown_kinds) else "conflict" if against else "unknown"
    reasons += {"match": ["semantic_entity_type_match"], "conflict": ["context_conflict:semantic_entity_type"]}.get(kind, [])
    if not pages:
        score, reasons, page, context, law, owner, country = 0, ["website_fetch_failed"], (0, ""), (0, ""), (0, ""), (0, ""), (0, "")

    level = lambda x: 3 if "_strong" in x else 2 if "_medium" in x else 1 if "_weak" in x else 0
    strength = 4 if "ownership_match" in law[1] else 3 if "full_match" in law[1] else 2 if "phrase_match" in law[1] else 0
    law_count = int(law[1].split(":")[1]) if strength else 0
    has_page, owner_ok = level(page[1]) >= 2, level(owner[1]) >= 2
    anchored = (
        ("domain_hits:" in reasons_of(c) and "search_text_identity:" not in reasons_of(c) and "explicit_cross_domain_redirect:" not in reasons_of(c))
        or intrinsic or (public_brand and ((len(brand) >= 2 and core == "".join(brand)) or (has_page and "email_domain_match" in reasons)))
    )
    strong_legal = strength == 4 or (strength == 3 and bool(brand) and len(brand[0]) >= 4 and core.startswith(brand[0])) or (strength == 2 and law_count >= 2)
    kind_of = {"mersis": "mersis", "tax_id": "taxid", "registry": "trade_registry"}
    identifiers = {(kind_of[f], norm(v.strip())) for _, f, v in claims if f in kind_of and v.strip()}
    plain = lambda f, v: re.sub("[^0-9]", "", v) if f == "phone" else norm(v.strip())
    on = {}
    for p, f, v in claims:
        if f in ("address", "phone") and plain(f, v):
            on.setdefault((f, plain(f, v)), set()).add(p)
    bundle = (level(page[1]) == 3) + (level(owner[1]) == 3 or (level(owner[1]) == 2 and "public_brand_partial" not in owner[1])) + strong_legal + any(len(x) >= 2 for x in on.values()) + bool(identifiers)
    first_party = has_page or owner_ok or strength > 0
    in_country = country[1].startswith("country_identity_tr_")
    partial = context[1].startswith("context_match:") and len(about) >= 2 and len(shown) < len(about)
    site_activities = set().union(*map(activities, names)) if names else set()
    short = len(brand) == 1 and len(brand[0]) < 7
    needed = 3 if short or (partial and not activities(name) & site_activities and not anchored and not strong_legal) else 2
    enough, owner_words = bundle >= needed and in_country, "holding group grup limited ltd anonim corporation corp inc llc sirket sirketi as".split()
    apart = lambda a, b: bool(a and b and not a & b and strength != 4)
    conflicts = [
        *["excluded_role"] * (c["role"] in P.EXCLUDED_ROLES), *["multiple_first_party_legal_identifiers"] * (len({k for k, _ in identifiers}) < len(identifiers)),
        *["structured_owner_mismatch"] * (owner[1].startswith("structured_identity_unmatched:") and strength != 4 and bool(legal_names or any(set(norm(x).split()) & set(owner_words) for x in names))),
        *["structured_company_type_mismatch"] * apart(types([name]), types(legal_names)), *["structured_owner_context_mismatch"] * apart(activities(name), site_activities),
        *["partial_business_context"] * (partial and not enough), *["business_context_conflict"] * any(r.startswith(("context_conflict:", "metadata_context_conflict:")) for r in reasons),
    ]
    same_site = lambda u: bool(u) and bool(h) and registrable(host(u)) == registrable(h)
    business = any(ok and same_site(w) for w, ok in places)
    supports = [*["authority"] * (c["query"] in ("verified_entity", "verified_alias", "input_website")), *["domain_identity"] * bool(anchored), *["first_party_identity"] * first_party, *["places_identity"] * business]
    independent, strong = len(supports) >= 2 and not conflicts, enough and c["role"] not in P.EXCLUDED_ROLES and not conflicts
    joined, first = "".join(legal(name)), (brand or [""])[0]
    final, contacts = host(c["final_url"] or c["url"]), [c["email_url"], c["phone_url"]]
    canonical = bool(final) and (registrable(final) == registrable(h) or (joined != "" and compact(final) == joined))
    exact_domain = len(joined) >= 7 and core == joined and (len(legal(name)) != 1 or level(page[1]) >= 2 or level(owner[1]) >= 2)
    evidence = {
        "reachable": bool(pages), "first_party": first_party, "country": in_country, "country_phone_only": country[1] == "country_identity_tr_phone", "conflict_free": not conflicts, "publishable": independent or strong,
        "exact_domain": exact_domain, "exact_brand": core in {"".join(brand), *("".join(e if j == i else u for j, u in enumerate(brand)) for i, t in enumerate(brand) for e in W.BRAND_EQUIVALENTS.get(t, ()))} - {""},
        "primary_exact": bool(first) and (len(first) >= 5 or (bool(re.search("[a-z]", first)) and bool(re.search("[0-9]", first)))) and core == first, "short_exact": len(first) >= 4 and core == first,
        "primary_contextual": len(first) >= 5 and any(core == first + t for t in legal(name)[1:] if len(t) >= 3 and t != first), "primary_anchored": len(first) >= 5 and core.startswith(first) and len(core) - len(first) >= 2,
        "same_site_contact": any(map(same_site, contacts)), "canonical": canonical, "has_contact": bool(c["email"] or c["phone"]), "semantic_match": bool(pages) and kind == "match", "semantic_conflict": bool(pages) and kind == "conflict",
        "relationship": strength == 4, "direct": strength != 4 and (strength >= 2 or exact_domain or (public_brand and (level(page[1]) >= 2 or level(owner[1]) >= 2) and any(map(same_site, contacts)) and canonical)),
        "places_phone": "google_places_first_party_phone_match" in reasons, "places_business": business, "linkedin": bool(c["website_proof"]), "arbiter": c["verdict"] == "match",
        "page": level(page[1]), "structured": level(owner[1]), "legal": strength, "legal_count": law_count, "query": c["official_query"],
        "context_count": int(context[1].split(":")[1].split("/")[0]) if context[1].startswith(("context_match:", "context_name_match:")) else 0,
        "eligible": c["role"] not in P.EXCLUDED_ROLES and not any(h == x or h.endswith("." + x) for x in W.EXCLUDED_DOMAINS) and not h.endswith(W.PUBLIC_BODY_SUFFIXES) and not ("." in h and h.split(".")[-1] in W.FOREIGN_TLDS),
    }
    return score, [r for r in reasons], supports, conflicts, evidence


def reasons_of(c):
    return c["reason"] or ""


def compare(spark, candidates, pages, claims):
    """The operator's rows against plain Python; names of listings and hosts go through the functions that other tests hold."""
    got = {r.node: r for r in V.evaluate(candidates, pages, claims).collect()}
    ratios = V.with_ratios(candidates)
    known = {
        r.node: r
        for r in ratios.select(
            "node", N.domain_identity(F.col("name"), F.col("host"), F.col("prefix_ratio"), F.col("whole_ratio"))["ok"].alias("i"), N.public_brand_domain(F.col("name"), F.col("host")).alias("p"),
            F.exists(F.coalesce("places", F.array().cast("array<struct<name:string,website:string>>")), lambda p: N.business_name_identity(F.col("name"), p["name"])).alias("n"),
        ).collect()
    }
    sites = {k: [r.html for r in sorted(rows, key=lambda r: r.place)] for k, rows in groupby(sorted(pages.select("node", "place", "html").collect(), key=lambda r: r.node), key=lambda r: r.node)}
    said = {k: [(r.page, r.field, r.value) for r in rows] for k, rows in groupby(sorted(claims.collect(), key=lambda r: r.node), key=lambda r: r.node)}
    rows = candidates.collect()
    assert len(got) == len(rows)
    for c in rows:
        k = known[c.node]
        score, reasons, supports, conflicts, evidence = plain_evaluation(c.asDict(), sites.get(c.node, []), said.get(c.node, []), k.n, k.i, k.p)
        r = got[c.node]
        assert (r.final_score, r.reasons, r.supports, r.conflicts) == (score, reasons, supports, conflicts), c
        assert {x: r[x] for x in evidence} == evidence, c
    return got


def test_evaluations_of_the_tables_pages(spark, small):
    pages = Q.site_html(spark, small)
    found = html.organization_claims(pages.select("page_id", "url", "html"))
    claims = found.select((F.col("page_id") - F.col("page_id") % Q.PAGES_A_SITE).alias("node"), F.col("page_id").alias("page"), "field", "value")
    got = compare(spark, Q.candidates(spark, small), pages, claims)
    assert len(got) > 10


CANDIDATE = dict(about="", role="company_candidate", query="search", score=50, reason="", official_query=2, final_url=None, email="", email_url="", phone="", phone_url="", places=None, listed_phone="", website_proof=False, verdict=None)  # noqa: C408
SCHEMA = (
    "company long, node long, name string, url string, about string, role string, query string, score int, reason string, official_query int, final_url string, email string, email_url string, phone string, "
    "phone_url string, places array<struct<name:string,website:string>>, listed_phone string, website_proof boolean, verdict string"
)


def tables(spark, sites):
    """sites: (candidate, pages, claims)."""
    rows = [CANDIDATE | {"company": 1, "node": i} | c for i, (c, _, _) in enumerate(sites)]
    names = [x.split()[0] for x in re.split(r", (?![^<]*>)", SCHEMA)]
    candidates = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)
    pages = spark.createDataFrame([(i, n, x) for i, (_, ps, _) in enumerate(sites) for n, x in enumerate(ps)], "node long, place int, html string")
    claims = spark.createDataFrame([(i, p, f, v) for i, (_, _, cs) in enumerate(sites) for p, f, v in cs], "node long, page long, field string, value string")
    return candidates, pages, claims


CASES = [
    ({"name": "Örnek Metal", "url": "https://ornekmetal.com.tr", "email": "info@ornekmetal.com.tr", "email_url": "https://ornekmetal.com.tr/x"}, ["<p>ORNEK METAL</p>", "<p>ornek metal</p>"], []),
    ({"name": "Ornek Metal", "url": "https://ornekotel.com.tr"}, ["<h1>Ornek Otel</h1> otel konaklama"], [(0, "name", "Ornek Otel Limited")]),
    ({"name": "Ornek Metal", "url": "https://gone.com.tr", "query": "verified_entity"}, [], []),
    ({"name": None, "url": None}, [None], []),
    ({"name": "Ileri Teknoloji Malzeme Sanayi Ticaret Uzun Unvan", "url": "https://ileri.com"}, ["ileri technologies", "ileri technology 0212 555 10 10"], [(0, "name", "Ileri Technology")]),
    ({"name": "Acme Gıda Ltd. Şti.", "url": "https://acme.com.tr", "about": "food, plastic"}, ["acme gida is owned by acme"], [(0, "legal_name", "Acme A S "), (0, "tax_id", "1"), (1, "tax_id", "2"), (0, "phone", "0212 1"), (1, "phone", "02121")]),
    ({"name": "Zümrüt Örgü", "url": "https://zumrutorgu.com", "about": "food, plastic"}, ["zumrut orgu cosmetics and cosmetics, food"], [(0, "name", "Zumrut Orgu")]),
    ({"name": "Zümrüt Örgü", "url": "https://zumrutorgu.com", "about": "food"}, ["zumrut orgu cosmetics and cosmetics"], [(0, "name", "Zumrut Orgu"), (0, "name", " Zumrut Orgu "), (0, "url", "https://x.y")]),
    ({"name": "Zümrüt", "url": "https://other.com", "about": "food"}, ["cosmetics", "beauty"], [(0, "url", "https://x.y")]),
    ({"name": "Kuzey Rota Makine", "url": "https://kuzeyrota.com.tr", "email": "a@gmail.com", "phone": "02125551010", "phone_url": "https://kuzeyrota.com.tr/c", "listed_phone": "+90 212 555 10 10", "places": [("Kuzey Rota", "https://kuzeyrota.com.tr")]}, ["kuzey rota makine celik"], [(0, "name", "Kuzey Rota Ambalaj")]),
    ({"name": "Boreas", "url": "https://boreas.de", "role": "news", "reason": "domain_hits:1/1", "verdict": "match", "website_proof": True}, ["boreas turkiye"], [(0, "related", "part of Boreas group")]),
    ({"name": "Makine Bank Okul Machine", "url": "https://mb.com.tr"}, ["bank finance kredi", "travel agency hotel", "x" * 60_000 + " makine bank"], []),
    ({"name": "San Tic Ltd", "url": "linkedin.com"}, ["san tic", '<a href="tel:+90 532 111 22 33">call</a>'], []),
]


def test_evaluations_of_cases(spark):
    got = compare(spark, *tables(spark, CASES))
    assert got[0].final_score > 60 and got[2].reasons == ["website_fetch_failed"] and not got[3].first_party


def test_evaluations_edges(spark):
    candidates, pages, claims = tables(spark, [CASES[0]])
    assert V.evaluate(candidates.limit(0), pages, claims).collect() == []
    alone = V.evaluate(candidates, pages.limit(0), claims.limit(0)).first()
    assert not alone.reachable and alone.final_score == 0


def resolution(spark, *sites):
    judged = V.evaluate(*tables(spark, sites)).withColumn("family", U.registrable(F.col("host")))
    return P.resolve_candidates(judged, "company", "node", "family").first()


SITE = ["Ornek Metal"]


def test_resolutions(spark):
    """The site that proves the name; noise falls; two equal ones abstain; one owner's sites are one."""
    base = {"name": "ORNEK METAL", "query": "input_website"}
    own = ({**base, "url": "https://ornekmetal.com.tr", "email": "i@ornekmetal.com.tr", "email_url": "https://ornekmetal.com.tr"}, SITE, [])
    noise = ({**base, "url": "https://ornekotel.com.tr"}, ["ornek otel"], [])
    found = resolution(spark, noise, own)
    assert (found.status, found.selected, found.resolved_by) == ("resolved", 1, "candidate_resolved_by_exact_full_name_domain")
    assert resolution(spark, noise).resolved_by == "no_candidate_proved_target_fingerprint"
    twin = ({**own[0], "url": "https://ornekmetal.com", "email": "i@ornekmetal.com", "email_url": "https://ornekmetal.com"}, ["Ornek Metal Istanbul"], [])
    both = resolution(spark, twin, own)
    assert (both.status, both.selected, both.resolved_by) == ("ambiguous", None, "multiple_candidates_proved_equal_target_fingerprint")
    language = ({**own[0], "url": "https://en.ornekmetal.com.tr"}, SITE, [])
    assert resolution(spark, language, own).status == "resolved"


def test_memory_takes_what_is_resolved(spark):
    """Every reason of a resolution can be remembered."""
    rows = [(f"c{i}", f"https://s{i}.com", "OK_HIGH", reason, 0, f"https://s{i}.com/x", None, i) for i, reason in enumerate([*P.RESOLVED.values(), P.RESOLVED_OTHERWISE, P.UNRESOLVED, P.AMBIGUOUS])]
    published = spark.createDataFrame(rows, "company string, website string, status string, resolution string, conflicts int, email_source string, phone_source string, seen_at long")
    memory = spark.createDataFrame([], "company string, domain string, resolution string, seen_at long")
    assert {r.company for r in registries.remember(memory, published).collect()} == {"c0", "c1", "c2", "c3", "c4"}




def test_whole_pages_are_read(spark):
    """What stands behind a page's first 50,000 characters counts like what stands before them."""
    t = V.target(F.lit("Örnek Metal Profil Gıda"), F.lit("food, metal"))
    said = "<p>ornek metal profil gida, a brand of ornek metal profil gida, istanbul, celik ve profil, food, drink, restaurant, Tel: 0312 555 20 30</p>"
    html = F.concat(F.lit("<p>"), F.repeat(F.lit("y"), F.col("n")), F.lit("</p>" + said))
    first, *others = [r.s for r in spark.createDataFrame([(9,), (60_000,), (2_000_000,)], "n int").coalesce(1).select(V.page_signals(t, html, F.lit(True)).alias("s")).collect()]
    assert first.full and first.primary and first.owned and first.phrase and first.country and first.phone and first.parts and first.seen
    assert others == [first, first]
