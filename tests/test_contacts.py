"""Contact ranking, roles of results and open evidence against plain Python."""

import re
from itertools import groupby
from urllib.parse import unquote, urlsplit

import pytest
from pyspark.sql import functions as F

from orgweave.functions import roles as R
from orgweave.functions import words as W
from orgweave.operators import acquisition, contacts
from orgweave.operators import fingerprint as P
from orgweave.plans import contact_queries as Q
from orgweave.sources.shared import written
from tests.test_arbitration import routes
from tests.test_evaluation import compact, distinctive, host, norm, phone

RECORD = "company string, website string, value string, source_url string, label string, method string"


def scope(u):
    v = norm(urlsplit(u or "").path)
    rules = (
        ("legal", ("kvkk", "legal", "ticari bilgi", "sirket bilgi", "imprint")), ("privacy", ("privacy", "gizlilik", "veri koruma", "data protection")), ("contact", ("contact", "iletisim", "bize ulas")),
        ("locations", ("location", "lokasyon", "sube", "branch", "factory", "fabrika")), ("about", ("about", "hakkimizda", "kurumsal", "corporate")), ("document", ("pdf", "catalog", "catalogue", "katalog", "brochure", "brosur")),
    )
    return next((s for s, ms in rules if any(m in v for m in ms)), "homepage" if not v.strip(" /") else "other")


def together(records, normal):
    out = {}
    for company, website, value, url, label, method in records:
        if v := normal(value):
            out.setdefault((company, website, v), []).append((contacts.PAGES[scope(url)], int((method or "http") == "http"), url or "", label or "general", method or "http"))
    for (company, website, v), seen in out.items():
        best = max(seen)
        yield {"company": company, "website": website, "value": v, "url": best[2], "label": best[3], "http": best[1], "scope": scope(best[2]), "n": len({s[2] for s in seen if s[2]})}


def places(rows, key):
    out = {}
    for company, own in groupby(sorted(rows, key=lambda r: r["company"]), key=lambda r: r["company"]):
        for n, r in enumerate(sorted(own, key=key, reverse=True), 1):
            out[company, r["value"]] = (n, r["url"], r["label"], r["n"])
    return out


def plain_phones(records):
    kind = lambda v: 3 if re.match("444|0850", v) else 2 if v[:2] in ("02", "03", "04") else 1 if v.startswith("05") else 0
    rows = [r for r in together(records, phone) if r["label"] != "fax"]
    return places(rows, lambda r: (contacts.PHONE_ROLES.get(r["label"], 0), kind(r["value"]), contacts.PAGES[r["scope"]], r["n"], r["http"], r["value"]))


def plain_emails(records):
    def usable(v):
        v = (v or "").strip().lower()
        domain = v.split("@")[-1]
        bad = any(domain == b or domain.endswith("." + b) for b in W.BAD_EMAIL_DOMAINS) or v.split("@")[0] in W.BLOCKED_EMAIL_PREFIXES
        return v if re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", v) and not bad else ""

    def key(r):
        local, domain = r["value"].split("@")
        root, site = compact(norm(re.sub(r"^www\.", "", domain))), compact(host(r["website"]))
        family = bool(root and site and (root in site or site in root))
        said = norm(f"{local} {root}")
        r["affinity"] = 80 * family + 35 * any(t in said for t in distinctive(r["company"])) + 5 * norm(domain).endswith(".tr")
        here = 2 * bool(re.search(r"(?:^|/)(?:tr|tr-tr|tr_tr|turkiye|turkey)(?:/|$)", urlsplit(r["url"]).path.lower())) + bool(re.search(r"(?:^|[._-])(?:tr|turkiye|turkey)(?:[._-]|$)", local))
        first = re.split("[.-]", local)[0]
        order = -W.EMAIL_PREFIXES.index(first) if first in W.EMAIL_PREFIXES else -len(W.EMAIL_PREFIXES)
        return family, r["affinity"], contacts.PAGES[r["scope"]], contacts.EMAIL_ROLES.get(r["label"], 0), here, r["n"], order, r["value"]

    rows = list(together(records, usable))
    return places([r for r in rows if key(r)[1] >= 15], key)


CASES = [
    ("Acme Metal", "https://acme.com.tr", "+90 532 735 53 47", "https://acme.com.tr", "general", "http"), ("Acme Metal", "https://acme.com.tr", "444 21 32", "https://acme.com.tr/contact", "general", None),
    ("Acme Metal", "https://acme.com.tr", "444 21 32", "https://acme.com.tr/x", "headquarters", "render"), ("Acme Metal", "https://acme.com.tr", "0212 555 00 02", "https://acme.com.tr/contact", "fax", None), ("Acme Metal", "https://acme.com.tr", None, None, None, None),
    ("Acme Metal", "https://acme.com.tr", "12", "x", None, None), ("Other", None, "0212 555 00 01", None, "branch", None),
]
MAILS = [
    ("Acme Metal", "https://acme.com.tr", v, u, label, m)
    for v, u, label, m in (
        ("informatics@acme.com.tr", "https://acme.com.tr/contact", None, None), ("info@acme.com.tr", "https://acme.com.tr/contact", None, None), ("INFO@acme.com.tr ", "https://acme.com.tr/tr/x", None, "render"), ("sales.tr@acme.com", "https://acme.com.tr/tr-tr/contact", None, None),
        ("acme@gmail.com", None, "sales", None), ("a@b.org", "https://acme.com.tr/contact", "sales", None), ("kvkk@acme.com.tr", "https://acme.com.tr/contact", None, None), ("x@mail.example.com", None, None, None), ("no mail", None, None, None), ("a@b.com.tr", None, None, None), (None, None, None, None),
    )
]


def test_contacts_against_plain_python(spark):
    rows = spark.createDataFrame(CASES, RECORD)
    got = {(r.company, r.value): (r.place, r.source_url, r.label, r.observations) for r in contacts.rank_phones(rows).collect()}
    assert got == plain_phones(CASES) and got["Acme Metal", "4442132"][0] == 1 and ("Acme Metal", "02125550002") not in got
    found = contacts.rank_emails(spark.createDataFrame(MAILS, RECORD)).collect()
    assert {(r.company, r.value): (r.place, r.source_url, r.label, r.observations) for r in found} == plain_emails(MAILS)
    assert [r.value for r in sorted(found, key=lambda r: r.place)][:2] == ["info@acme.com.tr", "informatics@acme.com.tr"]
    none = spark.createDataFrame([], RECORD)
    assert contacts.rank_phones(none).count() == contacts.rank_emails(none).count() == 0


def test_contacts_of_the_tables(spark, small):
    rows = Q.sightings(spark, small)
    names = ("company", "website", "value", "source_url", "label", "method")
    for column, rank, plain in (("number", contacts.rank_phones, plain_phones), ("mail", contacts.rank_emails, plain_emails)):
        given = rows.withColumn("value", F.col(column))
        got = {(r.company, r.value): (r.place, r.source_url, r.label, r.observations) for r in rank(given).collect()}
        assert got == plain([tuple(r) for r in given.select(*names).collect()]) and len(got) > 50


def plain_role(url, title, snippet, own, companies):
    h, parts = host(url), urlsplit(url or "")
    raw, q = unquote(parts.path).lower() if "%zz" not in parts.path else parts.path.lower(), unquote(parts.query).lower()
    path = norm(raw.replace("/", " "))
    text = norm(" ".join([h, path, title or "", snippet or ""]))
    n = lambda ms, x=text: sum(m in x for m in ms)
    profile, generic, fair = bool(set(path.split()) & set(R.PROFILE_PATH)), bool(n(W.GENERIC_KEYWORDS, h)), bool(n(R.FAIR_WORDS))
    if h.endswith(W.PUBLIC_BODY_SUFFIXES):
        return "public_body"
    if re.search(R.RECORD, raw):
        return "directory"
    if n(R.FAIR_HOST, h) and n(R.FAIR_PAGE):
        return "fair_profile"
    if n(R.NEWS_HOST, h):
        return "news"
    if re.search(R.ENTITY_QUERY, q) or re.search(R.DETAIL, raw) or re.search(R.NUMBERED, raw):
        return "directory"
    if own:
        return "company_candidate"
    if n(R.NEWS_PATH, path):
        return "news"
    if n(R.DIRECTORY) >= 2 or (n(R.DIRECTORY) and generic) or (re.search(R.ENTITY_PATH, raw) and n(R.DIRECTORY)):
        return "directory"
    if generic and re.search(R.BRAND_PATH, raw):
        return "fair_profile" if fair else "directory"
    if n(R.FAIR) >= 2 or (n(("exhibitor", "katilimci"), path) and fair):
        return "fair_profile"
    if n(R.MARKETPLACE) >= 2 and (profile or generic):
        return "marketplace"
    if n(R.NEWS) >= 2:
        return "news"
    return "shared_listing" if companies >= 2 and (profile or generic or n(R.DIRECTORY)) else "unknown"


def test_roles_of_the_tables(spark, small):
    given = {r.c_custkey: r for r in Q.results(spark, small).collect()}
    own = lambda r: norm(r.company).split()[0] in compact(host(r.url))  # noqa: E731  the name's word is the host's or none of it
    hosts = {}
    for r in given.values():
        hosts.setdefault(host(r.url), set()).add(r.company)
    got = {r.c_custkey: r.role for r in Q.candidate_roles(spark, small).collect()}
    assert got == {k: plain_role(r.url, r.title, r.snippet, own(r), len(hosts[host(r.url)])) for k, r in given.items()}
    assert set(got.values()) == {"public_body", "directory", "fair_profile", "news", "company_candidate", "marketplace", "shared_listing", "unknown"}


ROLES = [
    ("https://supplier-list.example", "Company directory", "Supplier profile exporters", False, "directory"), ("https://examplebrand.com", "Exporter company", "Supplier profile", True, "company_candidate"), (None, None, None, False, "unknown"),
    ("https://x.gov.tr/company/1", "", "", True, "public_body"), ("https://x.org/Company-Profile/a?b", "", "", True, "directory"), ("https://x.org/haber%20y", "", "", False, "news"),
]


def test_roles(spark):
    rows = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(ROLES)], "i int, url string, title string, snippet string, own boolean")
    got = [r.x for r in rows.orderBy("i").select(R.candidate_role(F.col("url"), "title", "snippet", F.col("own"), F.lit(1)).alias("x")).collect()]
    assert got == [r[4] for r in ROLES] == [plain_role(*r[:4], 1) for r in ROLES]


def plain_analysis(name, sector, address, status, rows, limit=3):
    ready = [routes(e)[1] for e in rows]
    if status == "resolved" and any(x and e["has_contact"] for x, e in zip(ready, rows)):
        return [], [], [], acquisition.COMPLETE
    gaps = set()
    viable = [(e, x) for e, x in zip(rows, ready) if e["reachable"] and e["eligible"] and e["conflict_free"] and e["canonical"]]
    if not rows:
        gaps.add("no_candidates")
    elif not any(e["reachable"] for e in rows):
        gaps.add("unreachable_candidates")
    elif not viable:
        gaps.add("missing_identity_coherence")
    else:
        t, is_ready = max(viable, key=lambda v: (v[1], v[0]["publishable"], v[0]["first_party"], v[0]["exact_domain"], v[0]["legal"], v[0]["public_brand"] and v[0]["page"] >= 2, v[0]["page"], v[0]["structured"], v[0]["country"], v[0]["context_count"], v[0]["same_site_contact"] and v[0]["has_contact"]))
        gaps |= {g for g, c in (("missing_legal_identity", t["legal"] < 2), ("missing_context", t["context_count"] <= 0), ("missing_country", not t["country"]), ("missing_relationship", not t["first_party"]), ("missing_contact", not (t["same_site_contact"] and t["has_contact"]))) if c}
        if status != "resolved" and not is_ready and not gaps:
            gaps.add("missing_identity_coherence")
    if status == "ambiguous" or sum(ready) > 1:
        gaps.add("ambiguous_candidates")
    ordered = [g for g in acquisition.GAPS if g in gaps]
    scopes = list(dict.fromkeys(s for g in ordered for s in acquisition.SCOPES.get(g, ())))
    full = re.sub(r"\s+", " ", name or "").strip(" \t\r\n-")
    q = f'"{full}"'
    planned = [f"{q} official website", f"{q} ticari unvan KVKK" if gaps & {"missing_legal_identity", "missing_identity_coherence", "ambiguous_candidates"} else "", f"{q} {(sector or '').strip()} Turkiye" if (sector or "").strip() and gaps & {"missing_context", "ambiguous_candidates"} else ""]
    planned += [f"{q} {(address or '').strip()}" if (address or "").strip() and gaps & {"missing_country", "ambiguous_candidates"} else "", f"{q} iletisim" if gaps & {"missing_contact", "unreachable_candidates"} else ""]
    return ordered, scopes, list(dict.fromkeys(p for p in planned if p))[:limit] if full else [], acquisition.NOTHING if gaps == {"no_candidates"} else acquisition.REQUIRED


EVIDENCE = ", ".join([f"{k} boolean" for k in P.FLAGS] + [f"{k} int" for k in P.STRENGTHS])


@pytest.mark.parametrize("limit", [3, 1, 9])
def test_open_evidence_against_plain_python(spark, limit):
    import random

    r = random.Random(limit)
    rows, companies = [], []
    for k in range(120):
        companies.append((k, r.choice((f"Acme  {k} -", None, " ")), r.choice(("food", "", None, " x ")), r.choice(("Izmir", None)), r.choice(("resolved", "ambiguous", "unresolved", None))))
        likely = r.random()
        for _ in range(r.randrange(4)):
            rows.append((k, *(r.random() < (0.9 if f in ("reachable", "eligible", "conflict_free", "canonical", "country", "has_contact") else likely) for f in P.FLAGS), *(r.randrange(4) for _ in P.STRENGTHS)))
    given = spark.createDataFrame(rows, f"company long, {EVIDENCE}")
    known = spark.createDataFrame(companies, "company long, name string, sector string, address string, status string")
    got = {x.company: (x.gaps, x.scopes, x.searches, x.terminal) for x in acquisition.analyse(known, given, limit).collect()}
    by = {k: [dict(zip((*P.FLAGS, *P.STRENGTHS), row[1:])) for row in rows if row[0] == k] for k, *_ in companies}
    assert got == {k: plain_analysis(name, sector, address, status, by[k], limit) for k, name, sector, address, status in companies}
    assert {g for gaps, *_ in got.values() for g in gaps} >= set(acquisition.GAPS) - {"missing_identity_coherence"}


def test_rounds_go_on_while_gaps_close(spark):
    cases = [(None, ["a"], 1, 0, True), (["a", "b"], ["a"], 1, 0, True), (["a"], ["a"], 1, 0, False), (["a"], ["a", "b"], 1, 0, False), (None, [], 1, 0, False), (None, ["a"], 0, 0, False)]
    rows = spark.createDataFrame([(i, b, g, s) for i, (b, g, s, _, _) in enumerate(cases)], "i int, b array<string>, g array<string>, s int")
    got = [r.x for r in rows.orderBy("i").select(acquisition.should_continue(F.col("b"), F.col("g"), F.col("s"), 0, 2).alias("x")).collect()]
    assert got == [c[4] for c in cases]
    assert not rows.select(acquisition.should_continue(None, F.col("g"), F.col("s"), 2, 2).alias("x")).where("x").count()


def test_evidence_of_the_tables(spark, small):
    from orgweave.plans import evaluation_queries as V

    judged = written(V.evaluations(spark, small))
    got = {r.company: r for r in Q.evidence_acquisition(spark, small).collect()}
    status = {r.company: r.status for r in V.page_resolution(spark, small).collect()}
    by = {k: list(rows) for k, rows in groupby(sorted((r.asDict() for r in judged.collect()), key=lambda r: r["company"]), key=lambda r: r["company"])}
    assert set(got) == set(by)
    for k, rows in by.items():
        gaps, scopes, searches, terminal = plain_analysis(rows[0]["name"], max(r["about"] for r in rows), "Izmir" if k % 3 == 0 else "", status[k], rows)
        assert (got[k].gaps, got[k].scopes, got[k].searches, got[k].terminal) == ("; ".join(gaps), "; ".join(scopes), "; ".join(searches), terminal)


def test_national_numbers_of_the_tables(spark, small):
    from orgweave.plans.page_queries import national_phone_numbers
    from tests.test_evaluation import phones

    got = {r.doc_id: r.phones for r in national_phone_numbers(spark, small).collect()}
    more = lambda k: f" Tel +90 (212) 555 {k % 10000:04d}" if k % 4 == 0 else " 444 1 234, 0 444 1 235 or 1444 1 236" if k % 4 == 1 else ""
    expected = {r.doc_id: ",".join(dict.fromkeys(phones((r.text or "") + more(r.doc_id)))) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    assert got == {k: v for k, v in expected.items() if v} and len(got) > 50
