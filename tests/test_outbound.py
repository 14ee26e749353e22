"""Outbound links, list cards, functions by name and the data source against plain Python."""

import json
import re
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from orgweave.functions import listings, markup, registered
from orgweave.functions import text as T
from orgweave.functions import url as U
from orgweave.functions import words as W
from orgweave.operators import outbound
from orgweave.plans import listing_queries as L
from orgweave.sources import recorded
from tests.test_evaluation import host, norm, registrable


def valid(h):
    labels = h.split(".")
    return len(h) <= 253 and "." in h and all(re.fullmatch("[a-z0-9]([a-z0-9-]*[a-z0-9])?", x) and len(x) <= 63 for x in labels) and bool(re.fullmatch("[a-z]{2,}", labels[-1])) and labels[-1] not in ("asp", "aspx", "php", "html", "htm", "jsp")


def shut(h):
    return any(h == x or h.endswith("." + x) for x in W.EXCLUDED_DOMAINS) or ("." in h and h.split(".")[-1] in W.FOREIGN_TLDS)


def plain_snippet(snippet, source):
    text, own, out = snippet or "", host(source), []
    found = [m[1] for m in re.finditer(outbound.LABELLED, text)]
    if urlsplit(source or "").path.lower().endswith(".pdf"):
        found += [m[1] for m in re.finditer(outbound.BARE, text)]
    for raw in found:
        raw = raw.rstrip(".,;:)]}\"")
        u = raw if raw.startswith(("http://", "https://")) else "https://" + raw
        h = host(u)
        if valid(h) and h != own and registrable(h) != registrable(own) and not shut(h):
            out.append(re.match(r"[a-zA-Z]+://[^/?#]+", u)[0])
    return list(dict.fromkeys(out))


def test_snippets_of_the_tables(spark):
    rows = L.snippets(spark, "/root/testdata/sf0.01").collect()
    got = {r.page_id: r.sites for r in L.snippet_outbound_websites(spark, "/root/testdata/sf0.01").collect()}
    expected = {r.page_id: plain_snippet(r.snippet, r.source) for r in rows}
    assert got == {k: " ".join(v) for k, v in expected.items() if v} and len(got) > 50


SNIPPETS = [
    ("YÜ-CE TIBBİ GEREÇLER SANAYİ resmi iletişim: yuce-tibbi.com", "https://directory.example/files/catalog.pdf", ["https://yuce-tibbi.com"]), ("E-posta: sales@unrelated.com", "https://directory.example/item", []),
    ("Company profile examplebrand.com", "https://directory.example/item", []), (None, "https://a.example", []), ("website: www.own.directory.example", "https://directory.example", []),
    ("Web Sitesi - https://Firma.com.tr/a). website www.firma.com.tr", "https://x.example", ["https://Firma.com.tr", "https://www.firma.com.tr"]), ("website: https://default.asp", "https://x.example", []), ("website www.a.com", None, ["https://www.a.com"]),
]


def test_snippets(spark):
    rows = spark.createDataFrame([(i, s, u) for i, (s, u, _) in enumerate(SNIPPETS)], "i int, s string, u string")
    got = {r.i: r.x for r in rows.select("i", outbound.snippet_websites("s", F.col("u")).alias("x")).collect()}
    assert got == {i: x for i, (_, _, x) in enumerate(SNIPPETS)} == {i: plain_snippet(s, u) for i, (s, u, _) in enumerate(SNIPPETS)}


def plain_profile(pages):
    """pages: (profile, url, html) of one profile, in order."""
    found, own = [], host(pages[0][0])
    for _, url, html in pages:
        root = markup.tree(html)
        marked = lambda x: any(m in norm(x) for m in outbound.MARKERS)
        for a in (x for x in root.walk() if x.tag == "a" and "href" in x.attributes):
            label = " ".join(x for x in (a.text(), a.attributes.get("title", ""), a.attributes.get("aria-label", "")) if x)
            found.append((a.attributes["href"], label, marked(label) or marked(a.parent.text()[:500]), url))
        text = root.text()
        found += [(m[0], m[0], marked(text[max(0, m.start() - 100) : m.end() + 100]), url) for m in outbound.PLAIN.finditer(text)]
    out = {}
    for raw, label, explicit, url in found:
        raw = raw.strip(" ")
        if not raw or raw.startswith(("mailto:", "tel:", "javascript:", "#")):
            continue
        u = "https:" + raw if raw.startswith("//") else raw if "://" in raw else "https://" + raw if raw.startswith("www.") or ("." in raw and not raw.startswith("/")) else None
        h = host(u) if u else ""
        if not h or h == own or h.endswith("." + own) or shut(h) or urlsplit(u).path.lower().endswith(outbound.FILES):
            continue
        site = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+", u)
        if site and site[0] not in out:
            out[site[0]] = (label, explicit, url)
    best = sorted(out.items(), key=lambda x: not x[1][1])[:5]
    return [(site, *x, n) for n, (site, x) in enumerate(best, 1)]


def plain_details(profiles, documents):
    out = {}
    for profile, url, html in profiles:
        pages = out.setdefault(profile, [(profile, url, html)])
        hrefs = re.findall(r"""(?i)<a\s[^>]*href\s*=\s*["']([^"']+)["']""", html or "")
        for t in dict.fromkeys(urljoin(url, h) for h in hrefs):
            if host(t) == host(profile) and urlsplit(t).path.rstrip("/").endswith("/detail") and t.rstrip("/") != url.rstrip("/") and t in documents:
                pages.append((profile, t, documents[t]))
    return out


def test_profiles_of_the_tables(spark):
    d = "/root/testdata/sf0.01"
    documents = {r.url: r.html for r in L.details(spark, d).collect()}
    closed = {r.host for r in L.health(spark, d).collect() if r.circuit_open}
    expected = {}
    for profile, pages in plain_details([tuple(r) for r in L.profiles(spark, d).collect()], documents).items():
        if host(profile) not in closed:
            for site, *rest in plain_profile(pages):
                expected[profile, site] = tuple(rest)
    got = {(r.profile, r.url): (r.label, r.explicit, r.source_url, r.place) for r in L.profile_outbound_websites(spark, d).collect()}
    assert got == expected and len(got) > 100 and closed
    assert any(r[2].endswith("/detail") for r in got.values())


def test_profile_edges(spark):
    html = "<p>Website <a href=' //www.a.com/x '>a</a></p>" + "".join(f"<div><a href='http://b{i}.com'>b</a></div>" for i in range(9)) + "<script>var x='http://hidden.com'</script> ftp://c.com mail me@d.com"
    rows = [("https://p.example", 0, "https://p.example", html), ("https://q.example", 0, "https://q.example", None), ("https://r.example", 0, "https://r.example", "<a>x</a><a href=''>y</a>")]
    got = outbound.profile_websites(spark.createDataFrame(rows, "profile string, place long, url string, html string")).orderBy("place").collect()
    assert [(r.url, r.explicit) for r in got] == [("https://www.a.com", True), *[(f"http://b{i}.com", False) for i in range(4)]]
    assert {r.profile for r in got} == {"https://p.example"}


def test_markup():
    root = markup.tree("<div>a<p>b<b> c </b><br>d</div>e</p></x><style>f</style>&amp;<img src=x>")
    assert root.text() == "a b c d e &" and root.text(3) == "a b"
    assert [x.tag for x in root.walk()] == ["div", "p", "b", "br", "style", "img"]
    assert next(x for x in root.walk() if x.tag == "b").above(lambda x: x.tag == "div").text() == "a b c d"
    assert markup.tree(None).text() == "" and markup.tree("<p>" * 5000 + "x").text() == "x"


BRAND = """<a class="brand-link" href="brand/ornek-makina"><div class="brand-info"><h2 class="brand-name">ÖRNEK MAKİNA SAN. VE TİC. A.Ş.</h2><p class="brand-country">Türkiye</p></div>
<div class="brand-location-info"><div class="location-item"><span>Salon: 12</span></div><div class="location-item"><span>Stant: 1220 A</span></div></div>
<h3 class="brand-desc-title">MARKALAR</h3> Örnek  CNC,<br/><b>Diğer</b> x<br> Örnek CNC <button>no</button></a><a href="?page=2">2</a><a class="brand-link" href="other/x"><h2 class="brand-name">x</h2></a><a class="brand-link" href="/brand/y"></a>"""
STAND = """<a href=" www.acme.com "><div class="katilimci-text"><p class="text"> ACME  Metal </p><p class="text">HALL 3 / 3A-12</p></div></a><div class="katilimci-text"><p class="text">No Link</p><p class="text">5B - 7</p></div>
<div class="katilimci-text"><p class="text"> </p></div><div class="katilimci-text"></div><a href="https://www.linkedin.com/acme"><div class="katilimci-text"><p class="text">Acme</p></div></a>"""


def test_cards():
    assert listings.cards(BRAND, "https://fair.example") == [("ÖRNEK MAKİNA SAN. VE TİC. A.Ş.", "", "Türkiye", "https://fair.example/brand/ornek-makina", "12", "1220 A", "Örnek CNC; Diğer x")]
    assert listings.cards(STAND, None) == [("ACME Metal", "https://www.acme.com", "", "", "3", "3A-12", ""), ("No Link", "", "", "", "5", "5B - 7", ""), ("Acme", "", "", "", "", "", "")]
    assert listings.cards(None, None) == listings.cards("", "x") == [] and listings.folded("Türkı̇ye") == "turkiye"


def test_functions_by_name(spark):
    names = registered.register_functions(spark)
    assert registered.register_functions(spark) == names
    rows = spark.createDataFrame([("ÖRNEK Metal A.Ş.", "https://www.Shop.Örnek.com.tr:8080/x"), (None, None), ("", "a.co.uk"), ("x", "localhost")], "n string, u string")
    rows.createOrReplaceTempView("some_rows")
    got = spark.sql("select n, u, normalize_name(n) a, name_tokens(n) b, legal_name_tokens(n) c, company_key(n) d, url_host(u) e, registrable_domain(url_host(u)) f, same_site(u, 'http://b.co.uk') g from some_rows").collect()
    own = rows.select("n", "u", T.normalize("n").alias("a"), T.tokens("n").alias("b"), T.legal_tokens("n").alias("c"), T.company_key("n").alias("d"), U.host("u").alias("e"), U.registrable(U.host("u")).alias("f")).collect()
    assert [tuple(r)[:8] for r in got] == [tuple(r) for r in own]
    assert [r.g for r in got] == [False, False, False, False]
    plan = spark.sql("select company_key(n) from some_rows")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    cards = spark.sql("select c.company from values ('x', null), (null, null) t(h, b), lateral list_cards(h, b) c").collect()
    assert cards == []


@pytest.fixture
def answers(spark, tmp_path):
    for provider, until, rows in (("one", 50, [("a", 10), ("b", 50)]), ("two", 100, [("a", 100), (None, None)]), ("three", 70, [("c", 70)])):
        (tmp_path / f"provider={provider}").mkdir()
        lines = [json.dumps({"key": k, "payload": f"{provider}-{k}", "fetched_at": t}) for k, t in rows] + ["", "no json", "[1]"]
        (tmp_path / f"provider={provider}" / f"part-until={until}.json").write_text("\n".join(lines))
    (tmp_path / "provider=one" / "_SUCCESS").write_text("")
    recorded.register_sources(spark)
    return spark.read.format(recorded.NAME).load(str(tmp_path))


def test_recorded_answers(spark, answers, tmp_path):
    everything = {("one", "a", 10), ("one", "b", 50), ("two", "a", 100), ("two", None, None), ("three", "c", 70)}
    seen = lambda df: {(r.provider, r.key, r.fetched_at) for r in df.collect()}
    assert seen(answers) == everything and answers.rdd.getNumPartitions() == 3
    one = answers.where("provider = 'one'")
    assert seen(one) == {x for x in everything if x[0] == "one"} and one.rdd.getNumPartitions() == 1
    fresh = answers.where("provider in ('one', 'two', 'none') and fetched_at >= 60")
    assert seen(fresh) == {("two", "a", 100)} and fresh.rdd.getNumPartitions() == 1
    assert seen(answers.where("fetched_at > 50 and key = 'c'")) == {("three", "c", 70)}
    assert answers.where("provider = 'none'").collect() == []
    assert answers.where("fetched_at is null").count() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan recorded_answers" in plan and "Filter" not in plan.replace("RuntimeFilters", ""), plan  # the source has taken the filter
    assert "Filter" in answers.where("key = 'a'")._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")


def test_reader_takes_and_gives_back_filters():
    reader = recorded.Reader("x")
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan

    left = list(reader.pushFilters([EqualTo(("provider",), "a"), In(("provider",), ("a", "b")), GreaterThan(("fetched_at",), 4), LessThan(("fetched_at",), 9), EqualTo(("key",), "k")]))
    assert left == [LessThan(("fetched_at",), 9), EqualTo(("key",), "k")] and reader.providers == {"a"} and reader.since == 5
