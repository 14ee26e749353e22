import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orgweave.functions import contact as C
from orgweave.functions import fuzzy, html
from orgweave.functions import text as T
from orgweave.functions import url as U


@pytest.fixture(scope="module")
def value(spark):
    def run(column, **given_):
        row = {k: v for k, v in given_.items()} or {"x": ""}
        schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in row.items())
        return spark.createDataFrame([tuple(row.values())], schema).select(column.alias("v")).first().v

    return run


@pytest.mark.parametrize("text,expected", [("ZÜMRÜT İş A.Ş.", "zumrut is a.s."), (None, ""), ("Iğdır", "igdir")])
def test_normalize(value, text, expected):
    assert value(T.normalize("t"), t=text) == expected


def test_names(value):
    assert value(T.legal_tokens("t"), t="Zümrüt Örgü San. ve Tic. Ltd. Şti.") == ["zumrut", "orgu"]
    assert value(T.distinctive_tokens("t"), t="Demir Çelik Ltd") == ["demir", "celik"]
    assert value(T.distinctive_tokens("t"), t="Anka Demir Çelik Ltd") == ["anka"]
    assert value(T.brand_compound("t"), t="Anka Global Metal") == "anka"
    assert value(T.company_key("t"), t="A.B-C Ş.") == "abcs"


def test_phrases(value):
    has = lambda h, n: value(T.has_phrase(T.tokens("h"), T.tokens("n")), h=h, n=n)
    assert has("the red fox ran", "Red Fox") and not has("the redfox", "red fox") and not has("x", "")
    assert value(T.phrase_count(F.col("t"), F.lit("a")), t="a a a b a") == 3


def test_contexts_labels_and_intents(value):
    assert value(T.contexts("t"), t="we make Olive Oil and cosmetics") == ["kozmetik", "gida"]
    assert value(T.contact_label("t"), t="Faks:") == "fax"
    assert value(T.contact_label("t"), t="nothing known") == "general"
    assert value(T.query_intent("t"), t="x resmi sitesi") == "official"
    assert value(T.query_intent("t"), t="x temsilci contact") == "relationship"
    assert value(T.abbreviation_match(T.tokens("n"), F.col("d")), n="Alpha Beta Gamma", d="abgtech") is True
    assert value(T.abbreviation_match(T.tokens("n"), F.col("d")), n="Alpha", d="a") is False
    assert value(T.abbreviation_match(T.tokens("n"), F.col("d")), n="Alpha Beta Gamma", d="abg") is True
    assert value(T.abbreviation_match(T.tokens("n"), F.col("d")), n="Alpha Beta Gamma", d="zzz") is False


@pytest.mark.parametrize("url,host,registrable,core", [
    ("https://www.Shop.Örnek.com.tr:8080/x?y#z", "shop.ornek.com.tr", "ornek.com.tr", "shop.ornek"), ("a.b.co.uk", "a.b.co.uk", "b.co.uk", "a.b"),
    ("http://x.org/", "x.org", "x.org", "x"), (None, "", "", ""),
])
def test_hosts(value, url, host, registrable, core):
    assert value(U.host("u"), u=url) == host
    assert value(U.registrable(U.host("u")), u=url) == registrable
    assert value(U.core(U.host("u")), u=url) == core


def test_url_rules(value):
    assert value(U.suffixes(F.col("h")), h="a.b.com") == ["a.b.com", "b.com", "com"]
    assert value(U.strip_tracking("u"), u="http://a/b?utm_source=x&id=1&gclid=2#top") == "http://a/b?id=1"
    assert value(U.page_scope("u"), u="https://a.com/tr/iletisim") == "contact"
    assert value(U.page_scope("u"), u="https://a.com/") == "homepage"
    assert [value(U.is_valid_host(F.col("h")), h=h) for h in ("a.com", "a", "-a.com", "x.php", "a..com")] == [True, False, False, False, False]
    assert value(U.is_public_body(F.col("h")), h="x.bel.tr") and value(U.is_foreign(F.col("h")), h="x.de")


def test_contacts(value):
    assert value(C.emails("t"), t="Write info [at] firm [dot] com.tr or INFO@firm.com.tr; a\\u0040b.org") == ["info@firm.com.tr", "a@b.org"]
    assert value(C.normalize_phone(F.col("p")), p="+90 (212) 555 12 34") == "02125551234"
    assert value(C.normalize_phone(F.col("p")), p="444 1 234") == "4441234"
    assert value(C.normalize_phone(F.col("p")), p="12345") is None
    assert value(C.phones("t"), t="tel 0212 555 12 34, again 02125551234") == ["02125551234"]
    assert value(C.is_placeholder(F.col("e")), e="a@x.example.com") and value(C.is_blocked(F.col("e")), e="kvkk@a.com")


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_ratios(a, b):
    expected = 100.0 if not a and not b else 200.0 * brute_common(a, b) / (len(a) + len(b))
    assert fuzzy.ratio_of(a, b) == pytest.approx(expected) == pytest.approx(fuzzy.ratio_of(b, a))
    assert 0 <= fuzzy.partial_of(a, b) <= 100
    if a and a in b:
        assert fuzzy.partial_of(a, b) == 100.0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab \0ş😀", max_size=9), st.text("ab \0ş😀", max_size=9)), max_size=20), st.text("abc", min_size=58, max_size=70))
def test_ratios_of_many(pairs, long):
    """Batches give exactly what single pairs do, at all lengths up to, at and beyond a word's."""
    pairs = [*pairs * 4, *[(long, long[::-1])] * 5, *[("abcab", long)] * 5]
    assert fuzzy.ratios(pairs).tolist() == [fuzzy.ratio_of(*p) for p in pairs]
    assert fuzzy.partial_ratios(pairs).tolist() == [fuzzy.partial_of(*p) for p in pairs]
    assert fuzzy.token_set_ratios(pairs).tolist() == [fuzzy.token_set_of(*p) for p in pairs]


@settings(max_examples=150, deadline=None)
@given(*[st.lists(st.one_of(st.text("ab \0ş😀", max_size=9), st.text("abc", min_size=29, max_size=34), st.text("abc", min_size=62, max_size=65)), min_size=1, max_size=9)] * 2)
def test_ratios_of_grids(a, b):
    """Every pair once, with exactly what single pairs give, at lengths about a word's."""
    found = {}
    for i, j, *numbers in fuzzy.grids(a, b):
        for r, c in itertools.product(range(len(i)), range(len(j))):
            found[i[r], j[c]] = tuple(x[r, c] for x in numbers)
    assert found == {(i, j): tuple(f(x, y) for f in (fuzzy.ratio_of, fuzzy.partial_of, fuzzy.token_set_of)) for i, x in enumerate(a) for j, y in enumerate(b)}
    assert sum(len(i) * len(j) for i, j, *_ in fuzzy.grids(a, b)) == len(a) * len(b)


def test_token_set():
    assert fuzzy.token_set_of("alpha beta", "beta alpha gamma") == 100.0
    assert fuzzy.token_set_of("", "a") == 0.0


PAGE = """<html><head><script type="application/ld+json">{"@graph":[{"@type":"Organization","legalName":"Zümrüt Örgü A.Ş.","telephone":["+90 212 555 12 34"]}]}</script>
<script type="application/ld+json">{broken</script></head><body><span itemprop="email">info@zumrut.example</span>
<a href="mailto:Sales@zumrut.example?subject=x">Sales</a><a href="/iletisim">Contact<a href="https://other.example/a.pdf">Other</a>
<span data-cfemail="2a4b6a4804455843"></span><p>Mersis No: 0123456789012345 </p><address>Street 1</address>"""


def test_page_tables(spark):
    pages = spark.createDataFrame([(1, "https://www.zumrut.example/", PAGE), (2, None, None), (3, "http://[bad", "<a href='http://[x'>x</a><p")], "page_id long, url string, html string")
    claims = {(r.field, r.value, r.method) for r in html.organization_claims(pages).collect()}
    assert {("legal_name", "Zümrüt Örgü A.Ş.", "json_ld"), ("phone", "+90 212 555 12 34", "json_ld"), ("email", "info@zumrut.example", "item_property"), ("mersis", "0123456789012345", "labelled"), ("address", "Street 1", "address")} <= claims
    found = {(r.kind, r.value) for r in html.contact_records(pages).collect()}
    assert ("email", "sales@zumrut.example") in found and ("email", "a@b.ori") in found
    links = {r.target: r for r in html.page_links(pages).where("page_id = 1").collect()}
    assert links["https://www.zumrut.example/iletisim"].score == 100 and links["https://other.example/a.pdf"].is_document
    assert [r.target for r in html.contact_links(pages).collect()] == ["https://www.zumrut.example/iletisim"]
    doubled = html.organization_claims(pages.union(pages))
    assert html.dedupe_claims(doubled).count() == html.dedupe_claims(html.organization_claims(pages)).count()
    assert html.decode_xor("zz") == "" == html.decode_xor("")


def test_listed_site_proofs(spark):
    """The proofs by brute force: a word of a value in the domain, an acronym of the name, or the profile itself."""
    from itertools import product

    from orgweave.plans import registry_queries as Q

    out = {r.c_custkey: r.proof for r in Q.listed_site_proofs(spark, "/root/testdata/sf0.001").collect()}
    made = lambda words: {"".join(w[:k] for w, k in zip(words, ks)) for ks in product((1, 2), repeat=len(words))}
    assert "ancazo" in made(["anadolu", "cam", "zoraaa"]) and "egzo" in made(["ege", "zoraaa"])
    proofs = [*["meaningful_identity_token"] * 4, "unproven", "profile_local_website", None, "meaningful_identity_token"]
    assert len(out) > 100 and out == {k: proofs[k % len(Q.LISTED)] for k in range(150) if proofs[k % len(Q.LISTED)]}


def test_national_phones(value):
    found = lambda t: value(C.national_phones("t"), t=t)
    assert found("Tel +90 (212) 555 10 12, 444 1 234 or 0532.555.10.12") == ["02125551012", "4441234", "05325551012"]
    assert found("0 444 1 234") == ["4441234"]
    assert found(None) == [] and found("order 123456") == []


def test_fold_unicode(value):
    fold = lambda t: value(T.fold_unicode("t"), t=t)
    assert [fold(x) for x in ("ＡＢＣ ﬁx", "STRASSE Straße", "İI ı", None)] == ["abc fix", "strasse strasse", "ii i", ""]


def test_titles_cut_within_a_reference(spark, tmp_path):
    """A reference without its end at the end of a title is text; whole ones are decoded."""
    from orgweave.plans import page_queries as Q

    titles = ("a&amp;&amp", "b &am", "c&", "d&amp;lt;", "e&quot;&quot", "f&gt")
    rows = [(i, f"<title>{t}</title>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = {r.page_id: r.title.split(" <Aüş>")[0] for r in Q.clean_titles(spark, str(tmp_path)).collect()}
    assert found == dict(enumerate(("a&&amp", "b &am", "c&", "d&lt;", 'e"&quot', "f&gt")))


def test_legal_form_is_a_word():
    """A name ends with a whole legal form, not with the first letters of a word."""
    named = lambda t: [v for f, v, m in html._claims(None, f"<p>{t}</p>") if m == "text"]
    assert named("seit. Engest. Inchberchver und") == [] and named("Ada Mavi A Şube") == [] and named("Foo GmbHx") == []
    assert named("Acme Inc. und") == ["Acme Inc."] and named("Acme Inc") == ["Acme Inc"] and named("Zümrüt Örgü A.Ş., Foo GmbH") == ["Zümrüt Örgü A.Ş.", "Foo GmbH"]
