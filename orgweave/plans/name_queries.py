"""Names against texts, other names and domains as queries, each with SQL of its own.

A customer's company name, host and texts are made of a word of its own, by one of several patterns,
chosen so that every rule decides some of them; the functions run on every customer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from orgweave.functions import fuzzy
from orgweave.functions import names as N
from orgweave.functions import text as T
from orgweave.functions import words as W
from orgweave.plans.catalogue import query, read
from orgweave.sources.shared import spread, written

#: company, host, title, snippet, business name, text; a customer's own word takes the place of a pattern's STEM
CASES = (
    ("Zümrüt Örgü A.Ş.", "zumrutorgu.com.tr", "Zümrüt Örgü", "resmi", "ZUMRUT ORGU", "Zümrüt Örgü Sanayi ve Ticaret A.Ş. hakkinda"),
    ("ATÇ Kimya Sanayi", "atckimya.com", "ATÇ", "kimya", "Atc Kimya Ltd", "atc kimya urunleri"),
    ("Dr Atabay", "dratabay.com", None, None, "Atabay", "this shop is owned by Dr Atabay since 1990"),
    ("Kardelen", "kardelan.com.tr", "", "", "Kardelenci", "kardelen"),
    ("Mavi Deniz", "mavi.com", "Mavi", "Deniz", "Deniz Mavi", "mavi ve deniz"),
    ("Anadolu Cam Sanayi Ticaret", "acme.com", "", "cam", "Anadolucam Pazarlama", "anadolu cam"),
    ("Ege Zeytin Yaglari", "egezeyyag.com.tr", "zeytin", "", "Ege Zeytinyaglari", "Ege Zeytin Yaglari bunyesinde"),
    ("Lal", "lal.com.tr", "Lal", "", "Lal", "lal"),
    ("Star Chocolate", "starcikolata.com", "Star", "candy", "Star Cikolata", "star chocolate part of something"),
    ("Acme Plastik", "linkedin.com", "", "", "Acme", "acme plastik"),
    ("Acme Plastik", "tr.linkedin.com", "", "", "Acme Plastik Ltd", ""),
    ("Acme Plastik", "acmeplastik.de", "", "", "Plastik", None),
    ("Acme Plastik", "acmeplastikspor.com", "", "", None, "spor"),
    ("Acme Plastik", "acmeplastiktrade.com", "plastik", "acme", "Acmeplastik", "acme"),
    ("Acme Plastik", "foobar.com", "acme plastik", "", "Foo Bar", "acme"),
    ("Sirius Medikal / Vega Tibbi", "vegatibbi.com", "Vega", "", "Vega Tibbi", "sirius medical and more"),
    ("Uzun Unvan Ithalat - Palmiye", "palmiyemobilya.com", "", "", "Palmiye", "Palmiye is a brand of Uzun Unvan Ithalat Palmiye and others"),
    ("Boreas Gida", "boreas.com", "Boreas", "", "Boreas Gida Dis Ticaret", "boreas food"),
    ("Boreas Gida", "boreas.siteindices.com", "Boreas", "gida", "Boreas", ""),
    ("Kuzey Rota Deniz Nakliyat", "kuzeyrota.com", "Kuzey Rota", "", "Kuzey Rota", "kuzey rota deniz nakliyat ltd"),
    ("Brands A", "brands-a.com", "", "", "Brands", "brands a"),
    ("San Tic Ltd", "santic.com", "", "", "San Tic", "san tic"),
    ("", "", "", "", "", ""),
    (None, None, None, None, None, None),
    ("Ileri Teknoloji Malzeme", "advancedtechnology.com.tr", "", "teknoloji", "Advanced Technology", "advanced teknoloji"),
    ("Teknoloji Ileri", "teknolojiadvanced.com", "", "", "Teknoloji", "teknoloji advanced technology"),
    ("Marmara Tekstil Makina", "marmaratextile.com", "tekstil", "", "Marmara", "marmara textile machine"),
    ("Tarim Makine Tekstil Gida Printing", "tarim.net.tr", "", "tarim", "Tarim Makine", "tarim"),
    ("Acme | Zeta", "zeta.org.tr", "", "", "Zeta", "acme zeta"),
    ("Abc Gida Sanayi", "abcgida.com.tr", "gida", "abc", "Abc Gida", "x " * 150 + "markasi " + "y " * 150 + "Abc Gida"),
    ("Pamukkale Dokuma Iplik", "pamukkale-dokuma.com", "Pamukkale", "dokuma", "Pamukkale Dokumacilik", "operated by pamukkale dokuma iplik"),
    ("Cok Kelimeli Uzun Adli Firma", "cokkelime.com", "cok", "", "Cok Kelimeli", "cok kelimeli uzun adli firma"),
)

#: the word of a pattern that a customer's own one replaces, in all its spellings; patterns without one stand as they are, with the word behind their title
STEMS = {
    0: "Zümrüt", 2: "Atabay", 3: "Kardel", 4: "Mavi", 5: "Anadolu", 8: "Star", 9: "Acme", 10: "Acme", 11: "Acme", 12: "Acme", 13: "Acme", 14: "Acme", 15: "Vega", 16: "Palmiye", 17: "Boreas", 18: "Boreas", 19: "Kuzey",
    20: "Brands", 26: "Marmara", 28: "Zeta", 30: "Pamukkale",
}
_FIELDS = ("company", "host", "title", "snippet", "business", "body")


def _pattern(i: int, values: tuple[str | None, ...]) -> list[str | None]:
    if i not in STEMS:
        return [v if k != 2 or v is None else v + " {w}" for k, v in enumerate(values)]
    plain = STEMS[i].translate(str.maketrans(W.FOLD_FROM, W.FOLD_TO)).lower()
    spelt = ((STEMS[i], "{W}"), (plain.capitalize(), "{W}"), (plain, "{w}"), (plain.upper(), "{U}"))
    out = []
    for v in values:
        for old, new in spelt:
            v = v and v.replace(old, new)
        out.append(v)
    return out


PATTERNS = [_pattern(i, values) for i, values in enumerate(CASES)]
_TEXT = lambda x: "null" if x is None else "'" + x.replace("'", "''") + "'"
_VALUES = ", ".join(f"({k}, {', '.join(map(_TEXT, row))})" for k, row in enumerate(PATTERNS))
_LETTERS = lambda key: f"'zor' || translate(lpad({key}::varchar, 6, '0'), '0123456789', 'abcdefghij')"
_SPELT = lambda x, word: f"replace(replace(replace({x}, '{{W}}', upper(left({word}, 1)) || substr({word}, 2)), '{{w}}', {word}), '{{U}}', upper({word}))"
_FOLD = lambda x: f"lower(translate(coalesce({x}, ''), 'çğıöşüÇĞİIÖŞÜ', 'cgiosucgiiosu'))"
_RAW = lambda x: f"regexp_extract_all({_FOLD(x)}, '[a-z0-9]+')"
_WITHOUT = lambda x, words: f"list_filter({x}, lambda t: not list_contains([{', '.join(repr(w) for w in words)}], t) and length(t) > 1)"
# fixed values, in the SQL's own words
_LEGAL = "ltd sti san sanayi tic ticaret anonim limited as co inc gmbh".split()
_SECTOR = "demir celik metal kimya kimyasal boya profil sac hadde haddecilik endustri makine".split()
_BUSINESS = "endustriyel mineraller kimyasal maddeler tekstil hizmetleri servis satis ambalaj barkod dijital baski sistemleri elektronik dahili ve".split()
_GENERIC = "group grup global kozmetik gida food dried kagit seluloz lojistik ic dis sirket sirketi urun urunleri".split()
_JOINING = "ve and sirket sirketi".split()
_CONTEXT = "kozmetik cosmetic cosmetics gida food temizlik cleaning kimya boya tekstil ambalaj barkod baski elektronik mineraller plastik plastic otomotiv automotive".split()
_BRIDGE = "ic dis paz pazarlama tic ticaret ith ihr ithalat ihracat san sanayi".split()
_L = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_EQUAL = _L(f"{k}={e}" for k, v in W.BRAND_EQUIVALENTS.items() for e in v)
_EQUAL_DOMAIN = _L("chocolate=cikolata cikolata=chocolate candy=seker candy=sekerleme seker=candy sekerleme=candy".split())
_CASES = f"""c0(i, {', '.join(_FIELDS)}) as (values {_VALUES}), c1 as (select c_custkey as k, {_LETTERS('c_custkey')} as word from customer),
v as (select k, {', '.join(f"{_SPELT(f, 'word')} as {f}" for f in _FIELDS)} from c1 join c0 on k % {len(CASES)} = i),
t0 as (select *, {_RAW('company')} as raw, {_RAW('business')} as b_raw, {_RAW('body')} as t_raw from v),
t1 as (select *, {_WITHOUT('raw', _LEGAL + _JOINING)} as legal, {_WITHOUT('raw', _LEGAL)} as comp, {_WITHOUT('b_raw', _LEGAL + _JOINING)} as b_legal, {_WITHOUT('t_raw', _LEGAL + _JOINING)} as t_legal, {_WITHOUT('raw', _LEGAL + _SECTOR + _BUSINESS)} as narrow from t0),
t2 as (select *, case when len(narrow) > 0 then narrow else comp end as dist from t1),
t3 as (select *, case when len({_WITHOUT('dist', _GENERIC)}) > 0 then {_WITHOUT('dist', _GENERIC)} else dist end as ident, dist[1:2] as prim, dist[1:4] as prim4 from t2)"""
_ALL = "(select k as c_custkey, r.* from r)"
_PHRASE = lambda hay, needle: f"(len({needle}) > 0 and contains(' ' || array_to_string({hay}, ' ') || ' ', ' ' || array_to_string({needle}, ' ') || ' '))"


def own_word(key):
    """A word of letters for a row's number."""
    return F.concat(F.lit("zor"), F.translate(F.lpad(key.cast("string"), 6, "0"), "0123456789", "abcdefghij"))


def spelt(pattern, word):
    """A pattern with a row's own word in its three spellings."""
    capital = F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 100))
    return F.replace(F.replace(F.replace(pattern, F.lit("{W}"), capital), F.lit("{w}"), word), F.lit("{U}"), F.upper(word))


def _cases(spark, d):
    """k and the fields of every customer."""
    patterns = spark.createDataFrame([(i, *row) for i, row in enumerate(PATTERNS)], "i long, " + ", ".join(f"{f} string" for f in _FIELDS))
    rows = spread(read(spark, d, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % len(CASES)).alias("i"), own_word(F.col("c_custkey")).alias("word"))
    return rows.join(F.broadcast(patterns), "i").select("k", *[spelt(F.col(f), F.col("word")).alias(f) for f in _FIELDS])


def _customers(spark, d, answers):
    return answers.withColumnRenamed("k", "c_custkey")


@query(f"""with {_CASES}, e as (select *, list_filter(prim, lambda t: list_contains(t_raw, t)) as exact, length(prim[1]) >= 5 and list_contains(t_raw, prim[1]) as anchored from t3),
r as (select k, exact, list_filter(prim, lambda t: not list_contains(t_raw, t) and anchored and len(list_filter(t_raw, lambda w: list_contains({_EQUAL}, t || '=' || w))) > 0) as other, prim from e)
select c_custkey, len(exact) + len(other) as matched, len(prim) as total, len(other) as translated from {_ALL}""")
def brand_text_hits(spark, d):
    hits = _cases(spark, d).select("k", N.brand_hits("company", "body").alias("h"))
    return _customers(spark, d, hits.select("k", *[F.col(f"h.{x}").cast("long").alias(x) for x in ("matched", "total", "translated")]))


@query(f"""with {_CASES}, r as (select k, {_PHRASE('t_legal', 'legal[1:4]')} as phrase, {_PHRASE('t_legal', 'legal')} as full_phrase from t3) select c_custkey, phrase, full_phrase from {_ALL}""")
def legal_phrase_match(spark, d):
    return _customers(spark, d, _cases(spark, d).select("k", N.legal_phrase("company", "body").alias("phrase"), N.legal_phrase("company", "body", True).alias("full_phrase")))


_MARKERS = ["ait bir marka", "markasidir", "markasi", "bunyesinde", "ticari unvani", "resmi unvani", "bir markadir", "brand of", "a brand of", "owned by", "belongs to", "operated by", "trading name of", "part of"]


@query(f"""with {_CASES}, w as (select *, array_to_string(t_raw, ' ') as words, array_to_string(legal[1:4], ' ') as needle from t3),
r as (select k, len(legal) > 0 and len(list_filter({_L(_MARKERS)}, lambda m: contains(words, m) and contains(substr(words, greatest(instr(words, m) - 241, 0) + 1, instr(words, m) + 239 - greatest(instr(words, m) - 241, 0)), needle))) > 0 as owned from w)
select c_custkey, owned from {_ALL}""")
def ownership_statement(spark, d):
    return _customers(spark, d, _cases(spark, d).select("k", N.ownership_statement("company", "body").alias("owned")))


@query(f"""with {_CASES}, o as (select *, list_filter(prim4, lambda t: not list_contains({_L(_BRIDGE)}, t))[1:2] as target, list_filter(b_legal, lambda t: not list_contains({_L(_BRIDGE)}, t)) as obs from t3),
e as (select *, list_concat(obs, [obs[i] || obs[i + 1] for i in range(1, len(obs)) if length(obs[i]) >= 3 and length(obs[i + 1]) >= 3]) as every from o),
f as (select *, len(list_filter(target, lambda t: len(list_filter(every, lambda v: t = v or (least(length(t), length(v)) >= 6 and (starts_with(t, v) or starts_with(v, t))))) > 0)) as fits from e),
r as (select k, {_PHRASE('b_legal', 'legal[1:4]')} or (len(target) = 2 and fits = 2) or coalesce(len(target) = 1 and length(target[1]) >= 3 and fits = 1, false) as same from f)
select c_custkey, same from {_ALL}""")
def business_name_identity(spark, d):
    return _customers(spark, d, _cases(spark, d).select("k", N.business_name_identity("company", "business").alias("same")))


_FAMILIES = {k: v for k, v in W.ACTIVITIES.items()} | {a: name for name, aliases in W.CONTEXTS.items() for a in aliases if " " not in a}
_KNOWN = sorted(({*_SECTOR, *_BUSINESS, *_CONTEXT} | set(_FAMILIES)) - set("ve dahili hizmetleri servis satis sistemleri endustri endustriyel maddeler".split()))


@query(f"""with {_CASES}, f as (select k, [coalesce(split_part(list_filter({_L(f'{a}={b}' for a, b in _FAMILIES.items())}, lambda x: starts_with(x, t || '='))[1], '=', 2), t) for t in raw if list_contains({_L(_KNOWN)}, t)] as said from t3),
r as (select k, array_to_string(list_filter(said, lambda x, i: list_position(said, x) = i), ',') as activities from f) select c_custkey, activities from {_ALL}""")
def activity_qualifiers(spark, d):
    return _customers(spark, d, _cases(spark, d).select("k", F.array_join(N.activity_qualifiers("company"), ",").alias("activities")))


@query(f"""with {_CASES}, s as (select k, coalesce(company, '') as company, list_filter(list_transform(regexp_split_to_array(coalesce(company, ''), '\\s*[/|]\\s*'), lambda x: trim(x)), lambda x: x <> '') as parts from v),
p as (select k, unnest(case when len(parts) > 1 then list_concat(parts, [company]) else [company] end) as name, unnest(range(1, case when len(parts) > 1 then len(parts) + 2 else 2 end)) as n from s),
q as (select *, {_RAW('name')} as raw from p), u as (select *, list_filter(raw, lambda t: not list_contains({_L(_LEGAL)}, t)) as plain, {_WITHOUT('raw', _LEGAL)} as comp, {_WITHOUT('raw', _LEGAL + _SECTOR + _BUSINESS)} as narrow from q),
x as (select *, (case when len(narrow) > 0 then narrow else comp end)[1:2] as prim, list_filter(plain[2:], lambda t: list_contains({_L(_CONTEXT)}, t))[1] as context from u),
f as (select k, n, [array_to_string(prim, ' '), case when length(plain[2]) = 1 then plain[1] || ' ' || plain[2] end, case when length(plain[1]) <= 4 and context is not null then plain[1] || ' ' || context end, array_to_string(raw, ' ')] as forms from x),
g as (select k, list_filter(flatten(list(forms order by n)), lambda x: x is not null and x <> '') as forms from f group by k),
r as (select k, array_to_string(list_filter(forms, lambda x, i: list_position(forms, x) = i), ';') as variants from g) select c_custkey, variants from {_ALL}""")
def search_name_variants(spark, d):
    return _customers(spark, d, _cases(spark, d).select("k", F.array_join(N.search_variants("company"), ";").alias("variants")))


_LAST = lambda x: f"list_element(string_split({x}, '.'), -1)"
_CORE = "case when regexp_matches(h, '(\\.com\\.tr|\\.net\\.tr|\\.org\\.tr|\\.co\\.uk)$') then regexp_replace(h, '(\\.com\\.tr|\\.net\\.tr|\\.org\\.tr|\\.co\\.uk)$', '') else regexp_replace(h, '\\.[a-z]{2,}$', '') end"
_HOSTS = f"""h0 as (select *, coalesce(host, '') as h from t3), h1 as (select *, {_CORE} as core from h0), h2 as (select *, regexp_replace(core, '[^a-z0-9]', '', 'g') as cc from h1)"""


@query(f"""with {_CASES}, {_HOSTS}, s as (select k, cc, coalesce(company, '') as company, list_filter(list_transform(regexp_split_to_array(coalesce(company, ''), '\\s+(?:-|/|\\|)\\s+'), lambda x: trim(x)), lambda x: x <> '') as parts from h2),
p as (select k, cc, unnest(case when len(parts) > 1 then list_concat([company], parts) else [company] end) as name, unnest(range(0, case when len(parts) > 1 then len(parts) + 1 else 1 end)) as n from s),
q as (select *, {_RAW('name')} as raw from p), u as (select *, {_WITHOUT('raw', _LEGAL)} as comp, {_WITHOUT('raw', _LEGAL + _SECTOR + _BUSINESS)} as narrow from q),
x as (select *, (case when len(narrow) > 0 then narrow else comp end)[1:2] as prim from u), y as (select *, array_to_string(prim, '') as whole from x),
z as (select k, cc <> '' and ((length(whole) >= case when n > 0 then 5 else 7 end and starts_with(cc, whole) and length(cc) - length(whole) <> 1) or coalesce(length(prim[1]) >= 7 and starts_with(cc, prim[1]) and length(cc) - length(prim[1]) <> 1, false)) as ok from y),
g as (select k, bool_or(ok) as public_brand from z group by k),
r as (select k, public_brand, coalesce(ends_with(h, '.siteindices.com') and len(ident) > 0 and list_contains(list_transform(string_split(regexp_replace(h, '\\.siteindices\\.com$', ''), '.'), lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')), array_to_string(ident, '')), false) as mirror from g join h2 using (k))
select c_custkey, public_brand, mirror from {_ALL}""")
def public_brand_domain(spark, d):
    host = T.text_or_empty("host")
    return _customers(spark, d, _cases(spark, d).select("k", N.public_brand_domain("company", host).alias("public_brand"), N.mirror_subdomain("company", host).alias("mirror")))


# Longest common subsequences in SQL: a row of the table for each letter of a.
_LCS = """lcs(a, b, i, line) as (select a, b, 0, [0 for x in range(0, length(b) + 1)] from pairs union all
select a, b, i + 1, [list_max([greatest(line[x + 1], case when x > 0 and substr(b, x, 1) = substr(a, i + 1, 1) then line[x] + 1 else 0 end) for x in range(0, y + 1)]) for y in range(0, length(b) + 1)] from lcs where i < length(a)),
ratio as (select a, b, case when length(a) + length(b) = 0 then 100.0 else 200.0 * line[length(b) + 1] / (length(a) + length(b)) end as r from lcs where i = length(a))"""
_IN = lambda t: f"case when length({t}) <= 3 then cc = {t} else contains(cc, {t}) or len(list_filter({_EQUAL_DOMAIN}, lambda e: starts_with(e, {t} || '=') and contains(cc, split_part(e, '=', 2)))) > 0 end"
_MERGED = lambda x, n: f"array_to_string([substr(t, 1, {n}) for t in {x} if length(t) >= {n}], '')"
_ABBREVIATED = lambda x: (
    f"coalesce(len({x}) >= 2 and (contains(cc, array_to_string([substr(t, 1, 1) for t in {x}], '')) or (length({x}[1] || array_to_string([substr(t, 1, 1) for t in {x}[2:]], '')) >= 4 and contains(cc, {x}[1] || array_to_string([substr(t, 1, 1) for t in {x}[2:]], '')))"
    f" or (length({_MERGED(x, 3)}) >= 4 and contains(cc, {_MERGED(x, 3)})) or (length({_MERGED(x, 4)}) >= 4 and contains(cc, {_MERGED(x, 4)}))), false)"
)
_IDENTITY = f"""{_HOSTS}, a0 as (select *, array_to_string(ident, '') as whole, coalesce(ident[1], '') as w1 from h2),
pairs(a, b) as (select whole, cc from a0 union select w1, substr(cc, 1, length(w1)) from a0 union
  select s, substr(l, greatest(i, 0) + 1, i + length(s) - greatest(i, 0)) from (select s, l, unnest(range(1 - length(s), length(l))) as i from (select case when length(whole) <= length(cc) then whole else cc end as s, case when length(whole) <= length(cc) then cc else whole end as l from a0) where s <> '')), {_LCS},
part as (select k, max(r) as part_ratio from (select k, unnest(range(1 - length(s), length(l))) as i, s, l from (select k, case when length(whole) <= length(cc) then whole else cc end as s, case when length(whole) <= length(cc) then cc else whole end as l from a0) where s <> '') join ratio on a = s and b = substr(l, greatest(i, 0) + 1, i + length(s) - greatest(i, 0)) group by k),
a1 as (select a0.*, x.r as whole_ratio, y.r as prefix_ratio, coalesce(part_ratio, case when whole = '' and cc = '' then 100 else 0 end) as part_ratio from a0 join ratio x on x.a = whole and x.b = cc join ratio y on y.a = w1 and y.b = substr(cc, 1, length(w1)) left join part using (k)),
a2 as (select *, len(ident) as n, len(list_filter(ident, lambda t: {_IN('t')})) as hits, len(ident) = 2 and len(list_filter(ident, lambda t: contains(cc, t))) = 1 and list_contains(ident, cc) as clean,
  len(list_filter(ident, lambda t: length(t) >= 5 and ends_with(cc, t) and length(cc) - length(t) between 1 and 3 and list_contains(ident, substr(cc, 1, length(cc) - length(t))))) > 0 as short_prefix,
  len(ident) = 1 and length(w1) >= 5 and length(cc) >= length(w1) and w1 <> substr(cc, 1, length(w1)) and substr(w1, 1, 4) = substr(cc, 1, 4) and prefix_ratio >= 83 as near_prefix,
  coalesce(length(raw[1]) between 3 and 4 and starts_with(cc, raw[1]) and len(list_filter(raw[2:], lambda t: length(t) >= 4 and contains(cc, t))) > 0, false) as anchored from a1),
a3 as (select *, n > 0 and cc <> '' as known, hits >= case when n <= 2 then n else greatest(1, ceil(n * 0.5)) end or clean or short_prefix or near_prefix or (length(whole) >= 5 and whole_ratio >= 88)
  or {_ABBREVIATED('ident')} or {_ABBREVIATED('comp')} or (n = 1 and length(w1) >= 4 and contains(cc, w1)) or anchored as rules from a2)"""


def _with_ratios(cases):
    """cases with the ratios that the rules need. The pairs are written first: Arrow functions take plain columns then, and no plan moves them."""
    needed = N.ratios_needed("company", T.text_or_empty("host"))
    pairs = written(cases.select("*", *[x.alias(f"{name}_{side}") for name, pair in needed.items() for side, x in zip("ab", pair, strict=True)]), "pairs")
    of = lambda name: (fuzzy.partial_ratio if name == "part" else fuzzy.ratio)(F.col(f"{name}_a"), F.col(f"{name}_b")).alias(f"{name}_ratio")
    return written(pairs.select(*cases.columns, *[of(name) for name in needed]), "ratios")


@query(f"""with recursive {_CASES}, {_IDENTITY}, r as (select k, known and rules as ok, case when known then hits else 0 end as hits, n as tokens from a3) select c_custkey, ok, hits, tokens from {_ALL}""")
def domain_identity_match(spark, d):
    found = _with_ratios(_cases(spark, d)).select("k", N.domain_identity("company", T.text_or_empty("host"), F.col("prefix_ratio"), F.col("whole_ratio")).alias("i"))
    return _customers(spark, d, found.select("k", "i.ok", F.col("i.hits").cast("long").alias("hits"), F.col("i.tokens").cast("long").alias("tokens")))


_KEYWORDS = "spor sport kulubu belediye municipality universite university edu project github gitlab sourceforge docs wiki blogspot wordpress".split()
_DIRECTORY = "alibaba amazon marketplace directory firma firmalar metalmarket trade b2b exporters portal haber news medya fair expo ihracat katalog rehber sanayirehber ticaretrehber sirketler kobirehber ihracatci sektor".split()
_ANY = lambda x, words: f"len(list_filter({_L(words)}, lambda w: contains({x}, w))) > 0"


@query(f"""with recursive {_CASES}, {_IDENTITY}, b0 as (select *, {_FOLD("core || ' ' || coalesce(title, '') || ' ' || coalesce(snippet, '')")} as searchable, list_distinct(list_filter(raw, lambda t: list_contains({_L(_CONTEXT)}, t))) as contexts from a3),
b1 as (select *, len(list_filter(contexts, lambda t: contains(searchable, t))) as n_contexts from b0),
b2 as (select *, trunc(hits / greatest(n, 1) * 32)::bigint + trunc(part_ratio * 0.24)::bigint + least(8, 2 * len(list_filter(comp, lambda t: contains(searchable, t)))) + case when ends_with(h, '.com.tr') then 8 when ends_with(h, '.tr') then 5 else 0 end
  + case when coalesce({_IN('ident[1]')}, false) then 14 else 0 end + case when len(contexts) = 0 then 0 when n_contexts > 0 then least(8, 4 * n_contexts) else -30 end + case when hits = 0 and {_ABBREVIATED('comp')} then 24 else 0 end
  + case when short_prefix then 24 else 0 end + case when near_prefix then 24 else 0 end + case when anchored then 24 else 0 end - case when {_ANY('h', _DIRECTORY)} then 30 else 0 end as total from b1),
b3 as (select *, case when anchored then greatest(total, 72) else total end as total3 from b2), b4 as (select *, case when clean then least(greatest(total3, 68), 84) else total3 end as total4 from b3),
b5 as (select *, case when n = 1 and length(w1) <= 3 then least(total4, 79) else total4 end as total5,
  case when h = '' or len(list_filter({_L(W.EXCLUDED_DOMAINS)}, lambda x: h = x or ends_with(h, '.' || x))) > 0 then 'excluded_or_empty_domain' when contains(h, '.') and list_contains({_L(W.FOREIGN_TLDS)}, {_LAST('h')}) then 'foreign_country_domain'
  when {_ANY('h', _KEYWORDS)} then 'non_company_domain_keyword' when not (known and rules) then 'no_distinctive_domain_match' when len(comp) = 0 then 'no_company_tokens' else 'scored' end as reason from b4),
r as (select k, case when reason = 'scored' then greatest(0, least(100, total5)) else 0 end as score, reason from b5) select c_custkey, score, reason from {_ALL}""")
def domain_score(spark, d):
    """Hosts as customers' own: all terms of the score decide some of the cases."""
    host = T.text_or_empty("host")
    scored = _with_ratios(_cases(spark, d)).select("k", N.domain_score("company", host, "title", "snippet", *[F.col(f"{x}_ratio") for x in ("prefix", "whole", "part")]).alias("s"))
    return _customers(spark, d, scored.select("k", F.col("s.score").cast("long").alias("score"), "s.reason"))


#: Queries and labels as they are written, given to events by their number, with a word of the event's user.
ASKED = (
    '"{W}" Türkiye distribütör temsilci', '"{W}" DISTRIBUTOR', '"{W}" marka resmi sitesi', '"{W}" KVKK', '"{W}" ticari unvan', '"{W}" contact', '"{W}" İletişim Türkiye',
    '"{W}" official website Turkiye', '"{W}" Türkiye official website', '"{W}" official website', '"{W}" resmi sitesi', '"{W}" web sitesi', '"{W}" plastik', "", None, '"{W}" contact kvkk',
)
LABELLED = (
    "Fax: {w}", "FAKS no {U}", "WhatsApp", "whats  app", "{W} Genel Merkez", "{W}  office", "Uzman {W}", "Company owner", "Pazarlama", "Sales team", "Satış", "satis", "Export {w} dept", "ihracat", "Istanbul", "izmir ofis", "Izmir", "{w} Ankara",
    "{U} Factory", "Fabrika", "Branch {w}", "Şube", "sube", "General {w}", "", None, "merkez fax",
)
_TEXTS = lambda rows: ", ".join(f"({i}, {_TEXT(x)})" for i, x in enumerate(rows))


_WRITTEN = {"ASKED": ASKED, "LABELLED": LABELLED}
_EVERY = lambda rows, column: f"select event_id as k, {_SPELT('pattern', 'word')} as {column} from (select event_id, {_LETTERS('user_id')} as word from events) join q on event_id % {len(_WRITTEN[rows])} = q.k"


def _events(spark, d, rows, column):
    """event_id and a text for every event, by a pattern and with the word of its user."""
    own = spark.createDataFrame(list(enumerate(rows)), f"k long, {column} string")
    each = read(spark, d, "events").select("event_id", (F.col("event_id") % len(rows)).alias("k"), own_word(F.col("user_id")).alias("word")).join(F.broadcast(own), "k")
    return each.select("event_id", spelt(F.col(column), F.col("word")).alias(column))


@query(f"""with q(k, pattern) as (values {_TEXTS(ASKED)}), n0 as ({_EVERY('ASKED', 'asked')}), n as (select k, asked, {_FOLD('asked')} as a from n0),
i as (select *, case when contains(a, 'distributor') or contains(a, 'temsilci') or contains(a, 'marka resmi') then 'relationship' when contains(a, 'kvkk') or contains(a, 'ticari unvan') then 'legal_identity' when contains(a, 'contact') or contains(a, 'iletisim') then 'contact'
when contains(a, 'official website') and contains(a, 'turkiye') then 'country_official' when contains(a, 'official website') or contains(a, 'resmi sitesi') or contains(a, 'web sitesi') then 'official' else 'context' end as intent from n)
select k as event_id, asked, intent, case intent when 'relationship' then 100 when 'legal_identity' then 95 when 'contact' then 90 when 'country_official' then 80 when 'official' then 70 else 60 end as priority from i""")
def query_intents(spark, d):
    intent = T.query_intent("asked")
    return _events(spark, d, ASKED, "asked").select("event_id", "asked", intent.alias("intent"), T.intent_priority(intent).alias("priority"))


@query(f"""with q(k, pattern) as (values {_TEXTS(LABELLED)}), n0 as ({_EVERY('LABELLED', 'label')}), n as (select k, label, lower(regexp_replace(coalesce(label, ''), '\\s+', ' ', 'g')) as a from n0),
i as (select k, label, case when contains(a, 'fax') or contains(a, 'faks') then 'fax' when contains(a, 'whatsapp') or contains(a, 'whats app') or contains(a, 'wa.me') then 'whatsapp' when contains(a, 'headquarters') or contains(a, 'merkez') then 'headquarters'
when contains(a, 'specialist') or contains(a, 'uzman') then 'specialist' when contains(a, 'owner') or contains(a, 'sahibi') or contains(a, 'yetkili') then 'owner' when contains(a, 'marketing') or contains(a, 'pazarlama') then 'marketing'
when contains(a, 'sales') or contains(a, 'satis') or contains(a, 'satış') then 'sales' when contains(a, 'export') or contains(a, 'ihracat') then 'export' when contains(a, 'istanbul') then 'istanbul' when contains(a, 'izmir') then 'izmir' when contains(a, 'ankara') then 'ankara'
when contains(a, 'factory') or contains(a, 'fabrika') then 'factory' when contains(a, 'branch') or contains(a, 'sube') or contains(a, 'şube') then 'branch' else 'general' end as kind from n)
select k as event_id, label, kind from i""")
def contact_labels(spark, d):
    return _events(spark, d, LABELLED, "label").select("event_id", "label", T.contact_label("label").alias("kind"))


#: Names with marks and other forms of letters, some with a word of the event's user.
MARKED = ("Çelik {W} İnşaat", "ILGIN ılık {U}", "Café {w} Ångström", "naïve Über {W}", "{U} ÖZGÜR ŞİRKET", "plain {w}", "", None, "Łódź", "ñandú")

_WRITTEN["MARKED"] = MARKED


@query(f"""with q(k, pattern) as (values {_TEXTS(MARKED)}), m as ({_EVERY('MARKED', 'name')}) select k as event_id, replace(lower(strip_accents(coalesce(name, ''))), 'ı', 'i') as folded from m""")
def unicode_fold(spark, d):
    return _events(spark, d, MARKED, "name").select("event_id", T.fold_unicode("name").alias("folded"))
