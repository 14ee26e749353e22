"""Fill-in-the-middle, whitening and URL verdicts against plain Python, with nulls, repeated rows, clashing names and empty tables."""

import collections
import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from orgweave.llm import fill_in_middle, url_filter, whitening

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def brute_middle(doc_id, text, marks=("<P>", "<S>", "<M>"), rate=100, suffix_first=50, seed=7):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    p, s, m = marks
    if not text or any(x in text for x in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < suffix_first:
        return n, "spm", len(pre), len(mid), s + suf + p + pre + m + mid
    return n, "psm", len(pre), len(mid), p + pre + s + suf + m + mid


MIDDLE = [(i, "\n".join("ab é日😀 <"[: 1 + (i * k) % 9] for k in range(i % 7))) for i in range(60)]
MIDDLE += [(60, None), (61, ""), (62, "\n"), (63, "\n\n\n"), (64, "no line feed"), (65, "a\nb\n"), (66, "has <M> mark\nin it"), (67, "a\r\nb c\n\n d"), (67, "a\r\nb c\n\n d"), (67, "same id\nother text"), (None, "a\nb\nc\nd"), (None, None)]
MIDDLE += [(68, "line of text\n" * 20_000), (69, "x" * 300_000), (70, "<P\n><S\n<\n>M>\n<")]
NAMES = "doc_id long, text string, n string, form string, id string, key string, row string, output int"


@pytest.fixture(scope="module")
def middle(spark):
    return spark.createDataFrame([(i, t, "clash", None, "id", "key", "row", 3) for i, t in MIDDLE], NAMES).repartition(3)


@pytest.mark.parametrize("rate,suffix_first,marks", [(100, 50, ("<P>", "<S>", "<M>")), (40, 10, ("⟨pre|", "⟨suf|", "⟨mid|"))])
def test_fill_in_middle_against_brute_force(spark, middle, rate, suffix_first, marks):
    made = fill_in_middle.fill_in_middle(middle, marks=marks, rate=rate, suffix_first=suffix_first).withColumn("back", fill_in_middle.restore(F.col("output"), F.col("form"), marks)).collect()
    got = collections.Counter((r.row.doc_id, r.row.text, r.row.output, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made)
    assert got == collections.Counter((i, t, 3, *brute_middle(i, t, marks, rate, suffix_first)) for i, t in MIDDLE)
    assert all(r.back == (r.row.text or "") for r in made)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_fill_in_middle_edges(spark):
    none = fill_in_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))
    assert none.collect() == [] and none.columns == ["row", "n", "form", "prefix_chars", "middle_chars", "output"]
    for marks in (("<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("a", "xay", "c"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fill_in_middle._checked(marks)


def test_op11_rows(spark, middle, tmp_path):
    middle.write.parquet(f"{tmp_path}/documents.parquet")
    rows = fill_in_middle.op11(spark, str(tmp_path)).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = [(i, *b[:4], sha(b[4]), sha(t or "")) for i, t in MIDDLE for b in [brute_middle(i, t)]]
    assert collections.Counter(map(tuple, rows)) == collections.Counter(expected)


def exact_whitening(rows, components=8):
    """Fractions and numpy: deviations, covariance and explained shares."""
    x = [[math.floor(1024 * c) + 100_000 for c in row] for row in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    deviations = [sum((n * r[k] - s[k]) ** 2 for k in range(d)) for r in x]
    v = [[sum((Fraction(r[i]) - Fraction(s[i], n)) * (Fraction(r[j]) - Fraction(s[j], n)) for r in x) / n for j in range(d)] for i in range(d)]
    e, q = np.linalg.eigh(np.array([[float(c) for c in r] for r in v]))
    order = np.argsort(-e)[:components]
    away = np.array([[float(Fraction(r[k]) - Fraction(s[k], n)) for k in range(d)] for r in x])
    return n, deviations, away @ q[:, order] / np.sqrt(e[order]), e[order] / float(sum(v[k][k] for k in range(d)))


def vectors(n, d, size=1.0, seed=3):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) * np.linspace(1, 3, d) * size + r.normal(size=d) * 5).astype(np.float32).astype(float).tolist()


@pytest.mark.parametrize("n,d,size,kind", [(60, 12, 1.0, "float"), (30, 4, 3e9, "double"), (40, 9, 1e14, "double")])
def test_whitening_against_fractions(spark, n, d, size, kind):
    good = vectors(n, d, size)
    rows = [(i, v, 1) for i, v in enumerate(good)]
    rows += [(900, None, 1), (901, [], 1), (902, [None, *good[0][1:]], 1), (903, [float("nan"), *good[0][1:]], 1), (904, [float("-inf"), *good[0][1:]], 1), (905, good[0][1:], 1)]
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, whitened int").repartition(4)
    n_, deviations, expected, explained = exact_whitening(good)
    got = whitening.whiten(table, "vec_id", "whitened").collect()
    k = min(8, d)
    assert len(got) == n * k and {r.n for r in got} == {n_} and max(r.identity_error for r in got) < 1e-9
    assert all(r.row.whitened == 1 for r in got)
    assert {(r.row.vec_id, int(r.deviation)) for r in got} == set(enumerate(deviations))
    found = np.zeros((n, k))
    for r in got:
        found[r.row.vec_id, r.component - 1] = r.whitened
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
    sign = np.sign((found * expected[:, :k]).sum(0))
    assert np.allclose(found, expected[:, :k] * sign, rtol=1e-7, atol=1e-8)


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>"
    columns = ["row", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None), (2, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5):
        got = whitening.whiten(spark.createDataFrame(rows, schema), "vec_id")
        assert got.collect() == [] and got.columns == columns
    # repeated rows and null ids are rows of their own; a constant entry makes no component; ties of lengths go to the longer
    rows = [(1, [1.0, 5.0, 2.0])] * 2 + [(None, [2.0, 5.0, -1.0]), (4, [0.5, 5.0, 0.25])] + [(i, [1.0, float(i)]) for i in range(5, 9)]
    got = whitening.whiten(spark.createDataFrame(rows, schema), "vec_id").collect()
    assert collections.Counter((r.row.vec_id, r.component) for r in got) == {(1, 1): 2, (1, 2): 2, (None, 1): 1, (None, 2): 1, (4, 1): 1, (4, 2): 1}
    assert got[0].identity_error < 1e-9


def test_whitening_digits_and_limbs():
    y = np.array([[0, 1, -1, 2**19, -(2**19), 2**62, -(2**62), 123456789012345]], np.int64)
    parts = whitening.digits(y)
    assert sum(p.astype(object) * (1 << (20 * k)) for k, p in enumerate(parts)).tolist() == y.tolist()
    for total in (0, -1, 2**150 + 17, -(2**140) + 5):
        assert sum(x << (30 * k) for k, x in enumerate(whitening.limbs(total))) == total


def brute_rule(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best and best[4]


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM:80/en/x?q#f", "https://example.com", "https://example.com/", "https://example.com/en/", "https://www.example.com/en/1", "https://a.www.example.com/en", "ftp://x.net/es/a"]
URLS += ["http://net/fr/", "http://xnet/fr/", "http://é.net/fr/é?x", "http://user@b.net/de/?/fr/", "a://b://c.com/x", "http://c.com?u=/en/", "http://" + "a." * 3000 + "com/" + "p" * 9000, "http://x.com\n/en/", "http://bücher.com/a b"]


def test_rules_against_brute_force(spark):
    rules = [*url_filter.RULES, ("com", "/x", "block"), ("b.net", "/de/", "block"), ("b.net", "/de/", "allow"), ("c.com", "", "block"), ("", "/", "block"), ("m", "/ab", "allow")]
    rows = [(i, u, "clash", 1) for i, u in enumerate(URLS)] + [(None, URLS[7], "clash", 1), (3, URLS[8], "clash", 2), (3, URLS[8], "clash", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict int")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = url_filter.filter_urls(pages, none, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    expected = [(i, u, k, *brute_rule(u, rules)) for i, u, _, k in rows]
    assert collections.Counter((r.row.page_id, r.row.url, r.row.verdict, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got) == collections.Counter(expected)
    assert all(r.verdict == "allow" for r in got if r.rule is None)


@pytest.mark.parametrize("a,b,x", [(0.5, 0.5, 0.5), (2.0, 30.0, 0.1), (700.5, 300.2, 0.72), (1.0, 1.0, 0.3), (40.0, 2.5, 0.9), (0.01, 5.0, 0.5), (5000.0, 5000.0, 0.5)])
def test_beta_tail(a, b, x):
    """Against the mean of the density over narrow strips, in a variable that tames the ends."""
    n = 2_000_000
    t = (np.arange(n) + 0.5) / n  # u = t^k / (t^k + (1 - t)^k)
    k = 60.0 if min(a, b) < 0.1 else 4.0
    logit = k * (np.log(t) - np.log1p(-t))
    log_u, log_v = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
    density = np.exp(a * log_u + b * log_v + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) * k / (t * (1 - t))
    assert url_filter.beta_above(np.array([a]), np.array([b]), x)[0] == pytest.approx(density[log_u > math.log(x)].sum() / n, abs=2e-5)


def brute_reputation(hosts):
    """{host: (n, k, mean)} by plain loops over {host: (n, k)}."""
    domain = lambda h: ".".join(h.split(".")[-2:])
    suffix = lambda d: d.split(".", 1)[1] if "." in d else d
    levels = [collections.defaultdict(lambda: [0, 0]) for _ in range(3)]
    up = [{}, {}, {}]
    for h, (n, k) in hosts.items():
        chain = (suffix(domain(h)), domain(h), h)
        for level, name in zip(levels, chain):
            level[name][0] += n
            level[name][1] += k
        up[0][chain[0]], up[1][chain[1]], up[2][chain[2]] = "", chain[0], chain[1]
    n, k = (sum(x[i] for x in levels[0].values()) for i in range(2))
    counts, prior = {"": (n, k)}, {"": (k + 0.5) / (n + 1)}
    for level, parent in zip(levels, up):
        excess = room = 0.0
        for p, (pn, pk) in counts.items():
            seen = [level[m] for m in level if parent[m] == p and level[m][0]]
            if seen:
                r = pk / pn
                excess += sum(c[0] * (c[1] / c[0] - r) ** 2 for c in seen) - r * (1 - r) * (len(seen) - 1)
                room += r * (1 - r) * (pn - sum(c[0] ** 2 for c in seen) / pn - len(seen) + 1)
        strength = url_filter.concentration(excess, room)
        prior = {m: (level[m][1] + strength * prior[parent[m]]) / (level[m][0] + strength) for m in level}
        counts = {m: tuple(level[m]) for m in level}
    return {h: (*counts[h], prior[h]) for h in hosts}


def test_reputation_against_brute_force(spark):
    r = random.Random(8)
    hosts, rows, labels = {}, [], []
    for d in range(40):
        rate = r.choice((0.05, 0.1, 0.9))
        for s in range(r.randint(1, 4)):
            host = f"s{s}.d{d}.{r.choice(('com', 'net', 'org'))}"
            for _ in range(r.choice((1, 3, 30, 200))):
                page, seen = len(rows), r.random() < 0.6
                rows.append((page, f"http://{host}/x/{page}"))
                bad = int(r.random() < rate)
                if seen:
                    labels.append((page, 1 - bad, 0))
                n, k = hosts.get(host, (0, 0))
                hosts[host] = (n + seen, k + (seen and bad))
    labels += [(None, 0, 1), (10**9, 0, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labelled = url_filter.outcomes(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = url_filter.filter_urls(pages, labelled, spark.createDataFrame([], "host string, path string, verdict string")).collect()
    expected = brute_reputation(hosts)
    assert len(found) == len(rows)
    for x in found:
        n, k, mean = expected[x.host]
        assert x.n_labelled == n and x.bad_rate == pytest.approx(mean, rel=1e-9)
        assert (x.verdict == "block") == (x.bad_probability >= url_filter.CONFIDENCE)
    blocked = {x.host for x in found if x.verdict == "block"}
    many = {h for h, (n, k) in hosts.items() if n >= 15}
    assert {h for h in many if hosts[h][1] / hosts[h][0] > 0.75} <= blocked and not {h for h in many if hosts[h][1] / hosts[h][0] < 0.4} & blocked


def test_url_filter_edges(spark):
    labels = spark.createDataFrame([(1, 0, None), (1, 1, 0), (2, None, None), (3, None, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, url_filter.outcomes(labels).collect())) == [(1, 1), (3, 1), (4, 0)]
    pages, none = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int")
    rules = spark.createDataFrame(list(url_filter.RULES), "host string, path string, verdict string")
    assert url_filter.filter_urls(pages, none, rules).collect() == []
