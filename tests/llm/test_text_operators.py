import hmac
import random
import re

import numpy as np
import pytest

from orgweave.llm import decontaminate, html_extract, license_scan, near_dedup, packing, pii

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- near-duplicates
def brute_components(rows, percent):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    parent = {i: i for i, _ in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(docs, texts, percent):
    expected = brute_components([(i, t) for i, t in texts if i is not None], percent)
    rows = near_dedup.near_duplicates(docs, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    kept = near_dedup.drop_near_duplicates(docs, percent)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in expected.values()})
    assert ids.count(None) == 1


def test_large_buckets_are_worked_through_in_blocks(spark, monkeypatch):
    """Variants of one text, few of them near its ends: only a full search of their buckets links all."""
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    r = np.random.default_rng(8)
    words, rows = [f"w{i}" for i in range(100)], []
    for i in range(60):
        copy = list(words)
        for k in range(i % 5):
            copy[(i * 7 + k * 20) % 100] = f"x{r.integers(1000)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_components(rows, 85)


def test_near_duplicates_of_nothing(no_docs):
    assert near_dedup.near_duplicates(no_docs).count() == 0
    assert near_dedup.drop_near_duplicates(no_docs).count() == 0


# ---- decontamination
def distance(a, b):
    """Edits between a and its best stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_decontaminate_against_brute_force(spark):
    r = np.random.default_rng(6)
    word = lambda: "".join(r.choice(list("abcdefghij"), r.integers(2, 8)))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(8)]
    rows = []
    for i in range(48):
        text = list(items[i % 8][1].upper() if i % 3 else items[i % 8][1])
        for _ in range(i // 2):
            at = int(r.integers(len(text)))
            kind = r.integers(3)
            text[at : at + (kind > 0)] = [] if kind == 1 else ["q"] if kind == 2 else ["q"]
        around = lambda: " ".join(word() for _ in range(30))
        rows.append((i, around() + "\n " + "".join(text) + "  " + around()))
    rows += [(100, None), (101, ""), (102, "short"), (0, rows[0][1])]
    docs = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, edits string")
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (52, "tiny")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in decontaminate.contaminated_passages(docs, bench).collect()}
    fold = lambda t: " ".join((t or "").lower().split())
    expected = {}
    for i, t in rows:
        for k, item in items:
            limit = min(int(0.1 * len(fold(item))), (len(fold(item)) - 8) // 8)
            if (d := distance(fold(item), fold(t))) <= limit:
                expected[i, k] = d
    assert {k: x.edits for k, x in got.items()} == expected
    assert 10 < len(expected) < 48
    exact = got[0, 0]
    assert fold(dict(rows)[0][exact.start : exact.start + exact.length]) == fold(items[0][1])
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert {x.doc_id for x in clean.collect()} == {i for i, _ in rows} - {i for i, _ in expected}
    assert decontaminate.remove_contaminated(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.contaminated_passages(docs.limit(0), bench).count() == 0


def test_decontaminate_in_parts(spark, monkeypatch):
    """Grams that all items hold are taken in parts; short items are found."""
    items = [(i, f"the same words in every item and then {i * 7919}") for i in range(30)] + [(90, "abcdefghi"), (91, " ".join(str(k * k) for k in range(400)))]
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(x) for x in decontaminate.contaminated_passages(docs, bench).collect()}
    assert {(i, i) for i, _ in items} <= {(x[0], x[1]) for x in whole}
    monkeypatch.setattr(decontaminate, "AT_ONCE", 40)
    index = next(decontaminate.indexes(bench.where("item_id < 90")))
    import numpy

    text = numpy.frombuffer(("before " + items[3][1] + " after").encode(), numpy.uint8)
    found = index.matches(*decontaminate.fold(text, numpy.array([0, len(text)]))[:2])
    assert {(3, x[1]) for x in whole if x[0] == 3} == {(3, index.ids[i]) for _, i, *_ in found}


def test_long_items_against_the_whole_band(monkeypatch):
    """Passages of long items with edits of all kinds: found by chains exactly where the whole band finds them, with at least its edits."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((420, 440))] + [(2, "aaaa bbbb " * 20 + " ".join(word() for _ in range(380)))]
    texts = []
    for share in (0, 0.04, 0.095, 0.2):
        for _, item in items:
            edited = list(item)
            for _ in range(int(share * len(item))):
                k, kind = r.randrange(len(edited)), r.random()
                if kind < 0.4:
                    edited[k] = r.choice("xyz")
                elif kind < 0.7:
                    edited.insert(k, r.choice("xyz "))
                else:
                    del edited[k]
            if share == 0.04:  # a whole stretch is gone, another is new
                edited[500:560] = list("something else that was never there")
            texts.append(" ".join([word(), "".join(edited), word(), word()]))
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    folded = decontaminate.fold(data, offsets)[:2]
    chained = {(x[0], x[1]): x for x in decontaminate.Index.build(items).matches(*folded)}
    monkeypatch.setattr(decontaminate, "LONG", 1 << 30)
    banded = {(x[0], x[1]): x for x in decontaminate.Index.build(items).matches(*folded)}
    assert set(chained) == set(banded) and len(banded) >= 8
    index = decontaminate.Index.build(items)
    for key, (_, item, start, end, edits) in chained.items():
        assert banded[key][4] <= edits <= index.edits[item] and abs(start - banded[key][2]) <= index.edits[item] and abs(end - banded[key][3]) <= index.edits[item]
    monkeypatch.undo()
    one = "".join(word() for _ in range(60_000))
    whole = np.frombuffer(("a " + one + " b").encode(), np.uint8)
    assert decontaminate.Index.build([(1, one)]).matches(*decontaminate.fold(whole, np.array([0, len(whole)]))[:2]) == [(0, 0, 2, 2 + len(one), 0)]


@pytest.mark.parametrize("a,b,whole", [("", "", True), ("abc", "abc", True), ("abc", "axcd", True), ("kitten", "sitting", True), ("abc", "xxabcxx", False), ("abc", "abxcyy", False), ("abc", "", False)])
def test_gap_edits(a, b, whole):
    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row = _next(row, c, y, i)
        return row

    def _next(row, c, y, i):
        out = [i]
        for j, d in enumerate(y, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (c != d)))
        return out

    row = distance(a, b)
    expected = row[-1] if whole else min(row)
    got, used = decontaminate._edits(np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8), 99, whole)
    assert got == expected and row[used] == expected


def test_decontaminate_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    items = [(i, f"item number {i} has some words of its own {i * 7919}") for i in range(6)]
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated_passages(docs, bench).collect() if x.edits == 0}
    assert got == {(i, i) for i in range(6)}


# ---- PII
@pytest.fixture(scope="module")
def hide(spark):
    def run(*values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")
        return [(r.text, r.kinds) for r in pii.pseudonymise(df, "key", kinds_col="kinds").orderBy("doc_id").collect()]

    return run


def luhn(s):
    return sum(int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pii_keeps_formats_and_links(hide):
    card, spaced, iban, mail = "4111111111111111", "4111 1111 1111 1111", "GB29 NWBK 6016 1331 9268 19", "Ab.c9@x.example.org"
    out = hide(f"pay {card} now", f"again {spaced}.", f"to {iban}", f"at {mail}, {mail}", "call +1 (743) 555-3824 or 743-555-3824", "on 1985-03-12 and 12/03/1985", "from 10.0.0.1", "ssn 123-45-6789")
    new = re.search(r"\d{16}", out[0][0])[0]
    assert new != card and luhn(new) and out[1][0] == f"again {' '.join(new[i : i + 4] for i in range(0, 16, 4))}."
    moved = out[2][0][3:].replace(" ", "")
    assert moved != iban.replace(" ", "") and int("".join(str(int(c, 36)) for c in moved[4:] + moved[:4])) % 97 == 1
    a, b = re.findall(r"\S+@x\.example\.org", out[3][0])
    assert a == b != mail and re.fullmatch(r"[A-Z][a-z]\.[a-z]\d@x\.example\.org", a)
    p, q = re.fullmatch(r"call \+1 (\(\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4})", out[4][0]).groups()
    assert re.sub(r"\D", "", p) == re.sub(r"\D", "", q) != "7435553824"
    iso, day_first = re.fullmatch(r"on (\d{4}-\d\d-\d\d) and (\d\d/\d\d/\d{4})", out[5][0]).groups()
    assert "/".join(reversed(iso.split("-"))) == day_first != "12/03/1985"
    assert [k for _, k in out] == [["card"], ["card"], ["iban"], ["email"] * 2, ["phone"] * 2, ["date"] * 2, ["ipv4"], ["ssn"]]


def test_pii_leaves_the_rest_alone(hide):
    values = [None, "", "plain words", "card 4111111111111112", "1985-02-30", "300.1.1.1", "000-12-3456", "page 12 of 2024", "v1.2.3.4.5", "order 8007782375593431", "a@b"]
    assert [t for t, _ in hide(*values)] == values


def test_pii_finds_numbers_before_other_groups(hide):
    """A card before its code, an IBAN before another block: the groups behind stay."""
    card, iban = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
    out = hide(f"{card} 123", card, f"{iban} 2024", iban)
    assert out[0][0] == out[1][0] + " 123" and out[0][1] == ["card"] and out[1][0] != card
    assert out[2][0] == out[3][0] + " 2024" and out[2][1] == ["iban"] and out[3][0] != iban


def test_pii_keys(spark):
    import hashlib
    import hmac

    from pyspark.sql import functions as F

    made = spark.range(1).select(pii._hmac("k" * 70, F.lit("a"), F.lit("b"))).first()[0]
    assert made == hmac.new(b"k" * 70, b"a|b", hashlib.sha256).hexdigest()
    spark.conf.unset(pii.KEY_SETTING)
    key = pii.session_key(spark)
    assert len(key) == 64 and pii.session_key(spark) == key


def plain_text_network(key, kind, value, alphabets):
    """The text network in plain Python."""
    if len(value) < 2:
        for letters in alphabets:
            order = sorted(letters, key=lambda c: hmac.new(key.encode(), f"{kind}|one|{c}".encode(), "sha256").hexdigest())
            if value and value in letters:
                return order[letters.index(value)]
        return value

    def moved(x, turn, other):
        digits = "".join(hmac.new(key.encode(), f"{kind}|{turn}|{b}|{other}".encode(), "sha256").hexdigest() for b in range(len(x) * 3 // 64 + 1))
        out = ""
        for k, c in enumerate(x):
            own = next((letters for letters in alphabets if c in letters), None)
            out += own[(own.index(c) + int(digits[3 * k : 3 * k + 3], 16)) % len(own)] if own else c
        return out

    a, b = value[: len(value) // 2], value[len(value) // 2 :]
    for i in range(pii.ROUNDS):
        a, b = (moved(a, i, b), b) if i % 2 == 0 else (a, moved(b, i, a))
    return a + b


def plain_digit_network(key, kind, digits):
    half = len(digits) // 2
    a, b, size_a, size_b = int(digits[:half] or 0), int(digits[half:]), 10**half, 10 ** (len(digits) - half)
    turn = lambda i, x: int(hmac.new(key.encode(), f"{kind}|{i}|{x}".encode(), "sha256").hexdigest()[:13], 16)
    for i in range(pii.ROUNDS):
        a, b = ((a + turn(i, b)) % size_a, b) if i % 2 == 0 else (a, (b + turn(i, a)) % size_b)
    return (str(a).zfill(half) if half else "") + str(b).zfill(len(digits) - half)


def test_pii_networks_against_plain_python(spark):
    from pyspark.sql import functions as F

    r = random.Random(6)
    letters = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
    texts = ["", "a", "Z", "7", ".", "a.b"] + ["".join(r.choice("abzABZ019._-") for _ in range(n)) for n in (2, 3, 21, 40, 41, 42, 64, 65, 85, 128, 129)]
    digits = ["".join(r.choice("0123456789") for _ in range(n)) for n in (1, 2, 5, 11, 17, 30, 36)]
    rows = spark.createDataFrame([(t, None) for t in texts] + [(None, d) for d in digits], "t string, d string")
    got = rows.select("t", "d", pii.permute_text("k", "x", F.col("t"), letters).alias("a"), F.when(F.col("d").isNotNull(), pii.permute_digits("k", "x", F.col("d"))).alias("b")).collect()
    assert {x.t: x.a for x in got if x.t is not None} == {t: plain_text_network("k", "x", t, letters) for t in texts}
    assert {x.d: x.b for x in got if x.d} == {d: plain_digit_network("k", "x", d) for d in digits}


@pytest.mark.parametrize("n", [41, 64, 100, 128])
def test_pii_keeps_no_difference_of_long_secrets(hide, n):
    """No distance at which the differences of characters survive: they agree as often as those of other texts would."""
    r = random.Random(n)
    secrets = ["".join(r.choice("0123456789abcdef") for _ in range(n)) for _ in range(30)]
    made = [t for t, _ in hide(*secrets)]
    assert all(re.fullmatch(f"[0-9a-f]{{{n}}}", t) and t != s for s, t in zip(secrets, made))
    for step in range(1, n):
        pairs = [(s, t, i) for s, t in zip(secrets, made) for i in range(n - step)]
        same = sum((int(s[i], 16) - int(s[i + step], 16) - int(t[i], 16) + int(t[i + step], 16)) % 16 == 0 for s, t, i in pairs)
        assert same < len(pairs) / 16 + 6 * (len(pairs) / 16) ** 0.5


def test_pii_clashing_names(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "call +1 (743) 555-3824", "a", "b", "c", "d")], "doc_id long, text string, __pii string, pii string, row string, odd_name string")
    done = pii.pseudonymise(rows, "key", kinds_col="kinds").first()
    assert done.asDict() | {"text": ""} == {"doc_id": 1, "text": "", "__pii": "a", "pii": "b", "row": "c", "odd_name": "d", "kinds": ["phone"]}
    alone = {t: x for t, x in zip("abcxyz", rows.select(F.explode(F.array(*map(F.lit, "abcxyz"))).alias("t")).select(pii.permute_text("k", "x", F.col("t"), ("abcxyz",))).toPandas().iloc[:, 0])}
    assert sorted(alone.values()) == sorted(alone) and alone != {t: t for t in alone}


def test_pii_is_a_bijection(hide):
    out = hide(*[f"{i}.{j}.7.9" for i in range(40) for j in range(40)])
    assert len({t for t, _ in out}) == 1600
    days = hide(*[f"20{y:02d}-01-{d:02d}" for y in range(20) for d in range(1, 29)])
    assert len({t for t, _ in days}) == 560


def test_pii_passes_columns_through(docs, no_docs):
    done = pii.pseudonymise(docs, "key")
    assert done.columns == docs.columns and done.count() == docs.count()
    assert pii.pseudonymise(no_docs, "key").count() == 0


# ---- licences
def scan(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [tuple(r)[1:] for r in license_scan.license_scan(df, "doc_id").drop("matches").orderBy("doc_id").collect()]


def test_license_scan(spark):
    out = scan(
        spark, None, "", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.",
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "the license of apache and mit",
        "MIT license MIT LICENSE", "x " * 3000 + "mit-license", "This work is licensed under the GNU Lesser General Public License version 2.1 or later",
    )
    assert out[0][:6] == out[1][:6] == (0, 0, None, None, "", "")
    assert out[2][:6] == (5, 1, 3, 3, "mit", "mit")
    assert out[3][:6] == (8, 1, 3, 3, "apache", "apache")
    assert out[4][:6] == (12, 1, 7, 7, "gpl", "gpl")
    assert out[5][4:6] == ("", "cc-by-nc") and out[5][6] > 0.5
    assert out[6][1:6] == (0, None, None, "", "")
    assert out[7][:4] == (4, 2, 0, 2)
    assert out[8][:4] == (3002, 1, 3000, 3000)
    assert out[9][4:6] == ("gpl", "gpl,lgpl") or set(out[9][5].split(",")) >= {"gpl", "lgpl"}
    assert all(0 <= r[6] <= 1 for r in out)


def test_license_scan_finds_every_notice_of_a_file(spark):
    """A long notice of rare words displaces no other, before it or behind it."""
    of = license_scan.TEMPLATES
    bsd = next(notice for _, notice, _ in of if notice.startswith("redistribution and use"))
    rows = [(i, f"{bsd} {'x ' * 40}{notice}") for i, (_, notice, _) in enumerate(of)]
    rows += [(100 + i, f"{notice} {'x ' * 40}{bsd}") for i, (_, notice, _) in enumerate(of)]
    rows.append((200, " ".join(f"{notice} {'x ' * 9}" for _, notice, _ in of)))
    # the words of all the other notices are frequent
    rows += [(1000 + i, notice.replace(" ", " x ")) for i, (_, notice, _) in enumerate(t for t in list(of) * 8 if t[0] != "bsd")]
    out = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    for i, (label, _, _) in enumerate(of):
        assert {label, "bsd"} <= set(out[i].labels.split(",")) and {label, "bsd"} <= set(out[100 + i].labels.split(","))
        assert (label, len(bsd.split()) + 40) in {(m.label, m.place) for m in out[i].matches}
    assert set(out[200].labels.split(",")) == {label for label, _, _ in of}


def test_license_scan_against_brute_force(spark):
    """Base columns, and every template of random concatenations with random filling."""
    import random

    r, of = random.Random(3), license_scan.TEMPLATES
    filling = ["the", "license", "MIT", "public", "general", "software", "é", "x1", "free", "apache"]
    rows = []
    for i in range(60):
        chosen = [r.randrange(len(of)) for _ in range(r.randrange(4))]
        parts = []
        for c in chosen:
            parts += [*(r.choice(filling) for _ in range(r.randrange(12))), of[c][1].upper() if r.random() < 0.3 else of[c][1]]
        rows.append((i, r.choice([" ", ", ", "\n"]).join([*parts, *(r.choice(filling) for _ in range(9))]), {of[c][0] for c in chosen}))
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    out = {x.doc_id: x for x in license_scan.license_scan(df, "doc_id").collect()}
    for i, text, labels in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(FOLD))
        places = {label: [k for k in range(len(words)) if words[k : k + len(p.split())] == p.split()] for p, label in license_scan.PHRASES.items()}
        every = sorted(k for x in places.values() for k in x)
        got = out[i]
        assert (got.n_words, got.n_base, got.first_word, got.last_word) == (len(words), len(every), min(every, default=None), max(every, default=None))
        base = sorted(k for k, x in places.items() if x)
        assert got.base_labels == ",".join(base)
        possible = {label for label, _, phrases in of if all(f" {p} " in f" {' '.join(words)} " for p in phrases)}
        assert labels | set(base) <= set(got.labels.split(",")) - {""} <= possible | set(base)


def test_license_near_misses(spark):
    """A notice whose key phrases are broken by a word gets no label but by phrases that still stand."""
    of = license_scan.TEMPLATES
    rows = []
    for i, (_, notice, phrases) in enumerate(of):
        for phrase in phrases:
            notice = notice.replace(phrase, " zzz ".join(phrase.split()) if " " in phrase else phrase[:-1] + "q")
        rows.append((i, notice))
    rows += [(900, "SPDX-License-Identifier: MITX"), (901, "license identifier: mit"), (902, "spdx license identifier apache 2 1"), (903, "mozilla's public license"), (904, "without any warranty of any kind")]
    for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect():
        text = f" {' '.join(re.findall('[a-z0-9]+', rows[r.doc_id][1].lower() if r.doc_id < 900 else dict(rows)[r.doc_id].lower()))} "
        possible = {label for label, _, phrases in of if all(f" {p} " in text for p in phrases)} | {label for p, label in license_scan.PHRASES.items() if f" {p} " in text}
        assert set(r.labels.split(",")) - {""} <= possible, (r.doc_id, r.labels)


def test_license_heads_and_identifiers(spark):
    cases = {
        "Mozilla Public License Version 2.0": "mpl", "Eclipse Public License - v 2.0": "epl", "SPDX-License-Identifier: BSD-3-Clause": "bsd", "// SPDX-License-Identifier: GPL-3.0-or-later": "gpl", "Licensed under the EUPL": "eupl",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY": "mit",
        "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0": "cddl", "The Artistic License 2.0": "artistic",
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license_scan.license_scan(rows, "doc_id").collect()} == dict(enumerate(cases.values()))
    named = spark.createDataFrame([(1, "mit license", "a", "b", "c")], "doc_id long, text string, found string, row string, matches string")
    got = license_scan.license_scan(named, "doc_id", "found", "row").first()
    assert (got.found, got.row, got.labels) == ("a", "b", "mit")


def test_near_dedup_clashing_names(spark):
    rows = [(1, "a b c d e f g", "x", 1), (2, "a b c d e f g", "y", 2), (2, "a b c d e f g", "y", 2), (3, "h i j k l m", "z", 3), (3, "h i j k l m", "w", 4), (None, "a b c d e f g", "n", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id string, other long")
    got = near_dedup.drop_near_duplicates(docs)
    assert got.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "a b c d e f g"), (1, "a b c d e f g"), (3, "h i j k l m")]


def test_license_scan_edges(docs, no_docs):
    assert license_scan.license_scan(docs, "doc_id", "label").count() == docs.count()
    assert license_scan.license_scan(no_docs, "doc_id").count() == 0


# ---- HTML
ARTICLE = "<article><h1>Title</h1><p>First &amp; long\n paragraph<br>here <b>bold</b>.<p>x</p><div class='comments'><p>reader says</p></div></article>"


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("<p>a < b &amp;amp; c</p>", "a < b &amp; c"), ("<script>x", ""), ("<!-- x", ""),
    (f"<nav><a>Menu</a></nav><div class=ad>Buy</div>{ARTICLE}<aside>side</aside><footer>&copy;</footer>", "Title\n\nFirst & long paragraph here bold.\n\nx"),
    ("<header>Site</header><div id='cookie-notice'>We use</div><article><h1>Title</h1><p>First &amp; lo", "Title\n\nFirst & lo"),
    ("<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><div>" + "long text " * 20 + "</div><div>Short end.</div><div><a>x</a></div><div><a>y</a></div><div><a>z</a></div>", ("long text " * 20).strip() + "\n\nShort end."),
    ("<title>t</title><style>p{}</style><p>only</p><form><p>name</p></form>", "only"),
])
def test_extract(html, text):
    assert html_extract.extract(html) == text


LONG = "A paragraph of some length that says what the article has to say."


@pytest.mark.parametrize("before,after", [
    ('<div class="content no-sidebar">', "</div>"), ('<div class="post has-comments">', "</div>"), ('<div class="page ad-free">', "</div>"),
    ('<main><div class="search-result-article">', "</div></main>"), ('<body class="right-sidebar"><div class="sidebar">', "</div>"),
    ('<div class="main-nav"><p>Menu of pages</p></div>', f'<div class="comment-list"><article class="comment"><p>{LONG * 3}</p></article></div>'),
])
def test_extract_keeps_marked_articles_whole(before, after):
    article = f"<article><h1>Title</h1><p>{LONG * 2}</p><p>Short.</p><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul><p>{LONG * 2}</p></article>"
    assert html_extract.extract(before + article + after) == "\n\n".join(["Title", LONG * 2, "Short.", "one", "two", "three", LONG * 2])


def test_extract_finds_surge_and_dive_on_unmarked_pages():
    menu = "".join(f"<div>{x}</div>" for x in ("Home", "Products and services", "About us"))
    links = "".join(f"<div><a href={i}>A link of some length to another page</a></div>" for i in range(4))
    first, second = f"<h2>Heading</h2><p>Short first.</p><p>{LONG * 2}</p><p>Short.</p>", f"<div>{LONG * 3}</div><div>And so on.</div>"
    page = menu + first + links + second + "<div>All rights reserved 2024</div><div>Copyright 2024 Someone</div><div>&copy; Someone</div>"
    assert html_extract.extract(page) == "\n\n".join(["Heading", "Short first.", LONG * 2, "Short.", LONG * 3, "And so on."])
    assert html_extract.extract("<p>Copyright law protects authors.</p>") == "Copyright law protects authors."


@pytest.mark.parametrize("html,blocks", [
    ("<ul><li>Home</li><li>News</li></ul><a name=x>" + f"<p>{LONG}</p>" * 4, [LONG] * 4),
    (f"<article><h1>T</h1><p>{LONG * 2}</p><a name=x><p>{LONG}</p><p><a href=1>{LONG}</p><p>{LONG}</p></article>", ["T", LONG * 2, LONG, LONG, LONG]),
    *[(f'<article><section {k}="{w}"><p>{LONG * 2}</p></section></article>', [LONG * 2]) for k in ("id", "class") for w in ("search", "social", "banner", "copyright")],
    ("<article><h1>Title</h1>" + "<p><a href=1>x y</a></p>" * 3 + f"<p>{LONG * 2}</p>" + "<p><a href=1>x y</a></p>" * 3 + "<p>Closing line</p><p><a href=2>more</a></p></article>", ["Title", *["x y"] * 3, LONG * 2, *["x y"] * 3, "Closing line"]),
    (f"<p>Short first sentence.</p><p>{LONG * 2}</p><p>Terms of use</p><p>Privacy policy</p><p>Contact us today</p>", ["Short first sentence.", LONG * 2]),
    (f"<p>{LONG * 2}</p>" + "<div><a href=1>x</a></div>" * 3 + "<p>Short last one.</p><div>Imprint</div>", [LONG * 2, "Short last one."]),
    (f"<article><p>{LONG * 3}</p><div class=ad>{LONG}</div><p>{LONG}</p><div id=comments><p>{LONG * 9}</p></div></article>", [LONG * 3, LONG]),
])
def test_extract_by_weight(html, blocks):
    assert html_extract.extract(html) == "\n\n".join(blocks)


def made_page(r, marked):
    """A page and the blocks of its article: known, as the page is made of them."""
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + r.choice(".!?")
    link = lambda: f"<a href='/{word()}'>{word()}</a>"
    blocks, body = [], []
    title = " ".join(word() for _ in range(4))
    blocks.append(title)
    body.append(f"<h1>{title}</h1>")
    for k in range(r.randint(1, 7)):
        text = sentence(r.randint(20, 60) if k == 0 or r.random() < 0.7 else 5)
        shown = text.replace(" ", "  \n" if r.random() < 0.2 else " ", 1).replace(text[3:6], f"<b>{text[3:6]}</b>", 1)
        blocks.append(text)
        body.append(r.choice((f"<p>{shown}</p>", f"<p class=x id=banner>{shown}", f"<div><p>{shown}</p></div>", f"<p>{shown}<!-- {word()} --><script>{word()}</script></p>")))
        if marked and r.random() < 0.3:
            body.append(r.choice((f"<div class='ad'>{sentence(9)}</div>", f"<aside>{sentence(30)}</aside>", f"<form>{sentence(5)}<button>{word()}</button></form>", f"<div class=share-links>{link()}{link()}</div>")))
    if marked and r.random() < 0.4:
        body.append(f"<section class='comments'><article class=comment><p>{sentence(40)}</p></article></section>")
    menu = "<nav>" + link() * 3 + "</nav>" if r.random() < 0.5 else "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(5)) + "</ul>"
    foot = r.choice((f"<footer>&copy; {word()} {sentence(6)}</footer>", f"<div id=footer>{sentence(20)}</div>", "<div>" + "</div><div>".join(link() for _ in range(4)) + "</div>"))
    notice = r.choice(("", f"<div class='cookie-banner'>{sentence(25)}</div>", f"<header><h2>{word()}</h2></header>"))
    article = "".join(body)
    if marked:
        article = r.choice((f"<article>{article}</article>", f"<main><div class=content>{article}</div></main>", f"<div class=right-sidebar><article id=search>{article}</article></div>"))
    else:
        article = f"<div class=content>{article}</div>"
    return f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{notice}{menu}{article}{foot}</body></html>", blocks


@pytest.mark.parametrize("marked", [True, False])
def test_extract_made_pages(marked):
    """The whole extraction against pages whose article is known."""
    r = random.Random(31)
    for _ in range(400):
        page, blocks = made_page(r, marked)
        assert html_extract.extract(page) == "\n\n".join(blocks), page


def test_runs_against_brute_force():
    r = np.random.default_rng(12)
    for _ in range(200):
        weights = [int(x) for x in r.integers(0, 50, r.integers(0, 25)) * (r.random() > 0.3) * (r.random(1)[0] > 0.1)]
        weights = [w if r.random() < 0.4 else 0 for w in weights]
        n, w = len(weights), html_extract.WINDOW
        sums = [sum(weights[k] for k in range(i, min(n, i + w))) for i in range(n)]
        assert html_extract.window_sums(weights) == sums
        # a line belongs to a run if its window or, within the run, an earlier one reaches text
        inside = [s > 0 for s in sums]
        expected, i = [], 0
        while i < n:
            if not inside[i]:
                i += 1
                continue
            end = i
            while end < n and inside[end]:
                end += 1
            first = next(k for k in range(i, end) if weights[k])
            expected.append((first, end, max(sums[i:end])))
            i = end
        assert html_extract.runs(weights) == expected


def test_extract_deep_and_long_pages(spark):
    deep = "<div>" * 3000 + LONG + "</div>" * 3000
    long = "<article>" + "".join(f"<p>{LONG} {i}</p>" for i in range(20000)) + "</article>"
    assert html_extract.extract(deep) == LONG
    assert html_extract.extract(long).count("\n\n") == 19999
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract_pages(empty, "page_id").count() == 0


def test_extract_pages(spark):
    rows = [(1, "u", None, "c"), (1, "u", f"<body>{ARTICLE}", "c"), (None, None, "<p>é" * 3, "c")]
    out = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), "page_id", "url").collect()
    assert [(r.page_id, r.n_chars) for r in out] == [(1, 0), (1, len(html_extract.extract(ARTICLE))), (None, 7)]
    named = html_extract.extract_pages(spark.createDataFrame([(1, "<p>x</p>", "a", "b", "c")], "row long, html string, __html string, text string, n_chars string"), "row", "html", "__html", "text", "n_chars").first()
    assert named.asDict() == {"row": 1, "html": "<p>x</p>", "__html": "a", "text": "x", "n_chars": 1}


# ---- packing
def test_packer_keeps_every_limit():
    r = np.random.default_rng(2)
    packer, sizes, pieces = packing.Packer(100, 7, 60, pool_size=50), {}, []
    for k in range(400):
        bearing = r.random(int(r.integers(1, 250))) < r.random()
        sizes[k] = len(bearing)
        pieces += [(p, p.example.loss[p.start + p.length] - p.example.loss[p.start]) for p in packer.add(packing.Example(k, len(bearing), None, np.concatenate([[0], np.cumsum(bearing)])))]
    pieces += [(p, p.example.loss[p.start + p.length] - p.example.loss[p.start]) for p in packer.finish()]
    at = dict.fromkeys(sizes, 0)
    by: dict = {}
    for p, loss in pieces:
        by.setdefault(p.sequence, []).append((p.offset, p.length, loss))
    for p, _ in sorted(pieces, key=lambda x: (x[0].example.key, x[0].start)):
        assert p.start == at[p.example.key]
        at[p.example.key] += p.length
    assert at == sizes
    for parts in by.values():
        parts.sort()
        assert [x[0] for x in parts] == list(np.cumsum([0, *[x[1] for x in parts]])[:-1])
        assert sum(x[1] for x in parts) <= 100 and len(parts) <= 7 and sum(x[2] for x in parts) <= 60


def test_pack_documents(spark, docs, texts, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing._vocabulary())
    rows = packing.pack_documents(docs).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *[n for _, n in parts]])[:-1]) and sum(n for _, n in parts) <= 4096
    import collections
    import zlib

    expected = collections.Counter((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in texts)
    got = collections.Counter()
    for r in rows:
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == {k: k[1] * n for k, n in expected.items()}
    whole = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in texts}
    assert all(zlib.crc32(whole[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in rows)
    assert packing.pack_documents(no_docs).count() == 0


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "don't  we'll it's", "a\xa0b　c\x85d\x1ce", "ΑΣ Σ. İstanbul İ ", "a\tb\nc", "x!!! ?!y 3rd", "ǅ ﬀ 각 각", "日本語。 текст, ÀÉ.,", ""])
def test_encoder_equals_the_tokenizer(text):
    e = packing.Encoder(packing._vocabulary())
    expected = e.tokenizer.encode(text, add_special_tokens=False).ids
    assert e.many([text, "other words", text])[0].tolist() == expected
    assert e.many([text])[0].tolist() == expected


def test_pack_conversations(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"turn {t} of {c}") for c in range(30) for t in range(4)] + [(None, None, None, None)]
    out = packing.pack_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.conv_id for r in out} == {*range(30), None}
    assert all(0 <= r.n_loss < r.length for r in out)


# ---- pipeline
def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert docs.count() > 100
    n = docs.count()
    pieces = corpus_pipeline.run(spark, small)
    assert pieces.select("doc_id").distinct().count() == n


def test_encoder_tries_its_tokenizer():
    """A tokenizer that does not split at white space is used on whole texts."""
    import os

    import numpy
    from tokenizers import Tokenizer

    for path in (packing._vocabulary(), os.path.join(os.path.dirname(packing._vocabulary()), "byte_bpe_50k.json")):
        encoder, tokenizer = packing.Encoder(path), Tokenizer.from_file(path)
        texts = ["Hello  World, 12!", "", "\n Über alles\t x", "a" * 50]
        for text, ids in zip(texts, encoder.many(texts), strict=True):
            assert ids.tolist() == numpy.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tolist()
