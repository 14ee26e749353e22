"""Company names against texts, other names and domains: Column in, Column out.

Fuzzy ratios (functions.fuzzy) are Arrow functions; where a rule needs one, the caller gives it
as a column of a table that is written, so that a plan computes it once and never within a lambda.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orgweave.functions import text as T
from orgweave.functions import url as U
from orgweave.functions import words as W


def _listed(words) -> Column:
    return F.array(*map(F.lit, words))


def _lookup(table: dict[str, tuple[str, ...]], word: Column) -> Column:
    """The table's words for a word, an empty array for none."""
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), _listed(v))])
    return F.coalesce(pairs[word], F.array().cast("array<string>"))


def company_tokens(c: Column | str) -> Column:
    """Words of more than one letter that are no legal form."""
    return T._without(T.tokens(c), W.LEGAL_WORDS)


def primary_brand(c: Column | str, limit: int = 2) -> Column:
    return F.slice(T.distinctive_tokens(c), 1, limit)


def brand_compounds(c: Column | str, limit: int = 2) -> Column:
    """The joined brand words, and the same with one word translated."""
    words = primary_brand(c, limit)
    translated = lambda t, i: F.transform(_lookup(W.BRAND_EQUIVALENTS, t), lambda e: F.array_join(F.transform(words, lambda u, j: F.when(j == i, e).otherwise(u)), ""))
    joined = F.array_distinct(F.concat(F.array(F.array_join(words, "")), F.flatten(F.transform(words, translated))))
    return F.filter(joined, lambda x: x != "")


def brand_hits_in(words: Column, found: Column) -> Column:
    """(matched, total, translated) of brand words among the words of a text; translations count only beside the first word, of 5 letters or more."""
    first = F.get(words, F.lit(0))
    anchored = F.coalesce((F.length(first) >= 5) & F.array_contains(found, first), F.lit(False))
    exact = F.filter(words, lambda t: F.array_contains(found, t))
    other = F.filter(words, lambda t: ~F.array_contains(found, t) & anchored & F.arrays_overlap(_lookup(W.BRAND_EQUIVALENTS, t), found))
    return F.struct((F.size(exact) + F.size(other)).alias("matched"), F.size(words).alias("total"), F.size(other).alias("translated"))


def brand_hits(company: Column | str, text: Column | str, limit: int = 2) -> Column:
    """brand_hits_in for a company's first brand words and a text."""
    return brand_hits_in(primary_brand(company, limit), T.tokens(text))


def brand_vocabulary(words: Column) -> Column:
    """Brand words and the words that translate them: all that brand_hits_in looks for in a text."""
    return F.array_distinct(F.concat(words, F.flatten(F.transform(words, lambda t: _lookup(W.BRAND_EQUIVALENTS, t)))))


def legal_phrase(company: Column | str, text: Column | str, whole: bool = False) -> Column:
    """Whether the name's first four meaningful words (all if whole) stand together among the text's."""
    needle = T.legal_tokens(company)
    return T.has_phrase(T.legal_tokens(text), needle if whole else F.slice(needle, 1, 4))


def business_name_identity(company: Column | str, business: Column | str) -> Column:
    """Whether a directory's business name is the company's: its phrase, or its first two brand words, alone, joined or as prefixes."""
    quiet = lambda words: F.filter(words, lambda t: ~F.array_contains(_listed(W.BRIDGE_NOISE), t))
    target = F.slice(quiet(primary_brand(company, 4)), 1, 2)
    observed = quiet(T.legal_tokens(business))
    long = lambda x: F.length(x) >= 3
    following = lambda i: F.get(observed, i + 1)
    joined = F.array_compact(F.transform(observed, lambda t, i: F.when(long(t) & F.coalesce(long(following(i)), F.lit(False)), F.concat(t, following(i)))))
    every = F.concat(observed, joined)
    prefix = lambda t, v: (F.least(F.length(t), F.length(v)) >= 6) & (t.startswith(v) | v.startswith(t))
    compatible = lambda t: F.exists(every, lambda v: (t == v) | prefix(t, v))
    one = (F.size(target) == 1) & F.coalesce(F.length(F.get(target, F.lit(0))) >= 3, F.lit(False)) & F.forall(target, compatible)
    return legal_phrase(company, business) | ((F.size(target) >= 2) & F.forall(target, compatible)) | one


def ownership_in(legal: Column, words: Column, reach: int = 240) -> Column:
    """ownership_statement of a name's meaningful words and a text's words, joined by spaces."""
    needle = F.array_join(F.slice(legal, 1, 4), " ")

    def near(marker: str) -> Column:
        at = F.instr(words, marker)
        low = F.greatest(at - 1 - reach, F.lit(0))
        return (at > 0) & F.contains(F.substring(words, low + 1, at - 1 + reach - low), needle)

    said = F.lit(False)
    for marker in W.OWNERSHIP_MARKERS:
        said = said | near(marker)
    return (F.size(legal) > 0) & said


def ownership_statement(company: Column | str, text: Column | str, reach: int = 240) -> Column:
    """Whether a text says, within `reach` characters of a marker of ownership, the name's first four meaningful words."""
    return ownership_in(T.legal_tokens(company), F.array_join(T.tokens(text), " "), reach)


def activity_qualifiers(c: Column | str) -> Column:
    """Activities that a name states, by family, in order."""
    families = W.ACTIVITIES | {a: name for name, aliases in W.CONTEXTS.items() for a in aliases if " " not in a}
    known = sorted({*W.SECTOR_WORDS, *W.BUSINESS_WORDS, *W.CONTEXT_WORDS, *families} - set(W.NO_ACTIVITIES))
    family = F.create_map(*[x for k, v in families.items() for x in (F.lit(k), F.lit(v))])
    said = F.filter(T.tokens(c), lambda t: F.array_contains(_listed(known), t))
    return F.array_distinct(F.transform(said, lambda t: F.coalesce(family[t], t)))


def search_variants(c: Column | str) -> Column:
    """Forms of a name to search by: those of its parts between / and |, brand words, short abbreviations, the whole."""
    whole = T.text_or_empty(c)

    def forms(name: Column) -> Column:
        plain = F.filter(T.tokens(name), lambda t: ~F.array_contains(_listed(W.LEGAL_WORDS), t))
        first, second = F.get(plain, F.lit(0)), F.get(plain, F.lit(1))
        context = F.get(F.filter(F.slice(plain, 2, 1000), lambda t: F.array_contains(_listed(W.CONTEXT_WORDS), t)), F.lit(0))
        return F.array(
            F.array_join(primary_brand(name), " "),
            F.when(F.length(second) == 1, F.concat_ws(" ", first, second)),
            F.when((F.length(first) <= 4) & context.isNotNull(), F.concat_ws(" ", first, context)),
            F.array_join(T.tokens(name), " "),
        )

    parts = F.filter(F.transform(F.split(whole, r"\s*[/|]\s*"), lambda p: F.trim(p)), lambda p: p != "")
    of_parts = F.when(F.size(parts) > 1, F.flatten(F.transform(parts, forms))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.array_compact(F.concat(of_parts, forms(whole)))), lambda v: v != "")


def in_domain(token: Column, compact: Column) -> Column:
    """Whether a domain has the word, or one that translates it; words of up to three letters must be all of it."""
    alias = F.exists(_lookup(W.DOMAIN_EQUIVALENTS, token), lambda e: F.contains(compact, e))
    return F.when(F.length(token) <= 3, compact == token).otherwise(F.contains(compact, token) | alias)


def clean_single_word(words: Column, compact: Column) -> Column:
    """Of two brand words the domain is exactly one."""
    return (F.size(words) == 2) & (F.size(F.filter(words, lambda t: F.contains(compact, t))) == 1) & F.array_contains(words, compact)


def short_prefix(words: Column, compact: Column) -> Column:
    """The domain ends with a word of 5 letters or more after another word of up to three."""
    before = lambda t: F.substring(compact, F.lit(1), F.length(compact) - F.length(t))
    fits = lambda t: (F.length(t) >= 5) & compact.endswith(t) & F.length(before(t)).between(1, 3) & F.array_contains(words, before(t))
    return F.exists(words, fits)


def near_prefix(words: Column, compact: Column, ratio: Column) -> Column:
    """The domain starts nearly as the only word; ratio: of the word with as many letters of the domain."""
    word = F.get(words, F.lit(0))
    start = F.substring(compact, F.lit(1), F.length(word))
    same = F.substring(word, 1, 4) == F.substring(compact, 1, 4)
    return F.coalesce((F.size(words) == 1) & (F.length(word) >= 5) & (F.length(compact) >= F.length(word)) & (word != start) & same & (ratio >= 83), F.lit(False))


def anchored_abbreviation(raw: Column, compact: Column) -> Column:
    """The domain starts with a first word of three or four letters and has another word of the name."""
    first = F.get(raw, F.lit(0))
    other = F.exists(F.slice(raw, 2, 1000), lambda t: (F.length(t) >= 4) & F.contains(compact, t))
    return F.coalesce(F.length(first).between(3, 4) & compact.startswith(first) & other, F.lit(False))


def domain_hits(words: Column, compact: Column) -> Column:
    return F.size(F.filter(words, lambda t: in_domain(t, compact)))


def _parts(c: Column | str, host: Column, **ratios: Column) -> Column:
    """What the rules read of a name and a host, once: brand words, words without legal form, all words, the domain's core, ratios."""
    own = {"words": T.brand_tokens(c), "legal": company_tokens(c), "raw": T.tokens(c), "core": U.core(host), "compact": U.compact_core(host)}
    return F.struct(*[x.alias(k) for k, x in (own | ratios).items()])


def _identity(p: Column) -> Column:
    words, compact = p["words"], p["compact"]
    n, first = F.size(words), F.get(words, F.lit(0))

    def judged(hits: Column) -> Column:
        needed = F.when(n <= 2, n).otherwise(F.greatest(F.lit(1), F.ceil(n * 0.5)))
        rules = (
            (hits >= needed)
            | clean_single_word(words, compact)
            | short_prefix(words, compact)
            | near_prefix(words, compact, p["prefix"])
            | ((F.length(F.array_join(words, "")) >= 5) & (p["whole"] >= 88))
            | T.abbreviation_match(words, compact)
            | T.abbreviation_match(p["legal"], compact)
            | ((n == 1) & (F.length(first) >= 4) & F.contains(compact, first))
            | anchored_abbreviation(p["raw"], compact)
        )
        known = (n > 0) & (compact != "")
        return F.struct((known & F.coalesce(rules, F.lit(False))).alias("ok"), F.when(known, hits).otherwise(0).alias("hits"), n.alias("tokens"))

    return T.let(domain_hits(words, compact), judged)


def domain_identity(c: Column | str, host: Column, prefix_ratio: Column, whole_ratio: Column) -> Column:
    """(ok, hits, tokens): whether a host names the company, by any of eight rules.

    prefix_ratio: as in near_prefix; whole_ratio: of the joined brand words with the domain.
    """
    return T.let(_parts(c, host, prefix=prefix_ratio, whole=whole_ratio), _identity)


def public_brand_domain(c: Column | str, host: Column) -> Column:
    """Whether a domain starts with the brand, of the whole name or of a part that a dash, slash or bar sets off."""
    core = U.compact_core(host)

    def starts(brand: Column, least: Column | int) -> Column:
        after = F.length(core) - F.length(brand)
        return (F.length(brand) >= least) & core.startswith(brand) & ((after == 0) | (after >= 2))

    def fits(name: Column, least: int) -> Column:
        words = primary_brand(name)
        return F.coalesce(starts(F.array_join(words, ""), least) | starts(F.get(words, F.lit(0)), 7), F.lit(False))

    name = T.text_or_empty(c)
    parts = F.filter(F.transform(F.split(name, r"\s+(?:-|/|\|)\s+"), lambda p: F.trim(p)), lambda p: p != "")
    return (core != "") & (fits(name, 7) | ((F.size(parts) > 1) & F.exists(parts, lambda p: fits(p, 5))))


def mirror_subdomain(c: Column | str, host: Column) -> Column:
    """Whether a host is the company's name below a site that mirrors others."""
    joined, out = F.array_join(T.brand_tokens(c), ""), F.lit(False)
    for mirror in W.MIRROR_DOMAINS:
        labels = F.split(F.substring(host, F.lit(1), F.length(host) - len(mirror) - 1), r"\.")
        out = out | (host.endswith("." + mirror) & F.exists(labels, lambda x: F.regexp_replace(x, "[^a-z0-9]", "") == joined))
    return (joined != "") & out


def rare_words(company: Column | str, evidence: Column | str, rare: Column) -> Column:
    """The name's meaningful words of 4 letters or more that are among the rare ones and stand in the evidence, as words or within it."""
    plain = T.normalize(evidence)
    padded, compact = F.concat(F.lit(" "), plain, F.lit(" ")), F.regexp_replace(plain, "[^a-z0-9]", "")
    said = lambda t: F.contains(padded, F.concat(F.lit(" "), t, F.lit(" "))) | F.contains(compact, t)
    return F.array_distinct(F.filter(T.legal_tokens(company), lambda t: (F.length(t) >= 4) & F.array_contains(rare, t) & said(t)))


def ratios_needed(c: Column | str, host: Column) -> dict[str, tuple[Column, Column]]:
    """Pairs of strings whose ratios the rules ask for: prefix and whole (ratio), part (partial ratio)."""
    words, compact = T.brand_tokens(c), U.compact_core(host)
    word = F.coalesce(F.get(words, F.lit(0)), F.lit(""))
    joined = F.array_join(words, "")
    return {"prefix": (word, F.substring(compact, F.lit(1), F.length(word))), "whole": (joined, compact), "part": (joined, compact)}


def domain_score(c: Column | str, host: Column, title: Column | str, snippet: Column | str, prefix_ratio: Column, whole_ratio: Column, part_ratio: Column) -> Column:
    """(score, reason): 0 to 100 for a host as the company's own.

    reason: why the score is 0, or `scored`. Ratios as in ratios_needed.
    """
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    said = F.concat_ws(" ", T.text_or_empty(title), T.text_or_empty(snippet))
    excluded = F.exists(U.suffixes(host), lambda s: F.array_contains(_listed(W.EXCLUDED_DOMAINS), s))

    def scored(p: Column, identity: Column, searchable: Column) -> Column:
        words, legal, compact = p["words"], p["legal"], p["compact"]
        hits, n, first = identity["hits"], identity["tokens"], F.get(words, F.lit(0))
        count = lambda xs: F.size(F.filter(xs, lambda t: F.contains(searchable, t)))
        contexts = F.array_distinct(F.filter(p["raw"], lambda t: F.array_contains(_listed(W.CONTEXT_WORDS), t)))
        context = T.let(F.struct(F.size(contexts).alias("n"), count(contexts).alias("m")), lambda x: F.when(x["n"] == 0, 0).when(x["m"] > 0, F.least(F.lit(8), 4 * x["m"])).otherwise(-30))
        anchored = anchored_abbreviation(p["raw"], compact)
        total = (
            F.floor(hits / F.greatest(n, F.lit(1)) * 32).cast("int") + F.floor(p["part"] * 0.24).cast("int") + F.least(2 * count(legal), F.lit(8)) + U.tld_bonus(host)
            + 14 * flag(in_domain(first, compact)) + context + 24 * flag((hits == 0) & T.abbreviation_match(legal, compact)) + 24 * flag(short_prefix(words, compact))
            + 24 * flag(near_prefix(words, compact, p["prefix"])) + 24 * flag(anchored) - 30 * flag(T.has_any(host, W.GENERIC_KEYWORDS))
        )
        floored = T.let(total, lambda t: F.when(anchored, F.greatest(t, F.lit(72))).otherwise(t))
        cleared = T.let(floored, lambda t: F.when(clean_single_word(words, compact), F.least(F.greatest(t, F.lit(68)), F.lit(84))).otherwise(t))
        short = (n == 1) & (F.length(first) <= 3)
        return T.let(cleared, lambda t: F.when(short, F.least(t, F.lit(79))).otherwise(t))

    def judged(p: Column, identity: Column) -> Column:
        reason = (
            F.when((host == "") | excluded, "excluded_or_empty_domain")
            .when(U.is_foreign(host), "foreign_country_domain")
            .when(T.has_any(host, W.NON_COMPANY_KEYWORDS), "non_company_domain_keyword")
            .when(~identity["ok"], "no_distinctive_domain_match")
            .when(F.size(p["legal"]) == 0, "no_company_tokens")
            .otherwise("scored")
        )
        total = T.let(T.normalize(F.concat_ws(" ", p["core"], said)), lambda searchable: scored(p, identity, searchable))
        bounded = lambda r: F.when(r == "scored", F.greatest(F.lit(0), F.least(F.lit(100), total))).otherwise(0)
        return T.let(reason, lambda r: F.struct(bounded(r).alias("score"), r.alias("reason")))

    return T.let(_parts(c, host, prefix=prefix_ratio, whole=whole_ratio, part=part_ratio), lambda p: T.let(_identity(p), lambda identity: judged(p, identity)))


# Words in capitals before an estate's name, and words of places that are no names.
ESTATE = r"((?:[A-ZÇĞİÖŞÜ][A-ZÇĞİÖŞÜ0-9-]{1,}[ \t]+){1,4}[A-ZÇĞİÖŞÜ][A-ZÇĞİÖŞÜ0-9-]{1,})[ \t]+S[İI]T(?:ES[İI])?\.?"
PLACE_WORDS = ("mahalle", "mahallesi", "cadde", "caddesi", "sokak", "bulvar", "organize", "sanayi", "sitesi", "site")


def related_names(company: Column | str, title: Column | str, snippet: Column | str, limit: int = 2) -> Column:
    """Names of two to four words, some of the company's own and some new, that a result with its legal name gives to an industrial estate."""
    text = F.concat_ws(" ", T.text_or_empty(title), T.text_or_empty(snippet))
    own = T.tokens(company)
    words = lambda raw: F.filter(T.tokens(F.replace(raw, F.lit("-"), F.lit(""))), lambda t: ~F.array_contains(_listed({*W.LEGAL_WORDS, *PLACE_WORDS}), t) & (F.length(t) > 2))
    long = lambda ts, known: F.exists(ts, lambda t: (F.length(t) >= 4) & (F.array_contains(own, t) == known))
    named = F.transform(F.regexp_extract_all(text, F.lit(ESTATE), F.lit(1)), words)
    hints = F.transform(F.filter(named, lambda ts: F.size(ts).between(2, 4) & long(ts, True) & long(ts, False)), lambda ts: F.array_join(ts, " "))
    return F.when(legal_phrase(company, text), F.slice(F.array_distinct(hints), 1, limit)).otherwise(F.array().cast("array<string>"))
