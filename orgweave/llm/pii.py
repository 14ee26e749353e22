"""Format-preserving pseudonyms for personal data (DataFrame functions only).

One pattern finds candidates: e-mail addresses, long hexadecimal secrets, IBANs, dates, US
social security numbers, IPv4 addresses, card numbers and telephone numbers. A candidate that
passes its check (mod 97, calendar, number ranges, Luhn, digit count) is replaced by a keyed
permutation of itself within its format: a Feistel network of ROUNDS rounds whose round
function is HMAC-SHA-256, with the key, of the kind, the round and the other half. The permutation is a bijection
of the valid values of a format, so equal values get equal pseudonyms in all documents, and
different values different ones. Separators stay where they are and do not enter the
permutation, so one number written in two ways stays linked. Cards keep their first digit and
get a new check digit, IBANs keep the country and letters and get new check digits, NANP
numbers keep the country, dates fall in 1800 to 2199, e-mail addresses keep the domain.

A card number or IBAN that fails its check with the groups behind it is tried without its last
one, two or three groups, which then stay as they are.

Defined cases: a null text stays null; texts without candidates and candidates that fail
their check stay as they are; repeated rows get equal results; only IPv4 addresses may
change a text's length; other columns are passed through by `pseudonymise`.

Not recognised: telephone numbers without `+` outside the North American plan, IPv6 addresses,
and secrets that are not hexadecimal.

The key is the session's `spark.orgweave.pii.key`. Where it is unset a random one is drawn and
kept in the session's settings, so pseudonyms are linked within the session and nobody can undo
them; to link several sessions, set the key.
"""

from __future__ import annotations

import hashlib
import hmac
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.llm.common import let, read

ROUNDS = 8
KEY_SETTING = "spark.orgweave.pii.key"
_A, _Z = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
SECRET = _A + r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})" + _Z
IBAN = _A + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _Z
DATE = _A + r"(?:(?:18|19|20|21)[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{2}[-/.][0-9]{2}[-/.](?:18|19|20|21)[0-9]{2})" + _Z
SSN = _A + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _Z
IPV4 = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
CARD = _A + r"[0-9](?:[ -]?[0-9]){12,18}" + _Z
PHONE = r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{1,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,4}" + _Z
PATTERN = "|".join((EMAIL, SECRET, IBAN, DATE, SSN, IPV4, CARD, PHONE))
#: The calendar's 400-year cycle has 189 * 773 days.
_DATE_SIZES = (189, 773)
_FIRST_DAY = "1800-01-01"


def _hmac(key: str, *parts: Column) -> Column:
    """HMAC-SHA-256 of the parts, as hexadecimal digits."""
    block = key.encode()
    if len(block) > 64:
        block = hashlib.sha256(block).digest()
    inner, outer = (bytearray(x ^ y for x in block.ljust(64, b"\0")) for y in (0x36, 0x5C))
    message = F.concat_ws("|", *parts).cast("binary")
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))), 256)


def _hash(key: str, kind: str, turn: Column, x: Column) -> Column:
    """52 keyed pseudo-random bits of x."""
    return F.conv(F.substring(_hmac(key, F.lit(kind), turn.cast("string"), x.cast("string")), 1, 13), 16, 10).cast("long")


def feistel(key: str, kind: str, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """struct(a, b): a keyed permutation of the pairs below (size_a, size_b)."""

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        next_a = F.when(even, F.pmod(s["a"] + F.pmod(_hash(key, kind, i, s["b"]), size_a), size_a)).otherwise(s["a"])
        next_b = F.when(even, s["b"]).otherwise(F.pmod(s["b"] + F.pmod(_hash(key, kind, i, s["a"]), size_b), size_b))
        return F.struct(next_a.alias("a"), next_b.alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permute_digits(key: str, kind: str, digits: Column) -> Column:
    """A permutation of the digit strings of one length (36 at most)."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    size = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    left = F.coalesce(F.nullif(F.substr(digits, F.lit(1), half), F.lit("")), F.lit("0")).cast("long")
    right = F.substr(digits, half + 1).cast("long")
    # the length is part of the key, so that formats do not share one permutation
    out = feistel(key, kind, left, right, size(half), size(n - half))
    return let(out, lambda s: F.concat(F.when(half > 0, F.lpad(s["a"].cast("string"), half, "0")).otherwise(F.lit("")), F.lpad(s["b"].cast("string"), n - half, "0")))


def _one_letter(key: str, kind: str, letters: str) -> str:
    """The letters in the order of their keyed hashes: a permutation of single characters."""
    return "".join(sorted(letters, key=lambda c: hmac.digest(key.encode(), f"{kind}|one|{c}".encode(), "sha256")))


def permute_text(key: str, kind: str, value: Column, alphabets: tuple[str, ...]) -> Column:
    """A permutation of strings that keeps each character's alphabet, and those of no alphabet.

    Every place of a half is moved by digits of its own, from as many hash blocks as the half needs.
    A single character, which has no other half, is permuted within its alphabet.
    """

    def stream(i: Column, x: Column, length: Column) -> Column:
        """Three hexadecimal digits or more for each of `length` characters."""
        blocks = F.sequence(F.lit(0), F.floor(length * 3 / 64).cast("int"))
        return F.array_join(F.transform(blocks, lambda b: _hmac(key, F.lit(kind), i.cast("string"), b.cast("string"), x)), "")

    def shifted(s: Column, digits: Column) -> Column:
        def one(c: Column, k: Column) -> Column:
            by = F.conv(F.substr(digits, k * 3 + 1, F.lit(3)), 16, 10).cast("int")
            out = c
            for letters in alphabets:
                at = F.instr(F.lit(letters), c)
                new = F.substr(F.lit(letters), F.pmod(at - 1 + by, F.lit(len(letters))) + 1, F.lit(1))
                out = F.when((c != "") & (at > 0), new).otherwise(out)
            return out

        return F.array_join(F.transform(F.split(s, ""), one), "")

    half = F.floor(F.length(value) / 2).cast("int")

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        move = lambda x, by: let(stream(i, by, F.length(x)), lambda d: shifted(x, d))
        a = F.when(even, move(s["a"], s["b"])).otherwise(s["a"])
        b = F.when(even, s["b"]).otherwise(move(s["b"], s["a"]))
        return F.struct(a.alias("a"), b.alias("b"))

    start = F.struct(F.substr(value, F.lit(1), half).alias("a"), F.substr(value, half + 1).alias("b"))
    rounds = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["a"], s["b"]))
    letters = "".join(alphabets)
    return F.when(F.length(value) > 1, rounds).otherwise(F.translate(value, letters, "".join(_one_letter(key, kind, x) for x in alphabets)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _fill(value: Column, digits: Column) -> Column:
    """value with its digits replaced in turn, separators kept."""

    def one(c: Column, k: Column) -> Column:
        nth = F.length(_digits(F.substr(value, F.lit(1), k + 1)))
        return F.when(c.rlike("[0-9]"), F.substr(digits, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits, the last one counted once."""

    def weigh(c: Column, k: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when(k % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(c.cast("int"))

    turned = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(F.transform(turned, weigh), F.lit(0), lambda t, x: t + x)


def _mod97(value: Column) -> Column:
    """An IBAN's remainder: the first four characters moved to the end, letters counted from 10."""
    turned = F.concat(F.substr(value, F.lit(5)), F.substr(value, F.lit(1), F.lit(4)))

    def step(r: Column, c: Column) -> Column:
        number = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.when(number >= 10, (r * 100 + number) % 97).otherwise((r * 10 + number) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def _longest_valid(v: Column, group: str, valid) -> Column:
    """v, or what is left of it without its last one to three groups: the longest form that is valid; null if none is."""
    less = lambda x: F.regexp_replace(x, group, "")
    forms = F.aggregate(F.sequence(F.lit(1), F.lit(3)), F.array(v), lambda made, _: F.array_append(made, less(F.element_at(made, -1))))
    return F.get(F.filter(F.array_distinct(forms), valid), F.lit(0))


def _card(key: str, v: Column) -> Column:
    def valid(x: Column) -> Column:
        return let(_digits(x), lambda d: F.length(d).between(13, 19) & (_luhn_sum(d) % 10 == 0) & ~d.rlike("^(.)\\1*$"))

    def new(x: Column) -> Column:
        d = _digits(x)
        n = F.length(d)
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permute_digits(key, "card", F.substr(d, F.lit(2), n - 2)))
        checked = let(body, lambda b: F.concat(b, F.pmod(10 - _luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))
        return F.when(x.isNotNull(), F.concat(_fill(x, checked), F.substr(v, F.length(x) + 1)))

    return let(_longest_valid(v, "[ -][0-9]+$", valid), new)


def _iban(key: str, v: Column) -> Column:
    compact = lambda x: F.replace(x, F.lit(" "), F.lit(""))

    def valid(x: Column) -> Column:
        return let(compact(x), lambda c: F.length(c).between(15, 34) & (_mod97(c) == 1) & F.substr(c, F.lit(5)).rlike("[0-9].*[0-9]"))

    def new(x: Column) -> Column:
        c = compact(x)
        account = F.substr(c, F.lit(5))
        moved = F.concat(F.substr(c, F.lit(1), F.lit(2)), F.lit("00"), _fill(account, permute_digits(key, "iban", _digits(account))))
        made = let(moved, lambda m: F.concat(F.substr(m, F.lit(1), F.lit(2)), F.lpad((98 - _mod97(m)).cast("string"), 2, "0"), F.substr(m, F.lit(5))))
        return F.when(x.isNotNull(), F.concat(let(made, lambda y: _spread(x, y)), F.substr(v, F.length(x) + 1)))

    def _spread(old: Column, new_value: Column) -> Column:
        one = lambda c, k: F.when(c == " ", c).otherwise(F.substr(new_value, F.length(compact(F.substr(old, F.lit(1), k + 1))), F.lit(1)))
        return F.array_join(F.transform(F.split(old, ""), one), "")

    return let(_longest_valid(v, " [A-Z0-9]+$", valid), new)


def _date(key: str, v: Column) -> Column:
    """ISO order, else day first, else month first."""
    digits = _digits(v)
    year_first = v.rlike("^[0-9]{4}")
    forms = [(year_first, "yyyyMMdd"), (~year_first, "ddMMyyyy"), (~year_first, "MMddyyyy")]
    out = F.lit(None).cast("string")
    for condition, form in reversed(forms):
        day = F.try_to_timestamp(F.lpad(digits, 8, "0"), F.lit(form)).cast("date")
        number = F.datediff(day, F.lit(_FIRST_DAY).cast("date")).cast("long")
        moved = feistel(key, "date", F.floor(number / _DATE_SIZES[1]), number % _DATE_SIZES[1], F.lit(_DATE_SIZES[0]).cast("long"), F.lit(_DATE_SIZES[1]).cast("long"))
        as_day = let(moved, lambda s: F.date_add(F.lit(_FIRST_DAY).cast("date"), (s["a"] * _DATE_SIZES[1] + s["b"]).cast("int")))
        text = let(as_day, _formatter(form))
        out = F.when(condition & day.isNotNull(), _fill(v, text)).otherwise(out)
    return out


def _formatter(form: str):
    return lambda d: F.date_format(d, form)


def _ssn(key: str, v: Column) -> Column:
    area, group, serial = (F.split(v, "-")[i].cast("long") for i in range(3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    moved = feistel(key, "ssn", index, (group - 1) * 9999 + serial - 1, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"))
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    text = let(
        moved,
        lambda s: F.concat_ws(
            "-", pad(F.when(s["a"] >= 665, s["a"] + 2).otherwise(s["a"] + 1), 3), pad(F.floor(s["b"] / 9999) + 1, 2), pad(s["b"] % 9999 + 1, 4)
        ),
    )
    return F.when(valid, text)


def _ipv4(key: str, v: Column) -> Column:
    """Addresses of one length may get another; the dots stay."""
    o = [F.split(v, r"\.")[i].cast("long") for i in range(4)]
    valid = (o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256)
    side = F.lit(65536).cast("long")
    moved = feistel(key, "ipv4", o[0] * 256 + o[1], o[2] * 256 + o[3], side, side)
    return F.when(valid, let(moved, lambda s: F.concat_ws(".", *[x.cast("string") for x in (F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)])))


def _phone(key: str, v: Column) -> Column:
    def new(d: Column) -> Column:
        n = F.length(d)
        local = F.when((n == 11) & d.startswith("1"), F.substr(d, F.lit(2))).when((n == 10) & ~v.startswith("+"), d)
        area, rest = F.substr(local, F.lit(1), F.lit(3)).cast("long"), F.substr(local, F.lit(4)).cast("long")
        nanp = local.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")
        moved = feistel(key, "nanp", area - 200, rest - 2_000_000, F.lit(800).cast("long"), F.lit(8_000_000).cast("long"))
        text = let(moved, lambda s: F.concat((s["a"] + 200).cast("string"), (s["b"] + 2_000_000).cast("string")))
        own = F.concat(F.when(n == 11, F.lit("1")).otherwise(F.lit("")), text)
        other = F.concat(F.substr(d, F.lit(1), F.lit(2)), permute_digits(key, "phone", F.substr(d, F.lit(3))))
        international = v.startswith("+") & (n >= 8) & (n <= 15)
        return F.when(F.coalesce(nanp, F.lit(False)) & v.rlike("[+ ().-]"), _fill(v, own)).when(international, _fill(v, other))

    return let(_digits(v), new)


def _email(key: str, v: Column) -> Column:
    at = F.instr(v, "@")
    alphabets = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
    return F.concat(permute_text(key, "email", F.substr(v, F.lit(1), at - 1), alphabets), F.substr(v, at))


def pseudonym(key: str, value: Column) -> Column:
    """struct(kind, value): the kind is null and the value unchanged where the check fails."""
    whole = lambda p: value.rlike(f"^(?:{p})$")
    hexes = ("0123456789abcdef",)
    secret = F.when(value.rlike("[A-F]"), F.upper(permute_text(key, "secret", F.lower(value), hexes))).otherwise(permute_text(key, "secret", value, hexes))
    kinds = (
        ("email", value.contains("@"), _email(key, value)),
        ("secret", whole(SECRET), secret),
        ("iban", value.rlike("^[A-Z]{2}[0-9]{2}"), _iban(key, value)),
        ("date", whole(DATE), _date(key, value)),
        ("ssn", whole(SSN), _ssn(key, value)),
        ("ipv4", whole(IPV4), _ipv4(key, value)),
        ("card", whole(CARD), _card(key, value)),
        ("phone", whole(PHONE), _phone(key, value)),
    )
    tried = F.lit(None).cast("struct<kind:string,value:string>")
    for kind, condition, new in reversed(kinds):
        made = let(new, _tagged(kind))
        # what is a card by its form and fails its check may still be a telephone number
        tried = F.when(condition, F.coalesce(made, tried) if kind == "card" else made).otherwise(tried)
    return F.coalesce(tried, F.struct(F.lit(None).cast("string").alias("kind"), value.alias("value")))


def _tagged(kind: str):
    return lambda x: F.when(x.isNotNull(), F.struct(F.lit(kind).alias("kind"), x.alias("value")))


def _rewritten(key: str, text: Column) -> Column:
    """struct(text, kinds): the text with pseudonyms, and the kind of each one in text order."""

    def joined(new: Column) -> Column:
        pieces = F.split(text, PATTERN, -1)
        rest = F.transform(new, lambda x: x["value"])
        whole = F.zip_with(pieces, rest, lambda p, x: F.concat(p, F.coalesce(x, F.lit(""))))
        return F.struct(F.array_join(whole, "").alias("text"), F.array_compact(F.transform(new, lambda x: x["kind"])).alias("kinds"))

    found = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda v: pseudonym(key, v))
    untouched = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    return F.when(text.rlike("[0-9@]|[a-fA-F]{32}"), let(found, joined)).otherwise(untouched)


def session_key(spark: SparkSession) -> str:
    """The session's key, drawn at random where none is set."""
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", kinds_col: str | None = None) -> DataFrame:
    """docs with pseudonyms in its text column; kinds_col, if given, gets the kinds of the values replaced."""
    done = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _rewritten(key, docs[text_col]).alias("pii"))
    columns = [(F.col("pii")["text"] if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns]
    if kinds_col:
        columns.append(F.col("pii")["kinds"].alias(kinds_col))
    return done.select(*columns)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = pseudonymise(docs, session_key(spark), kinds_col="kinds")
    return done.select(
        "doc_id",
        F.coalesce(F.size("kinds"), F.lit(0)).cast("long").alias("n_private"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct("kinds")), ","), F.lit("")).alias("kinds"),
        "text",
    )
