"""E-mail and telephone functions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orgweave.functions import words as W
from orgweave.functions.text import text_or_empty

EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"\+?\(?[0-9][0-9 ().-]{7,}[0-9]"


def clear_text(c: Column | str) -> Column:
    """Text whose hidden e-mail signs are written out."""
    out = F.regexp_replace(text_or_empty(c), r"\\u0040", "@")
    out = F.regexp_replace(out, r"(?i)\s*[\[(]\s*at\s*[\])]\s*", "@")
    return F.regexp_replace(out, r"(?i)\s*[\[(]\s*(dot|nokta)\s*[\])]\s*", ".")


def email_domain(e: Column) -> Column:
    return F.lower(F.substring_index(e, "@", -1))


def is_placeholder(e: Column) -> Column:
    domain = email_domain(e)
    out = domain.isin(*W.BAD_EMAIL_DOMAINS)
    for bad in W.BAD_EMAIL_DOMAINS:
        out = out | domain.endswith("." + bad)
    return out


def prefix_rank(e: Column) -> Column:
    """Place of the address's first part, up to a dot or dash, in the order of preferred ones; after all for others."""
    first, out = F.regexp_extract(F.substring_index(F.lower(e), "@", 1), "^([^.-]*)", 1), F.lit(len(W.EMAIL_PREFIXES))
    for i, prefix in reversed(list(enumerate(W.EMAIL_PREFIXES))):
        out = F.when(first == prefix, F.lit(i)).otherwise(out)
    return out


def is_blocked(e: Column) -> Column:
    return F.substring_index(F.lower(e), "@", 1).isin(*W.BLOCKED_EMAIL_PREFIXES)


def emails(c: Column | str) -> Column:
    """Distinct addresses in lower case, in order of appearance."""
    found = F.regexp_extract_all(clear_text(c), F.lit(EMAIL), F.lit(0))
    return F.array_distinct(F.transform(found, lambda e: F.lower(e)))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def phones(c: Column | str) -> Column:
    """Distinct digit strings of 10 to 15 digits, in order of appearance."""
    found = F.regexp_extract_all(text_or_empty(c), F.lit(PHONE), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, digits), lambda d: F.length(d).between(10, 15)))


# Numbers with a country or trunk prefix, however they are separated, and service numbers.
PREFIXED_PHONE = r"(?<!\d)(?:\+?90|0)(?:[\s().-]*\d){10}(?!\d)"
SERVICE_PHONE = r"(?<!\d)(?:0[\s().-]*)?444(?:[\s().-]*\d){4}(?!\d)"


def national_phones(c: Column | str) -> Column:
    """Distinct national numbers by all three patterns: general ones, prefixed ones, service numbers, each in order of appearance."""
    text = text_or_empty(c)
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (PHONE, PREFIXED_PHONE, SERVICE_PHONE)])
    return F.array_distinct(F.array_compact(F.transform(found, normalize_phone)))


def normalize_phone(c: Column) -> Column:
    """National form of a Turkish number (0 and ten digits, or a 444 number), else null."""
    d = F.regexp_replace(digits(c), "^(00)?90(?=[2-58][0-9]{9}$)", "")
    national = F.regexp_replace(d, "^0", "")
    return F.when(national.rlike("^444[0-9]{4}$"), national).when(national.rlike("^[2-58][0-9]{9}$"), F.concat(F.lit("0"), national))


def phone_type_rank(national: Column) -> Column:
    return F.when(national.rlike("^(444|0850)"), 3).when(national.rlike("^0[234]"), 2).when(national.startswith("05"), 1).otherwise(0)
