"""Publication policy, status ladder, gates and domain scores: typed columns, reasons rendered at sinks only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orgweave.functions import text as T
from orgweave.functions import url as U
from orgweave.functions import words as W


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), c))


def safety_score(
    support: Column, bundle: Column, strong_bundle: Column, publishable: Column, country: Column, contact: Column, email_verified: Column,
    phone: Column, domain_match: Column, fingerprint: Column, conflicts: Column, email_failed: Column, excluded: Column,
) -> Column:
    flag = lambda c: c.cast("int")
    return clamp(
        25 + 18 * F.least(support, F.lit(3)) + 8 * F.least(bundle, F.lit(4)) + 18 * flag(strong_bundle) + 10 * flag(publishable) + 7 * flag(country)
        + 5 * flag(contact) + 3 * flag(email_verified) + 2 * flag(phone) + 5 * flag(domain_match) + 18 * flag(fingerprint)
        - 35 * F.least(conflicts, F.lit(2)) - 20 * flag(email_failed) - 40 * flag(excluded)
    )


def risk_tier(score: Column, blockers: Column, minimum: int = W.POLICY_MIN_SAFETY) -> Column:
    return F.when(F.size(blockers) > 0, "blocked").when(score >= 90, "low").when(score >= minimum, "controlled").otherwise("elevated")


def policy_action(is_ok: Column, score: Column, blockers: Column, minimum: int = W.POLICY_MIN_SAFETY) -> Column:
    """Never promotes: what is not OK stays so, what is OK may be sent to review."""
    return F.when(~is_ok, "retain_legacy_abstention").when((F.size(blockers) == 0) & (score >= minimum), "allow").otherwise("downgrade_to_review")


def confidence_status(score: Column, has_contact: Column, verified: Column) -> Column:
    return (
        F.when(~verified, "REVIEW")
        .when((score >= W.HIGH_SCORE) & has_contact, "HIGH")
        .when((score >= W.MEDIUM_SCORE) & has_contact, "MEDIUM")
        .otherwise("REVIEW")
    )


def email_blockers(email: Column, first_party: Column, dns: Column, same_domain: Column) -> Column:
    """Why an address may not be published; none if the array is empty. dns: accepted, invalid or unknown."""
    syntax = F.coalesce(email.rlike(r"^[^@\s]+@[^@\s]+\.[a-z]{2,}$"), F.lit(False))
    rules = [
        ("syntax", ~syntax), ("not_first_party", ~first_party), ("dns_invalid", dns == "invalid"),
        ("cross_domain_unverified", ~same_domain & (dns != "accepted")),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
