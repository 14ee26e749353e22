"""Corroboration of candidates by recorded company profiles, with a memory of what was asked.

A company's profile is looked up once, whatever number of its domains are asked for, and the answer for a
company and domain is kept, also where there is none. A batch asks only for what an anti-join
with the memory leaves, and its answers are merged into it.

Defined cases: candidates without a host are not asked for; a null company is the empty name; a profile without
website or name matches nothing; of several profiles of one company the first by website and name counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.functions import names as N
from orgweave.functions import text as T
from orgweave.functions import url as U

MEMORY = "company_key string, domain string, name string, website string, website_match boolean, name_match boolean, verified boolean, batch int"


def asked(candidates: DataFrame) -> DataFrame:
    """company_key, domain and company of the candidates, once each. candidates: company, url."""
    host = U.host("url")
    known = candidates.where(host != "").select(T.normalize("company").alias("company_key"), U.registrable(host).alias("domain"), "company")
    return known.groupBy("company_key", "domain").agg(F.min("company").alias("company"))


def corroborate(candidates: DataFrame, profiles: DataFrame, memory: DataFrame, batch: int) -> tuple[DataFrame, DataFrame]:
    """(answers to what is new, companies whose profile has to be looked up).

    profiles: company, name, website, resolved (where a short link leads; null if it is none). memory: see MEMORY.
    """
    new = asked(candidates).join(memory.select("company_key", "domain"), ["company_key", "domain"], "left_anti")
    looked_up = new.select("company_key").distinct().join(memory.select("company_key").distinct(), "company_key", "left_anti")
    first = profiles.groupBy(T.normalize("company").alias("company_key")).agg(F.min(F.struct("website", "name", "resolved")).alias("p"))
    met = new.join(first, "company_key", "left")
    site = lambda c: F.coalesce((T.text_or_empty(c) != "") & (U.registrable(U.host(c)) == F.col("domain")), F.lit(False))
    website = site(F.col("p.website")) | site(F.col("p.resolved"))
    named = F.coalesce(N.business_name_identity("company", F.col("p.name")), F.lit(False))
    found = met.select("company_key", "domain", F.col("p.name").alias("name"), F.coalesce("p.resolved", "p.website").alias("website"), website.alias("website_match"), named.alias("name_match"))
    return found.withColumn("verified", F.col("website_match") & F.col("name_match")).withColumn("batch", F.lit(batch)), looked_up


def remember(memory: DataFrame, answers: DataFrame) -> DataFrame:
    """The memory with a batch's answers; what is remembered stays."""
    return memory.unionByName(answers.join(memory.select("company_key", "domain"), ["company_key", "domain"], "left_anti"))
