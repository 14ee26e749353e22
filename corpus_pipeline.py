"""A training corpus from `documents`: five stages, each over all that the one before kept.

Quality rules reject documents; of each group of near-duplicates the document with the
smallest id stays; documents with a benchmark passage go; personal data get pseudonyms;
what is left is packed into sequences. All but the last return the columns of `documents`.

Defined cases: null and empty texts are base failures and go; rows with a null doc_id are judged by
their text and never compared as copies; rows that repeat an id and a text stay once; a null
language is a stratum of its own; further columns, also of names that the operators use, are passed
through; empty tables give empty results. The pieces have the columns of `op9_packing`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.llm import decontaminate, near_dedup, packing, pii, quality_rules
from orgweave.llm.common import materialise, read


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs, read(spark, sf_dir, "labels"))


def keep_first_of_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text; a null text keeps its null or given count."""
    done = pii.pseudonymise(docs, pii.session_key(spark))
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("near_dedup", keep_first_of_duplicates),
    ("decontaminate", keep_uncontaminated),
    ("pii", hide_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. Each stage but the last is written as Parquet in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Three stages (alignment, Feistel networks and the tokenizer) are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
