"""Readers and writers of the record tables: alias headers, projections, JSON lines, replay tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Header aliases of the input columns, in two languages.
ALIASES = {
    "company": ("company", "company name", "firma", "firma adı", "unvan"), "website": ("website", "web", "web sitesi", "url"),
    "source": ("source", "kaynak"), "country": ("country", "ülke"), "listed_phone": ("phone", "telefon", "listed_phone"),
    "listed_email": ("email", "e-mail", "e-posta", "listed_email"), "sector": ("sector", "sektör"), "description": ("description", "açıklama"),
}
SECRET = r"(?i)(^_secret|secret|token|api_?key|password)"


def blank_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(F.trim(c) != "", F.trim(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def company_records(df: DataFrame) -> DataFrame:
    """Known columns by their aliases; a table without any known header is read by position. Rows without company go."""
    by_name = {c.strip().lower(): c for c in df.columns}
    found = {k: [by_name[a] for a in names if a in by_name] for k, names in ALIASES.items()}
    if not any(found.values()):
        found = {"company": df.columns[:1], "website": df.columns[1:2]}
    text = lambda c: F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", F.trim(F.col(f"`{c}`").cast("string")))
    columns = [F.coalesce(*[text(c) for c in found.get(k, [])], F.lit(None).cast("string")).alias(k) for k in ALIASES]
    return df.select(*columns).where("company is not null")


def read_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    return spark.read.csv(path, header=header, multiLine=True, escape='"')


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or JSON lines: the reader's multi-line mode takes both only by the file's first character."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    many = bool(first) and first[0].value.lstrip().startswith("[")
    return spark.read.schema(schema).json(path, multiLine=many)


def project(df: DataFrame, headers: list[str]) -> DataFrame:
    """The headers as text, missing columns and nulls as empty text."""
    return df.select(*[F.coalesce(F.col(h).cast("string"), F.lit("")).alias(h) if h in df.columns else F.lit("").alias(h) for h in headers])


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON text per row, without columns that name secrets."""
    import re

    kept = [c for c in df.columns if not re.search(SECRET, c)]
    return df.select(F.to_json(F.struct(*kept)).alias("value"))


def by_provider(results: DataFrame, query: str, providers: list[str]) -> DataFrame:
    """Recorded results of the first provider in the given order that has any for the query."""
    rank: Column = F.array_position(F.array(*map(F.lit, providers)), F.col("provider"))
    best = results.where(rank > 0).groupBy(query).agg(F.min(rank).alias("__best"))
    return results.join(best, query).where(rank == F.col("__best")).drop("__best")


def artifacts(df: DataFrame, status: str, published: tuple[str, ...]) -> dict[str, DataFrame]:
    """One result table as its published, review and failed parts; each row lies in one part."""
    ok = F.coalesce(F.col(status).isin(*published), F.lit(False))
    review = ~ok & F.coalesce(F.col(status) == "REVIEW", F.lit(False))
    return {"published": df.where(ok), "review": df.where(review), "failed": df.where(~ok & ~review)}
