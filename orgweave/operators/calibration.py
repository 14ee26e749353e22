"""Risk and coverage: curve, Wilson bound, threshold recommendation, leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from orgweave.functions.words import WILSON_Z

FIT_ROLES = ("calibration", "validation")


def parse_label(c: Column) -> Column:
    """true/yes/correct/1 and false/no/incorrect/0 as booleans; null stays null, anything else raises."""
    text = F.lower(F.trim(c.cast("string")))
    known = F.when(text.isin("true", "yes", "correct", "1"), True).when(text.isin("false", "no", "incorrect", "0"), False)
    return F.when(text.isNull() | (text == ""), F.lit(None).cast("boolean")).otherwise(
        F.coalesce(known, F.raise_error(F.concat(F.lit("unknown label: "), text)).cast("boolean"))
    )


def wilson_lower(correct: Column, total: Column, z: float = WILSON_Z) -> Column:
    p = F.try_divide(correct.cast("double"), total)
    middle = p + z * z / (2 * total)
    spread = z * F.sqrt((p * (1 - p) + z * z / (4 * total)) / total)
    return F.when(total <= 0, F.lit(0.0)).otherwise((middle - spread) / (1 + z * z / total))


def curve(records: DataFrame, score: str = "score", correct: str = "correct") -> DataFrame:
    """One row for each distinct score, highest first: what is accepted from there on, and how well.

    Scores are cut to whole numbers from 0 to 100, so the ordered window sees 101 rows at most.
    """
    points = (
        records.where(F.col(correct).isNotNull() & F.col(score).isNotNull())
        .groupBy(F.greatest(F.lit(0), F.least(F.lit(100), F.col(score).cast("int"))).alias("threshold"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(correct).alias("c"))
    )
    so_far = Win.orderBy(F.desc("threshold")).rowsBetween(Win.unboundedPreceding, 0)
    summed = points.select(
        "threshold", F.sum("n").over(so_far).alias("accepted"), F.sum("c").over(so_far).alias("correct"),
        F.sum("n").over(Win.orderBy(F.desc("threshold")).rowsBetween(Win.unboundedPreceding, Win.unboundedFollowing)).alias("total"),
    )
    precision = F.col("correct") / F.col("accepted")
    return summed.select(
        "threshold", "accepted", "correct", (F.col("accepted") / F.col("total")).alias("coverage"), precision.alias("precision"),
        (1 - precision).alias("risk"), wilson_lower(F.col("correct"), F.col("accepted")).alias("wilson_lower"),
    )


def leakage(records: DataFrame, role: str = "role", correct: str = "correct") -> DataFrame:
    """Labelled rows of roles that may not be fitted on, by role."""
    return records.where(F.col(correct).isNotNull() & ~F.coalesce(F.col(role), F.lit("")).isin(*FIT_ROLES)).groupBy(role).agg(F.count(F.lit(1)).alias("n"))


def recommend(points: DataFrame, target: float = 0.99, minimum: int = 20) -> DataFrame:
    """The threshold with the greatest coverage among those precise enough; deployable if its Wilson bound is too."""
    good = points.where((F.col("accepted") >= minimum) & (F.col("precision") >= target))
    best = good.agg(F.max_by(F.struct(*points.columns), F.struct("coverage", -F.col("threshold"))).alias("b"))
    return best.select(
        F.col("b.threshold").alias("threshold"), F.col("b.accepted").alias("accepted"), F.col("b.coverage").alias("coverage"),
        F.coalesce(F.col("b.wilson_lower") >= target, F.lit(False)).alias("deployable"),
    )
