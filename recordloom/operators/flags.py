"""Red flags of record types as predicates over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio_above(part: Column, whole: Column, limit: float) -> Column:
    """False where the whole is missing or 0."""
    return F.coalesce(F.when(whole != 0, part / whole > limit), F.lit(False))


def ratio_below(part: Column, whole: Column, limit: float) -> Column:
    return F.coalesce(F.when(whole != 0, part / whole < limit), F.lit(False))


def just_below(value: Column, threshold: float, share: float = 0.05) -> Column:
    """Under a threshold by at most a share of it."""
    return F.coalesce((value < threshold) & (value >= threshold * (1 - share)), F.lit(False))


def nominal(value: Column, limit: float = 10.0) -> Column:
    return F.coalesce((value > 0) & (value <= limit), F.lit(False))


def short_tenure(start: Column, end: Column, months: int = 12) -> Column:
    return F.coalesce(end < F.add_months(start, months), F.lit(False))


def cumulative_small(changes: DataFrame, key: str, amount: str, base: str, each: float = 0.1, together: float = 0.5) -> DataFrame:
    """key, n, total of contracts whose changes are each small against the base and together are not."""
    small = changes.where(F.col(amount) <= each * F.col(base))
    return small.groupBy(key).agg(F.count("*").alias("n"), F.sum(amount).alias("total"), F.max(base).alias("_base")).where(F.col("total") > together * F.col("_base")).drop("_base")


def same_address(people: DataFrame, companies: DataFrame, roles: DataFrame) -> DataFrame:
    """src_id, target_id of roles whose two ends have the same address (id, address), normalised alike."""
    end = lambda df, c: df.select(F.col("id").alias(c), F.lower(F.trim("address")).alias(f"{c}_at"))
    both = roles.join(end(people, "src_id"), "src_id").join(end(companies, "target_id"), "target_id")
    return both.where("src_id_at = target_id_at AND src_id_at <> ''").select("src_id", "target_id")
