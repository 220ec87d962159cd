"""Ranks within few, large groups, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread_rank(df: DataFrame, keys: list[str], leading: Column, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with the rank (from 1) of each row within its keys by (leading, order). ``leading`` is the front part of the
    order, such as a date or a prefix: rows are ranked within one of its values, and the counts of the values before are
    added. The counts are one row for each key and value."""
    marked = df.withColumn("_lead", leading)
    counts = marked.groupBy(*keys, "_lead").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_lead").alias("_l"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    on = F.col("_lead").eqNullSafe(F.col("_l"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    ranked = marked.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_lead").orderBy(*order)))
    return ranked.join(offsets, on).withColumn(name, F.col("_place") + F.col("_offset")).drop("_lead", "_l", "_offset", "_place", *[f"_k{i}" for i in range(len(keys))])
