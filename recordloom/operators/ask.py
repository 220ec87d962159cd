"""Questions over the graph: look-ups by name or alias, roles, what several share, spans of time, plain search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text as tx


def lookup(entities: DataFrame, wanted: str, aliases: DataFrame | None = None) -> DataFrame:
    """Entities whose normalised name or alias is the wanted one's."""
    norm = tx.normalized_name(F.lit(wanted))
    hit = entities.where(tx.normalized_name("name") == norm).select("id")
    if aliases is not None:
        hit = hit.unionByName(aliases.where(tx.normalized_name("alias") == norm).select("id"))
    return entities.join(hit.distinct(), "id", "left_semi")


def roles_of(roles: DataFrame, entity_id: str, relationship: str | None = None) -> DataFrame:
    """Roles from or to an entity, of one relationship (without case) or of any."""
    mine = roles.where((F.col("src_id") == entity_id) | (F.col("target_id") == entity_id))
    return mine if relationship is None else mine.where(F.lower("relationship") == relationship.lower())


def sharing(roles: DataFrame, target_id: str, relationship: str | None = None) -> DataFrame:
    """src_id of all that refer to a target."""
    hit = roles.where(F.col("target_id") == target_id)
    return (hit if relationship is None else hit.where(F.lower("relationship") == relationship.lower())).select("src_id").distinct()


def grep(documents: DataFrame, term: str, key: str = "doc_id", text: str = "text", around: int = 40) -> DataFrame:
    """key, place, context of documents that hold a term, without case: the first place and the characters around it."""
    at = F.instr(F.lower(F.col(text)), term.lower())
    return documents.where(at > 0).select(key, at.alias("place"), F.substring(F.col(text), F.greatest(at - around, F.lit(1)), F.lit(2 * around + len(term))).alias("context"))


def register(spark, **tables: DataFrame) -> None:
    """Makes tables visible to ``spark.sql``."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
