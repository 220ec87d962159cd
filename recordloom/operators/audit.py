"""Integrity audit: each check gives findings (severity, check, subject), which join into one report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text as tx

STALE_SECONDS = 1800


def finding(df: DataFrame, severity: str, check: str, subject: Column) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), subject.cast("string").alias("subject"))


def notes_against_registry(registry: DataFrame, notes: DataFrame, what: str) -> DataFrame:
    """Registered paths without a note, and notes that no row registers (both have ``note_path``)."""
    lost = registry.join(notes.select("note_path"), "note_path", "left_anti")
    orphan = notes.join(registry.select("note_path"), "note_path", "left_anti")
    return finding(lost, "CRITICAL", f"{what} note missing", F.col("note_path")).unionByName(finding(orphan, "WARNING", f"{what} note orphaned", F.col("note_path")))


def missing_fields(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field for each field that is null or empty."""
    empty = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", F.lit(f)) for f in fields]))
    return rows.select(key, F.explode(empty).alias("field"))


def dead_links(notes: DataFrame) -> DataFrame:
    """note_path, target of links whose target is no note."""
    links = notes.select("note_path", F.explode(F.array_distinct(tx.wiki_links("body"))).alias("target"))
    return links.join(notes.select(F.col("note_path").alias("target")), "target", "left_anti")


def is_stale(now: str) -> Column:
    """Whether a lock (started_at) is half an hour old or more, or has no readable start."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp("started_at", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))
    return F.coalesce(age >= STALE_SECONDS, F.lit(True))


def stale_locks(locks: DataFrame, now: str) -> DataFrame:
    return locks.where(is_stale(now))


def unlock(locks: DataFrame, now: str, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """The locks that stay and those that go: stale ones, or all where it is forced."""
    gone = F.lit(True) if force else is_stale(now)
    return locks.where(~gone), locks.where(gone)


def orphan_temps(files: DataFrame, prefix: str = "wdg_") -> DataFrame:
    """Temporary files (path) that a broken run left."""
    return files.where(F.startswith(F.element_at(F.split("path", "/"), -1), F.lit(prefix)))


def ingest_state(queue: DataFrame, locks: DataFrame, now: str) -> DataFrame:
    """locked, n_entries: whether a lock that is not stale is held, and what waits. Without entries there is no state."""
    locked = not locks.where(~is_stale(now)).isEmpty()
    return queue.agg(F.lit(locked).alias("locked"), F.count("*").alias("n_entries")).where("n_entries > 0")


def missing_permissions(wanted: DataFrame, given: DataFrame) -> DataFrame:
    """Permissions that are wanted and not given."""
    return wanted.select("permission").distinct().join(given.select("permission"), "permission", "left_anti")


def doctor(spark, modules: tuple[str, ...] = ("pyspark", "pyarrow", "pandas", "numpy", "ahocorasick"), tools: tuple[str, ...] = ("java",)) -> DataFrame:
    """what, name, present: what this installation needs and whether it is there (on the driver)."""
    import importlib.util
    import shutil

    rows = [("module", m, importlib.util.find_spec(m) is not None) for m in modules] + [("tool", t, shutil.which(t) is not None) for t in tools]
    return spark.createDataFrame(rows, "what string, name string, present boolean")


def manifest_drift(registry: DataFrame, manifest: DataFrame) -> DataFrame:
    """id, drift: missing, orphan, name, type, aliases. Both sides have id, name, type, aliases."""
    m = manifest.select(F.col("id").alias("mid"), F.col("name").alias("mname"), F.col("type").alias("mtype"), F.col("aliases").alias("maliases"))
    both = registry.join(m, F.col("id") == F.col("mid"), "full_outer")
    set_of = lambda c: F.sort_array(F.coalesce(c, F.array().cast("array<string>")))
    kinds = F.array_compact(
        F.when(F.col("mid").isNull(), F.array(F.lit("missing"))).when(F.col("id").isNull(), F.array(F.lit("orphan"))).otherwise(
            F.array(F.when(~F.col("name").eqNullSafe(F.col("mname")), F.lit("name")), F.when(~F.col("type").eqNullSafe(F.col("mtype")), F.lit("type")), F.when(set_of(F.col("aliases")) != set_of(F.col("maliases")), F.lit("aliases")))
        )
    )
    return both.select(F.coalesce("id", "mid").alias("id"), F.explode(kinds).alias("drift"))


def count_mismatch(counts: DataFrame, documents: DataFrame, entities: DataFrame) -> DataFrame:
    """what, stated, actual where the stated counts (document_count, entity_count; one row) are not the tables' own."""
    stated = counts.select(F.explode(F.array(F.struct(F.lit("documents").alias("what"), F.col("document_count").cast("long").alias("stated")), F.struct(F.lit("entities").alias("what"), F.col("entity_count").cast("long").alias("stated")))).alias("s")).select("s.*")
    actual = documents.agg(F.count("*").alias("actual")).select(F.lit("documents").alias("what"), "actual").unionByName(entities.agg(F.count("*").alias("actual")).select(F.lit("entities").alias("what"), "actual"))
    return stated.join(actual, "what").where("stated <> actual")


def report(findings: list[DataFrame]) -> DataFrame:
    """severity, check, n of all findings."""
    return reduce(DataFrame.unionByName, findings).groupBy("severity", "check").agg(F.count("*").alias("n"))
