"""States of files, queue, projects and sessions, and the reports on them."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import text as tx
from recordloom.operators.ranking import spread_rank


def chew_state(documents: DataFrame, text: str = "text", error: str | None = None) -> DataFrame:
    """The documents with state (FAILED, SKIPPED, OK), char_count and garbled."""
    blank = tx.stripped(text) == ""
    count = F.when(blank, F.lit(0)).otherwise(F.length(F.coalesce(F.col(text), F.lit("")))).cast("long")
    state = F.when(F.lit(False) if error is None else F.coalesce(F.col(error), F.lit("")) != "", F.lit("FAILED")).when(blank, F.lit("SKIPPED")).otherwise(F.lit("OK"))
    return documents.withColumns({"state": state, "char_count": count, "garbled": tx.is_garbled(text)})


def upper_median(column: str) -> Column:
    """The middle value, the upper one of two; what is held is a count for each distinct value."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)")


def workers(cores: int, median_pages: int | None) -> tuple[int, int]:
    """(files at once, chunks at once) for a median number of pages."""
    if median_pages is None or median_pages <= 10:
        a, b = cores // 2, cores // 5
    elif median_pages <= 50:
        a, b = cores // 3, cores // 3
    else:
        a, b = cores // 5, cores // 2
    return max(2, a), max(2, b)


def queue_view(queue: DataFrame) -> DataFrame:
    """sha256, filename, document_type, page_count (0 counts as unknown, then the pages count), est_tokens."""
    pages = F.coalesce(F.nullif("page_count", F.lit(0)), F.size("pages"))
    tokens = F.aggregate("pages", F.lit(0).cast("long"), lambda s, p: s + F.floor(F.length(F.coalesce(p["markdown"], F.lit(""))) / 4).cast("long"))
    return queue.select("sha256", "filename", "document_type", pages.alias("page_count"), tokens.alias("est_tokens"))


def batches(queue: DataFrame, size: int = 5) -> DataFrame:
    """document_type, sha256, batch, place: one list, by type (unknown last) and sha256, cut into batches of ``size``."""
    lead = F.struct(F.col("document_type").isNull().alias("none"), F.col("document_type").alias("type"), F.substring("sha256", 1, 3).alias("front"))
    numbered = spread_rank(queue, [], lead, ["sha256"], "n")
    return numbered.select("document_type", "sha256", F.floor((F.col("n") - 1) / size).cast("long").alias("batch"), ((F.col("n") - 1) % size).cast("long").alias("place"))


def by_pages(queue: DataFrame) -> DataFrame:
    """The queue with place: the shortest first, equals by sha256."""
    return spread_rank(queue, [], F.coalesce("page_count", F.lit(0)), ["sha256"], "place")


def recent(rows: DataFrame, date: str, key: str, n: int = 10) -> DataFrame:
    """The n rows with the last dates, equals by key; a top-k report."""
    return rows.orderBy(F.desc_nulls_last(date), key).limit(n)


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """sha256, pages, failed_chunks, ocr_used, error from (sha256, start, pages, ocr_used, error): pages are moved by their
    chunk's start and ordered; chunks that failed are listed; a document all of whose chunks failed is an error."""
    bad = F.col("error").isNotNull()
    pages = F.flatten(F.transform(F.sort_array(F.collect_list(F.when(~bad, F.struct("start", F.transform("pages", lambda p: F.struct((p["page"] + F.col("start")).alias("page"), p["markdown"])).alias("pages"))))), lambda c: c["pages"]))
    failed = F.transform(F.sort_array(F.collect_list(F.when(bad, F.struct("start", "error")))), lambda c: F.concat(c["start"].cast("string"), F.lit(": "), c["error"]))
    out = chunks.groupBy("sha256").agg(pages.alias("pages"), failed.alias("failed_chunks"), F.bool_or(F.coalesce("ocr_used", F.lit(False))).alias("ocr_used"), F.count("*").alias("n"))
    return out.select("sha256", "pages", "failed_chunks", "ocr_used", F.when(F.size("failed_chunks") == F.col("n"), F.lit("all chunks failed")).alias("error"))


def chunk_plan(total: Column, size: int = 40) -> Column:
    """Array of (start, stop) of the chunks of a document's pages."""
    made = F.transform(F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0)), F.lit(size)), lambda s: F.struct(s.alias("start"), F.least(s + size, total).alias("stop")))
    return F.when(total > 0, made).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))


def breakdown(rows: DataFrame, column: str) -> DataFrame:
    """column, n, place: counts, greatest first."""
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), column)))


def summary(rows: DataFrame) -> DataFrame:
    """ok, skipped, failed of a batch with states."""
    n = lambda s: F.count_if(F.col("state") == s)
    return rows.agg(n("OK").alias("ok"), n("SKIPPED").alias("skipped"), n("FAILED").alias("failed"))


def tail(log: DataFrame, n: int, order: str) -> DataFrame:
    return log.orderBy(F.desc(order)).limit(n)


def session_cost(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """agent, tokens and cost from usage (agent, model, kind, tokens) and rates (model, kind, usd a million tokens)."""
    priced = usage.groupBy("agent", "model", "kind").agg(F.sum("tokens").alias("tokens")).join(rates, ["model", "kind"], "left")
    return priced.groupBy("agent").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.coalesce("usd", F.lit(0.0)) / 1e6).alias("cost"))


def find_project(projects: DataFrame, wanted: str) -> DataFrame:
    """slug, outcome: the exact slug, else the only one that begins so; ``ambiguous`` or ``not found`` without one."""
    hit = projects.where(F.startswith("slug", F.lit(wanted))).agg(F.max(F.when(F.col("slug") == wanted, F.col("slug"))).alias("exact"), F.min("slug").alias("slug"), F.count("*").alias("n"))
    one = F.coalesce("exact", F.when(F.col("n") == 1, F.col("slug")))
    return hit.select(one.alias("slug"), F.when(one.isNotNull(), F.lit("found")).when(F.col("n") > 1, F.lit("ambiguous")).otherwise(F.lit("not found")).alias("outcome"))


def upsert_project(projects: DataFrame, change: DataFrame) -> DataFrame:
    """Projects with the rows of ``change`` (same columns) in the place of those with their slug."""
    return projects.join(change.select("slug"), "slug", "left_anti").unionByName(change)


def rename_project(projects: DataFrame, old: str, new: str, locked: DataFrame) -> DataFrame:
    """The projects with another slug for one of them, unless it is locked (slug in ``locked``) or the new one is taken."""
    barred = locked.where(F.col("slug") == old).limit(1).count() or projects.where(F.col("slug") == new).limit(1).count()
    if barred:
        raise ValueError(f"{old} is locked or {new} is taken")
    return projects.withColumn("slug", F.when(F.col("slug") == old, F.lit(new)).otherwise(F.col("slug")))


def delete_project(projects: DataFrame, slug: str, locked: DataFrame) -> DataFrame:
    if locked.where(F.col("slug") == slug).limit(1).count():
        raise ValueError(f"{slug} is locked")
    return projects.where(F.col("slug") != slug)


def archive(projects: DataFrame, slug: str, archived: bool = True) -> DataFrame:
    return projects.withColumn("archived", F.when(F.col("slug") == slug, F.lit(archived)).otherwise(F.coalesce("archived", F.lit(False))))


def project_list(projects: DataFrame, documents: DataFrame, entities: DataFrame, with_archived: bool = False) -> DataFrame:
    """slug, n_documents, n_entities, by name."""
    n = lambda df, c: df.groupBy("slug").agg(F.count("*").alias(c))
    kept = projects if with_archived else projects.where(~F.coalesce("archived", F.lit(False)))
    full = kept.join(n(documents, "n_documents"), "slug", "left").join(n(entities, "n_entities"), "slug", "left")
    return full.select("slug", "name", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("n_entities", F.lit(0)).alias("n_entities"))


def abort(queue: DataFrame, staged: DataFrame, sha256: str) -> tuple[DataFrame, DataFrame]:
    """The queue with the document failed, and the staged events without it."""
    return queue.withColumn("state", F.when(F.col("sha256") == sha256, F.lit("failed")).otherwise(F.col("state"))), staged.where(F.col("sha256") != sha256)


@dataclass(frozen=True)
class Config:
    """Settings with their bounds; ``set`` checks a value given as text."""

    chunk_size: int = 40
    chunk_timeout: int = 300
    preprocess_timeout: int = 120
    garbled_threshold: float = 0.75
    dup_threshold: float = 0.85
    shingle_size: int = 3
    classify_pages: int = 10
    section_threshold: int = 120_000
    section_budget: int = 60_000
    section_overlap: int = 4_000

    def set(self, key: str, value: str) -> Config:
        known = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        if key not in known:
            raise KeyError(key)
        made = known[key](value)
        low, high = (0.0, 1.0) if known[key] is float else (0 if key == "section_overlap" else 1, 10_000_000)
        if not low <= made <= high:
            raise ValueError(f"{key}: {value} lies outside {low} to {high}")
        return replace(self, **{key: made})


def pending(files: DataFrame) -> DataFrame:
    """n, bytes of incoming files (path, length): no dot files, descriptions or files set aside."""
    name = F.element_at(F.split("path", "/"), -1)
    aside = F.exists(F.split(F.lower("path"), "/"), lambda p: p.isin("_failed", "_skipped"))
    kept = files.where(~F.startswith(name, F.lit(".")) & ~F.endswith(F.lower(name), F.lit(".yml")) & ~aside)
    return kept.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def morgue_path(entity_id: Column, document_type: Column, filename: Column) -> Column:
    """Where a document's file belongs once it is ingested."""
    return F.concat_ws("/", F.lit("morgue"), tx.slug(entity_id), tx.slug(document_type), filename)


def refresh_entity(entities: DataFrame, events: DataFrame, entity_id: str, summary: str | None, new_events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entity with another summary (kept where none is given), its events replaced and not merged."""
    mine = F.col("id") == entity_id
    out = entities.withColumn("summary", F.when(mine & F.lit(summary is not None), F.lit(summary)).otherwise(F.col("summary")))
    return out, events.where(F.col("entity_id") != entity_id).unionByName(new_events)


def add_analysis(analysis: DataFrame, found: DataFrame, today: str) -> DataFrame:
    """analysis (entity_id, date, line) with a dated, linked line for each finding (entity_id, note_path, title, text)."""
    line = F.concat(F.lit(f"*{today}, via "), tx.wiki_link(F.col("note_path"), F.col("title")), F.lit(":* "), F.col("text"))
    return analysis.unionByName(found.where(F.coalesce("text", F.lit("")) != "").select("entity_id", F.lit(today).alias("date"), line.alias("line")))


def briefing(**parts: DataFrame) -> DataFrame:
    """part, n for each table of a batch's briefing (new and updated entities, alerts, contradictions, ...)."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out
