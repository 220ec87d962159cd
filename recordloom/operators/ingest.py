"""From extractions in JSON to the next snapshot of the graph: validate, reconcile, upsert, stage, log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom import schemas
from recordloom.operators import extraction, graph, timeline
from recordloom.operators.lifecycle import morgue_path
from recordloom.session import Workspace

#: The order in which things were said: batch, document, entity, place within the entity.
ORD = "struct<batch:string,arrival:long,at:int,k:int>"
#: Tables of a snapshot, empty.
EMPTY = {
    "entities": "id string, name string, type string, ord " + ORD + ", date_first_seen string, date_last_updated string",
    "aliases": "id string, alias string",
    "appearances": "id string, sha256 string",
    "roles": "src_id string, relationship string, target_id string, page int, confidence string, date_range string, source_sha256 string, is_reverse boolean, ord " + ORD,
    "timeline_events": "entity_id string, date string, event string, page int, confidence string, source_sha256 string, ord " + ORD,
    "documents": "sha256 string, filename string, title string, document_type string, date_of_document string, page_count int, ingested_at string, entities_extracted int, near_duplicate_of string, morgue_path string",
}


def empty(spark) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], ddl) for name, ddl in EMPTY.items()}


def validate(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw (arrival, json) as parsed extractions with their arrival, and the rejected rows with their errors."""
    checked = raw.withColumn("errors", extraction.errors(F.col("json")))
    good = checked.where(F.size("errors") == 0).select("arrival", F.from_json("json", schemas.struct(schemas.EXTRACTION)).alias("x")).select("arrival", "x.*")
    return good, checked.where(F.size("errors") > 0).select("arrival", "errors")


def post_flight(raw: DataFrame, tables: dict[str, DataFrame], now: str, workspace: Workspace | None = None) -> dict[str, DataFrame]:
    """The next snapshot's tables, with ``rejected``, ``staged`` events and ``log`` lines beside them. Documents are taken in the
    order of ``arrival``; those whose sha256 is known already are left out. Entities are reconciled with the registry and
    with each other, so documents of one batch see what came before them. An id belongs to its document: what one document
    calls ``j`` says nothing of another's ``j``, unless an entity was registered under that id. What several tables come from is
    written once."""
    today, ws = now[:10], workspace or Workspace(raw.sparkSession, "ingest")
    good, rejected = validate(raw)
    fresh = good.join(tables["documents"].select(F.col("sha256").alias("known")), F.col("document.sha256") == F.col("known"), "left_anti")
    docs = ws.keep(extraction.apply_match_ids(extraction.first_of(fresh.withColumn("sha", F.col("document.sha256")), ["sha"], "arrival")), "documents")

    place = lambda at, k: F.struct(F.lit(now).alias("batch"), F.col("arrival").cast("long").alias("arrival"), at.cast("int").alias("at"), k.cast("int").alias("k"))
    each = docs.select("arrival", "sha", F.posexplode("entities").alias("at", "e"))
    named = each.select("sha", "arrival", "at", F.col("e.id").alias("id"), F.col("e.name").alias("name"), F.col("e.type").alias("type"))
    mapping = ws.keep(graph.reconcile_documents(named, tables["entities"], tables["aliases"]), "mapping")
    mapped = each.join(mapping.withColumnRenamed("id", "said").withColumnRenamed("sha", "of"), (F.col("sha") == F.col("of")) & (F.col("e.id") == F.col("said"))).drop("said", "of")
    mapped = ws.keep(mapped.withColumn("ord", place(F.col("at"), F.lit(0))), "mapped")

    first = mapped.groupBy(F.col("final_id").alias("id")).agg(F.min_by("e.name", "ord").alias("name"), F.min_by("e.type", "ord").alias("type"), F.min("ord").alias("ord"))
    entities = ws.keep(graph.upsert_entities(tables["entities"], first, today), "entities")
    surfaces = mapped.select(F.col("final_id").alias("id"), F.explode(F.concat(F.array("e.name"), F.coalesce("e.aliases", F.array().cast("array<string>")))).alias("alias"))
    aliases = tables["aliases"].unionByName(surfaces).join(entities.select("id", "name"), "id").where("alias <> '' AND lower(alias) <> lower(name)")
    appearances = tables["appearances"].unionByName(mapped.select(F.col("final_id").alias("id"), F.col("sha").alias("sha256"))).distinct()

    said = mapped.select("arrival", "final_id", "sha", "at", F.posexplode("e.roles").alias("k", "r"))
    new_roles = said.select(
        F.col("final_id").alias("src_id"), "r.relationship", "r.target_id", "r.page", "r.confidence", "r.date_range", F.col("sha").alias("source_sha256"), F.lit(False).alias("is_reverse"), place(F.col("at"), F.col("k")).alias("ord")
    )
    forward = ws.keep(graph.upsert_roles(tables["roles"], graph.retarget(new_roles, mapping)), "roles")
    back = ws.keep(graph.reverse_roles(forward, entities), "back")
    roles = forward.unionByName(back, allowMissingColumns=True)
    touched = back.select(F.col("src_id").alias("id")).distinct().withColumn("_touched", F.lit(True))
    entities = entities.join(touched, "id", "left").withColumn("date_last_updated", F.when(F.col("_touched"), F.lit(today)).otherwise(F.col("date_last_updated"))).drop("_touched")

    happened = mapped.select("arrival", "final_id", "sha", "at", F.posexplode("e.timeline_events").alias("k", "v"))
    new_events = happened.select(F.col("final_id").alias("entity_id"), "v.date", "v.event", "v.page", "v.confidence", F.col("sha").alias("source_sha256"), place(F.col("at"), F.col("k")).alias("ord"))
    events = extraction.dedup_events(tables["timeline_events"].unionByName(new_events))

    target = F.coalesce("final_id", "morgue_entity_id")
    filed = docs.join(mapping.withColumnRenamed("sha", "of"), (F.col("sha") == F.col("of")) & (F.col("morgue_entity_id") == F.col("id")), "left").select(
        F.col("sha").alias("sha256"), "document.filename", "document.title", "document.document_type", "document.date_of_document", "document.page_count", F.lit(now).alias("ingested_at"),
        F.size("entities").alias("entities_extracted"), "document.near_duplicate_of", morgue_path(target, F.col("morgue_document_type"), F.col("document.filename")).alias("morgue_path"),
    )
    line = F.format_string("[%s] INGEST %s sha256=%s entities=%d type=%s", F.lit(now), F.col("filename"), F.col("sha256"), F.col("entities_extracted"), F.coalesce("document_type", F.lit("?")))
    return {
        "entities": entities, "aliases": aliases.groupBy("id", F.lower("alias").alias("low")).agg(F.min("alias").alias("alias")).drop("low"), "appearances": appearances, "roles": roles, "timeline_events": events,
        "documents": tables["documents"].unionByName(filed), "rejected": rejected, "staged": timeline.stage(new_events.withColumn("sha256", F.col("source_sha256"))), "log": filed.select(line.alias("line")),
    }


def abort_line(now: str, filename: Column, sha256: Column, reason: Column) -> Column:
    return F.format_string("[%s] ABORT %s sha256=%s reason=%s", F.lit(now), filename, sha256, F.coalesce(reason, F.lit("?")))
