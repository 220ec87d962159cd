"""Extractions: validation, ids, and the merge of the sections of one document.

Merging is a fold in section order for one thing only, the drift of ids; the rest are aggregates with an order column.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import text as tx
from recordloom.schemas import CONFIDENCE, ENTITY, FACT, struct


def _missing(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) == "", F.lit(True))


def errors(raw: Column) -> Column:
    """Array of messages for one extraction in JSON; empty where it is valid. Types are checked on the JSON itself, as a
    typed reading would turn a wrong type into a null."""
    v = F.try_parse_json(raw)
    at = lambda path, kind="string": F.try_variant_get(v, path, kind)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    is_object = lambda path: F.coalesce(kind(path).startswith("OBJECT"), F.lit(False))
    is_array = lambda path: F.coalesce(kind(path).startswith("ARRAY"), F.lit(False))
    note = lambda bad, message: F.when(bad, F.lit(message))
    facts = F.coalesce(at("$.document.key_facts", "array<variant>"), F.array().cast("array<variant>"))
    entities = F.coalesce(at("$.entities", "array<variant>"), F.array().cast("array<variant>"))
    sub = lambda x, path, kind="string": F.try_variant_get(x, path, kind)

    def confidence(x: Column, where: Column) -> Column:
        c = sub(x, "$.confidence")
        return F.when(F.coalesce(c, F.lit("")) != "", F.when(~c.isin(*CONFIDENCE), F.concat(where, F.lit(": confidence "), c)))

    def entity(e: Column, i: Column) -> Column:
        name = F.concat(F.lit("entities["), i.cast("string"), F.lit("]"))
        needed = F.array(*[F.when(_missing(sub(e, f"$.{k}")), F.concat(name, F.lit(f": {k} is missing"))) for k in ("id", "name", "type")])
        events = F.transform(F.coalesce(sub(e, "$.timeline_events", "array<variant>"), F.array().cast("array<variant>")), lambda x: confidence(x, F.concat(name, F.lit(".timeline_events"))))
        roles = F.transform(F.coalesce(sub(e, "$.roles", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.when(~F.schema_of_variant(x).startswith("OBJECT"), F.concat(name, F.lit(": a role is no object"))))
        return F.concat(needed, events, roles)

    found = F.concat(
        F.array(
            note(~is_object("$.document"), "document is no object"),
            note(is_object("$.document") & _missing(at("$.document.sha256")), "document: sha256 is missing"),
            note(is_object("$.document") & _missing(at("$.document.filename")), "document: filename is missing"),
            note(~is_array("$.entities"), "entities is no list"),
            note(_missing(at("$.morgue_entity_id")), "morgue_entity_id is missing"),
            note(_missing(at("$.morgue_document_type")), "morgue_document_type is missing"),
        ),
        F.transform(facts, lambda x: confidence(x, F.lit("document.key_facts"))),
        F.flatten(F.transform(entities, entity)),
    )
    return F.when(v.isNull(), F.array(F.lit("no JSON"))).otherwise(F.array_compact(found))


def apply_match_ids(extractions: DataFrame) -> DataFrame:
    """Entities take their match_id where they have one, and roles within the document follow."""
    taken = F.map_from_entries(
        F.array_distinct(F.transform(F.filter("entities", lambda e: F.coalesce(e["match_id"], F.lit("")) != ""), lambda e: F.struct(e["id"].alias("key"), e["match_id"].alias("value"))))
    )
    target = lambda t: F.coalesce(F.try_element_at(F.col("taken"), t), t)
    new_id = lambda e: F.coalesce(F.nullif(e["match_id"], F.lit("")), e["id"])
    moved = F.transform("entities", lambda e: e.withField("id", new_id(e)).withField("roles", F.transform(e["roles"], lambda r: r.withField("target_id", target(r["target_id"])))))
    return extractions.withColumn("taken", taken).withColumn("entities", moved).drop("taken")


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_place = 1").drop("_place")


def fact_key(c: Column) -> Column:
    return F.lower(F.substring(c, 1, 120))


def event_key(date: Column, event: Column) -> Column:
    """Date and the first 80 characters; cut before they are lower-cased."""
    return F.concat(F.coalesce(date, F.lit("")), F.lit("|"), F.lower(F.substring(F.coalesce(event, F.lit("")), 1, 80)))


def dedup_facts(facts: DataFrame) -> DataFrame:
    """facts (sha256, ord, fact, ...): the first of each key, empty ones dropped."""
    kept = facts.where(F.coalesce("fact", F.lit("")) != "").withColumn("key", fact_key(F.col("fact")))
    return first_of(kept, ["sha256", "key"], "ord").drop("key")


def dedup_events(events: DataFrame, by: str = "entity_id") -> DataFrame:
    """events (by, date, event, ord, ...): the first of each key."""
    return first_of(events.withColumn("key", event_key(F.col("date"), F.col("event"))), [by, "key"], "ord").drop("key")


def final_aliases(names: DataFrame) -> DataFrame:
    """id, aliases from (id, name, alias): distinct without case, never the name itself, in alphabetical order."""
    kept = names.where((F.coalesce("alias", F.lit("")) != "") & (F.lower("alias") != F.lower(F.coalesce("name", F.lit("")))))
    return kept.groupBy("id", F.lower("alias").alias("low")).agg(F.min("alias").alias("alias")).groupBy("id").agg(F.sort_array(F.collect_list("alias")).alias("aliases"))


def drift(entities: DataFrame) -> DataFrame:
    """sha256, section, ord, id, final_id: an entity takes the id under which one of its surfaces (name, aliases,
    normalised) is already known in its document. The fold runs in section order, within one document at a time."""
    surfaces = F.array_distinct(F.filter(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), tx.normalized_name), lambda s: s != ""))
    rows = entities.select("sha256", "section", "ord", "id", surfaces.alias("surfaces"))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        known: dict[str, str] = {}
        out = []
        for r in group.sort_values(["section", "ord"]).itertuples():
            final = next((known[s] for s in r.surfaces if s in known), r.id)
            for s in r.surfaces:
                known.setdefault(s, final)
            out.append((r.sha256, r.section, r.ord, r.id, final))
        return pd.DataFrame(out, columns=["sha256", "section", "ord", "id", "final_id"])

    return rows.groupBy("sha256").applyInPandas(fold, "sha256 string, section int, ord int, id string, final_id string")


def merge_entities(entities: DataFrame) -> DataFrame:
    """sha256, id, name, type, summary, analysis of each document, from (sha256, section, ord, id, name, type, summary,
    analysis): the longest name (the first of equals), the first type and summary that are not empty, analyses one below the
    other unless they are contained in another one that came before."""
    place = F.struct("section", "ord")
    filled = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", place))
    texts = F.sort_array(F.collect_list(F.when(F.coalesce("analysis", F.lit("")) != "", F.struct("section", "ord", "analysis"))))
    joined = F.aggregate("texts", F.lit(""), lambda s, t: F.when(F.contains(s, t["analysis"]), s).when(s == "", t["analysis"]).otherwise(F.concat(s, F.lit("\n\n"), t["analysis"])))
    named = F.max_by("name", F.struct(F.length(F.coalesce("name", F.lit(""))).alias("n"), (-F.col("section")).alias("s"), (-F.col("ord")).alias("o")))
    grouped = entities.groupBy("sha256", "id").agg(named.alias("name"), filled("type").alias("type"), filled("summary").alias("summary"), texts.alias("texts"))
    return grouped.select("sha256", "id", "name", "type", "summary", joined.alias("analysis"))


def merge_sections(sections: DataFrame) -> DataFrame:
    """One extraction for each sha256 from those of its sections (sha256, section, document, entities, morgue_entity_id,
    morgue_document_type). The document is that of the first section that says anything of it, with the key facts of all;
    entities under one id, or under a name that another of the document has, are one: its names, events (by date and text) and roles (by
    relationship without case and target) are united, the first of equals stays, and entities keep the order in which they first
    came. Entities without an id are left out; a document without entities has an empty list. What is held in a row is one
    document's extraction."""
    at = lambda *more: F.struct("section", *more)
    each = sections.select("sha256", "section", F.posexplode("entities").alias("ord", "e")).where(F.coalesce("e.id", F.lit("")) != "").select("sha256", "section", "ord", "e.*")
    final = drift(each).select("sha256", "section", "ord", "final_id")
    said = each.join(final, ["sha256", "section", "ord"]).withColumn("id", F.col("final_id")).drop("final_id")

    def united(column: str, key: Column) -> DataFrame:
        one = said.select("sha256", "id", "section", "ord", F.posexplode(column).alias("k", "x")).groupBy("sha256", "id", key.alias("key")).agg(F.min_by("x", at("ord", "k")).alias("x"), F.min(at("ord", "k")).alias("p"))
        return one.groupBy("sha256", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda y: y["x"]).alias(column))

    merged = merge_entities(said)
    surfaces = said.select("sha256", "id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    names = final_aliases(surfaces.join(merged.select("sha256", "id", "name"), ["sha256", "id"]).select(F.struct("sha256", "id").alias("id"), "name", "alias"))
    came = said.groupBy("sha256", "id").agg(F.min(at("ord")).alias("came"))
    full = merged.join(came, ["sha256", "id"]).join(names.select("id.sha256", "id.id", "aliases"), ["sha256", "id"], "left")
    full = full.join(united("timeline_events", event_key(F.col("x.date"), F.col("x.event"))), ["sha256", "id"], "left")
    full = full.join(united("roles", F.struct(F.lower(F.coalesce("x.relationship", F.lit(""))), "x.target_id")), ["sha256", "id"], "left")
    kinds = {f.name: f.dataType for f in struct(ENTITY).fields}
    empty = lambda c: F.coalesce(c, F.array().cast(kinds[c])).alias(c)
    entity = F.struct("id", F.lit(None).cast("string").alias("match_id"), "name", "type", empty("aliases"), "summary", F.nullif("analysis", F.lit("")).alias("analysis"), empty("timeline_events"), empty("roles"))
    entities = full.groupBy("sha256").agg(F.transform(F.sort_array(F.collect_list(F.struct("came", entity.alias("e")))), lambda y: y["e"]).alias("entities"))

    facts = dedup_facts(sections.select("sha256", "section", F.posexplode("document.key_facts").alias("k", "f")).select("sha256", at("k").alias("ord"), "f.fact", "f"))
    facts = facts.groupBy("sha256").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "f"))), lambda y: y["f"]).alias("facts"))
    filled = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("section"))).alias(c)
    heads = sections.groupBy("sha256").agg(F.min_by("document", F.when(F.coalesce(F.to_json("document"), F.lit("{}")) != "{}", F.col("section"))).alias("document"), filled("morgue_entity_id"), filled("morgue_document_type"))
    whole = heads.join(entities, "sha256", "left").join(facts, "sha256", "left")
    document = F.when(F.col("document").isNotNull(), F.col("document").withField("key_facts", F.coalesce("facts", F.array().cast(f"array<{FACT}>"))))
    return whole.select("sha256", document.alias("document"), F.coalesce("entities", F.array().cast(f"array<{ENTITY}>")).alias("entities"), "morgue_entity_id", "morgue_document_type")


def section_errors(wanted: DataFrame, sections: DataFrame) -> DataFrame:
    """sha256, error of the documents (sha256) that cannot be merged: without a section, or with one that is no JSON (all of
    whose fields are null)."""
    lost = wanted.select("sha256").distinct().join(sections.select("sha256"), "sha256", "left_anti").select("sha256", F.lit("no section").alias("error"))
    fields = ("document", "entities", "morgue_entity_id", "morgue_document_type")
    broken = sections.where(" AND ".join(f"{c} IS NULL" for c in fields)).join(wanted.select("sha256"), "sha256", "left_semi")
    return lost.unionByName(broken.groupBy("sha256").agg(F.concat(F.lit("no JSON: section "), F.min("section").cast("string")).alias("error")))


def explode_entities(extractions: DataFrame, ordered: str = "section") -> DataFrame:
    """A row for each entity: sha256, section, ord and the entity's fields."""
    section = F.col(ordered) if ordered in extractions.columns else F.lit(0)
    rows = extractions.select(F.col("document.sha256").alias("sha256"), section.cast("int").alias("section"), F.posexplode("entities").alias("ord", "e"))
    return rows.select("sha256", "section", "ord", "e.*")


def split_new(merged: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities that the registry lacks, and those that it has."""
    return merged.join(registry.select("id"), "id", "left_anti"), merged.join(registry.select("id"), "id", "left_semi")


def minhash_of(queue: Column, sidecar: Column, document: Column) -> Column:
    """The first signature that is there; an empty one counts as none."""
    full = lambda c: F.when(F.size(c) > 0, c)
    return F.coalesce(full(queue), full(sidecar), full(document), F.array().cast("array<long>"))
