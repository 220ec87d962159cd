"""The entity graph: reconciliation, upserts, reverse edges, and the questions asked of it.

Tables: entities (id, name, type, ...), aliases (id, alias), appearances (id, sha256), roles (src_id, relationship, target_id, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import text as tx
from recordloom.operators.components import components
from recordloom.session import Workspace


def name_index(entities: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """norm, type, id: each normalised name or alias of a type belongs to the id that was registered first (``ord``)."""
    named = entities.select(tx.normalized_name("name").alias("norm"), "type", "id", "ord")
    if aliases is not None:
        named = named.unionByName(aliases.join(entities.select("id", "type", "ord"), "id").select(tx.normalized_name("alias").alias("norm"), "type", "id", "ord"))
    return named.where("norm <> ''").groupBy("norm", "type").agg(F.min_by("id", F.struct("ord", "id")).alias("id"))


def reconcile(incoming: DataFrame, registry: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """id, final_id, matched of incoming entities (id, name, type, ord). Ids that are registered stay; others take the id
    registered for their name and type, else the id that came first in the batch with that name and type."""
    index = name_index(registry, aliases).withColumnRenamed("id", "known_id")
    new = incoming.select("id", "type", "ord", tx.normalized_name("name").alias("norm"))
    marked = new.join(registry.select(F.col("id"), F.lit(True).alias("here")), "id", "left").join(index, ["norm", "type"], "left")
    first = new.where("norm <> ''").groupBy("norm", "type").agg(F.min_by("id", F.struct("ord", "id")).alias("first_id"))
    marked = marked.join(first, ["norm", "type"], "left")
    batch = F.coalesce("first_id", "id")
    final = F.when(F.col("here"), F.col("id")).otherwise(F.coalesce("known_id", batch))
    return marked.withColumn("final_id", final).select("id", "final_id", (F.col("id") != F.col("final_id")).alias("matched"))


def reconcile_documents(named: DataFrame, registry: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """sha, id, final_id for the entities (sha, arrival, at, id, name, type) of a batch of documents, one row for each id of
    each document. Registered ids stay, also those that an earlier document of the batch registers; others take the id that is
    registered for their name and type, or that the first document of the batch with that name and type has given it; the
    rest are registered under their own. What documents call their entities is compared by name only."""
    rows = named.groupBy("sha", "id").agg(F.min(F.struct("arrival", "at", "name", "type")).alias("f")).select("sha", "id", "f.*")
    rows = rows.withColumn("norm", tx.normalized_name("name"))
    known = name_index(registry, aliases).withColumnRenamed("id", "known_id")
    first = rows.where("norm <> ''").groupBy("norm", "type").agg(F.min(F.struct("arrival", "at", "id")).alias("first"))
    marked = rows.join(registry.select("id", F.lit(True).alias("here")), "id", "left").join(known, ["norm", "type"], "left").join(first, ["norm", "type"], "left")
    # these are registered under their own id
    own = marked.where(F.col("here").isNull() & F.col("known_id").isNull() & (F.col("first").isNull() | (F.col("first.arrival") == F.col("arrival"))))
    since = own.groupBy("id").agg(F.min("arrival").alias("since"))
    marked = marked.join(since, "id", "left")
    earlier = F.when(F.col("first.arrival") < F.col("arrival"), F.col("first.id"))
    final = F.when(F.col("here") | (F.col("since") < F.col("arrival")), F.col("id")).otherwise(F.coalesce("known_id", earlier, "id"))
    return marked.select("sha", "id", final.alias("final_id"))


def retarget(roles: DataFrame, mapping: DataFrame) -> DataFrame:
    """Roles (with source_sha256) whose targets follow the mapping (sha, id, final_id) of their own document."""
    to = mapping.select(F.col("sha").alias("source_sha256"), F.col("id").alias("target_id"), "final_id")
    return roles.join(to, ["source_sha256", "target_id"], "left").withColumn("target_id", F.coalesce("final_id", "target_id")).select(*roles.columns)


def upsert_roles(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing roles, then incoming ones by ``ord``; the first of each (source, relationship without case, target) stays."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("src_id", F.lower("relationship"), "target_id").orderBy("_new", "ord")
    return both.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place", "_new")


def upsert_entities(existing: DataFrame, incoming: DataFrame, today: str) -> DataFrame:
    """Existing entities with the later update date, and the new ones."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumns({"_new": F.lit(1), "date_first_seen": F.lit(today), "date_last_updated": F.lit(today)}), allowMissingColumns=True)
    first = lambda c: F.min_by(c, F.col("_new")).alias(c)
    rest = [c for c in existing.columns if c not in ("id", "date_last_updated")]
    return both.groupBy("id").agg(*[first(c) for c in rest], F.max("date_last_updated").alias("date_last_updated"))


def reverse_roles(roles: DataFrame, entities: DataFrame) -> DataFrame:
    """The reversed edge of each role whose target is registered, with what else the role says (page, confidence, span, source),
    unless the target already has that relationship with the source. Of roles that differ in case alone the first (``ord``, where
    there is one) counts."""
    rest = [c for c in roles.columns if c not in ("src_id", "relationship", "target_id", "is_reverse")]
    known = roles.join(entities.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    turned = known.select(F.col("target_id").alias("src_id"), F.lower("relationship").alias("low"), F.col("src_id").alias("target_id"), F.struct("relationship", *rest).alias("said"))
    order = F.struct(*[F.col(f"said.{c}") for c in ("ord", "relationship") if c in ("relationship", *rest)])
    there = roles.select(F.col("src_id").alias("s"), F.lower("relationship").alias("r"), F.col("target_id").alias("t"))
    same = (F.col("src_id") == F.col("s")) & (F.col("low") == F.col("r")) & (F.col("target_id") == F.col("t"))
    first = turned.groupBy("src_id", "low", "target_id").agg(F.min_by("said", order).alias("said")).join(there, same, "left_anti")
    return first.select("src_id", "said.relationship", "target_id", F.lit(True).alias("is_reverse"), *[f"said.{c}" for c in rest])


def shared_targets(roles: DataFrame, at_least: int = 2, edges: DataFrame | None = None) -> DataFrame:
    """target_id, n_entities, n_pairs, n_linked: targets that several entities refer to, how many pairs of these that makes
    and how many of the pairs are linked directly (by ``edges``, or by the roles themselves). Pairs are counted, never made."""
    members = roles.select("target_id", "src_id").distinct()
    groups = members.groupBy("target_id").agg(F.count("*").alias("n_entities")).where(F.col("n_entities") >= at_least)
    edges = (roles if edges is None else edges).where("src_id <> target_id").select(F.least("src_id", "target_id").alias("a"), F.greatest("src_id", "target_id").alias("b")).distinct()
    of = lambda c, t: members.select(F.col("src_id").alias(c), F.col("target_id").alias(t))
    inside = edges.join(of("a", "ta"), "a").join(of("b", "tb"), "b").where("ta = tb").groupBy(F.col("ta").alias("target_id")).agg(F.count("*").alias("n_linked"))
    return groups.join(inside, "target_id", "left").select("target_id", "n_entities", F.expr("n_entities * (n_entities - 1) div 2").alias("n_pairs"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))


def many_targets(roles: DataFrame, pattern: str, at_least: int = 3) -> DataFrame:
    """src_id, n_targets, relationships of sources with a matching relationship to several targets."""
    hit = roles.where(F.lower("relationship").rlike(pattern)).groupBy("src_id", "target_id").agg(F.collect_set(F.lower("relationship")).alias("said"))
    named = F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("said")))), ",").alias("relationships")
    return hit.groupBy("src_id").agg(F.count("*").alias("n_targets"), named).where(F.col("n_targets") >= at_least)


def recurring_unlinked(entities: DataFrame, appearances: DataFrame, roles: DataFrame, at_least: int = 3) -> DataFrame:
    """id, n_documents of entities in several documents without any role."""
    seen = appearances.groupBy("id").agg(F.count_distinct("sha256").alias("n_documents")).where(F.col("n_documents") >= at_least)
    return seen.join(entities.select("id"), "id", "left_semi").join(roles.select(F.col("src_id").alias("id")), "id", "left_anti")


def isolated(entities: DataFrame, roles: DataFrame) -> DataFrame:
    ends = roles.select(F.col("src_id").alias("id")).unionByName(roles.select(F.col("target_id").alias("id")))
    return entities.join(ends, "id", "left_anti")


def feature_clusters(features: DataFrame, workspace: Workspace, larger_than: int = 2, useless: list[tuple[str, str]] | None = None) -> DataFrame:
    """id, cluster_id (least id), size: clusters of entities that share two kinds of feature (id, kind, value). Who shares two
    features has one key of both, so each key hangs its members on its least one: no pair is ever made. Pairs of kinds in
    ``useless`` (in alphabetical order) are no evidence."""
    f = features.distinct()
    keys = f.alias("x").join(f.alias("y"), "id").where("x.kind < y.kind").select("id", F.col("x.kind").alias("k1"), F.col("x.value").alias("v1"), F.col("y.kind").alias("k2"), F.col("y.value").alias("v2"))
    for a, b in useless or []:
        keys = keys.where(~((F.col("k1") == a) & (F.col("k2") == b)))
    key = ["k1", "v1", "k2", "v2"]
    least = keys.groupBy(*key).agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    edges = keys.join(least, key).select("a", F.col("id").alias("b"))
    named = components(edges, workspace, "clusters")
    size = named.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") > larger_than)
    return named.join(size, "label").select(F.col("node").alias("id"), F.col("label").alias("cluster_id"), "size")


def co_occurrence(appearances: DataFrame, at_least: int = 2, block: int = 200) -> DataFrame:
    """a, b, n_documents of entities that several documents name together. Entities that only one document names cannot
    qualify and go first. A document that names more than ``block`` entities is taken in blocks of them, so that no task makes the
    pairs of a wide one alone; the counts are joined before they are shuffled."""
    seen = appearances.select("id", "sha256").distinct()
    often = seen.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= at_least).select("id")
    kept = seen.join(often, "id", "left_semi")
    width = kept.groupBy("sha256").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    wide = kept.join(width, "sha256")
    x = wide.select("sha256", F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    y = wide.select("sha256", F.col("id").alias("b"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    return x.join(y, ["sha256", "block"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_documents")).where(F.col("n_documents") >= at_least)


def documents_without_entities(documents: DataFrame, appearances: DataFrame) -> DataFrame:
    return documents.join(appearances.select("sha256"), "sha256", "left_anti")


def dangling(appearances: DataFrame, entities: DataFrame) -> DataFrame:
    return appearances.select("id").distinct().join(entities.select("id"), "id", "left_anti")


def contradictions(facts: DataFrame, at_least: int = 3) -> DataFrame:
    """id, kind, n_values, n_documents: facts (id, kind, value, sha256, confidence) of one kind with several values, for
    entities in several documents, of medium confidence or better."""
    good = facts.where(F.col("confidence").isin("high", "medium"))
    wide = facts.groupBy("id").agg(F.count_distinct("sha256").alias("n_documents")).where(F.col("n_documents") >= at_least)
    split = good.groupBy("id", "kind").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")
    return split.join(wide, "id").select("id", "kind", "n_values", "n_documents")


def weakest(a: Column, b: Column) -> Column:
    """The weaker of two confidences."""
    order = F.create_map(*[F.lit(x) for pair in (("disputed", 0), ("low", 1), ("medium", 2), ("high", 3)) for x in pair])
    return F.when(order[a] <= order[b], a).otherwise(b)


def within_days(left: DataFrame, right: DataFrame, days: int, left_date: str, right_date: str, on: list[str]) -> DataFrame:
    """Rows of both sides with equal keys and dates at most ``days`` apart: the time is cut into spans of that length, and a
    row of the left side meets its own span and its neighbours, so that the join stays an equi-join."""
    span = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01")) / days)
    x = left.withColumn("_span", F.explode(F.array(span(left_date) - 1, span(left_date), span(left_date) + 1)))
    y = right.withColumn("_span", span(right_date))
    return x.join(y, [*on, "_span"]).where(F.abs(F.datediff(right_date, left_date)) <= days).drop("_span")


def disproportionate(transactions: DataFrame, revenue: DataFrame, factor: float = 2.0) -> DataFrame:
    """Transactions (id, amount, ...) above ``factor`` times the yearly revenue (id, revenue) of a party."""
    return transactions.join(revenue, "id").where(F.col("amount") > factor * F.col("revenue"))


def rapid(events: DataFrame, key: str, date: str, days: int = 365, at_least: int = 3) -> DataFrame:
    """key, first_date, n of the busiest span of ``days`` of keys with several events in one span."""
    day = F.datediff(F.col(date), F.lit("1970-01-01"))
    w = Window.partitionBy(key).orderBy("day").rangeBetween(0, days - 1)
    counted = events.select(key, F.col(date).alias("first_date"), day.alias("day")).withColumn("n", F.count("*").over(w)).where(F.col("n") >= at_least)
    return counted.groupBy(key).agg(F.max(F.struct("n", (-F.col("day")).alias("d"), "first_date")).alias("m")).select(key, F.col("m.first_date").alias("first_date"), F.col("m.n").alias("n"))


def _surface_blocks(surfaces: DataFrame, size: int):
    """(id, surface in lower case) in blocks of about ``size`` bytes."""
    rows, held = [], 0
    for r in surfaces.where("surface <> ''").select("id", F.lower("surface").alias("surface")).distinct().toLocalIterator():
        rows.append((r["id"], r["surface"]))
        held += len(r["surface"].encode()) + 64
        if held >= size:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def mentions(surfaces: DataFrame, documents: DataFrame, key: str = "doc_id", text: str = "text", block: int = 32 << 20) -> DataFrame:
    """id, key of every entity a surface of which is a substring (not a word) of a document's text, without case. The
    surfaces are taken in blocks of bounded bytes; for each, every task holds one automaton and reads each text once."""
    spark, of, to = documents.sparkSession, surfaces.schema["id"].dataType.simpleString(), documents.schema[key].dataType.simpleString()
    out = None
    for rows in _surface_blocks(surfaces, block):
        held = spark.sparkContext.broadcast(rows)

        def find(batches, held=held):
            import ahocorasick
            import pandas as pd

            by: dict[str, list] = {}
            for i, s in held.value:
                by.setdefault(s, []).append(i)
            machine = ahocorasick.Automaton()
            for s, ids in by.items():
                machine.add_word(s, ids)
            machine.make_automaton()
            for batch in batches:
                found = [(i, k) for k, t in zip(batch[key], batch[text], strict=True) for i in {i for _, ids in machine.iter((t or "").lower()) for i in ids}]
                yield pd.DataFrame(found, columns=["id", key])

        part = documents.select(key, text).mapInPandas(find, f"id {of}, {key} {to}")
        # an entity's surfaces may lie in several blocks
        out = part if out is None else out.unionByName(part).distinct()
    return spark.createDataFrame([], f"id {of}, {key} {to}") if out is None else out


def manifest(listed: DataFrame, events: DataFrame, roles: DataFrame, entities: DataFrame) -> DataFrame:
    """id, kind (event, role), ord, and the fields of a digest of what the registry holds of the listed entities (id): date, event,
    confidence of events; relationship, target_name, target_type, date_range, confidence of roles. One row each, as an entity may
    have any number; listed entities that the registry lacks have none."""
    named = entities.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"), F.col("type").alias("target_type"))
    none = F.lit(None).cast("string")
    happened = events.select(F.col("entity_id").alias("id"), F.lit("event").alias("kind"), "ord", "date", "event", none.alias("relationship"), none.alias("target_name"), none.alias("target_type"), none.alias("date_range"), "confidence")
    related = roles.join(named, "target_id", "left").select(F.col("src_id").alias("id"), F.lit("role").alias("kind"), "ord", none.alias("date"), none.alias("event"), "relationship", "target_name", "target_type", "date_range", "confidence")
    return happened.unionByName(related).join(listed.select("id").distinct(), "id", "left_semi")


def changing_roles(roles: DataFrame, at_least: int = 2) -> DataFrame:
    """src_id, target_id, n_relationships of sources with several relationships to one target."""
    counted = roles.groupBy("src_id", "target_id").agg(F.count_distinct(F.lower("relationship")).alias("n_relationships"))
    return counted.where(F.col("n_relationships") >= at_least)


def callouts(notes: DataFrame) -> DataFrame:
    """note_path, n of notes that hold contradiction callouts."""
    n = F.size(F.regexp_extract_all("body", F.lit(r"\[!contradiction\]"), F.lit(0)))
    return notes.select("note_path", n.alias("n")).where("n > 0")


def widely_said(roles: DataFrame, at_least: int = 3) -> DataFrame:
    """src_id, relationship, target_id, n_documents of roles that several documents state."""
    said = roles.groupBy("src_id", F.lower("relationship").alias("relationship"), "target_id").agg(F.count_distinct("source_sha256").alias("n_documents"))
    return said.where(F.col("n_documents") >= at_least)


def widely_seen(appearances: DataFrame, at_least: int = 3) -> DataFrame:
    """id, n_documents of entities that several documents name."""
    return appearances.groupBy("id").agg(F.count_distinct("sha256").alias("n_documents")).where(F.col("n_documents") >= at_least)


def dormant(seen: DataFrame, key: str, date: str, before: str, since: str) -> DataFrame:
    """key, first_seen, last_seen of what was there before a date and again since a later one."""
    span = seen.groupBy(key).agg(F.to_date(F.min(date)).alias("first_seen"), F.to_date(F.max(date)).alias("last_seen"))
    return span.where((F.col("first_seen") < F.lit(before).cast("date")) & (F.col("last_seen") >= F.lit(since).cast("date")))


def early(rows: DataFrame, key: str, order: str, day: str, days: int = 365) -> DataFrame:
    """The rows (``order``, days) more than ``days`` before the day of their key's first row."""
    first = rows.groupBy(key).agg(F.min_by(day, order).alias("_first"))
    return rows.join(first, key).select(order, F.datediff("_first", day).alias("days")).where(F.col("days") > days)


def round_amount(c: Column, unit: int = 100) -> Column:
    return F.round(c).cast("long") % unit == 0
