"""Timelines: dates of any precision as text, staged by document, promoted by date, rendered in date order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import text as tx
from recordloom.operators import similarity
from recordloom.operators.components import components
from recordloom.operators.extraction import event_key
from recordloom.operators.ranking import spread_rank
from recordloom.session import Workspace


def stage(events: DataFrame) -> DataFrame:
    """date, key, event, page, confidence, entity_ids of one document each (sha256): events (sha256, entity_id, date, event,
    page, confidence, ord) are trimmed, empty ones dropped, equal ones joined with all their entities; the first decides the
    rest, and a missing confidence is high."""
    clean = events.withColumns({"date": F.trim(F.coalesce("date", F.lit(""))), "event": F.trim(F.coalesce("event", F.lit("")))}).where("date <> '' AND event <> ''")
    keyed = clean.withColumn("key", event_key(F.col("date"), F.col("event")))
    first = F.min_by(F.struct("event", "page", "confidence"), F.col("ord")).alias("f")
    ids = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("ord", "entity_id"))), lambda r: r["entity_id"])).alias("entity_ids")
    out = keyed.groupBy("sha256", "date", "key").agg(first, ids)
    return out.select("sha256", "date", "key", "f.event", "f.page", F.coalesce(F.nullif("f.confidence", F.lit("")), F.lit("high")).alias("confidence"), "entity_ids")


def staged_dates(staged: DataFrame) -> DataFrame:
    return staged.groupBy("sha256").agg(F.count_distinct("date").alias("n_dates"))


def collisions(raw: DataFrame, canonical: DataFrame, consumed: DataFrame | None = None) -> DataFrame:
    """date, n_raw: dates with raw events whose canonical timeline exists. Raw rows that were promoted before
    (``consumed``: sha256, date) are left out."""
    fresh = raw if consumed is None else raw.join(consumed.select("sha256", "date"), ["sha256", "date"], "left_anti")
    return fresh.join(canonical.select("date").distinct(), "date", "left_semi").groupBy("date").agg(F.count("*").alias("n_raw"))


def promote(raw: DataFrame, canonical: DataFrame) -> DataFrame:
    """The canonical events and all raw events of dates that had none; nothing is dropped between documents."""
    return canonical.unionByName(raw.join(canonical.select("date").distinct(), "date", "left_anti"), allowMissingColumns=True)


def settle(events: DataFrame) -> DataFrame:
    """A deterministic settlement of collisions: of events of a date whose first 80 characters agree, the longest
    wording stays (the first in text order of equals)."""
    w = Window.partitionBy("date", event_key(F.col("date"), F.col("event"))).orderBy(F.desc(F.length("event")), "event")
    return events.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def _front(events: DataFrame, order: str) -> Column:
    """The front part of an order, by which long groups of one date are ranked in parts."""
    numeric = events.schema[order].dataType.typeName() in ("long", "integer", "short", "byte")
    return F.floor(F.col(order) / 1024) if numeric else F.lit(0).cast("long")


def by_year(events: DataFrame, order: str = "ord", within: tuple[str, ...] = ()) -> DataFrame:
    """year, place, date, event, ...: the events of each year (``within`` the values of further columns) in the order of
    their dates, a coarser date before the finer ones."""
    rows = spread_rank(events.withColumn("year", tx.year_of("date")), [*within, "year"], F.struct(tx.date_key("date").alias("key"), _front(events, order).alias("front")), [order], "place")
    return rows.withColumn("place", F.col("place").cast("int"))


def by_date(canonical: DataFrame, order: str = "ord") -> DataFrame:
    """date, place, line: the second rendering of the timeline, from the promoted events: a heading for each date (place 0) and a
    line for each of its events, with its confidence unless that is high. The lines by date and place are the text; events without
    a date or text are skipped."""
    kept = canonical.where((F.coalesce("date", F.lit("")) != "") & (F.coalesce("event", F.lit("")) != ""))
    rows = spread_rank(kept, ["date"], _front(kept, order), [order], "place")
    note = F.when(F.coalesce("confidence", F.lit("")).isin("", "high"), F.lit("")).otherwise(F.concat(F.lit(" *(confidence: "), "confidence", F.lit(")*")))
    said = rows.select("date", F.col("place").cast("int").alias("place"), F.concat(F.lit("- "), "event", note).alias("line"))
    return said.unionByName(kept.select("date").distinct().select("date", F.lit(0).alias("place"), F.concat(F.lit("### "), "date").alias("line")))


def line(date: Column, event: Column, confidence: Column) -> Column:
    note = F.when(F.coalesce(confidence, F.lit("")).isin("", "high"), F.lit("")).otherwise(F.concat(F.lit(" *("), confidence, F.lit(" confidence)*")))
    return F.concat(F.lit("- **"), tx.render_date(date), F.lit("** — "), event, note)


def render(events: DataFrame) -> DataFrame:
    """entity_id, year, body: the text of every entity's timeline, a heading and its lines for each year. A row is as long as
    what one entity has in one year; the timeline of all entities is ``lines``."""
    rows = by_year(events, within=("entity_id",)).withColumn("line", line(F.col("date"), F.col("event"), F.col("confidence")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda r: r["line"]), "\n")
    return rows.groupBy("entity_id", "year").agg(body.alias("lines")).select("entity_id", "year", F.concat(F.lit("## "), F.col("year"), F.lit("\n\n"), F.col("lines")).alias("body"))


def lines(events: DataFrame, entities: DataFrame) -> DataFrame:
    """year, place, line: the timeline of all entities (id, name, type), each line with a link to its entity, or the id of an
    entity that is not listed. The lines of a year in the order of their places are its text; no year is collected."""
    link = F.concat(F.lit("[[entities/"), F.lower("type"), F.lit("/"), F.col("id"), F.lit("|"), F.col("name"), F.lit("]]"))
    linked = events.join(entities.select(F.col("id").alias("entity_id"), link.alias("link")), "entity_id", "left")
    said = F.concat(F.coalesce("link", "entity_id"), F.lit(" — "), F.col("event"))
    return by_year(linked).select("year", "place", line(F.col("date"), said, F.col("confidence")).alias("line"))


def bursts(events: DataFrame, days: int = 7, at_least: int = 3) -> DataFrame:
    """window_start, n_entities, n_events of the spans of ``days`` from each day with an event in which several entities have
    events (day precision). An event counts in the spans of the days before it, so no border parts a burst."""
    day = F.to_date("date")
    dated = events.where(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$")).groupBy(day.alias("day"), "entity_id").agg(F.count("*").alias("n"))
    each = dated.select("entity_id", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.date_sub("day", i))).alias("window_start"))
    spans = each.groupBy("window_start").agg(F.count_distinct("entity_id").alias("n_entities"), F.sum("n").alias("n_events"))
    return spans.join(dated.select(F.col("day").alias("window_start")).distinct(), "window_start", "left_semi").where(F.col("n_entities") >= at_least)


def settle_alike(events: DataFrame, workspace: Workspace, percent: int = 80) -> DataFrame:
    """``settle``, and of the events of a date whose words agree by ``percent`` (directly or through others) the longest wording too.
    Words carry their date, so that only events of one date can share any; those alike are met through their rarest words."""
    kept = workspace.keep(settle(events).withColumn("_id", F.monotonically_increasing_id()), "settled")
    words = F.array_distinct(F.transform(tx.tokens("event"), lambda t: F.concat(F.col("date"), F.lit("|"), t)))
    sets = kept.select(F.col("_id").alias("key"), words.alias("items")).where("size(items) > 0").groupBy("items").agg(F.min("key").alias("key"), F.collect_list("key").alias("keys"))
    sets = workspace.keep(sets, "words")
    same = sets.where("size(keys) > 1").select(F.col("key").alias("a"), F.explode("keys").alias("b"))
    links = similarity.jaccard_pairs(sets.select("key", "items"), percent).select("a", "b").unionByName(same)
    named = workspace.keep(components(links, workspace, "alike"), "groups")
    grouped = kept.join(named, kept["_id"] == named["node"], "left").withColumn("_group", F.coalesce("label", "_id"))
    w = Window.partitionBy("_group").orderBy(F.desc(F.length("event")), "event")
    return grouped.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place", "_group", "_id", "node", "label")


def between(events: DataFrame, low: str, high: str) -> DataFrame:
    """Events from ``low`` to ``high`` inclusive, by the dates' sort keys; a year or month covers all of its days."""
    key = tx.date_key("date")
    return events.where((key >= tx.date_key(F.lit(low))) & (key <= F.concat(F.lit(high), F.lit("￿"))))
