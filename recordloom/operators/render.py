"""Notes as text, from the normalised tables. Order columns decide the order of lines; nothing is read back from notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text as tx


def _quoted(c: Column) -> Column:
    """A YAML scalar in double quotes."""
    safe = F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(safe, F.lit("\n"), F.lit("\\n")), F.lit('"'))


def frontmatter(**fields: Column) -> Column:
    lines = [F.concat(F.lit(f"{k}: "), _quoted(v)) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def role_line(relationship: Column, target_path: Column, target_name: Column, page: Column, confidence: Column, span: Column) -> Column:
    parts = [
        F.when(F.coalesce(span, F.lit("")) != "", F.concat(F.lit(" ("), span, F.lit(")"))),
        F.when(page.isNotNull(), F.concat(F.lit(", p. "), page.cast("string"))),
        F.when(~F.coalesce(confidence, F.lit("")).isin("", "high"), F.concat(F.lit(" *("), confidence, F.lit(")*"))),
    ]
    link = F.when(target_path.isNotNull(), tx.wiki_link(target_path, target_name)).otherwise(F.coalesce(target_name, F.lit("?")))
    return F.concat(F.lit("- "), relationship, F.lit(": "), link, *[F.coalesce(p, F.lit("")) for p in parts])


def _lines(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))), lambda r: r["line"]), "\n").alias(name))


def _block(title: str, c: str) -> Column:
    body = F.coalesce(F.col(c), F.lit(""))
    return F.when(body != "", F.concat(F.lit(f"\n## {title}\n\n"), body, F.lit("\n"))).otherwise(F.lit(""))


def entity_notes(entities: DataFrame, events: DataFrame, roles: DataFrame, analysis: DataFrame, notes: DataFrame) -> DataFrame:
    """id, note_path, body. entities: id, name, type, note_path, summary, date_first_seen, date_last_updated; events: entity_id,
    ord, line; roles: src_id, ord, line; analysis: entity_id, ord, line; notes: id, body (kept as written)."""
    parts = [
        (_lines(analysis, "entity_id", "analysis"), "entity_id"), (_lines(events, "entity_id", "timeline"), "entity_id"), (_lines(roles, "src_id", "relationships"), "src_id"),
        (notes.select(F.col("id").alias("nid"), F.col("body").alias("kept")), "nid"),
    ]
    df = entities
    for part, key in parts:
        df = df.join(part, df["id"] == part[key], "left").drop(key)
    head = frontmatter(id=F.col("id"), type=F.col("type"), name=F.col("name"), date_first_seen=F.col("date_first_seen"), date_last_updated=F.col("date_last_updated"))
    body = F.concat(head, F.lit("\n# "), F.col("name"), F.lit("\n"), _block("Summary", "summary"), _block("Analysis", "analysis"), _block("Timeline", "timeline"), _block("Relationships", "relationships"), F.lit("\n## Notes\n\n"), F.coalesce("kept", F.lit("")))
    return df.select("id", "note_path", body.alias("body"))


def document_notes(documents: DataFrame, facts: DataFrame, mentioned: DataFrame) -> DataFrame:
    """sha256, body. documents: sha256, title, filename, document_type, date_of_document, summary; facts, mentioned: sha256, ord, line."""
    df = documents.join(_lines(facts, "sha256", "facts"), "sha256", "left").join(_lines(mentioned, "sha256", "mentioned"), "sha256", "left")
    head = frontmatter(title=F.col("title"), document_type=F.col("document_type"), date_of_document=F.col("date_of_document"), sha256=F.col("sha256"))
    body = F.concat(head, F.lit("\n# "), F.col("title"), F.lit("\n\nSource file: `"), F.col("filename"), F.lit("`\n"), _block("Summary", "summary"), _block("Key facts", "facts"), _block("Entities mentioned", "mentioned"), F.lit("\n## Notes\n\n"))
    return df.select("sha256", body.alias("body"))


def slugs(rows: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """key, slug: a slug of the name; all but the first with a slug get the first six characters of their key behind it."""
    made = rows.select(F.col(key), F.col(order).alias("_order"), tx.doc_slug(name).alias("slug"))
    first = made.groupBy("slug").agg(F.min("_order").alias("_first"))
    later = F.concat("slug", F.lit("-"), F.substring(F.col(key).cast("string"), 1, 6))
    return made.join(first, "slug").select(key, F.when(F.col("_order") == F.col("_first"), F.col("slug")).otherwise(later).alias("slug"))
