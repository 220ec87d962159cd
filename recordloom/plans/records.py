"""Queries over records, queues, registries and notes, with their SQL; the rest is in ``catalog``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom import schemas
from recordloom.functions import text as tx
from recordloom.operators import audit, extraction, flags, graph, lifecycle, similarity, timeline, vectors
from recordloom.plans import catalog
from recordloom.plans import world as w
from recordloom.plans.registry import ORACLE_SQL, QUERIES, query
from recordloom.session import Workspace, table

__all__ = ["ORACLE_SQL", "QUERIES"]

NOW = "2024-01-15T00:00:00Z"


# ---- texts


_NOTE = "'---' || chr(10) || 'a: 1' || chr(10) || '---' || chr(10) || 'x' || chr(10) || '## Summary' || chr(10) || lang || ' ' || source || chr(10) || '## Next' || chr(10) || 'y'"


@query(
    "note_parts",
    f"SELECT doc_id, substr({_NOTE}, 14) AS body, lang || ' ' || source AS summary, substr(sha256(source), 1, 16) AS short_id, substr(regexp_replace(lang || '/' || source, '[^A-Za-z0-9_-]', '_', 'g'), 1, 40) || '-' || substr(sha256(lang || '/' || source), 1, 8) AS note_id, md5(substr(text, 1, 300)) AS preview, md5(replace(substr(text, 1, 200), chr(10), ' ')) AS shown FROM documents",
)
def note_parts(spark, d):
    note = F.concat(F.lit("---\na: 1\n---\nx\n## Summary\n"), "lang", F.lit(" "), "source", F.lit("\n## Next\ny"))
    name = F.concat("lang", F.lit("/"), "source")
    return table(spark, d, "documents").select(
        "doc_id", tx.strip_frontmatter(note).alias("body"), tx.section(note, "Summary").alias("summary"), tx.short_id("source").alias("short_id"), tx.note_id(name).alias("note_id"),
        F.md5(tx.preview("text")).alias("preview"), F.md5(tx.one_line("text")).alias("shown"),
    )


@query(
    "formatted",
    """SELECT doc_id, CASE WHEN n >= 1073741824 THEN printf('%.1f GB', round(n / 1073741824.0, 1)) WHEN n >= 1048576 THEN printf('%.1f MB', round(n / 1048576.0, 1)) WHEN n >= 1024 THEN printf('%.1f KB', round(n / 1024.0, 1)) ELSE n || ' B' END AS size,
  CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%dh %02dm', s // 3600, s % 3600 // 60) END AS eta,
  CASE WHEN doc_id % 3 = 1 THEN '1 page' ELSE (doc_id % 3) || ' pages' END AS pages FROM (SELECT doc_id, n_chars * (doc_id % 2000) AS n, n_chars AS s FROM documents)""",
)
def formatted(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.human_size(F.col("n_chars") * (F.col("doc_id") % 2000)).alias("size"), tx.eta("n_chars").alias("eta"), tx.page_label(F.col("doc_id") % 3).alias("pages"))


@query(
    "split_pages",
    r"""SELECT doc_id, len(p)::INT AS n_pages, md5(p[1].t) AS first_md5, p[-1].k::INT AS last_page FROM (SELECT doc_id, list_filter(list_transform(string_split(text, '. '), lambda t, i: {'k': i, 't': trim(t, ' ' || chr(9) || chr(10) || chr(13))}), lambda s: s.t <> '') AS p FROM documents) WHERE len(p) > 0""",
)
def split_pages(spark, d):
    pages = tx.split_pages(F.replace("text", F.lit(". "), F.lit(tx.PAGE_BREAK)))
    rows = table(spark, d, "documents").select("doc_id", pages.alias("p"))
    return rows.select("doc_id", F.size("p").alias("n_pages"), F.md5(F.col("p")[0]["markdown"]).alias("first_md5"), F.element_at("p", -1)["page"].alias("last_page")).where("first_md5 <> md5('')")


# ---- queue


@query(
    "chunk_merge",
    """SELECT sha256, n_pages, pages, n_failed, ocr_used, CASE WHEN n_failed = n THEN 'all chunks failed' END AS error FROM (SELECT 'D' || o_custkey AS sha256, count(*) AS n, count(*) FILTER (WHERE o_orderstatus <> 'F')::INT AS n_pages,
  coalesce(sum(o_orderkey + 1) FILTER (WHERE o_orderstatus <> 'F'), 0)::BIGINT AS pages, count(*) FILTER (WHERE o_orderstatus = 'F')::INT AS n_failed, bool_or(o_orderkey % 2 = 0) AS ocr_used FROM orders GROUP BY 1)""",
)
def chunk_merge(spark, d):
    page = F.array(F.struct(F.lit(1).alias("page"), F.col("o_orderpriority").alias("markdown")))
    chunks = table(spark, d, "orders").select(F.concat(F.lit("D"), F.col("o_custkey").cast("string")).alias("sha256"), F.col("o_orderkey").cast("int").alias("start"), page.alias("pages"), (F.col("o_orderkey") % 2 == 0).alias("ocr_used"), F.when(F.col("o_orderstatus") == "F", F.lit("broken")).alias("error"))
    merged = lifecycle.merge_chunks(chunks)
    total = F.aggregate("pages", F.lit(0).cast("long"), lambda s, p: s + p["page"])
    return merged.select("sha256", F.size("pages").alias("n_pages"), total.alias("pages"), F.size("failed_chunks").alias("n_failed"), "ocr_used", "error")


def _queue(spark, d):
    pages = F.transform(F.split("text", "\n"), lambda p, i: F.struct((i + 1).alias("page"), p.alias("markdown")))
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sha256"), F.col("source").alias("filename"), F.col("lang").alias("document_type"), F.when(F.col("doc_id") % 2 == 0, F.lit(0)).otherwise(F.lit(7)).alias("page_count"), pages.alias("pages"))


@query("queue_view", "SELECT doc_id::VARCHAR AS sha256, source AS filename, lang AS document_type, CASE WHEN doc_id % 2 = 0 THEN len(string_split(text, chr(10))) ELSE 7 END::INT AS page_count, list_sum(list_transform(string_split(text, chr(10)), lambda p: length(p) // 4))::BIGINT AS est_tokens FROM documents")
def queue_view(spark, d):
    return lifecycle.queue_view(_queue(spark, d))


@query("queue_by_pages", "SELECT sha256, page_count, row_number() OVER (ORDER BY page_count, sha256) AS place FROM (SELECT doc_id::VARCHAR AS sha256, n_chars // 100 AS page_count FROM documents)")
def queue_by_pages(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sha256"), F.floor(F.col("n_chars") / 100).alias("page_count"))
    return lifecycle.by_pages(rows).select("sha256", "page_count", "place")


@query("batch_summary", r"SELECT count(*) FILTER (WHERE NOT b) AS ok, count(*) FILTER (WHERE b AND doc_id % 5 <> 0) AS skipped, count(*) FILTER (WHERE b AND doc_id % 5 = 0) AS failed FROM (SELECT doc_id, doc_id % 5 = 0 OR coalesce(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '') = '' AS b FROM documents)")
def batch_summary(spark, d):
    rows = table(spark, d, "documents").withColumn("error", F.when(F.col("doc_id") % 5 == 0, F.lit("broken")))
    return lifecycle.summary(lifecycle.chew_state(rows, error="error"))


@query("aborted", "SELECT state, count(*) AS n FROM (SELECT CASE WHEN doc_id = 7 THEN 'failed' ELSE 'queued' END AS state FROM documents) GROUP BY 1")
def aborted(spark, d):
    queue = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sha256"), F.lit("queued").alias("state"))
    return lifecycle.abort(queue, queue, "7")[0].groupBy("state").agg(F.count("*").alias("n"))


@query("pending", "SELECT count(*) AS n, coalesce(sum(strlen(html)), 0)::BIGINT AS bytes FROM pages WHERE page_id % 3 = 0")
def pending(spark, d):
    name = F.when(F.col("page_id") % 3 == 1, F.lit("/_Failed/a.html")).when(F.col("page_id") % 3 == 2, F.lit("/a.html.yml")).otherwise(F.lit("/a.html"))
    return lifecycle.pending(table(spark, d, "pages").select(F.concat(F.lit("/in"), name).alias("path"), F.octet_length("html").alias("length")))


@query("known_documents", "SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def known_documents(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return similarity.known(rows.where("doc_id % 2 = 1"), rows.where("doc_id % 2 = 0")).select("doc_id")


@query(
    "registry_near_dups",
    f"""WITH {catalog._SIGNED}, pos AS (SELECT doc_id, unnest(sig) AS v, generate_subscripts(sig, 1) AS k FROM signed),
hit AS (SELECT x.doc_id AS candidate, y.doc_id AS registered, count(*) AS n FROM pos x JOIN pos y ON x.k = y.k AND x.v = y.v AND x.doc_id % 2 = 1 AND y.doc_id % 2 = 0 GROUP BY 1, 2 HAVING count(*) / 128.0 >= 0.85)
SELECT candidate, registered, round_even(n / 128.0, 4)::DOUBLE AS similarity, row_number() OVER (PARTITION BY candidate ORDER BY n DESC, registered)::INT AS place FROM hit""",
)
def registry_near_dups(spark, d):
    signed = Workspace(spark, "registry").keep(similarity.signatures(table(spark, d, "documents")).withColumnRenamed("doc_id", "key"), "signed")
    return similarity.against_registry(signed.where("key % 2 = 1"), signed.where("key % 2 = 0"))


# ---- extractions


@query("match_ids", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'C' || o_custkey ELSE 'o' || o_orderkey || '-c' END AS id, 'n' || c_nationkey AS target FROM orders JOIN customer ON c_custkey = o_custkey")
def match_ids(spark, d):
    raw = catalog._extractions(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("arrival"), "o_custkey"), "arrival")
    parsed = raw.select("arrival", "o_custkey", F.from_json("json", schemas.struct(schemas.EXTRACTION)).alias("x")).select("arrival", "o_custkey", "x.*")
    known = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("C"), F.col("o_custkey").cast("string")))
    said = parsed.withColumn("entities", F.transform("entities", lambda e: e.withField("match_id", F.when(e["type"] == "Person", known))))
    done = extraction.apply_match_ids(said)
    return done.select(F.col("arrival").alias("o_orderkey"), F.col("entities")[0]["id"].alias("id"), F.col("entities")[0]["roles"][0]["target_id"].alias("target"))


@query("minhash_source", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 WHEN doc_id % 3 = 0 THEN 2 WHEN doc_id % 5 = 0 THEN 3 END::BIGINT AS source FROM documents")
def minhash_source(spark, d):
    one = lambda n, by: F.when(F.col("doc_id") % by == 0, F.array(F.lit(n).cast("long"))).when(F.col("doc_id") % 7 == 0, F.array().cast("array<long>"))
    return table(spark, d, "documents").select("doc_id", F.get(extraction.minhash_of(one(1, 2), one(2, 3), one(3, 5)), F.lit(0)).alias("source"))


@query("id_drift", "SELECT o_custkey::VARCHAR AS sha256, 'o' || o_orderkey AS id, first_value('o' || o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey % 3, o_orderkey) AS final_id FROM orders")
def id_drift(spark, d):
    name = F.when(F.col("o_orderkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit(".")))
    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("sha256"), (F.col("o_orderkey") % 3).cast("int").alias("section"), F.col("o_orderkey").cast("int").alias("ord"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), name.alias("name"), F.array().cast("array<string>").alias("aliases"))
    return extraction.drift(rows).select("sha256", "id", "final_id")


_PARTS = """x AS (SELECT o_custkey::VARCHAR AS sha256, (o_orderkey % 4)::INT AS section, o_orderkey AS ord, o_orderpriority AS p, o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '.' END AS name,
  strftime(o_orderdate, '%Y') AS date, 'Order ' || o_orderstatus AS event, CASE WHEN o_orderkey % 2 = 0 THEN 'Near' ELSE 'NEAR' END AS relationship, 'N' || (o_orderkey % 3) AS target FROM orders)"""


@query(
    "section_merge",
    f"""WITH {_PARTS},
n AS (SELECT sha256, p, p || '-' || min(section) AS id, max(name) AS name, CASE WHEN max(name) <> min(name) THEN min(name) ELSE '' END AS aliases, min((section, ord)) AS came FROM x GROUP BY 1, 2),
e AS (SELECT sha256, p, string_agg(date || ' ' || event || ' ' || ord, '; ' ORDER BY section, ord) AS events FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY sha256, p, date, event ORDER BY section, ord) = 1) GROUP BY 1, 2),
r AS (SELECT sha256, p, string_agg(relationship || ' ' || target, '; ' ORDER BY section, ord) AS roles FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY sha256, p, target ORDER BY section, ord) = 1) GROUP BY 1, 2),
d AS (SELECT sha256, 'T' || min(section) AS title, count(DISTINCT p)::INT AS n_facts, 'M' || (min(section) FILTER (WHERE section > 0)) AS filed FROM x GROUP BY 1)
SELECT sha256, title, n_facts, filed, id, n.name, aliases, events, roles, (row_number() OVER (PARTITION BY sha256 ORDER BY came) - 1)::INT AS place FROM n JOIN e USING (sha256, p) JOIN r USING (sha256, p) JOIN d USING (sha256)""",
)
def section_merge(spark, d):
    even, p, key = F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"), F.col("o_orderkey")
    section = (key % 4).cast("int")
    text = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    event = F.struct(F.date_format("o_orderdate", "yyyy").alias("date"), text("Order ", F.col("o_orderstatus")).alias("event"), key.cast("int").alias("page"))
    role = F.struct(F.when(even, F.lit("Near")).otherwise(F.lit("NEAR")).alias("relationship"), text("N", (key % 3).cast("string")).alias("target_id"))
    entity = F.struct(text(p, "-", section.cast("string")).alias("id"), text(p, F.when(even, F.lit("")).otherwise(F.lit("."))).alias("name"), F.array(event).alias("timeline_events"), F.array(role).alias("roles"))
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("sha256"), section.alias("section")).agg(F.sort_array(F.collect_list(F.struct(key.alias("k"), entity.alias("e"), p.alias("fact")))).alias("all"))
    number = F.col("section").cast("string")
    document = F.struct("sha256", text("T", number).alias("title"), F.transform("all", lambda x: F.struct(x["fact"].alias("fact"))).alias("key_facts"))
    said = F.to_json(F.struct(document.alias("document"), F.transform("all", lambda x: x["e"]).alias("entities"), F.when(F.col("section") > 0, text("M", number)).alias("morgue_entity_id")))
    one = extraction.merge_sections(rows.select("sha256", "section", F.from_json(said, schemas.EXTRACTION).alias("x")).select("sha256", "section", "x.*"))
    each = one.select("sha256", F.col("document.title").alias("title"), F.size("document.key_facts").alias("n_facts"), F.col("morgue_entity_id").alias("filed"), F.posexplode("entities").alias("place", "e"))
    events = F.array_join(F.transform("e.timeline_events", lambda x: F.concat_ws(" ", x["date"], x["event"], x["page"].cast("string"))), "; ")
    roles = F.array_join(F.transform("e.roles", lambda x: F.concat_ws(" ", x["relationship"], x["target_id"])), "; ")
    return each.select("sha256", "title", "n_facts", "filed", "e.id", "e.name", F.array_join("e.aliases", ", ").alias("aliases"), events.alias("events"), roles.alias("roles"), "place")


@query("key_facts", "SELECT sha256, ord FROM (SELECT lang AS sha256, doc_id AS ord, text FROM documents WHERE text <> '') QUALIFY row_number() OVER (PARTITION BY sha256, lower(substr(text, 1, 120)) ORDER BY ord) = 1")
def key_facts(spark, d):
    return extraction.dedup_facts(table(spark, d, "documents").select(F.col("lang").alias("sha256"), F.col("doc_id").alias("ord"), F.col("text").alias("fact"))).select("sha256", "ord")


@query("alias_lists", "SELECT lang AS id, list_sort(list(a)) AS aliases FROM (SELECT lang, min(a) AS a FROM (SELECT lang, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END AS a FROM documents WHERE source <> 'src1') GROUP BY lang, lower(a)) GROUP BY lang")
def alias_lists(spark, d):
    alias = F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source"))
    return extraction.final_aliases(table(spark, d, "documents").select(F.col("lang").alias("id"), F.lit("SRC1").alias("name"), alias.alias("alias")))


# ---- graph


@query("changing_roles", f"WITH {w.ENTITIES}, r AS (SELECT 'C' || o_custkey AS src_id, 'Rated ' || o_orderpriority AS relationship, 'P' || (o_orderkey % 5) AS target_id FROM orders) SELECT src_id, target_id, count(DISTINCT lower(relationship)) AS n_relationships FROM r GROUP BY 1, 2 HAVING count(DISTINCT lower(relationship)) >= 2")
def changing_roles(spark, d):
    return graph.changing_roles(_rated(spark, d))


def _rated(spark, d):
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("src_id"), F.concat(F.lit("Rated "), "o_orderpriority").alias("relationship"), F.concat(F.lit("P"), (key % 5).cast("string")).alias("target_id"), key.alias("source_sha256"))


@query("widely_said", "SELECT 'C' || o_custkey AS src_id, lower('Rated ' || o_orderpriority) AS relationship, 'P' || (o_orderkey % 5) AS target_id, count(*) AS n_documents FROM orders GROUP BY 1, 2, 3 HAVING count(*) >= 3")
def widely_said(spark, d):
    return graph.widely_said(_rated(spark, d))


@query("widely_seen", f"WITH {w.APPEARANCES} SELECT id, count(DISTINCT sha256) AS n_documents FROM appearances GROUP BY 1 HAVING count(DISTINCT sha256) >= 3")
def widely_seen(spark, d):
    return graph.widely_seen(w.appearances(spark, d))


@query("callouts", f"WITH {w.ENTITIES} SELECT id AS note_path, (ord % 3)::INT AS n FROM entities WHERE ord % 3 > 0")
def callouts(spark, d):
    body = F.concat(F.lit("# x\n"), F.expr("repeat('> [!contradiction] a\n', cast(ord % 3 as int))"))
    return graph.callouts(w.entities(spark, d).select(F.col("id").alias("note_path"), body.alias("body")))


@query("weakest", "SELECT o_orderkey, CASE WHEN a < b THEN a ELSE b END AS rank FROM (SELECT o_orderkey, o_orderkey % 4 AS a, o_custkey % 4 AS b FROM orders)")
def weakest(spark, d):
    names = F.array(*map(F.lit, ("disputed", "low", "medium", "high")))
    of = lambda c: F.element_at(names, (F.col(c) % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", (F.array_position(names, graph.weakest(of("o_orderkey"), of("o_custkey"))) - 1).alias("rank"))


@query(
    "manifest_digests",
    f"""WITH {w.ENTITIES}, {w.EVENTS}, {w.ROLES}, listed AS (SELECT id FROM entities WHERE ord % 3 = 0)
SELECT entity_id AS id, 'event' AS kind, date, event, NULL AS relationship, NULL AS target_name, NULL AS target_type, confidence FROM events WHERE entity_id IN (SELECT id FROM listed)
UNION ALL SELECT src_id, 'role', NULL, NULL, relationship, name, type, NULL FROM roles LEFT JOIN entities ON id = target_id WHERE src_id IN (SELECT id FROM listed)""",
)
def manifest_digests(spark, d):
    e, none = w.entities(spark, d), F.lit(None).cast("string")
    roles = w.roles(spark, d).select("*", none.alias("date_range"), none.alias("confidence"), F.lit(0).cast("long").alias("ord"))
    return graph.manifest(e.where("ord % 3 = 0"), w.events(spark, d), roles, e).drop("ord", "date_range")


# ---- timeline


@query(
    "timeline_by_date",
    f"""WITH {w.EVENTS} SELECT date, row_number() OVER (PARTITION BY date ORDER BY ord)::INT AS place, '- ' || event || CASE WHEN confidence IN ('', 'high') THEN '' ELSE ' *(confidence: ' || confidence || ')*' END AS line FROM events
UNION ALL SELECT DISTINCT date, 0, '### ' || date FROM events""",
)
def timeline_by_date(spark, d):
    return timeline.by_date(w.events(spark, d))


@query("refreshed", f"WITH {w.EVENTS} SELECT entity_id, count(*) AS n FROM events WHERE entity_id <> 'C2' GROUP BY 1 UNION ALL SELECT 'C2', 1")
def refreshed(spark, d):
    events = w.events(spark, d).select("entity_id", "date", "event")
    new = spark.createDataFrame([("C2", "2020", "Anew")], "entity_id string, date string, event string")
    people = w.entities(spark, d).withColumn("summary", F.lit("old"))
    return lifecycle.refresh_entity(people, events, "C2", "new", new)[1].groupBy("entity_id").agg(F.count("*").alias("n"))


@query("analysis_lines", "SELECT 'C' || o_custkey AS entity_id, '2024-01-15' AS date, '*2024-01-15, via [[documents/' || o_orderkey || '|Order ' || o_orderkey || ']]:* ' || o_orderpriority AS line FROM orders")
def analysis_lines(spark, d):
    key = F.col("o_orderkey").cast("string")
    found = table(spark, d, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("entity_id"), F.concat(F.lit("documents/"), key).alias("note_path"), F.concat(F.lit("Order "), key).alias("title"), F.col("o_orderpriority").alias("text"))
    return lifecycle.add_analysis(spark.createDataFrame([], "entity_id string, date string, line string"), found, "2024-01-15")


# ---- vaults


@query("wiki_dead_links", f"WITH {w.ENTITIES} SELECT id AS note_path, 'X' || (ord % 7) AS target FROM entities")
def wiki_dead_links(spark, d):
    body = F.concat(F.lit("See [["), "id", F.lit("|"), "name", F.lit("]] and [[X"), (F.col("ord") % 7).cast("string"), F.lit("]], [[X"), (F.col("ord") % 7).cast("string"), F.lit("|again]]"))
    return audit.dead_links(w.entities(spark, d).select(F.col("id").alias("note_path"), body.alias("body"))).select("note_path", "target")


@query("stale_locks", "SELECT event_id FROM events WHERE event_id % 7 = 0 OR date_trunc('second', ts) <= TIMESTAMP '2024-01-14 23:30:00'")
def stale_locks(spark, d):
    started = F.when(F.col("event_id") % 7 == 0, F.lit("some time")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return audit.stale_locks(table(spark, d, "events").select("event_id", started.alias("started_at")), NOW).select("event_id")


@query("found_projects", "SELECT * FROM (VALUES ('france', 'france', 'found'), ('united', NULL, 'ambiguous'), ('braz', 'brazil', 'found'), ('atlantis', NULL, 'not found')) t(wanted, slug, outcome)")
def found_projects(spark, d):
    """Four look-ups among projects: an exact slug, a front part of several, of one, of none."""
    rows = [("france",), ("united-kingdom",), ("united-states",), ("brazil",), ("france-2",)]
    projects = spark.createDataFrame(rows, "slug string")
    out = None
    for wanted in ("france", "united", "braz", "atlantis"):
        one = lifecycle.find_project(projects, wanted).select(F.lit(wanted).alias("wanted"), "slug", "outcome")
        out = one if out is None else out.unionByName(one)
    return out


@query("project_list", "SELECT r_regionkey::VARCHAR AS slug, r_name AS name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n_documents, (SELECT count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = r_regionkey) AS n_entities FROM region WHERE r_regionkey <> 2")
def project_list(spark, d):
    projects = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("slug"), F.col("r_name").alias("name"), (F.col("r_regionkey") == 2).alias("archived"))
    nations = table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("slug"), "n_nationkey")
    people = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return lifecycle.project_list(projects, nations, people)


@query("recent_documents", "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS date FROM orders ORDER BY o_orderdate::DATE DESC, o_orderkey LIMIT 10")
def recent_documents(spark, d):
    return lifecycle.recent(table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("date")), "date", "o_orderkey")


# ---- vectors and flags


@query("index_upsert", "SELECT kind, count(*) AS n, sum(v)::BIGINT AS v FROM (SELECT CASE WHEN label % 2 = 0 THEN 'page' ELSE 'note' END AS kind, CASE WHEN vec_id % 3 = 0 THEN 100 ELSE label END AS v FROM embeddings) GROUP BY 1")
def index_upsert(spark, d):
    rows = table(spark, d, "embeddings").select(F.when(F.col("label") % 2 == 0, F.lit("page")).otherwise(F.lit("note")).alias("kind"), F.col("vec_id").alias("key"), F.col("label").cast("int").alias("v"))
    new = rows.where("key % 3 = 0").withColumn("v", F.lit(100))
    return vectors.upsert_index(rows, new).groupBy("kind").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


@query("embedded", "SELECT doc_id AS key, (length(text) % 8)::INT AS axis FROM documents")
def embedded(spark, d):
    """A stand-in for a model: one axis of eight, by the length of the text; half of the vectors come from a cache."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = lambda texts: np.eye(8)[[len(t) % 8 for t in texts]] * 3
    ws = Workspace(spark, "embedded")
    cache = ws.keep(vectors.embed(docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi"), model, "doc_id", model="axes").select("digest", "vector").distinct(), "cache")
    made = vectors.embed(docs, model, "doc_id", model="axes", cache=cache)
    return made.select("key", (F.array_position("vector", F.lit(1.0)) - 1).cast("int").alias("axis"))


@query("nominal", "SELECT o_orderkey FROM orders WHERE o_totalprice > 0 AND o_totalprice <= 50000")
def nominal(spark, d):
    return table(spark, d, "orders").where(flags.nominal(F.col("o_totalprice"), 50_000)).select("o_orderkey")


@query("same_address", "SELECT DISTINCT 'C' || o_custkey AS src_id, 'S' || l_suppkey AS target_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey = s_nationkey")
def same_address(spark, d):
    at = lambda name, key, prefix, nation, blank: table(spark, d, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.concat(F.lit(blank), F.lit("Nation "), F.col(nation).cast("string")).alias("address"))
    return flags.same_address(at("customer", "c_custkey", "C", "c_nationkey", ""), at("supplier", "s_suppkey", "S", "s_nationkey", " "), w.roles(spark, d).where("relationship = 'Ordered from'"))
