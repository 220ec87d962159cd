"""Registered queries of the library, and SQL that gives the same rows.

Each query runs one operator over its whole tables; SQL stands beside it where SQL can express it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import fingerprint as fp
from recordloom.functions import text as tx
from recordloom.operators import ask, audit, extraction, flags, graph, ingest, lifecycle, render, sections, similarity, timeline, vectors
from recordloom.plans import world as w
from recordloom.plans.registry import ORACLE_SQL, QUERIES, query
from recordloom.session import Workspace, table
from recordloom.streaming import watch

__all__ = ["ORACLE_SQL", "QUERIES"]

# ---- documents

_TOKENS = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), lambda t: regexp_full_match(t, '[a-z0-9]+'))"
_A = "[" + ", ".join(map(str, fp.A)) + "]"
_B = "[" + ", ".join(map(str, fp.B)) + "]"
_SIGNED = rf"""tok AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
  ELSE list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) END) AS s FROM tok WHERE len(t) > 0)),
hx AS (SELECT doc_id, md5(s) AS m FROM sh),
hs AS (SELECT doc_id, (('0x' || m[15:16] || m[13:14] || m[11:12] || m[9:10])::BIGINT * 2 + ('0x' || m[7:8] || m[5:6] || m[3:4] || m[1:2])::BIGINT) % 2147483647 AS h FROM hx),
co AS (SELECT unnest({_A}) AS a, unnest({_B}) AS b, generate_subscripts({_A}, 1) AS k),
mins AS (SELECT doc_id, k, min((h * a + b) % 2147483647) AS v FROM hs, co GROUP BY doc_id, k),
signed AS (SELECT doc_id, list(v ORDER BY k) AS sig FROM mins GROUP BY doc_id),
classes AS (SELECT sig, min(doc_id) AS class_id, count(*) AS members FROM signed GROUP BY sig)"""


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return Workspace(spark, "signatures").keep(similarity.classes(similarity.signatures(table(spark, d, "documents"))), "classes")


@query(
    "near_dup_pairs",
    f"""WITH {_SIGNED},
pos AS (SELECT class_id, unnest(sig) AS v, generate_subscripts(sig, 1) AS k FROM classes),
hit AS (SELECT x.class_id AS a, y.class_id AS b, count(*) AS n FROM pos x JOIN pos y ON x.k = y.k AND x.v = y.v AND x.class_id < y.class_id GROUP BY 1, 2)
SELECT a, b, round_even(n / 128.0, 4)::DOUBLE AS similarity FROM hit WHERE n / 128.0 >= 0.85""",
)
def near_dup_pairs(spark, d):
    return similarity.signature_pairs(_classes(spark, d))


@query("near_dup_classes", f"WITH {_SIGNED} SELECT doc_id, class_id, members FROM signed JOIN classes USING (sig)")
def near_dup_classes(spark, d):
    signed = Workspace(spark, "signed").keep(similarity.signatures(table(spark, d, "documents")), "signed")
    return signed.join(similarity.classes(signed), "signature").select("doc_id", "class_id", "members")


@query(
    "shingle_jaccard_pairs",
    rf"""WITH tok AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(t) < 3 THEN [array_to_string(t, ' ')] ELSE list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) END)) AS items FROM tok WHERE len(t) > 0),
cls AS (SELECT items, min(doc_id) AS key FROM sets GROUP BY items), one AS (SELECT key, len(items) AS n, unnest(items) AS item FROM cls),
hit AS (SELECT x.key AS a, y.key AS b, count(*) AS common, any_value(x.n + y.n) AS total FROM one x JOIN one y ON x.item = y.item AND x.key < y.key GROUP BY 1, 2)
SELECT a, b, common::INT AS common, (total - common)::INT AS either FROM hit WHERE 100 * common >= 85 * (total - common)""",
)
def shingle_jaccard_pairs(spark, d):
    return similarity.shingle_pairs(table(spark, d, "documents"))


@query("exact_dup_groups", "SELECT sha256(coalesce(text, '')) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, d):
    return similarity.exact_groups(table(spark, d, "documents"))


@query("token_stats", f"SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def token_stats(spark, d):
    t = table(spark, d, "documents").select("doc_id", tx.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


_RATIO = r"length(regexp_replace(text, '[^\p{L}\p{N}\s]', '', 'g')) / length(text)"


@query("garbled_docs", rf"SELECT doc_id, round({_RATIO}, 6) AS ratio FROM documents WHERE trim(coalesce(text, ''), chr(9) || chr(10) || chr(13) || ' ') <> '' AND {_RATIO} < 0.75")
def garbled_docs(spark, d):
    return table(spark, d, "documents").where(tx.is_garbled("text")).select("doc_id", F.round(tx.readable_ratio("text"), 6).alias("ratio"))


@query("est_tokens", "SELECT doc_id, length(coalesce(text, '')) // 4 AS est_tokens FROM documents")
def est_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.est_tokens("text").alias("est_tokens"))


@query(
    "chew_state",
    r"""SELECT state, garbled, count(*) AS n, sum(char_count)::BIGINT AS chars FROM (SELECT CASE WHEN b THEN 'SKIPPED' ELSE 'OK' END AS state, CASE WHEN b THEN 0 ELSE length(text) END AS char_count,
  CASE WHEN b THEN false ELSE length(regexp_replace(text, '[^\p{L}\p{N}\s]', '', 'g')) / length(text) < 0.75 END AS garbled
  FROM (SELECT text, coalesce(trim(text, chr(9) || chr(10) || chr(13) || ' '), '') = '' AS b FROM documents)) GROUP BY 1, 2""",
)
def chew_state(spark, d):
    return lifecycle.chew_state(table(spark, d, "documents")).groupBy("state", "garbled").agg(F.count("*").alias("n"), F.sum("char_count").alias("chars"))


@query("doc_types", "SELECT lang, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lang)::INT AS place FROM documents GROUP BY lang")
def doc_types(spark, d):
    return lifecycle.breakdown(table(spark, d, "documents"), "lang")


_CHARS = "SELECT doc_id, unnest(CASE WHEN n > 0 THEN range(0, greatest(ceil((n - 2000) / 1800.0)::INT, 0) + 1) ELSE [] END) AS i, n FROM (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents)"


@query("char_windows", f"SELECT doc_id, i::INT AS section, (i * 1800)::INT AS start, least(i * 1800 + 2000, n)::INT AS stop FROM ({_CHARS})")
def char_windows(spark, d):
    ranges = sections.char_ranges(F.length(F.coalesce("text", F.lit(""))), F.lit(2000), F.lit(200))
    return table(spark, d, "documents").select("doc_id", F.posexplode(ranges).alias("section", "r")).select("doc_id", "section", "r.start", F.col("r.end").alias("stop"))


@query(
    "page_windows",
    "SELECT o_orderkey, i::INT AS section, (i * 3 + 1)::INT AS first, least(i * 3 + 4, n)::INT AS last FROM (SELECT o_orderkey, n, unnest(range(0, greatest(ceil((n - 4) / 3.0)::INT, 0) + 1)) AS i FROM (SELECT l_orderkey AS o_orderkey, count(*)::INT AS n FROM lineitem GROUP BY 1))",
)
def page_windows(spark, d):
    pages = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("int").alias("n"))
    return pages.select("o_orderkey", F.posexplode(sections.page_ranges(F.col("n"), F.lit(4), F.lit(1))).alias("section", "r")).select("o_orderkey", "section", "r.first", "r.last")


@query(
    "section_plan",
    """WITH t AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda p: length(p)) AS n FROM documents),
p AS (SELECT doc_id, len(n) AS pages, list_sum(list_transform(n, lambda x: x // 4))::BIGINT AS est, (list_sum(n) + 2 * (len(n) - 1))::BIGINT AS chars FROM t),
q AS (SELECT *, greatest(1, est // pages) AS av FROM p), r AS (SELECT *, greatest(1, round_even(500.0 / av, 0)::INT) AS size FROM q),
s AS (SELECT *, least(size - 1, greatest(0, round_even(50.0 / av, 0)::INT)) AS over FROM r),
u AS (SELECT doc_id, est, pages, chars, CASE WHEN pages > 1 THEN size ELSE 2000 END AS w, CASE WHEN pages > 1 THEN size - over ELSE 1800 END AS step, CASE WHEN pages > 1 THEN pages ELSE chars END AS total FROM s),
v AS (SELECT *, unnest(CASE WHEN est > 1000 THEN range(0, greatest(ceil((total - w) / step::DOUBLE)::BIGINT, 0) + 1) ELSE [NULL] END) AS i FROM u)
SELECT doc_id AS key, est AS est_tokens, est > 1000 AS sectioned, pages > 1 AS paginated, i::INT AS section, (i * step + CASE WHEN pages > 1 THEN 1 ELSE 0 END)::INT AS first, CASE WHEN i IS NOT NULL THEN least(i * step + w, total) END::INT AS last FROM v""",
)
def section_plan(spark, d):
    pages = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda p, i: F.struct((i + 1).alias("page"), p.alias("markdown")))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), pages.alias("pages"), F.lit(0).alias("page_count"))
    return sections.plan(docs, 1000, 500, 50)


@query("candidate_mentions", "SELECT item_id AS id, doc_id FROM documents JOIN benchmark ON contains(lower(documents.text), lower(benchmark.text))")
def candidate_mentions(spark, d):
    return graph.mentions(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("surface")), table(spark, d, "documents"))


@query("unlabelled_docs", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("labelled_docs", "SELECT source, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY source")
def labelled_docs(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


@query(
    "doc_slugs",
    r"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(source || ' Report ' || lang || '!', ' ')), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents)
SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY slug ORDER BY doc_id) = 1 THEN slug ELSE slug || '-' || substr(doc_id::VARCHAR, 1, 6) END AS slug FROM s""",
)
def doc_slugs(spark, d):
    named = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit(" Report "), "lang", F.lit("!.pdf")).alias("file"))
    return render.slugs(named, "doc_id", "file", "doc_id")


# ---- pages

_HTML = "html"
for _tag in ("script", "style", "nav"):
    _HTML = rf"regexp_replace({_HTML}, '<{_tag}\b.*?</{_tag}\s*>', ' ', 'gis')"
_HTML = rf"regexp_replace(regexp_replace({_HTML}, '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs')"
for _name, _char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("amp", "&")):
    _HTML = f"replace({_HTML}, '&{_name};', '{_char}')"


@query("html_text", rf"SELECT page_id, md5(t) AS text_md5, length(t)::INT AS n_chars FROM (SELECT page_id, trim(regexp_replace({_HTML}, '[ \t\n\r\x0b\x0c]+', ' ', 'g'), ' ') AS t FROM pages)")
def html_text(spark, d):
    t = table(spark, d, "pages").select("page_id", tx.html_text("html").alias("t"))
    return t.select("page_id", F.md5("t").alias("text_md5"), F.length("t").alias("n_chars"))


_LINKS = """SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"#?]+)', 1))) AS target FROM pages"""


def _links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"#?]+)'), F.lit(1)))).alias("target"))


@query("page_links", f"SELECT page_id, target FROM ({_LINKS})")
def page_links(spark, d):
    return _links(spark, d)


@query("dead_links", f"SELECT page_id, target FROM ({_LINKS}) WHERE target NOT IN (SELECT regexp_extract(url, '^[^#?]+') FROM pages)")
def dead_links(spark, d):
    known = table(spark, d, "pages").select(F.regexp_extract("url", "^[^#?]+", 0).alias("target"))
    return _links(spark, d).join(known, "target", "left_anti").select("page_id", "target")


@query("url_slugs", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def url_slugs(spark, d):
    return table(spark, d, "pages").select("page_id", tx.slug("url").alias("slug"))


# ---- vectors


@query(
    "vector_topk",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(v.e, q.e) AS score FROM v, v q WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, round(score, 6) AS score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s) WHERE place <= 5""",
)
def vector_topk(spark, d):
    rows = table(spark, d, "embeddings")
    return vectors.top_k(rows, rows.where("vec_id % 100 = 0")).select("query_id", "vec_id", F.round("score", 6).alias("score"), "place")


@query(
    "classify_nearest",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
m AS (SELECT label, list(a ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS a FROM x GROUP BY label, i) GROUP BY label), c AS (SELECT label, list_transform(c, lambda y: y / sqrt(list_dot_product(c, c))) AS c FROM m),
s AS (SELECT vec_id, c.label, list_dot_product(v, c) AS score FROM e, c)
SELECT vec_id, CASE WHEN score >= 0.65 THEN label END AS label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS k FROM s) WHERE k = 1""",
)
def classify_nearest(spark, d):
    rows = table(spark, d, "embeddings")
    pages = rows.select(F.col("vec_id"), F.lit(1).alias("page"), F.col("embedding").alias("vector"))
    return vectors.classify(pages, vectors.centroids(rows), key="vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


@query("index_stats", "SELECT CASE WHEN label % 2 = 0 THEN 'page' ELSE 'note' END AS kind, count(*) AS n FROM embeddings GROUP BY 1")
def index_stats(spark, d):
    return vectors.index_stats(table(spark, d, "embeddings").select(F.when(F.col("label") % 2 == 1, F.lit("note")).alias("kind")))


# ---- entities and roles


@query("entity_index", f"WITH {w.ENTITIES} SELECT id, name, type FROM entities WHERE name <> ''")
def entity_index(spark, d):
    return w.entities(spark, d).where("name <> ''").select("id", "name", "type")


@query(
    "name_reconcile",
    rf"""WITH {w.ENTITIES}, inc AS (SELECT 'I' || id AS id, upper(replace(name, '#', ' & ')) AS name, type, ord FROM entities WHERE ord % 3 = 0 UNION ALL SELECT 'J' || id, replace(name, '#', '  AND '), type, ord + 1 FROM entities WHERE ord % 6 = 0),
reg AS (SELECT id, replace(name, '#', ' and ') AS name, type, ord FROM entities WHERE ord % 2 = 0), nr AS (SELECT *, trim(regexp_replace(regexp_replace(replace(lower(name), '&', 'and'), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'), ' ') AS norm FROM reg),
ni AS (SELECT *, trim(regexp_replace(regexp_replace(replace(lower(name), '&', 'and'), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'), ' ') AS norm FROM inc), ix AS (SELECT norm, type, arg_min(id, (ord, id)) AS known FROM nr GROUP BY norm, type)
SELECT id, final_id, id <> final_id AS matched FROM (SELECT ni.id, coalesce(known, first_value(ni.id) OVER (PARTITION BY ni.norm, ni.type ORDER BY ni.ord, ni.id)) AS final_id FROM ni LEFT JOIN ix USING (norm, type))""",
)
def name_reconcile(spark, d):
    all_ = w.entities(spark, d)
    one = all_.where("ord % 3 = 0").select(F.concat(F.lit("I"), "id").alias("id"), F.upper(F.replace("name", F.lit("#"), F.lit(" & "))).alias("name"), "type", "ord")
    two = all_.where("ord % 6 = 0").select(F.concat(F.lit("J"), "id").alias("id"), F.replace("name", F.lit("#"), F.lit("  AND ")).alias("name"), "type", (F.col("ord") + 1).alias("ord"))
    registry = all_.where("ord % 2 = 0").select("id", F.replace("name", F.lit("#"), F.lit(" and ")).alias("name"), "type", "ord")
    return graph.reconcile(one.unionByName(two), registry)


@query(
    "reverse_roles",
    f"WITH {w.ENTITIES}, {w.ROLES} SELECT DISTINCT target_id AS src_id, relationship, src_id AS target_id, true AS is_reverse FROM roles r WHERE target_id IN (SELECT id FROM entities) AND NOT EXISTS (SELECT 1 FROM roles o WHERE o.src_id = r.target_id AND o.target_id = r.src_id AND lower(o.relationship) = lower(r.relationship))",
)
def reverse_roles(spark, d):
    return graph.reverse_roles(w.roles(spark, d), w.entities(spark, d)).select("src_id", "relationship", "target_id", "is_reverse")


@query(
    "shared_address",
    f"""WITH {w.ROLES}, a AS (SELECT DISTINCT target_id, src_id FROM roles WHERE relationship = 'Located at'), g AS (SELECT target_id, count(*) AS n FROM a GROUP BY 1 HAVING count(*) >= 2),
e AS (SELECT DISTINCT least(src_id, target_id) AS a, greatest(src_id, target_id) AS b FROM roles WHERE relationship = 'Ordered from'),
l AS (SELECT x.target_id, count(*) AS n FROM e JOIN a x ON x.src_id = e.a JOIN a y ON y.src_id = e.b AND y.target_id = x.target_id GROUP BY 1)
SELECT g.target_id, g.n AS n_entities, g.n * (g.n - 1) // 2 AS n_pairs, coalesce(l.n, 0) AS n_linked FROM g LEFT JOIN l ON l.target_id = g.target_id""",
)
def shared_address(spark, d):
    roles = w.roles(spark, d)
    at, bought = roles.where("relationship = 'Located at'"), roles.where("relationship = 'Ordered from'")
    return graph.shared_targets(at, edges=bought)


@query("roles_3plus", f"WITH {w.ROLES} SELECT src_id, count(DISTINCT target_id) AS n_targets, string_agg(DISTINCT lower(relationship), ',') AS relationships FROM roles WHERE lower(relationship) LIKE '%ordered%' GROUP BY 1 HAVING count(DISTINCT target_id) >= 3")
def roles_3plus(spark, d):
    return graph.many_targets(w.roles(spark, d), "ordered")


@query("isolated_entities", f"WITH {w.ENTITIES}, {w.ROLES} SELECT id, type FROM entities WHERE id NOT IN (SELECT src_id FROM roles WHERE relationship = 'Ordered from') AND id NOT IN (SELECT target_id FROM roles WHERE relationship = 'Ordered from')")
def isolated_entities(spark, d):
    return graph.isolated(w.entities(spark, d), w.roles(spark, d).where("relationship = 'Ordered from'")).select("id", "type")


@query("recurring_unlinked", f"WITH {w.ENTITIES}, {w.APPEARANCES}, {w.ROLES} SELECT a.id, count(DISTINCT sha256) AS n_documents FROM appearances a JOIN entities USING (id) WHERE a.id NOT IN (SELECT src_id FROM roles WHERE relationship = 'Ordered from') GROUP BY 1 HAVING count(DISTINCT sha256) >= 3")
def recurring_unlinked(spark, d):
    return graph.recurring_unlinked(w.entities(spark, d), w.appearances(spark, d), w.roles(spark, d).where("relationship = 'Ordered from'"))


@query(
    "co_occurrence",
    f"WITH {w.APPEARANCES} SELECT x.id AS a, y.id AS b, count(*) AS n_documents FROM appearances x JOIN appearances y ON x.sha256 = y.sha256 AND x.id < y.id GROUP BY 1, 2 HAVING count(*) >= 2",
)
def co_occurrence(spark, d):
    return graph.co_occurrence(w.appearances(spark, d))


@query("docs_without_entities", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def docs_without_entities(spark, d):
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("sha256"))
    return graph.documents_without_entities(docs, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sha256"))).select(F.col("sha256").alias("o_orderkey"))


@query("dangling_mentions", f"WITH {w.ENTITIES}, {w.APPEARANCES} SELECT DISTINCT id FROM appearances WHERE id NOT IN (SELECT id FROM entities WHERE ord % 10 <> 0)")
def dangling_mentions(spark, d):
    return graph.dangling(w.appearances(spark, d), w.entities(spark, d).where("ord % 10 <> 0"))


_FEATURES = "f AS (SELECT c_custkey AS id, unnest(['nation', 'segment', 'balance', 'tail']) AS kind, unnest([c_nationkey::VARCHAR, c_mktsegment, (floor(c_acctbal / 100)::BIGINT)::VARCHAR, (c_custkey // 7)::VARCHAR]) AS value FROM customer)"


@query(
    "clusters",
    f"""WITH RECURSIVE {_FEATURES}, k AS (SELECT x.id, x.kind || x.value || '|' || y.kind || y.value AS key FROM f x JOIN f y ON x.id = y.id AND x.kind < y.kind WHERE x.kind IN ('balance', 'nation') AND y.kind IN ('tail', 'segment') AND NOT (x.kind = 'nation' AND y.kind = 'segment')),
e AS (SELECT DISTINCT m.a, k.id AS b FROM k JOIN (SELECT key, min(id) AS a, count(*) AS n FROM k GROUP BY key HAVING count(*) > 1) m USING (key) WHERE k.id <> m.a), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, l) AS (SELECT a, a FROM s UNION SELECT s.b, r.l FROM r JOIN s ON s.a = r.id WHERE r.l < s.b), c AS (SELECT id, min(l) AS cluster_id FROM r GROUP BY id)
SELECT id, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS size FROM c QUALIFY count(*) OVER (PARTITION BY cluster_id) > 2""",
)
def clusters(spark, d):
    c = table(spark, d, "customer")
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    features = c.select(F.col("c_custkey").alias("id"), F.explode(F.array(pair("nation", F.col("c_nationkey")), pair("segment", F.col("c_mktsegment")), pair("balance", F.floor(F.col("c_acctbal") / 100)), pair("tail", F.floor(F.col("c_custkey") / 7)))).alias("p"))
    rows = features.select("id", "p.kind", "p.value")
    # nation and segment together are no evidence: everyone shares them with many
    return graph.feature_clusters(rows, Workspace(spark, "clusters"), useless=[("nation", "segment"), ("balance", "nation"), ("segment", "tail")])


@query("contradictions", "WITH f AS (SELECT o_custkey AS id, 'priority' AS kind, o_orderpriority AS value, o_orderkey AS sha256, ['high', 'medium', 'low', 'disputed'][(o_orderkey % 4 + 1)::INT] AS confidence FROM orders) SELECT id, kind, count(DISTINCT value) FILTER (WHERE confidence IN ('high', 'medium')) AS n_values, count(DISTINCT sha256) AS n_documents FROM f GROUP BY 1, 2 HAVING n_values > 1 AND n_documents >= 3")
def contradictions(spark, d):
    sure = F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "disputed"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    facts = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.lit("priority").alias("kind"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("sha256"), sure.alias("confidence"))
    return graph.contradictions(facts)


@query("disproportionate", "WITH r AS (SELECT o_custkey AS id, avg(o_totalprice) AS revenue FROM orders GROUP BY 1) SELECT o_orderkey, id, round(o_totalprice, 2) AS amount FROM orders JOIN r ON id = o_custkey WHERE o_totalprice > 1.5 * revenue")
def disproportionate(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("amount"))
    return graph.disproportionate(orders, orders.groupBy("id").agg(F.avg("amount").alias("revenue")), 1.5).select("o_orderkey", "id", F.round("amount", 2).alias("amount"))


@query("round_amounts", "SELECT o_orderkey, round(o_totalprice, 2) AS amount FROM orders WHERE round(o_totalprice)::BIGINT % 100 = 0")
def round_amounts(spark, d):
    return table(spark, d, "orders").where(graph.round_amount(F.col("o_totalprice"))).select("o_orderkey", F.round("o_totalprice", 2).alias("amount"))


@query(
    "rapid_transfers",
    """WITH e AS (SELECT o_custkey, o_orderdate::DATE AS first_date, datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS day FROM orders),
c AS (SELECT *, count(*) OVER (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN CURRENT ROW AND 364 FOLLOWING) AS n FROM e)
SELECT o_custkey, arg_max(first_date, (n, -day)) AS first_date, max(n) AS n FROM c WHERE n >= 3 GROUP BY 1""",
)
def rapid_transfers(spark, d):
    return graph.rapid(table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("o_orderdate")), "o_custkey", "o_orderdate")


@query("formation_window", "WITH f AS (SELECT o_custkey AS id, min(o_orderdate)::DATE AS formed FROM orders GROUP BY 1) SELECT id, o_orderkey, abs(datediff('day', formed, o_orderdate::DATE))::INT AS days FROM f JOIN orders ON o_custkey = id WHERE o_totalprice > 200000 AND abs(datediff('day', formed, o_orderdate::DATE)) <= 30")
def formation_window(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    formed = orders.groupBy("id").agg(F.min("day").alias("formed"))
    near = graph.within_days(formed, orders.where("o_totalprice > 200000").select("id", "o_orderkey", "day"), 30, "formed", "day", ["id"])
    return near.select("id", "o_orderkey", F.abs(F.datediff("day", "formed")).alias("days"))


@query("dormant", "SELECT o_custkey, min(o_orderdate)::DATE AS first_seen, max(o_orderdate)::DATE AS last_seen FROM orders GROUP BY 1 HAVING first_seen < DATE '1996-01-01' AND last_seen >= DATE '2001-01-01'")
def dormant(spark, d):
    return graph.dormant(table(spark, d, "orders"), "o_custkey", "o_orderdate", "1996-01-01", "2001-01-01")


@query("early_appearance", f"WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders), f AS (SELECT o_custkey, day AS first_seen FROM s WHERE k = 1) SELECT s.o_orderkey, datediff('day', day, first_seen)::INT AS days FROM s JOIN f USING (o_custkey) WHERE datediff('day', day, first_seen) > 365")
def early_appearance(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    return graph.early(rows, "o_custkey", "o_orderkey", "day")


# ---- timeline


@query("timeline_dedup", f"WITH {w.EVENTS} SELECT entity_id, date, event, ord FROM events QUALIFY row_number() OVER (PARTITION BY entity_id, {w.EVENT_KEY} ORDER BY ord) = 1")
def timeline_dedup(spark, d):
    return extraction.dedup_events(w.events(spark, d)).select("entity_id", "date", "event", "ord")


_STAGED = f"staged AS (SELECT sha256, date, {w.EVENT_KEY} AS key, arg_min(event, ord) AS event, arg_min(page, ord) AS page, CASE WHEN arg_min(confidence, ord) = '' THEN 'high' ELSE arg_min(confidence, ord) END AS confidence, list(DISTINCT entity_id) AS ids FROM events GROUP BY 1, 2, 3)"


@query("timeline_staging", f"WITH {w.EVENTS}, {_STAGED} SELECT sha256, date, key, event, page, confidence, len(ids)::INT AS n_entities FROM staged")
def timeline_staging(spark, d):
    return timeline.stage(w.events(spark, d)).withColumn("n_entities", F.size("entity_ids")).drop("entity_ids")


@query("collisions", f"WITH {w.EVENTS}, {_STAGED} SELECT date, count(*) AS n_raw FROM staged WHERE sha256 >= 'D3' AND date IN (SELECT date FROM staged WHERE sha256 < 'D3') GROUP BY 1")
def collisions(spark, d):
    staged = timeline.stage(w.events(spark, d))
    return timeline.collisions(staged.where("sha256 >= 'D3'"), staged.where("sha256 < 'D3'"))


@query("promoted_dates", f"WITH {w.EVENTS}, {_STAGED} SELECT date, count(*) AS n FROM staged WHERE sha256 < 'D3' OR date NOT IN (SELECT date FROM staged WHERE sha256 < 'D3') GROUP BY 1")
def promoted_dates(spark, d):
    staged = timeline.stage(w.events(spark, d))
    return timeline.promote(staged.where("sha256 >= 'D3'"), staged.where("sha256 < 'D3'")).groupBy("date").agg(F.count("*").alias("n"))


@query("settled_events", f"WITH {w.EVENTS} SELECT date, event FROM events QUALIFY row_number() OVER (PARTITION BY date, {w.EVENT_KEY} ORDER BY length(event) DESC, event) = 1")
def settled_events(spark, d):
    return timeline.settle(w.events(spark, d)).select("date", "event")


@query("timeline_by_year", f"WITH {w.EVENTS} SELECT substr(date, 1, 4) AS year, row_number() OVER (PARTITION BY substr(date, 1, 4) ORDER BY {w.DATE_KEY}, ord)::INT AS place, date, ord FROM events")
def timeline_by_year(spark, d):
    return timeline.by_year(w.events(spark, d)).select("year", "place", "date", "ord")


_SHOWN = f"{w.DATE_KEY} AS k, substr(date, 1, 4) AS year, CASE length(date) WHEN 10 THEN strftime(date::DATE, '%d %b %Y') WHEN 7 THEN strftime((date || '-01')::DATE, '%B %Y') ELSE date END AS shown, CASE WHEN confidence IN ('', 'high') THEN '' ELSE ' *(' || confidence || ' confidence)*' END AS note"


@query(
    "timeline_rendered",
    f"""WITH {w.EVENTS}, e AS (SELECT *, {_SHOWN} FROM events)
SELECT entity_id, year, '## ' || year || chr(10) || chr(10) || string_agg('- **' || shown || '** — ' || event || note, chr(10) ORDER BY k, ord) AS body FROM e GROUP BY entity_id, year""",
)
def timeline_rendered(spark, d):
    return timeline.render(w.events(spark, d))


@query(
    "timeline_lines",
    f"""WITH {w.EVENTS}, {w.ENTITIES}, e AS (SELECT *, {_SHOWN} FROM events)
SELECT year, row_number() OVER (PARTITION BY year ORDER BY k, e.ord)::INT AS place, '- **' || shown || '** — [[entities/' || lower(type) || '/' || id || '|' || name || ']] — ' || event || note AS line FROM e JOIN entities ON id = entity_id""",
)
def timeline_lines(spark, d):
    return timeline.lines(w.events(spark, d), w.entities(spark, d))


@query(
    "bursts",
    f"""WITH {w.EVENTS}, e AS (SELECT date::DATE AS day, entity_id FROM events WHERE length(date) = 10), d AS (SELECT DISTINCT day FROM e)
SELECT d.day AS window_start, count(DISTINCT entity_id) AS n_entities, count(*) AS n_events FROM d JOIN e ON e.day >= d.day AND e.day < d.day + 7 GROUP BY 1 HAVING count(DISTINCT entity_id) >= 3""",
)
def bursts(spark, d):
    return timeline.bursts(w.events(spark, d))


@query("events_between", f"WITH {w.EVENTS} SELECT entity_id, date, ord FROM events WHERE {w.DATE_KEY} >= '1996-03-00' AND {w.DATE_KEY} <= '1996-05~'")
def events_between(spark, d):
    return timeline.between(w.events(spark, d), "1996-03", "1996-05").select("entity_id", "date", "ord")


# ---- queue, sessions, audit


@query("queue_batches", "SELECT document_type, sha256, (n - 1) // 5 AS batch, (n - 1) % 5 AS place FROM (SELECT *, row_number() OVER (ORDER BY document_type NULLS LAST, sha256) AS n FROM (SELECT CASE WHEN doc_id % 9 <> 0 THEN lang END AS document_type, doc_id::VARCHAR AS sha256 FROM documents))")
def queue_batches(spark, d):
    return lifecycle.batches(table(spark, d, "documents").select(F.when(F.col("doc_id") % 9 != 0, F.col("lang")).alias("document_type"), F.col("doc_id").cast("string").alias("sha256")))


@query("adaptive_median", "SELECT source, list_sort(list(n_chars))[(count(*) // 2 + 1)::INT] AS median FROM documents GROUP BY source")
def adaptive_median(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(lifecycle.upper_median("n_chars").cast("long").alias("median"))


@query("session_usage", "SELECT 'conv' || conv_id AS agent, sum(length(text))::BIGINT AS tokens, round(sum(length(text) * CASE WHEN role = 'assistant' THEN 15.0 WHEN role = 'user' THEN 3.0 ELSE 0 END / 1e6), 9) AS cost FROM conversations GROUP BY 1")
def session_usage(spark, d):
    usage = table(spark, d, "conversations").select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("agent"), F.lit("m").alias("model"), F.col("role").alias("kind"), F.length("text").alias("tokens"))
    rates = spark.createDataFrame([("m", "assistant", 15.0), ("m", "user", 3.0)], "model string, kind string, usd double")
    return lifecycle.session_cost(usage, rates).withColumn("cost", F.round("cost", 9))


@query("log_tail", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 20")
def log_tail(spark, d):
    return lifecycle.tail(table(spark, d, "events").select("event_id", "event_type"), 20, "event_id")


@query("latest_event", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_event(spark, d):
    return lifecycle.latest(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("windowed_events", "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    out = watch.windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("missing_fields", "SELECT doc_id, field FROM (SELECT doc_id, 'toxic' AS field FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL UNION ALL SELECT doc_id, 'quality' FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL)")
def missing_fields(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return audit.missing_fields(rows, "doc_id", ["lang", "source", "quality", "toxic"])


@query("notes_audit", f"WITH {w.ENTITIES}, r AS (SELECT id FROM entities WHERE ord % 5 <> 0), n AS (SELECT id FROM entities WHERE ord % 7 <> 0) SELECT 'CRITICAL' AS severity, 'entity note missing' AS check, id AS subject FROM r WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT 'WARNING', 'entity note orphaned', id FROM n WHERE id NOT IN (SELECT id FROM r)")
def notes_audit(spark, d):
    e = w.entities(spark, d).withColumnRenamed("id", "note_path")
    return audit.notes_against_registry(e.where("ord % 5 <> 0"), e.where("ord % 7 <> 0"), "entity")


@query("manifest_drift", f"WITH {w.ENTITIES}, m AS (SELECT id, CASE WHEN ord % 11 = 0 THEN name || 'x' ELSE name END AS name FROM entities WHERE ord % 13 <> 0 UNION ALL SELECT 'X' || n_nationkey, 'x' FROM nation) SELECT coalesce(e.id, m.id) AS id, CASE WHEN m.id IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'orphan' ELSE 'name' END AS drift FROM entities e FULL JOIN m ON e.id = m.id WHERE m.id IS NULL OR e.id IS NULL OR e.name <> m.name")
def manifest_drift(spark, d):
    e = w.entities(spark, d).withColumn("aliases", F.array("name"))
    changed = e.where("ord % 13 <> 0").withColumn("name", F.when(F.col("ord") % 11 == 0, F.concat("name", F.lit("x"))).otherwise(F.col("name")))
    extra = table(spark, d, "nation").select(F.concat(F.lit("X"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("x").alias("name"), F.lit("Address").alias("type"), F.lit(0).cast("long").alias("ord"), F.array(F.lit("x")).alias("aliases"))
    return audit.manifest_drift(e, changed.unionByName(extra))


@query("audit_report", f"WITH {w.ENTITIES}, {w.ROLES}, {w.APPEARANCES} SELECT 'WARNING' AS severity, 'isolated entity' AS check, count(*) AS n FROM entities WHERE id NOT IN (SELECT src_id FROM roles) AND id NOT IN (SELECT target_id FROM roles) GROUP BY 1, 2 HAVING count(*) > 0 UNION ALL SELECT 'INFO', 'entity without document', count(*) FROM entities WHERE id NOT IN (SELECT id FROM appearances) GROUP BY 1, 2 HAVING count(*) > 0")
def audit_report(spark, d):
    e = w.entities(spark, d)
    return audit.report([audit.finding(graph.isolated(e, w.roles(spark, d)), "WARNING", "isolated entity", F.col("id")), audit.finding(e.join(w.appearances(spark, d), "id", "left_anti"), "INFO", "entity without document", F.col("id"))])


@query("registry_counts", f"WITH {w.ENTITIES} SELECT what, stated, actual FROM (SELECT 'documents' AS what, 7::BIGINT AS stated, (SELECT count(*) FROM orders) AS actual UNION ALL SELECT 'entities', (SELECT count(*) FROM entities), (SELECT count(*) FROM entities)) WHERE stated <> actual")
def registry_counts(spark, d):
    e = w.entities(spark, d)
    counts = e.agg(F.lit(7).alias("document_count"), F.count("*").alias("entity_count"))
    return audit.count_mismatch(counts, table(spark, d, "orders"), e)


@query("chunk_plan", "SELECT doc_id, unnest(range(0, n, 40))::INT AS start, least(unnest(range(0, n, 40)) + 40, n)::INT AS stop FROM (SELECT doc_id, len(string_split(text, chr(10)))::INT AS n FROM documents)")
def chunk_plan(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n"))
    return docs.select("doc_id", F.explode(lifecycle.chunk_plan(F.col("n"))).alias("c")).select("doc_id", "c.start", "c.stop")


@query("entity_merge", f"WITH {w.EVENTS} SELECT sha256, entity_id AS id, arg_max(event, (length(event), -s, -ord)) AS name, arg_min(confidence, (s, ord)) FILTER (WHERE confidence <> '') AS type, arg_min(date, (s, ord)) AS summary, string_agg(a, chr(10) || chr(10) ORDER BY s, ord) AS analysis FROM (SELECT *, ord % 4 AS s, 'said in ' || ord || '.' AS a FROM events) GROUP BY 1, 2")
def entity_merge(spark, d):
    e = w.events(spark, d)
    rows = e.select("sha256", (F.col("ord") % 4).cast("int").alias("section"), "ord", F.col("entity_id").alias("id"), F.col("event").alias("name"), F.col("confidence").alias("type"), F.col("date").alias("summary"), F.concat(F.lit("said in "), F.col("ord").cast("string"), F.lit(".")).alias("analysis"))
    return extraction.merge_entities(rows)


@query("entity_notes", f"WITH {w.ENTITIES}, {w.ROLES}, r AS (SELECT src_id, string_agg('- ' || relationship || ': [[' || target_id || '|' || name || ']]', chr(10) ORDER BY target_id) AS t FROM roles JOIN entities ON id = target_id GROUP BY 1) SELECT id, md5('---' || chr(10) || 'id: \"' || id || '\"' || chr(10) || 'type: \"' || type || '\"' || chr(10) || 'name: \"' || name || '\"' || chr(10) || 'date_first_seen: \"2024-01-01\"' || chr(10) || 'date_last_updated: \"2024-01-01\"' || chr(10) || '---' || chr(10) || chr(10) || '# ' || name || chr(10) || coalesce(chr(10) || '## Relationships' || chr(10) || chr(10) || t || chr(10), '') || chr(10) || '## Notes' || chr(10) || chr(10)) AS note_md5 FROM entities LEFT JOIN r ON src_id = id")
def entity_notes(spark, d):
    e = w.entities(spark, d)
    roles = w.roles(spark, d).join(e.select(F.col("id").alias("target_id"), "name"), "target_id")
    lines = roles.select("src_id", F.col("target_id").alias("ord"), render.role_line(F.col("relationship"), F.col("target_id"), F.col("name"), F.lit(None), F.lit(None), F.lit(None)).alias("line"))
    none = spark.createDataFrame([], "entity_id string, ord long, line string")
    rows = e.select("id", "name", "type", F.col("id").alias("note_path"), F.lit(None).cast("string").alias("summary"), F.lit("2024-01-01").alias("date_first_seen"), F.lit("2024-01-01").alias("date_last_updated"))
    notes = render.entity_notes(rows, none, lines, none, spark.createDataFrame([], "id string, body string"))
    return notes.select("id", F.md5("body").alias("note_md5"))



# ---- questions, red flags, briefing


@query("ask_lookup", f"WITH {w.ENTITIES} SELECT id, type FROM entities WHERE lower(name) = 'supplier#000000003' OR lower(replace(name, '#', '')) = 'supplier000000003'")
def ask_lookup(spark, d):
    return ask.lookup(w.entities(spark, d), "SUPPLIER#000000003").select("id", "type")


@query("ask_roles", f"WITH {w.ROLES} SELECT src_id, relationship, target_id FROM roles WHERE (src_id = 'S3' OR target_id = 'S3') AND lower(relationship) = 'ordered from'")
def ask_roles(spark, d):
    return ask.roles_of(w.roles(spark, d), "S3", "ordered From")


@query("ask_sharing", f"WITH {w.ROLES} SELECT DISTINCT src_id FROM roles WHERE target_id = 'N3' AND relationship = 'Located at'")
def ask_sharing(spark, d):
    return ask.sharing(w.roles(spark, d), "N3", "located at")


@query("grep", "SELECT doc_id, instr(lower(text), 'token')::INT AS place, substr(text, greatest(instr(lower(text), 'token') - 40, 1)::BIGINT, 85) AS context FROM documents WHERE instr(lower(text), 'token') > 0")
def grep(spark, d):
    return ask.grep(table(spark, d, "documents"), "Token")


@query("just_below", "SELECT o_orderkey FROM orders WHERE o_totalprice < 100000 AND o_totalprice >= 95000")
def just_below(spark, d):
    return table(spark, d, "orders").where(flags.just_below(F.col("o_totalprice"), 100_000.0)).select("o_orderkey")


@query("cost_ratios", "SELECT l_orderkey, count(*) FILTER (WHERE l_discount / l_tax > 2) AS high, count(*) FILTER (WHERE l_discount / l_tax < 0.5) AS low FROM (SELECT l_orderkey, l_discount, nullif(l_tax, 0) AS l_tax FROM lineitem) GROUP BY 1")
def cost_ratios(spark, d):
    part, whole = F.col("l_discount"), F.col("l_tax")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(flags.ratio_above(part, whole, 2.0)).alias("high"), F.count_if(flags.ratio_below(part, whole, 0.5)).alias("low"))


@query("short_tenure", "SELECT o_custkey FROM (SELECT o_custkey, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders GROUP BY 1) WHERE b < a + INTERVAL 12 MONTH")
def short_tenure(spark, d):
    span = table(spark, d, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    return span.where(flags.short_tenure(F.col("a"), F.col("b"))).select("o_custkey")


@query("cumulative_small", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT o_custkey, o_totalprice, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_totalprice <= 0.5 * m GROUP BY 1 HAVING sum(o_totalprice) > 1.0 * max(m)")
def cumulative_small(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_totalprice")
    base = orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("base"))
    return flags.cumulative_small(orders.join(base, "o_custkey"), "o_custkey", "o_totalprice", "base", 0.5, 1.0).withColumn("total", F.round("total", 2))


@query("briefing", f"WITH {w.ENTITIES} SELECT 'new_entities' AS part, count(*) FILTER (WHERE ord % 4 = 0) AS n FROM entities UNION ALL SELECT 'updated_entities', count(*) FILTER (WHERE ord % 4 <> 0) FROM entities UNION ALL SELECT 'exact_duplicates', (SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY text HAVING count(*) > 1))")
def briefing(spark, d):
    e = w.entities(spark, d)
    new, updated = extraction.split_new(e, e.where("ord % 4 <> 0"))
    return lifecycle.briefing(new_entities=new, updated_entities=updated, exact_duplicates=similarity.exact_groups(table(spark, d, "documents")))


@query("storage", "SELECT source, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY source")
def storage(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


def _extractions(spark, d, buyer=None, place=None):
    """An extraction in JSON for each order: its buyer, under an id of the order's own, and the buyer's nation; or both under given ids."""
    buyers = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = table(spark, d, "orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    own, nation = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit("-c")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    own, nation = F.lit(buyer) if buyer else own, F.lit(place) if place else nation
    role = F.struct(F.lit("Resides in").alias("relationship"), nation.alias("target_id"), F.lit("high").alias("confidence"))
    none = F.array().cast("array<struct<relationship:string,target_id:string,confidence:string>>")
    who = F.struct(own.alias("id"), F.col("c_name").alias("name"), F.lit("Person").alias("type"), F.array(role).alias("roles"))
    where = F.struct(nation.alias("id"), F.col("n_name").alias("name"), F.lit("Address").alias("type"), none.alias("roles"))
    key = F.col("o_orderkey").cast("string")
    document = F.struct(F.concat(F.lit("D"), key).alias("sha256"), F.concat(key, F.lit(".pdf")).alias("filename"), F.col("o_orderpriority").alias("document_type"))
    whole = F.struct(document.alias("document"), F.array(who, where).alias("entities"), own.alias("morgue_entity_id"), F.lit("Order").alias("morgue_document_type"))
    return rows.select(F.col("o_orderkey").alias("arrival"), F.to_json(whole).alias("json"))


_BUYERS = "b AS (SELECT 'o' || min(o_orderkey) || '-c' AS id, c_name AS name, c_custkey, any_value(c_nationkey) AS nk FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_name, c_custkey)"


@query("ingest_entities", f"WITH {_BUYERS} SELECT id, name, 'Person' AS type FROM b UNION ALL SELECT 'n' || n_nationkey, n_name, 'Address' FROM nation WHERE n_nationkey IN (SELECT nk FROM b)")
def ingest_entities(spark, d):
    return ingest.post_flight(_extractions(spark, d), ingest.empty(spark), "2024-01-01T00:00:00Z")["entities"].select("id", "name", "type")


@query("ingest_roles", f"WITH {_BUYERS} SELECT id AS src_id, 'Resides in' AS relationship, 'n' || nk AS target_id, false AS is_reverse FROM b UNION ALL SELECT 'n' || nk, 'Resides in', id, true FROM b")
def ingest_roles(spark, d):
    return ingest.post_flight(_extractions(spark, d), ingest.empty(spark), "2024-01-01T00:00:00Z")["roles"].select("src_id", "relationship", "target_id", "is_reverse")


_DAMAGE = (
    ('"morgue_document_type":"Order"', '"morgue_document_type":""', "morgue_document_type is missing"),
    ('"entities":[', '"entities":{"a":[', "no JSON"),
    ('"confidence":"high"', '"confidence":"sure"', None),
    ('"type":"Person"', '"type":" "', "entities[0]: type is missing"),
    ('"roles":[]', '"roles":["x"]', "entities[1]: a role is no object"),
    ('"document":{', '"document":[],"was":{', "document is no object"),
)


@query("ingest_rejected", "SELECT o_orderkey AS arrival, [" + ", ".join(f"'{m}'" if m else "NULL" for *_, m in _DAMAGE) + "][(o_orderkey % 10 + 1)::INT] AS error FROM orders WHERE o_orderkey % 10 IN (" + ", ".join(str(k) for k, (*_, m) in enumerate(_DAMAGE) if m) + ")")
def ingest_rejected(spark, d):
    raw, json = _extractions(spark, d), F.col("json")
    for k, (old, new, _) in enumerate(_DAMAGE):
        json = F.when(F.col("arrival") % 10 == k, F.replace("json", F.lit(old), F.lit(new))).otherwise(json)
    return ingest.validate(raw.withColumn("json", json))[1].select("arrival", F.array_join("errors", "; ").alias("error"))


@query(
    "ingest_local_ids",
    "SELECT 'C' || o_custkey AS id, 'D' || o_orderkey AS sha256 FROM orders UNION SELECT 'N' || c_nationkey, 'D' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey",
)
def ingest_local_ids(spark, d):
    """All documents call their buyer ``buyer`` and the place ``place``; the registry knows them by name."""
    raw = _extractions(spark, d, "buyer", "place")
    known = w.entities(spark, d).where("type <> 'Company'").select("id", "name", "type", F.struct(F.lit("2023").alias("batch"), F.col("ord").alias("arrival"), F.lit(0).alias("at"), F.lit(0).alias("k")).alias("ord"), F.lit("2023-01-01").alias("date_first_seen"), F.lit("2023-01-01").alias("date_last_updated"))
    return ingest.post_flight(raw, ingest.empty(spark) | {"entities": known}, "2024-01-01T00:00:00Z")["appearances"]
