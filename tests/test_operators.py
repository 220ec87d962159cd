import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom import schemas
from recordloom.functions import fingerprint as fp
from recordloom.operators import ask, audit, extraction, flags, graph, lifecycle, render, sections, similarity, timeline, vectors
from recordloom.operators.components import components
from recordloom.plans import catalog
from recordloom.session import Workspace, spread


def test_page_ranges_cover_all_pages(spark):
    cases = [(n, size, over) for n in (0, 1, 4, 5, 13) for size in (1, 3, 20) for over in (0, 1, 5)]
    df = spark.createDataFrame(cases, "n int, size int, over int")
    for r in df.withColumn("r", sections.page_ranges(F.col("n"), F.col("size"), F.col("over"))).collect():
        over, at, want = min(max(r.over, 0), r.size - 1), 1, []
        while r.n:
            want.append((at, min(at + r.size - 1, r.n)))
            if want[-1][1] == r.n:
                break
            at = want[-1][1] - over + 1
        assert [tuple(x) for x in r.r] == want


def test_section_plan_by_page_and_by_character(spark):
    pages = [{"page": i, "markdown": "x" * 200} for i in range(1, 7)]
    df = spark.createDataFrame([("a", pages, 6), ("b", [{"page": 1, "markdown": "y" * 1000}], 1), ("c", [{"page": 1, "markdown": "z"}], 0)], "key string, pages array<struct<page:int,markdown:string>>, page_count int")
    got = {}
    for r in sections.plan(df, 100, 200, 0).collect():
        got.setdefault(r.key, []).append((r.sectioned, r.paginated, r.section, r.first, r.last))
    assert sorted(got["a"]) == [(True, True, 0, 1, 4), (True, True, 1, 5, 6)]
    assert sorted(got["b"]) == [(True, False, 0, 0, 800), (True, False, 1, 800, 1000)]
    assert got["c"] == [(False, False, None, None, None)]


def test_section_text_fills_missing_pages(spark):
    df = spark.createDataFrame([([{"page": 1, "markdown": "one"}, {"page": 3, "markdown": "three"}],)], "p array<struct<page:int,markdown:string>>")
    t = df.select(sections.section_text(F.col("p"), F.lit(1), F.lit(3)).alias("t")).first()["t"]
    assert t == "<!-- PAGE 1 -->\n\none\n\n---\n\n<!-- PAGE 2 -->\n\n\n\n---\n\n<!-- PAGE 3 -->\n\nthree"


GOOD = {"document": {"sha256": "s", "filename": "f", "key_facts": [{"fact": "x", "confidence": "high"}]}, "entities": [{"id": "a", "name": "A", "type": "Person", "roles": [{"relationship": "r"}], "timeline_events": [{"confidence": ""}]}], "morgue_entity_id": "a", "morgue_document_type": "t"}


@pytest.mark.parametrize(
    "change, part",
    [
        ({}, None),
        ({"document": []}, "document is no object"),
        ({"document": {"filename": "f"}}, "sha256"),
        ({"document": {"sha256": "s", "filename": "f", "key_facts": [{"confidence": "sure"}]}}, "confidence sure"),
        ({"entities": {}}, "entities is no list"),
        ({"entities": [{"id": "a", "name": "", "type": "T"}]}, "name is missing"),
        ({"entities": [{"id": "a", "name": "A", "type": "T", "roles": ["text"]}]}, "a role is no object"),
        ({"entities": [{"id": "a", "name": "A", "type": "T", "timeline_events": [{"confidence": "wild"}]}]}, "confidence wild"),
        ({"morgue_entity_id": " "}, "morgue_entity_id"),
    ],
)
def test_validation(spark, change, part):
    got = spark.createDataFrame([(json.dumps(GOOD | change),)], "raw string").select(extraction.errors(F.col("raw")).alias("e")).first()["e"]
    assert got == [] if part is None else any(part in x for x in got), got


def test_validation_of_no_json(spark):
    assert spark.createDataFrame([("{broken",)], "raw string").select(extraction.errors(F.col("raw")).alias("e")).first()["e"] == ["no JSON"]


def test_match_ids_move_roles(spark):
    row = {"document": {"sha256": "s"}, "entities": [{"id": "x", "match_id": "known", "name": "X"}, {"id": "y", "match_id": "", "name": "Y", "roles": [{"relationship": "of", "target_id": "x"}]}]}
    df = spark.read.schema(schemas.EXTRACTION).json(spark.sparkContext.parallelize([json.dumps(row)]))
    out = extraction.apply_match_ids(df).first()
    assert [e.id for e in out.entities] == ["known", "y"] and out.entities[1].roles[0].target_id == "known"


def test_drift_is_a_fold(spark):
    rows = [("s", 0, 0, "tilva-port", "Tilva Port", ["TILVA"]), ("s", 1, 0, "tilva-port-2", "TILVA  PORT", None), ("s", 1, 1, "other", "Other", []), ("s", 2, 0, "third", "Third", ["tilva"]), ("t", 0, 0, "tilva-port-2", "Tilva Port", None)]
    df = spark.createDataFrame(rows, "sha256 string, section int, ord int, id string, name string, aliases array<string>")
    got = {(r.sha256, r.id): r.final_id for r in extraction.drift(df).collect()}
    assert got == {("s", "tilva-port"): "tilva-port", ("s", "tilva-port-2"): "tilva-port", ("s", "other"): "other", ("s", "third"): "tilva-port", ("t", "tilva-port-2"): "tilva-port-2"}


def test_merge_of_sections(spark):
    rows = [("s", 0, 0, "a", "Ann", None, "", "first"), ("s", 1, 0, "a", "Anna", "Person", "sum", "first"), ("s", 2, 0, "a", "Anne", "X", "later", "second")]
    df = spark.createDataFrame(rows, "sha256 string, section int, ord int, id string, name string, type string, summary string, analysis string")
    r = extraction.merge_entities(df).first()
    assert (r.name, r.type, r.summary, r.analysis) == ("Anna", "Person", "sum", "first\n\nsecond")


def _sections(spark, rows):
    return spark.createDataFrame([(sha, k, json.dumps(x) if isinstance(x, dict) else x) for sha, k, x in rows], "sha256 string, section int, raw string").select("sha256", "section", F.from_json("raw", schemas.struct("struct<" + ",".join(f"{n}:{t}" for n, t in SECTION) + ">")).alias("x")).select("sha256", "section", "x.*")


SECTION = [("document", schemas.DOCUMENT), ("entities", f"array<{schemas.ENTITY}>"), ("morgue_entity_id", "string"), ("morgue_document_type", "string")]


def test_sections_become_one_extraction(spark):
    event = lambda date, event: {"date": date, "event": event}
    role = lambda relationship, target: {"relationship": relationship, "target_id": target}
    first = {
        "document": {}, "morgue_entity_id": "",
        "entities": [
            {"id": "quay", "name": "Orla Quay", "aliases": ["OQ"], "timeline_events": [event("2031", "Opened")], "roles": [role("Owner of", "mill")]},
            {"id": "", "name": "Nobody"}, {"id": "mill", "name": "Mill", "type": "Company", "analysis": "old"},
        ],
    }
    second = {
        "document": {"sha256": "s", "title": "T", "key_facts": [{"fact": "One"}, {"fact": "one"}, {"fact": ""}]}, "morgue_entity_id": "mill", "morgue_document_type": "deed",
        "entities": [
            {"id": "quay-2", "name": "ORLA  QUAY", "type": "Person", "summary": "sum", "timeline_events": [event("2031", "OPENED"), event("2032", "Opened")], "roles": [role("owner OF", "mill"), role("Owner of", "barge")]},
            {"id": "mill", "name": "The Mill", "analysis": "new"},
        ],
    }
    third = {"document": {"sha256": "s", "title": "later", "key_facts": [{"fact": "Two", "page": 3}]}, "entities": None, "morgue_document_type": "lease"}
    got = {r.sha256: r for r in extraction.merge_sections(_sections(spark, [("s", 2, third), ("s", 0, first), ("s", 1, second), ("t", 0, {"morgue_entity_id": "x"})])).collect()}
    r = got["s"]
    assert (r.document.title, [f.fact for f in r.document.key_facts], r.morgue_entity_id, r.morgue_document_type) == ("T", ["One", "Two"], "mill", "deed")
    quay, mill = r.entities
    assert (quay.id, quay.name, quay.type, quay.summary, quay.aliases) == ("quay", "ORLA  QUAY", "Person", "sum", ["OQ", "Orla Quay"])
    assert [(e.date, e.event) for e in quay.timeline_events] == [("2031", "Opened"), ("2032", "Opened")]
    assert [(x.relationship, x.target_id) for x in quay.roles] == [("Owner of", "mill"), ("Owner of", "barge")]
    assert (mill.name, mill.type, mill.analysis, mill.aliases, mill.roles) == ("The Mill", "Company", "old\n\nnew", ["Mill"], [])
    assert (got["t"].document, got["t"].entities, got["t"].morgue_entity_id) == (None, [], "x")
    assert extraction.merge_sections(_sections(spark, [])).count() == 0


def test_what_cannot_be_merged(spark):
    wanted = spark.createDataFrame([("s",), ("t",), ("u",)], "sha256 string")
    got = extraction.section_errors(wanted, _sections(spark, [("s", 0, {"entities": []}), ("t", 0, {"entities": []}), ("t", 4, None)]))
    assert sorted((r.sha256, r.error) for r in got.collect()) == [("t", "no JSON: section 4"), ("u", "no section")]


def test_facts_and_aliases(spark):
    facts = spark.createDataFrame([("s", 0, "A" * 130), ("s", 1, "a" * 125), ("s", 2, ""), ("s", 3, "b")], "sha256 string, ord int, fact string")
    assert sorted(r.ord for r in extraction.dedup_facts(facts).collect()) == [0, 3]
    names = spark.createDataFrame([("i", "Tilva", "TILVA"), ("i", "Tilva", "The Co"), ("i", "Tilva", "the co"), ("i", "Tilva", None)], "id string, name string, alias string")
    assert extraction.final_aliases(names).first().aliases == ["The Co"]


def test_reconciliation_keeps_types_apart(spark):
    registry = spark.createDataFrame([("e1", "Ernst & Young", "Company", 1), ("e2", "Ernst and Young", "Company", 2), ("p", "Alex Doe", "Person", 3)], "id string, name string, type string, ord int")
    aliases = spark.createDataFrame([("p", "A. Doe")], "id string, alias string")
    new = spark.createDataFrame([("n1", "ernst and young", "Company", 1), ("n2", "a doe", "Person", 2), ("n3", "Alex Doe", "Company", 3), ("n4", "alex doe", "Company", 4), ("e2", "Alex Doe", "Person", 5)], "id string, name string, type string, ord int")
    got = {r.id: r.final_id for r in graph.reconcile(new, registry, aliases).collect()}
    assert got == {"n1": "e1", "n2": "p", "n3": "n3", "n4": "n3", "e2": "e2"}


def test_roles_upsert_and_reverse(spark):
    ddl = "src_id string, relationship string, target_id string, ord int"
    old, new = spark.createDataFrame([("a", "Director of", "c", 0)], ddl), spark.createDataFrame([("a", "director OF", "c", 0), ("a", "Owner of", "c", 1), ("a", "Owner of", "zz", 2)], ddl)
    both = graph.upsert_roles(old, new)
    assert sorted((r.relationship, r.target_id) for r in both.collect()) == [("Director of", "c"), ("Owner of", "c"), ("Owner of", "zz")]
    entities = spark.createDataFrame([("a",), ("c",)], "id string")
    back = graph.reverse_roles(both, entities)
    assert sorted((r.src_id, r.relationship, r.target_id) for r in back.collect()) == [("c", "Director of", "a"), ("c", "Owner of", "a")]
    done = both.select("src_id", "relationship", "target_id").unionByName(back.select("src_id", "relationship", "target_id"))
    assert graph.reverse_roles(done, entities).count() == 0


def test_entity_upsert(spark):
    old = spark.createDataFrame([("a", "Ann", "2020-01-01", "2020-01-01")], "id string, name string, date_first_seen string, date_last_updated string")
    new = spark.createDataFrame([("a", "Other"), ("b", "Bob")], "id string, name string")
    got = {r.id: (r.name, r.date_first_seen, r.date_last_updated) for r in graph.upsert_entities(old, new, "2024-05-05").collect()}
    assert got == {"a": ("Ann", "2020-01-01", "2024-05-05"), "b": ("Bob", "2024-05-05", "2024-05-05")}


def test_components_of_random_edges(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "cc")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_staging_joins_entities(spark):
    rows = [("s", "a", " 2020 ", "Founded", None, "", 0), ("s", "b", "2020", "FOUNDED", 2, "low", 1), ("s", "c", "2020", "", 1, "low", 2), ("t", "a", "2020", "Founded", 1, "low", 0)]
    df = spark.createDataFrame(rows, "sha256 string, entity_id string, date string, event string, page int, confidence string, ord int")
    got = {(r.sha256, r.key): (r.event, r.confidence, r.entity_ids) for r in timeline.stage(df).collect()}
    assert got == {("s", "2020|founded"): ("Founded", "high", ["a", "b"]), ("t", "2020|founded"): ("Founded", "low", ["a"])}


def test_collisions_leave_out_consumed(spark):
    raw = spark.createDataFrame([("s", "2020"), ("t", "2020"), ("t", "2021")], "sha256 string, date string")
    canonical = spark.createDataFrame([("s", "2020")], "sha256 string, date string")
    assert [(r.date, r.n_raw) for r in timeline.collisions(raw, canonical, canonical).collect()] == [("2020", 1)]


def test_timelines_hold_every_entity(spark):
    rows = [("a", "2020-03", "Moved", "low", 1), ("b", "2020", "Founded", "high", 2), ("c", "2021-01-02", "Left", None, 3), ("a", "2020-03-01", "Paid", "", 4)]
    events = spark.createDataFrame(rows, "entity_id string, date string, event string, confidence string, ord int")
    got = {(r.entity_id, r.year): r.body for r in timeline.render(events).collect()}
    assert got == {("a", "2020"): "## 2020\n\n- **March 2020** — Moved *(low confidence)*\n- **01 Mar 2020** — Paid", ("b", "2020"): "## 2020\n\n- **2020** — Founded", ("c", "2021"): "## 2021\n\n- **02 Jan 2021** — Left"}
    entities = spark.createDataFrame([("a", "Ann", "Person"), ("b", "Bee", "Company")], "id string, name string, type string")
    got = {(r.year, r.place): r.line for r in timeline.lines(events, entities).collect()}
    assert got == {
        ("2020", 1): "- **2020** — [[entities/company/b|Bee]] — Founded", ("2020", 2): "- **March 2020** — [[entities/person/a|Ann]] — Moved *(low confidence)*",
        ("2020", 3): "- **01 Mar 2020** — [[entities/person/a|Ann]] — Paid", ("2021", 1): "- **02 Jan 2021** — c — Left",
    }


def test_registry_mode_excludes_itself(spark):
    sig = list(range(128))
    near = sig[:115] + [9999 + i for i in range(13)]
    far = sig[:60] + [5000 + i for i in range(68)]
    new = spark.createDataFrame([("a", sig)], "key string, signature array<long>")
    old = spark.createDataFrame([("a", sig), ("b", near), ("c", far), ("d", None), ("e", sig)], "key string, signature array<long>")
    got = [(r.registered, r.similarity, r.place) for r in similarity.against_registry(new, old).orderBy("place").collect()]
    assert got == [("e", 1.0, 1), ("b", 0.8984, 2)]
    assert [similarity.bands_for(t) for t in (0.99, 0.85, 0.6, 0.4)] == [2, 32, 64, 128]


def test_vectors(spark):
    one = lambda k: [1.0 if i == k else 0.0 for i in range(4)]
    labels = spark.createDataFrame([("court", one(0)), ("land", one(1)), ("also", one(1))], "label string, vector array<double>")
    pages = spark.createDataFrame([("d1", 1, one(0)), ("d1", 11, one(1)), ("d2", 1, one(1)), ("d3", 1, one(3)), ("d4", 2, None), ("d4", 1, one(0))], "key string, page int, vector array<double>")
    got = {r.key: (r.label, r.score) for r in vectors.classify(pages, labels).collect()}
    assert got == {"d1": ("court", 1.0), "d2": ("also", 1.0), "d3": (None, 0.0), "d4": ("court", 1.0)}
    rows = spark.createDataFrame([(k, one(k % 4)) for k in range(12)], "vec_id long, embedding array<double>")
    best = vectors.top_k(rows, rows.where("vec_id = 1"), 4).orderBy("place").collect()
    assert [(r.vec_id, r.score) for r in best] == [(1, 1.0), (5, 1.0), (9, 1.0), (0, 0.0)]
    assert vectors.top_k(rows, rows.limit(0)).count() == 0
    norm = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(vectors.normalized(F.col("v")).alias("v")).collect()
    assert [list(r.v) for r in norm] == [[0.6, 0.8], [0.0, 0.0]]
    index = spark.createDataFrame([("page", "f", 1), ("note", "n", 1)], "kind string, key string, page int")
    assert sorted((r.kind, r.page) for r in vectors.upsert_index(index, spark.createDataFrame([("page", "f", 2)], "kind string, key string, page int")).collect()) == [("note", 1), ("page", 2)]


def test_mentions_are_substrings(spark):
    docs = spark.createDataFrame([(1, "The TILVA harbour"), (2, None), (3, "pilvan")], "doc_id long, text string")
    surfaces = spark.createDataFrame([("a", "tilva"), ("a", "Tilva Port"), ("b", ""), ("c", "ilv")], "id string, surface string")
    assert sorted((r.id, r.doc_id) for r in graph.mentions(surfaces, docs).collect()) == [("a", 1), ("c", 1), ("c", 3)]


def test_locks_and_links(spark):
    locks = spark.createDataFrame([("a", "2024-01-01T00:00:00Z"), ("b", "2024-01-01T00:45:00Z"), ("c", "?")], "name string, started_at string")
    assert sorted(r.name for r in audit.stale_locks(locks, "2024-01-01 01:00:00").collect()) == ["a", "c"]
    notes = spark.createDataFrame([("a", "see [[b|B]] [[zz]]"), ("b", None)], "note_path string, body string")
    assert [(r.note_path, r.target) for r in audit.dead_links(notes).collect()] == [("a", "zz")]


def test_confidence_of_a_chain(spark):
    df = spark.createDataFrame([("high", "low"), ("medium", "high"), ("disputed", "low")], "a string, b string")
    assert [r.c for r in df.select(graph.weakest(F.col("a"), F.col("b")).alias("c")).collect()] == ["low", "medium", "disputed"]


def test_chunks(spark):
    rows = [("s", 40, [(1, "c")], True, None), ("s", 0, [(1, "a"), (2, "b")], False, None), ("s", 80, None, None, "timeout"), ("t", 0, None, None, "bad")]
    df = spark.createDataFrame(rows, "sha256 string, start int, pages array<struct<page:int,markdown:string>>, ocr_used boolean, error string")
    got = {r.sha256: r for r in lifecycle.merge_chunks(df).collect()}
    assert [(p.page, p.markdown) for p in got["s"].pages] == [(1, "a"), (2, "b"), (41, "c")]
    assert got["s"].failed_chunks == ["80: timeout"] and got["s"].ocr_used and got["s"].error is None
    assert got["t"].error == "all chunks failed"


def test_projects(spark):
    p = spark.createDataFrame([("alpha", "A", False), ("alphabet", "B", True), ("beta", "C", None)], "slug string, name string, archived boolean")
    found = lambda w: tuple(lifecycle.find_project(p, w).first())
    assert found("alpha") == ("alpha", "found") and found("alph") == (None, "ambiguous") and found("be") == ("beta", "found") and found("x") == (None, "not found")
    none = spark.createDataFrame([("alpha",)], "slug string")
    assert sorted(tuple(r) for r in lifecycle.project_list(p, none, none).collect()) == [("alpha", "A", 1, 1), ("beta", "C", 0, 0)]
    assert {r.slug: r.archived for r in lifecycle.archive(p, "beta").collect()} == {"alpha": False, "alphabet": True, "beta": True}


def test_config():
    c = lifecycle.Config().set("dup_threshold", "0.9").set("chunk_size", "10")
    assert (c.dup_threshold, c.chunk_size) == (0.9, 10)
    for key, value in (("dup_threshold", "2"), ("chunk_size", "0"), ("chunk_size", "x")):
        with pytest.raises(ValueError):
            c.set(key, value)
    with pytest.raises(KeyError):
        c.set("unknown", "1")
    assert [lifecycle.workers(20, m) for m in (5, 30, 100)] == [(10, 4), (6, 6), (4, 10)]


def test_notes(spark):
    e = spark.createDataFrame([("a", 'Ann "X"', "Person", "p/a", "Sum", "2020", "2021")], "id string, name string, type string, note_path string, summary string, date_first_seen string, date_last_updated string")
    lines = lambda key, *ls: spark.createDataFrame([("a", i, x) for i, x in ls], f"{key} string, ord int, line string")
    kept = spark.createDataFrame([("a", "my own words")], "id string, body string")
    body = render.entity_notes(e, lines("entity_id", (2, "later"), (1, "sooner")), lines("src_id", (1, "- r")), lines("entity_id", (1, "an")), kept).first().body
    assert 'name: "Ann \\"X\\""' in body and body.index("sooner") < body.index("later") and body.endswith("## Notes\n\nmy own words")


def test_questions(spark):
    e = spark.createDataFrame([("a", "Ernst & Young"), ("b", "Bob")], "id string, name string")
    aliases = spark.createDataFrame([("b", "Robert")], "id string, alias string")
    assert [r.id for r in ask.lookup(e, "ERNST and young").collect()] == ["a"]
    assert [r.id for r in ask.lookup(e, "robert", aliases).collect()] == ["b"]
    docs = spark.createDataFrame([(1, "xx NEEDLE yy"), (2, None)], "doc_id long, text string")
    assert [(r.doc_id, r.place, r.context) for r in ask.grep(docs, "needle", around=3).collect()] == [(1, 4, "xx NEEDLE yy")]


def test_flags(spark):
    df = spark.createDataFrame([(40.0, 100.0, "2020-01-01", "2020-06-01"), (10.0, 0.0, "2020-01-01", "2021-01-01"), (None, 5.0, None, None)], "a double, b double, s string, e string")
    a, b = F.col("a"), F.col("b")
    got = df.select(flags.ratio_above(a, b, 0.35).alias("x"), flags.just_below(a, 41.0).alias("y"), flags.nominal(a).alias("z"), flags.short_tenure(F.to_date("s"), F.to_date("e")).alias("t")).collect()
    assert [tuple(r) for r in got] == [(True, True, False, True), (False, False, True, False), (False, False, False, False)]
    people, firms = spark.createDataFrame([("p", " 1 Main St")], "id string, address string"), spark.createDataFrame([("c", "1 main st "), ("d", "")], "id string, address string")
    roles = spark.createDataFrame([("p", "c"), ("p", "d")], "src_id string, target_id string")
    assert [(r.src_id, r.target_id) for r in flags.same_address(people, firms, roles).collect()] == [("p", "c")]


def test_refresh_analysis_and_pending(spark):
    e = spark.createDataFrame([("a", "old"), ("b", "keep")], "id string, summary string")
    ev = spark.createDataFrame([("a", "2020"), ("b", "2021")], "entity_id string, date string")
    e2, ev2 = lifecycle.refresh_entity(e, ev, "a", "new", spark.createDataFrame([("a", "2022")], "entity_id string, date string"))
    assert sorted(map(tuple, e2.collect())) == [("a", "new"), ("b", "keep")] and sorted(map(tuple, ev2.collect())) == [("a", "2022"), ("b", "2021")]
    none = spark.createDataFrame([], "entity_id string, date string, line string")
    found = spark.createDataFrame([("a", "docs/x", "X", "said so"), ("a", "docs/y", "Y", "")], "entity_id string, note_path string, title string, text string")
    assert [r.line for r in lifecycle.add_analysis(none, found, "2024-01-02").collect()] == ["*2024-01-02, via [[docs/x|X]]:* said so"]
    files = spark.createDataFrame([("in/a.txt", 3), ("in/.x", 5), ("in/a.yml", 7), ("in/_FAILED/b.txt", 9), ("in/_skipped/c", 1)], "path string, length long")
    assert tuple(lifecycle.pending(files).first()) == (1, 3)
    assert spark.range(1).select(lifecycle.morgue_path(F.lit("Tilva Port"), F.lit("Annual Report"), F.lit("f.pdf"))).first()[0] == "morgue/tilva-port/annual-report/f.pdf"


def test_the_second_timeline(spark):
    rows = [("2020", "Founded", "high", 1), ("2020", "Moved", "low", 2), ("2019-05", "Begun", "", 3), ("", "x", "", 4), ("2021", " ", None, 5), ("2021", None, None, 6)]
    got = sorted((r.date, r.place, r.line) for r in timeline.by_date(spark.createDataFrame(rows, "date string, event string, confidence string, ord int")).collect())
    assert got == [("2019-05", 0, "### 2019-05"), ("2019-05", 1, "- Begun"), ("2020", 0, "### 2020"), ("2020", 1, "- Founded"), ("2020", 2, "- Moved *(confidence: low)*"), ("2021", 0, "### 2021"), ("2021", 1, "-  ")]
    assert timeline.by_date(spark.createDataFrame([], "date string, event string, confidence string, ord int")).count() == 0


def test_events_alike_settle_on_the_longest(spark):
    rows = [("2020", "The old harbour wall of Tilva fell down"), ("2020", "the harbour wall of old Tilva fell down today"), ("2020", "A new wall"), ("2021", "The old harbour wall of Tilva fell down"), ("2020", "??"), ("2020", "!!")]
    got = sorted((r.date, r.event) for r in timeline.settle_alike(spark.createDataFrame(rows, "date string, event string"), Workspace(spark, "settle")).collect())
    assert got == [("2020", "!!"), ("2020", "??"), ("2020", "A new wall"), ("2020", "the harbour wall of old Tilva fell down today"), ("2021", "The old harbour wall of Tilva fell down")]


def test_registry_rows_without_a_signature_meet_by_shingles(spark):
    sig, words = list(range(128)), [f"w{k}" for k in range(20)]
    new = spark.createDataFrame([("n", sig, words)], "key string, signature array<long>, shingles array<string>")
    old = spark.createDataFrame([("a", sig, None), ("b", None, words[:19] + ["x"]), ("c", [], words), ("d", None, words[:5]), ("e", [7] * 128, words), ("f", None, None)], "key string, signature array<long>, shingles array<string>")
    got = [(r.registered, r.similarity, r.place) for r in similarity.against_registry_or_shingles(new, old).orderBy("place").collect()]
    assert got == [("a", 1.0, 1), ("c", 1.0, 2), ("b", 0.9048, 3)]


def test_blocks_of_surfaces_and_labels_give_the_same(spark):
    docs = spark.createDataFrame([(k, f"text {k} of names {k % 7}") for k in range(40)], "doc_id long, text string")
    surfaces = spark.createDataFrame([(f"i{k % 5}", f"names {k % 9}") for k in range(18)] + [("t", "text 1")], "id string, surface string")
    whole = sorted(map(tuple, graph.mentions(surfaces, docs).collect()))
    assert sorted(map(tuple, graph.mentions(surfaces, docs, block=100).collect())) == whole and len(whole) > 20
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(k, k % 12, rng.standard_normal(6).tolist()) for k in range(60)], "key int, page int, vector array<double>")
    labels = spark.createDataFrame([(f"l{k % 20:02}", rng.standard_normal(6).tolist()) for k in range(20)], "label string, vector array<double>")
    one = sorted(map(str, vectors.classify(rows, labels, 0.1).collect()))
    assert sorted(map(str, vectors.classify(rows, labels, 0.1, block=3).collect())) == one
    assert {r.label for r in vectors.classify(rows, labels.limit(0)).collect()} == {None}


def test_embedding_takes_equal_texts_and_cached_ones_once(spark, tmp_path):
    out = str(tmp_path)

    def model(texts):
        import os
        import uuid

        with open(os.path.join(out, uuid.uuid4().hex), "w") as f:
            f.write("\n".join(texts))
        return [[float(len(t)), 0.0] for t in texts]

    rows = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, "de"), (4, ""), (5, None)], "key int, text string")
    first = vectors.embed(rows.where("key < 3"), model, model="m").cache()
    assert [r.vector for r in first.collect()] == [[1.0, 0.0]] * 2
    got = {r.key: r.vector for r in vectors.embed(rows, model, model="m", cache=first.select("digest", "vector").distinct()).collect()}
    assert got == {1: [1.0, 0.0], 2: [1.0, 0.0], 3: [1.0, 0.0], 4: [0.0, 0.0], 5: [0.0, 0.0]}
    seen = [line for f in tmp_path.iterdir() for line in f.read_text().split("\n")]
    assert seen.count("abc") == 1 and seen.count("de") == 1


def test_locks_states_and_permissions(spark):
    now = "2024-01-01T12:00:00Z"
    locks = spark.createDataFrame([("a", "2024-01-01T11:59:00Z"), ("b", "2024-01-01T10:00:00Z"), ("c", None)], "name string, started_at string")
    stay, gone = audit.unlock(locks, now)
    assert [r.name for r in stay.collect()] == ["a"] and sorted(r.name for r in gone.collect()) == ["b", "c"]
    assert audit.unlock(locks, now, force=True)[0].count() == 0
    queue = spark.createDataFrame([("s",)], "sha256 string")
    assert [tuple(r) for r in audit.ingest_state(queue, locks, now).collect()] == [(True, 1)]
    assert [tuple(r) for r in audit.ingest_state(queue, gone, now).collect()] == [(False, 1)] and audit.ingest_state(queue.limit(0), locks, now).count() == 0
    temps = spark.createDataFrame([("/v/wdg_1",), ("/v/note.md",)], "path string")
    assert [r.path for r in audit.orphan_temps(temps).collect()] == ["/v/wdg_1"]
    have, want = (spark.createDataFrame([(p,) for p in ps], "permission string") for ps in ("ab", "abcc"))
    assert [r.permission for r in audit.missing_permissions(want, have).collect()] == ["c"]
    assert {r.name: r.present for r in audit.doctor(spark, ("numpy", "no_such_module"), ("no-such-tool",)).collect()} == {"numpy": True, "no_such_module": False, "no-such-tool": False}
    projects = spark.createDataFrame([("p",), ("q",)], "slug string")
    free, held = spark.createDataFrame([], "slug string"), spark.createDataFrame([("p",)], "slug string")
    assert sorted(r.slug for r in lifecycle.rename_project(projects, "p", "r", free).collect()) == ["q", "r"]
    assert [r.slug for r in lifecycle.delete_project(projects, "p", free).collect()] == ["q"]
    for change in (lambda: lifecycle.rename_project(projects, "p", "r", held), lambda: lifecycle.rename_project(projects, "p", "q", free), lambda: lifecycle.delete_project(projects, "p", held)):
        with pytest.raises(ValueError):
            change()


def test_wide_documents_are_paired_in_blocks(spark):
    rows = [(f"e{k:02}", d) for k in range(30) for d in range(4) if (k + d) % 3]
    seen = spark.createDataFrame(rows, "id string, sha256 int")
    whole = sorted(map(tuple, graph.co_occurrence(seen).collect()))
    assert sorted(map(tuple, graph.co_occurrence(seen, block=4).collect())) == whole and len(whole) > 100


def test_meetings_in_blocks_are_those_of_a_join(spark):
    rng = random.Random(5)
    held = sorted({(k, rng.choice("aaab") + rng.choice("xy")) for k in range(40) for _ in range(2)})
    rows = spark.createDataFrame(held, "key int, value string")
    want = sorted({(a, b) for a, v in held for b, w in held if v == w and a < b})
    for block in (1, 7, 1000):
        assert sorted((r.a, r.b) for r in similarity._meetings(rows, ["value"], block).collect()) == want


def test_few_files_are_dealt_over_the_cores(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "cast(id as string) AS text")
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert spread(one).count() == 1000 and "Exchange" in spread(one)._jdf.queryExecution().toString()
    assert "Exchange" not in spread(one, 0)._jdf.queryExecution().toString()


def _alike_texts():
    """Texts of 1 to 700 words and copies with few words changed, so that many pairs lie just above and just below the threshold."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    texts = ["", "...", "one", "one two", "One, TWO!", "one two three", "a_b é one two"]
    for n in [*range(3, 40), 75, 160, 330, 700]:
        base = [word() for _ in range(n)]
        for edits in range(max(2, n // 18)):
            varied = list(base)
            for at in rng.sample(range(n), min(edits, n)):
                varied[at] = word()
            texts.append(" ".join(varied))
        texts += [" ".join(base + [word() for _ in range(more)]) for more in range(1, n // 4, 1 + n // 40)]
    passage = [word() for _ in range(60)]
    texts += [" ".join(passage + [word() for _ in range(k % 50)]) for k in range(80)]
    return [*enumerate(texts), (9000, texts[-1]), (9001, None), (None, texts[-1])]


def _alike(texts, percent):
    first = {}
    for key, text in texts:
        words = fp.tokenize(text or "")
        if words and key is not None:
            items = frozenset(fp.shingles(words))
            first[items] = min(key, first.get(items, key))
    sets, out = sorted((key, items) for items, key in first.items()), []
    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if 100 * len(x & y) >= percent * len(x | y):
                out.append((a, b, len(x & y), len(x | y)))
    return sorted(out)


def test_shingle_pairs_lose_no_pair_at_any_size(spark, monkeypatch):
    texts = _alike_texts()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for percent, most in ((85, 500), (85, 8), (60, 500), (95, 500)):
        monkeypatch.setattr(similarity, "LIST_BLOCK", most)
        monkeypatch.setattr(similarity, "SET_BLOCK", most)
        monkeypatch.setattr(similarity, "BROADCAST_NARROW", most)
        want = _alike(texts, percent)
        assert len(want) > 50 and sorted(map(tuple, similarity.shingle_pairs(docs, percent).collect())) == want


def test_sets_so_alike_share_a_part():
    rng = np.random.default_rng(3)
    for percent in (60, 85, 95):
        for n in (7, 20, 34, 100, 455, 3000, 20_000):
            for _ in range(10):
                drop = rng.integers(0, n * (100 - percent) // 100 + 1)
                most = (n - drop) * 100 // percent - n  # the two sets are then just so alike
                a = np.unique(rng.integers(0, 1 << 63, n, np.uint64, endpoint=True))
                b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, max(0, most), np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both) and len(a) + len(b) > 2 * both:
                    level = min(np.searchsorted(similarity._sizes(percent), len(x), "right") - 1 for x in (a, b))
                    assert len(np.intersect1d(*(similarity._parts(x, int(level), percent) for x in (a, b))))


def test_shingles_are_not_shuffled(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(str(rng.randrange(5000)) for _ in range(400)) for _ in range(300)]
    spark.createDataFrame([*enumerate(texts), *((1000 + k, f"{texts[k]} more") for k in range(30))], "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert catalog.QUERIES["shingle_jaccard_pairs"](spark, str(tmp_path)).count() == 30
    assert written() - before < 3 * sum(map(len, texts))
