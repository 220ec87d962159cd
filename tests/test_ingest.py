import json

from recordloom.operators import ingest
from recordloom.sources.store import Store

NAMES = list(ingest.EMPTY)


def record(sha, entities, **more):
    return json.dumps({"document": {"sha256": sha, "filename": f"{sha}.pdf", "title": sha, "document_type": "Harbour Log"}, "entities": entities, "morgue_entity_id": entities[0]["id"], "morgue_document_type": "Harbour Log"} | more)


def batch(spark, *records):
    return spark.createDataFrame(list(enumerate(records, 1)), "arrival int, json string")


PILOT = {"id": "odile-marn", "name": "Odile Marn", "type": "Person", "aliases": ["O. Marn"], "timeline_events": [{"date": "1998-07-02", "event": "Took the helm", "confidence": "medium"}, {"date": "2003", "event": "Went ashore"}], "roles": [{"relationship": "Pilot at", "target_id": "port-tilva", "page": 7, "confidence": "medium", "date_range": "1998-2003"}]}
PORT = {"id": "port-tilva", "name": "Port Tilva", "type": "Place", "aliases": ["TILVA"]}


def test_two_batches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "vault"))
    out = ingest.post_flight(batch(spark, record("s1", [PILOT, PORT]), "{", record("s1", [PORT])), ingest.empty(spark), "2024-05-01T00:00:00Z")
    assert [r.arrival for r in out["rejected"].collect()] == [2]
    store.commit(**{k: out[k] for k in NAMES})
    said = ("page", "confidence", "date_range", "source_sha256")
    assert sorted((r.src_id, r.relationship, r.target_id, r.is_reverse, *[r[c] for c in said]) for r in store.read("roles").collect()) == [
        ("odile-marn", "Pilot at", "port-tilva", False, 7, "medium", "1998-2003", "s1"), ("port-tilva", "Pilot at", "odile-marn", True, 7, "medium", "1998-2003", "s1"),
    ]
    assert store.read("documents").first().morgue_path == "morgue/odile-marn/harbour-log/s1.pdf"
    assert out["log"].first().line == "[2024-05-01T00:00:00Z] INGEST s1.pdf sha256=s1 entities=2 type=Harbour Log"
    assert sorted((r.date, r.confidence) for r in out["staged"].collect()) == [("1998-07-02", "medium"), ("2003", "high")]

    other = {"id": "marn", "name": "o marn", "type": "Person", "timeline_events": [{"date": "1998-07-02", "event": "TOOK THE HELM"}], "roles": [{"relationship": "owner of", "target_id": "tilva-2"}]}
    again = {"id": "tilva-2", "name": "PORT  TILVA!", "type": "Place"}
    out = ingest.post_flight(batch(spark, record("s2", [other, again]), record("s1", [PORT])), {k: store.read(k) for k in NAMES}, "2024-06-01T00:00:00Z")
    store.commit(**{k: out[k] for k in NAMES})
    assert {r.id: (r.name, r.date_first_seen, r.date_last_updated) for r in store.read("entities").collect()} == {"odile-marn": ("Odile Marn", "2024-05-01", "2024-06-01"), "port-tilva": ("Port Tilva", "2024-05-01", "2024-06-01")}
    assert sorted((r.id, r.sha256) for r in store.read("appearances").collect()) == [("odile-marn", "s1"), ("odile-marn", "s2"), ("port-tilva", "s1"), ("port-tilva", "s2")]
    assert sorted((r.src_id, r.relationship) for r in store.read("roles").where("not is_reverse").collect()) == [("odile-marn", "Pilot at"), ("odile-marn", "owner of")]
    assert store.read("timeline_events").count() == 2 and store.read("documents").count() == 2
    assert {r.alias for r in store.read("aliases").where("id = 'odile-marn'").collect()} == {"O. Marn", "o marn"}


def test_ids_belong_to_their_documents(spark):
    known = {"id": "vt-1", "name": "Vesna Tolk", "type": "Person"}
    first = ingest.post_flight(batch(spark, record("s0", [known])), ingest.empty(spark), "2024-05-01T00:00:00Z")
    to = lambda target: [{"relationship": "wrote to", "target_id": target}]
    s1 = record("s1", [{"id": "v", "name": "Vesna Tolk", "type": "Person", "roles": to("w")}, {"id": "w", "name": "Ruben Ash", "type": "Person"}])
    s2 = record("s2", [{"id": "v", "name": "Lio Brandt", "type": "Person", "roles": to("w")}, {"id": "w", "name": "ruben ash", "type": "Person"}])
    s3 = record("s3", [{"id": "x", "name": "LIO BRANDT", "type": "Person", "roles": to("y")}, {"id": "y", "name": "Vesna Tolk", "type": "Person"}])
    out = ingest.post_flight(batch(spark, s1, s2, s3), {k: first[k] for k in NAMES}, "2024-06-01T00:00:00Z")
    assert sorted((r.id, r.name) for r in out["entities"].collect()) == [("v", "Lio Brandt"), ("vt-1", "Vesna Tolk"), ("w", "Ruben Ash")]
    assert sorted((r.id, r.sha256) for r in out["appearances"].collect()) == [("v", "s2"), ("v", "s3"), ("vt-1", "s0"), ("vt-1", "s1"), ("vt-1", "s3"), ("w", "s1"), ("w", "s2")]
    assert sorted((r.src_id, r.target_id, r.source_sha256) for r in out["roles"].where("not is_reverse").collect()) == [("v", "vt-1", "s3"), ("v", "w", "s2"), ("vt-1", "w", "s1")]
    assert out["documents"].count() == 4
    assert {r.sha256: r.morgue_path.split("/")[1] for r in out["documents"].collect()} == {"s0": "vt-1", "s1": "vt-1", "s2": "v", "s3": "v"}


def test_an_id_that_is_registered_stays(spark):
    one = record("s1", [{"id": "q", "name": "Quill House", "type": "Company"}])
    two = record("s2", [{"id": "q", "name": "Quill House Ltd", "type": "Company"}])
    out = ingest.post_flight(batch(spark, one, two), ingest.empty(spark), "2024-06-01T00:00:00Z")
    assert [(r.id, r.name) for r in out["entities"].collect()] == [("q", "Quill House")] and out["appearances"].count() == 2


def test_documents_of_many_entities_keep_their_order(spark):
    many = [{"id": f"e{k}", "name": f"Name {k}", "type": "Person"} for k in range(1500)]
    late = [{"id": "late", "name": "Name 1400", "type": "Person"}]
    out = ingest.post_flight(batch(spark, record("s1", many), record("s2", late)), ingest.empty(spark), "2024-06-01T00:00:00Z")
    assert out["entities"].count() == 1500 and sorted((r.id, r.sha256) for r in out["appearances"].where("sha256 = 's2'").collect()) == [("e1400", "s2")]
