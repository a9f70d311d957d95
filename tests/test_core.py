from __future__ import annotations

import json
import random
import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from weftgraph.functions import columns as C
from weftgraph.operators import chunks as K
from weftgraph.operators import edges as E
from weftgraph.operators import insights as I  # noqa: E741
from weftgraph.operators import merge as M
from weftgraph.operators import projection as J
from weftgraph.operators import quality as Q
from weftgraph.operators import rank as R
from weftgraph.operators import retrieval as V
from weftgraph.operators.orphans import orphan_counts, orphan_references
from weftgraph.operators.snapshot_diff import snapshot_changes
from weftgraph.plans import questions as P
from weftgraph.sources import readers, sinks
from weftgraph.streaming import index

T = datetime
SNAP = "project_slug string, snapshot_no int, delivered_at timestamp_ntz, id string, description string, community string, source_path string, cut string"


def brute_changes(data):
    latest = {}
    for p, v, at, k, *values in data:
        if p is None or v is None or k is None:
            continue
        order = ((at is not None, at or T(1, 1, 1)), [(x is not None, x or "") for x in values[:3]])
        if (p, v, k) not in latest or latest[p, v, k][0] < order:
            latest[p, v, k] = (order, values[:3])
    out = []
    for p in {x[0] for x in latest}:
        versions = sorted({x[1] for x in latest if x[0] == p})
        for a, b in zip(versions, versions[1:]):
            old = {k: x[1] for (q, v, k), x in latest.items() if (q, v) == (p, a)}
            new = {k: x[1] for (q, v, k), x in latest.items() if (q, v) == (p, b)}
            out += [(p, b, k, "added", "") for k in new.keys() - old.keys()] + [(p, b, k, "removed", "") for k in old.keys() - new.keys()]
            for k in new.keys() & old.keys():
                out += [(p, b, k, "modified", f) for f, x, y in zip(("description", "community", "source_path"), old[k], new[k]) if x != y]
    return sorted(out, key=repr)


def test_snapshot_changes_of_unequal_ties_are_stable(spark):
    data = [("p", v, T(2025, 1, 1), f"e{k}", c, None, "s", "x") for v in (1, 2) for k in range(20) for c in "abc"[: 1 + k % 3]]
    got = rows(snapshot_changes(spark.createDataFrame(data, SNAP)))
    assert got == rows(snapshot_changes(spark.createDataFrame(data[::-1], SNAP).repartition(5))) == []


@pytest.mark.parametrize("per_chunk", [1, 4, 64])
def test_snapshot_changes_equal_brute_force(spark, per_chunk):
    r = random.Random(per_chunk)
    keys = [(r.choice(["p", "q", None]), r.choice([1, 2, 4, 7, None]), r.choice([None, T(2025, 1, r.randint(1, 28))]), r.choice([None, *[f"e{k}" for k in range(40)]])) for _ in range(1500)]
    values = {k: [r.choice([None, "", "a", "b"]) for _ in range(2)] for k in sorted(set(keys), key=repr)}  # rows that tie are equal
    data = [(*k, *values[k], "s", "x") for k in keys]
    got = rows(snapshot_changes(spark.createDataFrame(data, SNAP), rows_per_chunk=per_chunk))
    assert got == brute_changes(data) and got


def test_snapshot_changes_edge_cases(spark):
    assert rows(snapshot_changes(spark.createDataFrame([], SNAP))) == []
    same = [("p", v, T(2025, 1, 1), "k", None, "", "x", "1") for v in (1, 2)] * 3
    assert rows(snapshot_changes(spark.createDataFrame(same, SNAP))) == []
    long = [("p", 1, T(2025, 1, 1), "k", "x" * 200_000, "", "x", "1"), ("p", 2, T(2025, 1, 1), "k", "x" * 199_999 + "y", "", "x", "1")]
    assert rows(snapshot_changes(spark.createDataFrame(long, SNAP)), "change", "field") == [("modified", "description")]


def graph_tables(spark, **given):
    common = "project_slug string, id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz"
    schemas = {"sources": common, "source_spans": common + ", source_id string, state string", "chunks": common + ", source_span_id string", "entities": common + ", source_span_ids array<string>, parent string", "knowledge_chunks": common + ", entity_id string"}
    return {t: spark.createDataFrame(given.get(t, []), s) for t, s in schemas.items()}


def test_orphans(spark):
    early, later = T(2025, 1, 1), T(2025, 2, 1)
    t = graph_tables(
        spark,
        sources=[("p", "S1", early, None), ("p", "s2", early, later), ("p", "s3", later, None), ("q", "s1", early, None)],
        source_spans=[
            ("p", "a", early, None, " s1 ", "x"), ("p", "b", early, None, "S2", "x"), ("p", "c", early, None, "s3", "x"), ("p", "d", early, None, "s4", "x"), ("p", "d", later, None, "s4", "x"),
            ("p", "e", early, early, "s4", "x"), ("p", "f", early, None, "  ", "x"), ("p", "g", early, None, None, "x"), ("p", "h", None, None, "s3", "x"), ("r", "i", early, None, "s1", "x"), (None, "j", early, None, "s1", "x"),
        ],
        entities=[("p", "n", early, None, ["a", None, "zz", "zz", "A"], "x"), ("p", "m", early, None, None, "x"), ("p", "l", early, None, [], "x")],
    )
    got = orphan_references(t)
    assert rows(got, "table_name", "record_id", "ref_id", "state") == sorted(
        [("source_spans", "b", "s2", "deleted"), ("source_spans", "c", "s3", "late"), ("source_spans", "d", "s4", "missing"), ("source_spans", "i", "s1", "missing"), ("source_spans", "j", "s1", "missing"), ("entities", "n", "zz", "missing")], key=repr
    )
    assert rows(orphan_counts(got).where("table_name = 'entities'")) == [("entities", "2025-01", "missing", 1, 1)]
    assert rows(orphan_references(graph_tables(spark))) == []


def test_hot_orphan_key(spark):
    t = graph_tables(spark, source_spans=[("p", f"a{k}", None, None, "gone", "x") for k in range(3000)])
    assert orphan_references(t).count() == 3000


def test_ids_and_names(spark):
    df = spark.createDataFrame([("  Foo--Bar! ", "a", None), ("***", "b", "x")], "n string, p string, q string")
    assert rows(df.select(C.slugify("n"), C.canonical_name("n"))) == [("foo-bar", "foo bar"), ("untitled", "untitled")]
    assert rows(df.select(C.stable_id("e", "p", F.lit("b")))) != rows(df.select(C.stable_id("e", F.lit("b"), "p")))
    one = spark.range(1).select(C.stable_id("x", F.lit("a"), F.lit("b")).alias("i")).first()[0]
    assert one == "x_78f0be89237d77f7"


@pytest.mark.parametrize(("value", "kind"), [("", "empty"), (None, "empty"), ("True", "boolean"), ("007", "string"), ("-5", "string"), ("0", "int"), ("12", "int"), ("1.5", "float"), ("1e3", "float"), ("e", "string"), ("x", "string")])
def test_value_kinds(spark, value, kind):
    assert spark.createDataFrame([(value,)], "v string").select(C.value_kind("v")).first()[0] == kind


def test_predicates(spark):
    df = spark.createDataFrame([("Powered-By",), (" called by ",), ("uses",), ("a b",)], "p string")
    assert [r[0] for r in df.select(C.normal_predicate("p")).collect()] == ["uses", "calls", "uses", "a_b"]
    assert spark.range(1).select(C.relationship_type(F.lit("--"))).first()[0] == "RELATED_TO"


def test_first_and_last_wins_and_merge(spark):
    df = spark.createDataFrame([("p", "1", 2, "b"), ("p", "1", 1, "a"), ("p", "1", 1, "0"), ("p", None, 1, "n")], "project_slug string, id string, ord int, name string")
    assert rows(M.first_wins(df, ("project_slug", "id"), ("ord",))) == [("p", "1", 1, "0"), ("p", None, 1, "n")]
    assert rows(M.first_wins(df, ("project_slug", "id"), ("ord",), last=True)) == [("p", "1", 2, "b"), ("p", None, 1, "n")]
    assert rows(M.merge_graphs([df.where("ord = 2"), df]), "id", "name") == [("1", "b"), (None, "n")]


def test_upsert_and_prune(spark):
    s = "project_slug string, id string, name string, status string, stale boolean"
    old = spark.createDataFrame([("p", "1", "a", "validated", True), ("p", "2", "b", "validated", None)], s)
    new = spark.createDataFrame([("p", "1", None, "candidate", None), ("p", "3", "c", None, None)], s)
    assert rows(M.upsert(old, new)) == [("p", "1", "a", "candidate", False), ("p", "2", "b", "validated", None), ("p", "3", "c", None, False)]
    assert rows(M.prune_stale(old, new), "id", "status", "stale") == [("1", "validated", True), ("2", "superseded", True)]
    assert rows(M.prune_delete(old, new), "id") == [("1",)]
    assert rows(M.reset_project(old, "p")) == []


ENTITY = "project_slug string, id string, type string, name string, normalized_name string, aliases array<string>, source_span_ids array<string>, source_path string, community string, extraction_source string, description string, domain string, dataset string, connector string, mapped_type string, record_key string, semantic_summary boolean, metadata_json string, stale boolean, ord long"


def entity(**x):
    d = {"project_slug": "p", "type": "System", "ord": 0} | x
    return tuple(d.get(f.split()[0]) for f in ENTITY.split(", "))


def test_resolution_prefers_readable_names(spark):
    data = [
        entity(id="1", name="oe:12", domain="d", mapped_type="T", record_key="k", extraction_source="structured_connector", ord=1, aliases=["x"], source_span_ids=["s2"], description=""),
        entity(id="2", name="Blue Team", domain="d", mapped_type="T", record_key="k", extraction_source="structured_connector", ord=2, aliases=["y", None], source_span_ids=["s1"], description="one"),
        entity(id="3", name="The Blue Team", domain="d", mapped_type="T", record_key="k", extraction_source="structured_connector", ord=3, description="two"),
        entity(id="4", name="blue-team", ord=4), entity(id="5", name="Blue  team", ord=5), entity(id="6", name=None, ord=6),
    ]
    got = {r["mentions"]: r for r in Q.resolve_entities(spark.createDataFrame(data, ENTITY)).collect() if r["mentions"] > 1}
    assert (got[3]["name"], got[3]["description"], got[3]["aliases"], got[3]["source_span_ids"]) == ("Blue Team", "one", ["The Blue Team", "oe:12", "x", "y"], ["s1", "s2"])
    assert got[2]["name"] == "Blue  team"


ASSERT = "project_slug string, id string, predicate string, subject_id string, object_id string, evidence_span_id string, confidence double, status string, extraction_source string, confidence_tier string, evidence_text string, source_path string, stale boolean, extractor string, ord long"


def assertion(**x):
    d = {"project_slug": "p", "predicate": "uses", "confidence": 0.9, "evidence_span_id": "s"} | x
    return tuple(d.get(f.split()[0]) for f in ASSERT.split(", "))


def test_validation_order(spark):
    e = spark.createDataFrame([("p", "a"), ("p", "b")], "project_slug string, id string")
    s = spark.createDataFrame([("p", "s")], "project_slug string, id string")
    data = [
        assertion(id="1", subject_id="a", object_id="b"), assertion(id="2", subject_id="a", object_id="z", predicate="zzz"), assertion(id="3", subject_id="a", object_id="z", predicate="zzz", extractor="structured_connector"),
        assertion(id="4", subject_id="a", object_id="b", evidence_span_id=None), assertion(id="5", subject_id="a", object_id="b", confidence=0.4), assertion(id="6", subject_id="a", object_id=None), assertion(id="7", subject_id="a", object_id="b", predicate=" Depends On"), assertion(id="8", subject_id="a", object_id="b", predicate="powered_by"),
    ]
    v = Q.validate(spark.createDataFrame(data, ASSERT), e, s)
    assert rows(v, "id", "reason") == [("1", None), ("2", "invalid_predicate"), ("3", "missing_entity"), ("4", "missing_evidence"), ("5", "confidence_below_threshold"), ("6", "missing_entity"), ("7", None), ("8", None)]
    assert rows(Q.accepted(v), "id", "predicate", "status") == [("1", "uses", "validated"), ("7", "depends_on", "validated"), ("8", "uses", "validated")]
    shapes = spark.createDataFrame([("entity", "a", "no name")], "kind string, id string, violation string")
    assert Q.accepted(v, shapes).count() == 0 and Q.accepted(v, shapes.limit(0)).count() == 3
    odd = spark.createDataFrame([("p", "x", "Spaceship"), ("p", "y", "System"), ("p", "z", None)], "project_slug string, id string, type string")
    assert rows(Q.rejected_entities(odd)) == [("p", "x", "invalid_entity_type"), ("p", "z", "invalid_entity_type")]


def test_resolution_keys_and_assertion_ids(spark):
    e = spark.createDataFrame([
        entity(id="1", name="Blue Team!", normalized_name="blue team"), entity(id="2", name="The Blues", normalized_name="Blue  Team"), entity(id="3", name="Blue Team", normalized_name=""),
        entity(id="4", name="x", domain="d", mapped_type="T", record_key="k", extraction_source="structured_connector"), entity(id="5", name="y", domain="d", mapped_type="T", record_key="k", extraction_source="structured_connector"), entity(id="6", name="y", domain="d", mapped_type="T", record_key="k"),
    ], ENTITY)
    ids = {r["id"]: r["resolved_id"] for r in Q.resolution_key(e).collect()}
    assert ids["1"] == ids["2"] == ids["3"] and ids["4"] == ids["5"] and len(set(ids.values())) == 3
    a = spark.createDataFrame([assertion(id="p", subject_id="1", object_id="4"), assertion(id="q", subject_id="2", object_id="5")], ASSERT)
    moved = Q.remap_assertions(a, Q.resolution_key(e)).collect()
    assert len({r["id"] for r in moved}) == 2 and {(r["subject_id"], r["object_id"]) for r in moved} == {(ids["1"], ids["4"])}


@pytest.fixture(scope="module")
def small_edges(spark):
    r = random.Random(3)
    names = "abcdefg"
    data = [("p", f"e{k}", r.choice(["x", "y"]), r.choice(names), r.choice(names)) for k in range(22)]
    df = spark.createDataFrame(data, "project_slug string, id string, predicate string, subject_id string, object_id string")
    kinds = F.when(F.col("subject_id") < "d", "K").otherwise("L")
    return data, df.withColumn("s_type", kinds).withColumn("o_type", F.when(F.col("object_id") < "d", "K").otherwise("L")).withColumn("s_name", F.col("subject_id")).withColumn("o_name", F.col("object_id")).withColumn("confidence", F.lit(0.5))


def brute_trails(data, hops):
    sym = [(e, p, a, b) for _, e, p, a, b in data] + [(e, p, b, a) for _, e, p, a, b in data if a != b]
    paths = [((a, b), (e,), (p,)) for e, p, a, b in sym]
    for _ in range(hops - 1):
        paths = [(n + (b,), i + (e,), q + (p,)) for n, i, q in paths for e, p, a, b in sym if a == n[-1] and e not in i]
    return paths


def test_trails_equal_brute_force(spark, small_edges):
    data, df = small_edges
    for hops in (1, 2, 3):
        got = sorted((tuple(r["nodes"]), tuple(r["eids"])) for r in E.trails(df, [None] * hops).collect())
        assert got == sorted((n, i) for n, i, _ in brute_trails(data, hops))
    got = sorted((tuple(r["nodes"]), tuple(r["eids"])) for r in E.trails(df, ["x", "y"]).collect())
    assert got == sorted((n, i) for n, i, q in brute_trails(data, 2) if q == ("x", "y"))
    assert E.trail_count_2(df).first()["trails"] == len(brute_trails(data, 2))
    with pytest.raises(ValueError, match="three hops"):
        E.trails(df, [None] * 4)


def test_signatures_count_without_paths(spark, small_edges):
    data, df = small_edges
    start = spark.createDataFrame([("p", "a"), ("p", "e")], "project_slug string, a string")
    kind = lambda n: "K" if n < "d" else "L"
    want = {}
    for n, _, q in brute_trails(data, 1) + brute_trails(data, 2):
        if n[0] in "ae":
            key = (kind(n[-1]), tuple(reversed(q)), tuple(kind(x) for x in n[1:-1]))
            want[key] = want.get(key, 0) + 1
    got = {(r["group_type"], tuple(r["predicates"]), tuple(r["intermediate_types"])): r["examples"] for r in E.signatures(df, start).collect()}
    assert got == want


def test_signatures_of_three_hops(spark, small_edges):
    data, df = small_edges
    start = spark.createDataFrame([("p", "a"), ("p", "e")], "project_slug string, a string")
    kind = lambda n: "K" if n < "d" else "L"
    want = {}
    for n, _, q in brute_trails(data, 1) + brute_trails(data, 2) + brute_trails(data, 3):
        if n[0] in "ae":
            key = (kind(n[-1]), tuple(reversed(q)), tuple(kind(x) for x in reversed(n[1:-1])))
            want[key] = want.get(key, 0) + 1
    got = {(r["group_type"], tuple(r["predicates"]), tuple(r["intermediate_types"])): r["examples"] for r in E.signatures(df, start, hops=3).collect()}
    assert got == want and any(len(p) == 3 for _, p, _ in got)


def test_degrees_and_impact(spark, small_edges):
    data, df = small_edges
    d = {r["id"]: (r["fan_in"], r["fan_out"], r["degree"]) for r in E.degrees(df).collect()}
    for n in d:
        i, o = sum(x[4] == n for x in data), sum(x[3] == n for x in data)
        assert d[n] == (i, o, i + o)
    near = {x[3] for x in data if x[4] == "a"} - {"a"}
    far = {x[3] for x in data if x[4] in near} - near - {"a"}
    got = E.reverse_impact(df, spark.createDataFrame([("p", "a")], "project_slug string, a string"))
    assert rows(got, "id", "distance") == sorted([(n, 1) for n in near] + [(n, 2) for n in far], key=repr)


def test_affected_needs_one_changed_end(spark, small_edges):
    data, df = small_edges
    changed = spark.createDataFrame([("p", "a"), ("p", "b")], "project_slug string, id string")
    got = {r["id"]: (r["neighbour_id"], r["direction"]) for r in E.affected(changed, df).collect()}
    want = {x[1]: (x[4], "downstream") if x[3] in "ab" else (x[3], "upstream") for x in data if (x[3] in "ab") != (x[4] in "ab")}
    assert got == want


def test_windows_of_paragraphs():
    text = "\n\n".join("abcdef"[k] * 150 for k in range(6))
    assert [e - s for s, e in K.windows(text, 310)] == [302, 302, 302]
    assert K.windows("", 10) == [] and K.windows("\n\n \n\n", 10) == []
    assert K.windows("x" * 25, 10) == [(0, 10), (10, 20), (20, 25)]


def test_mapping(spark):
    people = spark.createDataFrame([("p1", "Ada", "a@x", ""), ("p2", "Bo", "b@x", "p1"), ("", "No", None, "p1")], "person_id string, full_name string, email string, manager_id string")
    m = J.EntityMapping("person", "people", "PersonRecord", ["person_id"], "{full_name}", ["email", "absent"], ["email"])
    d = J.DatasetMapping("hr", "company", [m], [J.RelationshipMapping("REPORTS-TO", "person", ["manager_id"], "person")])
    e = J.project_entities({"people": people}, d)
    assert rows(e, "record_key", "name", "properties") == [("p1", "Ada", '{"email":"[redacted]"}'), ("p2", "Bo", '{"email":"[redacted]"}')]
    assert rows(J.project_relationships({"people": people}, d), "predicate") == [("reports_to",)]
    with pytest.raises(ValueError, match="alias"):
        J.DatasetMapping("hr", "c", [m], [J.RelationshipMapping("x", "person", ["a"], "team")])


def test_readers(spark, tmp_path):
    (tmp_path / "people.csv").write_text('id,v\n1,007\n2,"a,b"\n')
    assert rows(readers.read_records(spark, "csv", str(tmp_path / "people.csv"), infer=True), "id", "v", "v__kind", "__source") == [("1", "007", "string", "people"), ("2", "a,b", "string", "people")]
    with pytest.raises(ValueError, match="email"):
        readers.read_csv(spark, str(tmp_path / "people.csv"), required=["email"])
    (tmp_path / "r.json").write_text(json.dumps({"records": [{"a": 1}, {"a": 2}]}))
    assert rows(readers.read_json(spark, str(tmp_path / "r.json")), "a") == [(1,), (2,)]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "l.jsonl"), row_limit=1).count() == 1
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "q"))
    assert rows(readers.read_parquet(spark, str(tmp_path / "q")), "row_number") == [(1,), (2,), (3,)]
    with sqlite3.connect(tmp_path / "d.db") as db:
        db.execute("create table events (id integer, name text)")
        db.execute("insert into events values (1, 'x'), (null, null)")
    assert rows(readers.read_sqlite(spark, str(tmp_path / "d.db")), "id", "name", "__source") == [(1, "x", "events"), (None, None, "events")]
    with pytest.raises(ValueError, match="connector"):
        readers.read_records(spark, "kafka", "x")


def test_extractor_graph_and_documents(spark, tmp_path):
    nodes = [{"id": "a", "label": "A", "type": "class"}, {"node_id": "b", "name": "B", "file": "f.py"}, {"id": "a", "label": "A2", "type": "class"}]
    (tmp_path / "g.json").write_text(json.dumps({"graph": {"nodes": nodes, "links": [{"source": "a", "target": "b", "relation": "uses"}, {"from": "a", "to": "zz"}]}}))
    n, e = readers.read_extractor_graph(spark, str(tmp_path / "g.json"))
    assert rows(n, "raw_id", "name") == [("a", "A2"), ("b", "B")] and rows(e, "source", "target", "relation") == [("a", "b", "uses")]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("hello")
    (tmp_path / "docs/empty.txt").write_text("  ")
    (tmp_path / "docs/x.py").write_text("x")
    assert rows(readers.read_documents(spark, str(tmp_path / "docs"))[0], "text") == [("hello",)]


def test_sinks_and_incremental_index(spark, tmp_path):
    s = "project_slug string, id string, content_hash string, ord int"
    embed = lambda df: df.withColumn("embedding", F.array(F.lit(1.0)))
    path = str(tmp_path / "index")
    index.apply_batch(spark.createDataFrame([("p", "1", "h1", 1), ("p", "1", "h2", 2)], s), path, embed)
    index.apply_batch(spark.createDataFrame([("p", "1", "h2", 3), ("p", "2", "h1", 3)], s), path, embed)
    assert rows(spark.read.parquet(path), "id", "content_hash", "ord") == [("1", "h2", 2), ("2", "h1", 3)]
    chunk = "project_slug string, id string, content_hash string, entity_ids array<string>, source_span_ids array<string>"
    one = spark.createDataFrame([("p", "1", "a", ["x", None, "y"], ["s", "s"]), ("p", "2", "b", None, None), ("q", "3", "c", [], None)], chunk)
    two = spark.createDataFrame([("p", "1", "a", ["x"], None), ("p", "4", "d", ["x"], None)], chunk)
    at = str(tmp_path / "synced")
    assert index.sync_index(one, at, embed) == {"new": 3} and index.sync_index(two, at, embed) == {"unchanged": 1, "deleted": 1, "new": 1}
    assert index.sync_index(two, at, embed) == {"unchanged": 2} and rows(spark.read.parquet(at), "project_slug", "id") == [("p", "1"), ("p", "4"), ("q", "3")]
    assert index.sync_index(two, at, embed, "other") == {"changed": 2}
    about, by = index.bridges(one)
    assert rows(about, "chunk_id", "entity_id", "ordinal") == [("1", "x", 0), ("1", "y", 2)] and rows(by, "chunk_id", "span_id") == [("1", "s")]
    for k in range(2):
        sinks.snapshot(spark.range(k + 1), str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap/previous")).count() == 1
    v = spark.createDataFrame([("1", "uses", "low_confidence"), ("2", "uses", None)], "id string, predicate string, reason string")
    assert sinks.write_rejects(v, str(tmp_path / "rej")) == 1
    spark.createDataFrame([("p", "9", "h", 1)], s).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s).parquet(str(tmp_path / "in"))
    index.index_stream(stream, path, str(tmp_path / "ck"), embed).awaitTermination()
    assert spark.read.parquet(path).count() == 3


def test_streamed_counts(spark, tmp_path):
    spark.createDataFrame([(T(2025, 1, 1, 0, 5), "a", 1.0), (T(2025, 1, 1, 0, 50), "a", 2.0)], "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "ev"))
    q = index.event_counts(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "ev"))).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.sql("select n, total from counts")) == [(2, 3.0)]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0])], "id int, embedding array<float>")
    assert rows(V.vector_top_k(df, "id", [1.0, 1.0], 4)) == [(1, 0.707107), (2, 0.707107)]
    with pytest.raises(ValueError, match="50"):
        V.vector_top_k(df, "id", [1.0], 51)


def test_search_and_enrichment(spark):
    e = spark.createDataFrame([entity(id="1", name="Gateway"), entity(id="2", name="Gateway Lite"), entity(id="3", name="x", aliases=["the gateway", None]), entity(id="4", name="Gateway", stale=True), entity(id="5", name=None)], ENTITY)
    assert [r["id"] for r in V.search_entities(e, "gateway").collect()] == ["1", "2", "3"]
    a = spark.createDataFrame([entity(id="c", type="Class", name="LeagueRatingsLoader"), entity(id="d", type="Class", name="Other")], ENTITY)
    s = spark.createDataFrame([entity(id="s", mapped_type="League", semantic_summary=True)], ENTITY)
    assert rows(V.enrichment(a, s), "entity_id", "summary_id") == [("c", "s")]


def test_insights(spark):
    e = spark.createDataFrame([entity(id="1", name="Alpha", source_path="services/a/x.py"), entity(id="2", name="Beta", source_path="services/b/y.py", type="Module"), entity(id="3", name="r", type="BusinessEntity", extraction_source="structured_connector", dataset="d", mapped_type="Row"), entity(id="4", name="any", type="Module")], ENTITY)
    a = spark.createDataFrame([assertion(id="x", subject_id="1", object_id="2", predicate="calls")], ASSERT)
    assert rows(I.hotspots(e, a), "id", "degree") == [("1", 1), ("2", 1)]
    assert rows(I.orphan_groups(e, a)) == [("d", "Row", 1)]
    assert rows(I.ownership_gaps(e)) == [("d", 1)]
    edges = E.resolved_edges(e, a, I.END_FACTS)
    assert rows(I.cross_boundaries(edges), "source_area", "target_area", "n") == [("services/a", "services/b", 1)]
    assert rows(R.architecture_groups(e), "id", "group") == [("1", "services/a"), ("2", "services/b"), ("4", "Module")]
    flagged = E.affected(spark.createDataFrame([("p", "1")], "project_slug string, id string"), edges)
    assert rows(I.affected_components(flagged, e), "direction", "name") == [("downstream", "Beta")]


def test_key_relationship_quotas(spark):
    e = spark.createDataFrame([entity(id=f"m{k}", name=f"m{k}", type="Module") for k in range(9)], ENTITY)
    a = spark.createDataFrame([assertion(id=f"a{k}", subject_id="m0", object_id=f"m{k}", predicate="depends_on") for k in range(1, 9)], ASSERT)
    got = R.key_relationships(E.resolved_edges(e, a, I.END_FACTS)).collect()
    assert max(sum(r["section"] == s for r in got) for s in {r["section"] for r in got}) == 3 and len({r["id"] for r in got}) == len(got)


def brute_key_relationships(edges, scores, sections, per_section=12):
    used, out = set(), []
    for name, predicates, types in sections:
        def belongs(r):
            if r["predicate"] in predicates:
                return True
            if r["predicate"] == "contains":
                return False
            if "BusinessEntity" in types:
                return "BusinessEntity" in (r["s_type"], r["o_type"])
            return bool({r["s_type"], r["o_type"], r["s_mapped_type"] or r["s_type"], r["o_mapped_type"] or r["o_type"]} & set(types))

        counts, n = {}, 0
        for r in sorted((r for r in edges if r["id"] not in used and belongs(r)), key=lambda r: (-scores[r["id"]], r["ord"], r["id"])):
            source = r["source_path"] or r["s_source_path"] or "synthetic"
            quotas = [(("s", source), 3), (("t", r["s_type"], r["o_type"]), 4), (("p", r["predicate"]), 4)] + ([(("c", source), 1)] if r["predicate"] == "contains" and r["s_type"] == "File" else [])
            if any(counts.get(k, 0) >= most for k, most in quotas):
                continue
            for k, _ in quotas:
                counts[k] = counts.get(k, 0) + 1
            n += 1
            out.append((name, n, r["id"]))
            if n == per_section:
                break
        used |= {i for s, _, i in out if s == name}
    return sorted(out)


def test_key_relationships_equal_a_plain_choice(spark):
    import random

    from weftgraph.model import SECTIONS

    r = random.Random(8)
    kinds = ["Module", "System", "File", "Class", "DataModel", "BusinessEntity", "Concept"]
    e = spark.createDataFrame([entity(id=f"e{k}", name=f"e{k}", type=r.choice(kinds), mapped_type=r.choice([None, None, "DataStore"]), source_path=r.choice([None, "a", "b", "c"])) for k in range(40)], ENTITY)
    a = spark.createDataFrame([assertion(id=f"a{k:04}", subject_id=f"e{r.randrange(40)}", object_id=f"e{r.randrange(40)}", predicate=r.choice(["depends_on", "contains", "uses", "calls", "exposes", "stores", "mentions", "defines"]), source_path=r.choice([None, *"xyzuvw"]), confidence=r.choice([0.5, 0.9]), ord=r.randrange(99)) for k in range(1500)], ASSERT)
    edges = E.resolved_edges(e, a, I.END_FACTS)
    scores = {x["id"]: x["score"] for x in R.relationship_scores(edges).collect()}
    got = [(x["section"], x["position"], x["id"]) for x in R.key_relationships(edges).collect()]
    assert sorted(got) == brute_key_relationships([x.asDict() for x in edges.collect()], scores, SECTIONS) and len(got) > 20
    worthy = {x["id"] for x in R.page_worthy(e, a, edges).collect()}
    ends = {x[c] for x in edges.collect() if x["id"] in {g[2] for g in got} for c in ("subject_id", "object_id")}
    assert ends <= worthy


def test_neighbours_by_relevance(spark):
    e = spark.createDataFrame([entity(id=k, name=k) for k in "abcdef"], ENTITY)
    a = spark.createDataFrame([
        assertion(id="1", subject_id="a", object_id="b", confidence=0.5), assertion(id="2", subject_id="c", object_id="a", confidence=0.96), assertion(id="3", subject_id="a", object_id="d", confidence=0.1, extraction_source="structured_connector"),
        assertion(id="4", subject_id="a", object_id="a", confidence=0.2), assertion(id="5", subject_id="a", object_id="e", predicate="owned_by", confidence=None),
    ], ASSERT)
    edges = E.resolved_edges(e, a)
    of_a = lambda df: [r["edge_id"] for r in df.where("entity_id = 'a'").orderBy("rank").collect()]
    assert of_a(E.top_neighbours(edges)) == ["2", "3", "4", "1", "5"]
    assert of_a(E.top_neighbours(edges, 2)) == ["2", "3"] and of_a(E.top_neighbours(edges, preferred=["own"])) == ["5"] and of_a(E.top_neighbours(edges, direction="incoming")) == ["2"]


def test_diff_of_assertions(spark):
    a, b = (spark.createDataFrame([assertion(id=k, subject_id="x", object_id="y") for k in ids] * 2, ASSERT) for ids in ("12", "23"))
    assert rows(M.diff_ids(a, b), "id", "change") == [("1", "removed"), ("3", "added")]


def test_planner():
    assert P.operation("Which customers have the most orders?") == "rank"
    assert P.operation("How many services use Alpha?") == "count"
    assert P.operation("What is the average price?") is None and P.operation("Who owns Alpha?") is None
    assert P.name_candidates("Who owns the Blue Gateway of Atlas?")[0] == "Blue Gateway"
    assert P.score_signature({"group_type": "A", "predicates": ["x"], "intermediate_types": [], "hops": 1, "examples": 3}, "most A", "rank") == float("-inf")
    assert P.evaluate([], lambda q: None) == {"pass_rate": 1.0, "refusal_rate": 1.0}
    cases = [{"question": "a", "should_answer": True, "expected_entities": ["Alpha"]}, {"question": "b", "should_answer": False}, {"question": "c", "should_answer": True}]

    def ask(q):
        if q == "c":
            raise RuntimeError
        return P.Answer("retrieved", "alpha it is") if q == "a" else P.Answer("refusal", "no")

    assert P.evaluate(cases, ask) == {"pass_rate": 2 / 3, "refusal_rate": 1.0}


def test_analytics_answers_a_ranking(spark):
    people = [entity(id=f"c{k}", type="Person", name=f"Person {k}") for k in range(3)] + [entity(id=f"o{k}", type="Task", name=f"t{k}") for k in range(6)] + [entity(id="u", type="Concept", name="Urgent")]
    links = [assertion(id=f"a{k}", subject_id=f"o{k}", object_id=f"c{0 if k < 4 else 1}", predicate="owned_by") for k in range(6)] + [assertion(id=f"b{k}", subject_id=f"o{k}", object_id="u", predicate="has_role") for k in range(6)]
    e = spark.createDataFrame(people, ENTITY)
    edges = E.resolved_edges(e, spark.createDataFrame(links, ASSERT))
    a = P.analytics("Which person has the most tasks with Urgent?", e, edges)
    assert a.kind == "rank" and a.rows[0]["name"] == "Person 0" and a.rows[0]["value"] == 4
    assert a.rows[0]["paths"][0].startswith("Person 0 → t")
    n = P.analytics("How many tasks are with Urgent?", e, edges)
    assert n.kind == "count" and n.text == "There are 6."
    assert P.answer("Who is Nobody?", e, edges, lambda q: [], None).kind == "refusal"


def test_analytics_follows_edges_against_their_direction(spark):
    """``owns`` from team to service answers what ``owned_by`` from service to team does; three hops do as well."""
    things = [entity(id="t1", type="Organization", name="Alpha"), entity(id="t2", type="Organization", name="Beta"), entity(id="o", type="Issue", name="Outage")] + [entity(id=f"s{k}", type="System", name=f"service {k}") for k in range(3)]
    things += [entity(id=f"m{k}", type="Module", name=f"module {k}") for k in range(3)]
    e = spark.createDataFrame(things, ENTITY)

    def ask(*links, question="Which organization has the most systems with Outage?"):
        data = [assertion(id=f"x{k}", subject_id=a, predicate=p, object_id=b) for k, (a, p, b) in enumerate(links)]
        return P.analytics(question, e, E.resolved_edges(e, spark.createDataFrame(data, ASSERT)))

    has = [(f"s{k}", "blocks", "o") for k in range(3)]
    for own in ([("s0", "owned_by", "t1"), ("s1", "owned_by", "t1"), ("s2", "owned_by", "t2")], [("t1", "manages", "s0"), ("t1", "manages", "s1"), ("t2", "manages", "s2")]):
        a = ask(*has, *own)
        assert [(r["name"], r["value"]) for r in a.rows] == [("Alpha", 2), ("Beta", 1)] and a.text == "Alpha ranks first with 2."
    long = [(f"m{k}", "blocks", "o") for k in range(3)] + [(f"m{k}", "part_of", f"s{k}") for k in range(3)] + [("t1", "manages", "s0"), ("t1", "manages", "s1"), ("t2", "manages", "s2")]
    assert [(r["name"], r["value"]) for r in ask(*long).rows] == [("Alpha", 2), ("Beta", 1)]


def test_vector_top_k_of_many_queries(spark):
    import numpy as np

    r = np.random.default_rng(2)
    v = {k: r.normal(size=5).tolist() for k in range(60)} | {60: None, 61: [0.0] * 5, 62: [1.0]}
    df = spark.createDataFrame([(k, x, "z") for k, x in v.items()], "vec_id long, embedding array<float>, score string")
    got = rows(V.vector_top_k_each(df, df.where("vec_id % 20 = 0"), "vec_id", 3), "query_id", "rank", "vec_id")
    unit = {k: np.array(x, dtype=np.float32).astype(float) / np.linalg.norm(np.array(x, dtype=np.float32).astype(float)) for k, x in v.items() if k < 60}
    assert got == [(q, n, k) for q in (0, 20, 40) for n, k in enumerate(sorted(unit, key=lambda k: (-round(float(unit[k] @ unit[q]), 6), k))[:3], 1)]
    assert V.vector_top_k_each(df.limit(0), df.limit(0), "vec_id").count() == 0


UNSAFE = ["select count(*) from v, secret", "select * from v join secret using (id)", "select id from v where id in (select id from secret)", "select (select max(id) from secret) from v", "select * from range(10)", "select * from v, range(3)", "with s as (select * from secret) select * from v, s", "select * from v lateral view explode(array(1)) t", "select * from (values (1)) t", "select id from v where exists (select 1 from secret)", "select java_method('a', 'b') from v", "", "drop table v", "select 1; select 2", "select * from v -- x", "select * from other", "select 1", "select reflect('a') from v", "insert into v values (1)", "select java_method('x') from v", "select * from `v`", "select * from v union select * from v", "select explode(array(1)) from v", "x" * 12_001]


@pytest.mark.parametrize("text", UNSAFE)
def test_guarded_sql_refuses(spark, text):
    spark.range(5).createOrReplaceTempView("v")
    spark.range(15).createOrReplaceTempView("secret")
    with pytest.raises(P.Refused):
        P.guarded_sql(spark, text, ["v"])


def test_guarded_sql_limits(spark):
    spark.range(5000).createOrReplaceTempView("v")
    assert P.guarded_sql(spark, "select max(a.id) as top, count(*) as n from v a, v b where a.id = b.id and a.id > 2 having count(*) > 1 order by n limit 5", ["v"]).count() == 1
    assert P.guarded_sql(spark, "select id from v", ["v"]).count() == 500


def test_queries_have_sql_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
