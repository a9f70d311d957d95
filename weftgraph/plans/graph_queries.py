"""Queries over the graph tables, each with its SQL; names begin with the operator's number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions import columns as C
from weftgraph.model import DEFAULT_PREDICATE_WEIGHT, ENTITY_TYPES, FLOW_PREDICATES, GENERIC_NAMES, HIDDEN_PATH_PARTS, HOTSPOT_TYPES, LINEAGE_TYPES, PREDICATE_ALIASES, PREDICATE_WEIGHTS, PREDICATES, STATUSES, TYPE_WEIGHTS, load_graph
from weftgraph.operators import chunks as K
from weftgraph.operators import edges as E
from weftgraph.operators import insights as I  # noqa: E741
from weftgraph.operators import merge as M
from weftgraph.operators import projection as J
from weftgraph.operators import quality as Q
from weftgraph.operators import rank as R
from weftgraph.operators import retrieval as V
from weftgraph.runtime import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
P = "project_slug"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _case(column: str, mapping: dict, default) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in mapping.items()) + f" ELSE {default} END"


# --- building blocks of the SQL ------------------------------------------------------------
_E = "e AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project_slug, id ORDER BY ord NULLS FIRST, ingested_at NULLS FIRST) AS rn FROM entities) WHERE rn = 1)"
_A = "a AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project_slug, id ORDER BY ord NULLS FIRST, created_at NULLS FIRST) AS rn FROM assertions) WHERE rn = 1)"
_S = "s AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project_slug, id ORDER BY ingested_at NULLS FIRST) AS rn FROM sources) WHERE rn = 1)"
_SP = "sp AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project_slug, id ORDER BY ingested_at NULLS FIRST) AS rn FROM source_spans) WHERE rn = 1)"
_CH = "ch AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project_slug, id ORDER BY ingested_at NULLS FIRST) AS rn FROM chunks) WHERE rn = 1)"
_LIVE = f"{_E}, live AS (SELECT * FROM e WHERE NOT coalesce(stale, false))"
_ENDS = ", ".join(f"{p}.{c} AS {p}_{c}" for p in ("s", "o") for c in I.END_FACTS)
_X = f"""{_LIVE}, {_A}, x AS (SELECT a.*, {_ENDS} FROM a
  JOIN live s ON s.project_slug = a.project_slug AND s.id = a.subject_id JOIN live o ON o.project_slug = a.project_slug AND o.id = a.object_id WHERE NOT coalesce(a.stale, false))"""
_SYM = f"""{_X}, sym AS (SELECT project_slug, id AS eid, predicate, subject_id AS a, object_id AS b, o_type AS b_type, confidence FROM x
  UNION ALL SELECT project_slug, id, predicate, object_id, subject_id, s_type, confidence FROM x WHERE subject_id <> object_id)"""
_DEG = f"""d AS (SELECT project_slug, id, sum(i) AS fan_in, sum(o) AS fan_out, count(*) AS degree, sum(w) AS weighted FROM (
  SELECT project_slug, subject_id AS id, 0 AS i, 1 AS o, {_case("predicate", PREDICATE_WEIGHTS, DEFAULT_PREDICATE_WEIGHT)} AS w FROM a
  UNION ALL SELECT project_slug, object_id, 1, 0, {_case("predicate", PREDICATE_WEIGHTS, DEFAULT_PREDICATE_WEIGHT)} FROM a) WHERE id IS NOT NULL GROUP BY ALL)"""


def _public(p: str = "") -> str:
    return f"(CASE WHEN {p}mapped_type IS NOT NULL AND {p}mapped_type <> '' THEN {p}mapped_type WHEN {p}type = 'BusinessEntity' THEN 'Concept' ELSE {p}type END)"


def _layer(p: str = "") -> str:
    return f"(CASE WHEN coalesce({p}extraction_source = 'structured_connector', false) OR coalesce({p}connector, '') <> '' THEN 'data' ELSE 'repo' END)"


def _test(p: str = "") -> str:
    t = f"lower(coalesce({p}name, '') || ' ' || coalesce({p}source_path, ''))"
    return f"(contains({t}, '/test') OR contains({t}, 'tests/') OR coalesce(starts_with({p}name, 'test_'), false))"


def _meaningful(p: str = "") -> str:
    n = f"trim(coalesce({p}name, ''), ' ')"
    return f"""({_layer(p)} = 'data' OR ({n} <> '' AND lower({n}) NOT IN ({_list(GENERIC_NAMES)}) AND NOT {_test(p)} AND NOT regexp_matches(lower({n}), '^(oe:|entity_)')
      AND NOT (upper({n}) = {n} AND lower({n}) <> {n} AND contains({n}, '_')) AND length({n}) <= 80 AND len(list_filter(regexp_split_to_array({n}, '\\s+'), lambda w: w <> '')) <= 8 AND NOT ends_with({n}, '.')))"""


def _area(p: str = "") -> str:
    path = f"regexp_replace(coalesce({p}source_path, ''), '^/+|/+$', '', 'g')"
    return f"(CASE WHEN {p}community IS NOT NULL AND {p}community <> '' THEN {p}community WHEN {path} = '' THEN {_public(p)} ELSE array_to_string(list_filter(string_split({path}, '/'), lambda y: y NOT IN ('data', 'raw'))[1:2], '/') END)"


def _visible(p: str = "") -> str:
    parts = f"list_filter(string_split(replace(lower(coalesce({p}source_path, '')), '\\', '/'), '/'), lambda y: y <> '')"
    hidden = f"(list_has_any({parts}, [{_list(HIDDEN_PATH_PARTS)}]) OR len(list_filter({parts}, lambda y: starts_with(y, 'test_'))) > 0)"
    return f"(NOT {hidden} AND NOT (len({parts}) = 0 AND lower(coalesce({p}type, '')) IN ('class', 'function', 'method')))"


def _sid(prefix: str, *parts: str) -> str:
    return f"'{prefix}_' || substr(sha256(concat_ws('::', {', '.join(f'coalesce(CAST({x} AS VARCHAR), {chr(39)*2})' for x in parts)})), 1, 16)"


def _evidence() -> str:
    return "(CASE WHEN coalesce(extraction_source = 'structured_connector', false) THEN 'authoritative' WHEN coalesce(evidence_text, '') <> '' OR coalesce(source_path, '') <> '' THEN 'evidence_backed' ELSE 'weak' END)"


def _opaque(c: str) -> str:
    return f"coalesce(regexp_matches(lower(trim({c})), '^(oe:|entity_)|^[0-9a-f-]{{18,}}$|[0-9a-f]{{24,}}'), false)"


def _graph(spark: SparkSession, d: str):
    return load_graph(spark, d)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return E.resolved_edges(g.entities, g.assertions, I.END_FACTS)


# --- A: sources --------------------------------------------------------------------------
@query("SELECT source, count(*) AS records FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS source FROM {t}" for t in ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")) + ") GROUP BY 1")
def a12_inspect(spark, d):
    parts = [table(spark, d, t).agg(F.count("*").alias("records")).select(F.lit(t).alias("source"), "records") for t in ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN v IS NULL OR v = '' THEN 'empty' WHEN lower(v) IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(v, '^(0|[1-9][0-9]*)$') THEN 'int'
    WHEN regexp_matches(v, '[.eE]') AND regexp_matches(v, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'float' ELSE 'string' END AS kind
    FROM (SELECT record_key AS v FROM entities UNION ALL SELECT name FROM entities)) GROUP BY 1"""
)
def a2_value_kinds(spark, d):
    e = table(spark, d, "entities")
    return e.select(F.explode(F.array("record_key", "name")).alias("v")).groupBy(C.value_kind("v").alias("kind")).agg(F.count("*").alias("n"))


# --- B: projections and predicates ---------------------------------------------------------
_MAP = J.DatasetMapping(
    "sales", "commerce",
    [
        J.EntityMapping("customer", "customer", "Customer", ["c_custkey"], "{c_name}", ["c_mktsegment", "c_acctbal"], ["c_acctbal"]),
        J.EntityMapping("nation", "nation", "Nation", ["n_nationkey"], "{n_name}", ["n_name"]),
        J.EntityMapping("order", "orders", "Order", ["o_orderkey"], "Order {o_orderkey}", ["o_orderpriority"]),
        J.EntityMapping("part", "part", "Part", ["p_partkey"], "{p_name} {p_partkey}", ["p_brand"]),
    ],
    [J.RelationshipMapping("LOCATED_IN", "customer", ["c_nationkey"], "nation"), J.RelationshipMapping("PLACED-BY", "order", ["o_custkey"], "customer")],
)


def _tables(spark, d):
    return {t: table(spark, d, t) for t in ("customer", "nation", "orders", "part")}


_PROJECTED = f"""
SELECT {_sid("entity", "'commerce'", "'Customer'", "c_custkey")} AS id, 'Customer' AS type, c_name AS name, CAST(c_custkey AS VARCHAR) AS record_key FROM customer
UNION ALL SELECT {_sid("entity", "'commerce'", "'Nation'", "n_nationkey")}, 'Nation', n_name, CAST(n_nationkey AS VARCHAR) FROM nation
UNION ALL SELECT {_sid("entity", "'commerce'", "'Order'", "o_orderkey")}, 'Order', 'Order ' || o_orderkey, CAST(o_orderkey AS VARCHAR) FROM orders
UNION ALL SELECT {_sid("entity", "'commerce'", "'Part'", "p_partkey")}, 'Part', p_name || ' ' || p_partkey, CAST(p_partkey AS VARCHAR) FROM part"""


@query(f"SELECT DISTINCT * FROM ({_PROJECTED})")
def b1_entities(spark, d):
    return J.project_entities(_tables(spark, d), _MAP).select("id", "type", "name", "record_key")


@query("SELECT l_orderkey || '|' || l_linenumber AS record_key, count(*) AS rows FROM lineitem GROUP BY 1")
def b2_composite_key(spark, d):
    return table(spark, d, "lineitem").groupBy(J.key_of(["l_orderkey", "l_linenumber"]).alias("record_key")).agg(F.count("*").alias("rows"))


@query("SELECT p_partkey, p_name || ' ' || p_partkey || ' ()' AS name FROM part")
def b3_name_template(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", J.from_template("{p_name} {p_partkey} ({absent})", p.columns).alias("name"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS record_key, c_mktsegment AS segment, CASE WHEN c_acctbal IS NOT NULL THEN '[redacted]' END AS balance FROM customer")
def b4_redaction(spark, d):
    rows = J.map_entities(table(spark, d, "customer"), _MAP.entities[0], "commerce", "sales")
    return rows.select("record_key", F.get_json_object("properties", "$.c_mktsegment").alias("segment"), F.get_json_object("properties", "$.c_acctbal").alias("balance"))


@query(f"WITH {_LIVE} SELECT project_slug, count(*) AS n FROM live GROUP BY 1")
def b7_live_entities(spark, d):
    return M.live(_graph(spark, d).entities).groupBy(P).agg(F.count("*").alias("n"))


@query(f"WITH {_X} SELECT CASE WHEN {_layer('s_')} = 'data' OR {_layer('o_')} = 'data' OR extraction_source = 'structured_connector' THEN 'data' ELSE 'repo' END AS layer, count(*) AS n FROM x GROUP BY 1")
def b9_edge_layers(spark, d):
    data = (C.layer("s_") == "data") | (C.layer("o_") == "data") | F.coalesce(F.col("extraction_source") == "structured_connector", F.lit(False))
    return _edges(spark, d).groupBy(F.when(data, "data").otherwise("repo").alias("layer")).agg(F.count("*").alias("n"))


_NORM = "regexp_replace(lower(trim(predicate)), '[- ]', '_', 'g')"


@query(f"SELECT predicate, {_case(_NORM, {k: v for k, v in PREDICATE_ALIASES.items()}, _NORM)} AS normal, count(*) AS n FROM assertions GROUP BY ALL")
def b10_predicate_norm(spark, d):
    return table(spark, d, "assertions").groupBy("predicate", C.normal_predicate("predicate").alias("normal")).agg(F.count("*").alias("n"))


@query(f"SELECT 'predicate' AS what, predicate AS value, count(*) AS n FROM assertions WHERE coalesce(predicate NOT IN ({_list(PREDICATES)}), true) GROUP BY ALL UNION ALL SELECT 'type', type, count(*) FROM entities WHERE coalesce(type NOT IN ({_list(ENTITY_TYPES)}), true) GROUP BY ALL UNION ALL SELECT 'status', status, count(*) FROM assertions WHERE coalesce(status NOT IN ({_list(STATUSES)}), true) GROUP BY ALL")
def b11_vocabulary(spark, d):
    def outside(t, c, allowed, what):
        return table(spark, d, t).where(~F.coalesce(F.col(c).isin(list(allowed)), F.lit(False))).groupBy(F.lit(what).alias("what"), F.col(c).alias("value")).agg(F.count("*").alias("n"))

    return outside("assertions", "predicate", PREDICATES, "predicate").unionByName(outside("entities", "type", ENTITY_TYPES, "type")).unionByName(outside("assertions", "status", STATUSES, "status"))


@query(f"WITH {_E} SELECT project_slug, id FROM e WHERE {_test()}")
def b12_test_entities(spark, d):
    return _graph(spark, d).entities.where(C.is_test()).select(P, "id")


@query(f"WITH {_E} SELECT project_slug, id, name FROM e WHERE {_opaque('name')}")
def b13_opaque_names(spark, d):
    return _graph(spark, d).entities.where(C.is_opaque("name")).select(P, "id", "name")


@query(f"WITH {_E} SELECT type, count(*) AS n FROM e WHERE {_meaningful()} GROUP BY 1")
def b14_meaningful(spark, d):
    return _graph(spark, d).entities.where(C.is_meaningful()).groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {_E} SELECT project_slug, id FROM e WHERE {_layer()} = 'repo' AND type IN ({_list(HOTSPOT_TYPES)}) AND {_meaningful()}")
def b15_actionable(spark, d):
    return _graph(spark, d).entities.where(C.is_actionable()).select(P, "id")


@query(f"WITH {_E} SELECT project_slug, id FROM e WHERE {_layer()} = 'repo' AND {_visible()}")
def b16_visible(spark, d):
    return _graph(spark, d).entities.where((C.layer() == "repo") & C.is_visible_architecture()).select(P, "id")


@query(f"WITH {_LIVE} SELECT project_slug, id, name, type, rank, length FROM (SELECT *, CASE WHEN lower(coalesce(name, '')) = 'gateway' THEN 0 WHEN starts_with(lower(coalesce(name, '')), 'gateway') THEN 1 ELSE 2 END AS rank, CAST(length(name) AS INTEGER) AS length FROM live WHERE contains(lower(coalesce(name, '')), 'gateway') OR contains(lower(coalesce(normalized_name, '')), 'gateway') OR len(list_filter(coalesce(aliases, []), lambda y: coalesce(contains(lower(y), 'gateway'), false))) > 0) ORDER BY rank, length NULLS FIRST, name NULLS FIRST, project_slug, id LIMIT 50")
def b17_search(spark, d):
    return V.search_entities(_graph(spark, d).entities, "Gateway")


@query(f"WITH {_A} SELECT {_evidence()} AS level, count(*) AS n FROM a GROUP BY 1")
def b20_edge_evidence(spark, d):
    return _graph(spark, d).assertions.groupBy(C.edge_evidence().alias("level")).agg(F.count("*").alias("n"))


@query(f"""WITH {_E}, {_A}, l AS (SELECT project_slug, id, coalesce(extraction_source = 'structured_connector', false) AS st, len(coalesce(source_span_ids, [])) > 0 OR coalesce(graphify_id, '') <> '' AS evid, true AS known FROM e
  UNION ALL SELECT project_slug, unnest([subject_id, object_id]), coalesce(extraction_source = 'structured_connector', false), coalesce(evidence_text, '') <> '', false FROM a)
SELECT project_slug, id, CASE WHEN bool_or(st) AND NOT bool_and(st) THEN 'mixed' WHEN bool_or(st) THEN 'authoritative' WHEN bool_or(evid) THEN 'evidence_backed' ELSE 'weak' END AS evidence_level FROM l GROUP BY ALL HAVING bool_or(known)""")
def b21_entity_evidence(spark, d):
    g = _graph(spark, d)
    return K.entity_evidence(g.entities, g.assertions)


@query(f"WITH {_E} SELECT {_public()} AS public_type, count(*) AS n FROM e GROUP BY 1")
def b23_public_types(spark, d):
    return _graph(spark, d).entities.groupBy(C.public_type().alias("public_type")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT predicate, CASE WHEN t <> '' THEN t ELSE 'RELATED_TO' END AS relationship_type FROM (SELECT predicate, upper(regexp_replace(regexp_replace(predicate, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS t FROM assertions)")
def b24_relationship_types(spark, d):
    return table(spark, d, "assertions").select("predicate", C.relationship_type("predicate").alias("relationship_type")).distinct()


@query("SELECT count(*) AS n, round(sum(greatest(0.0, least(1.0, coalesce(confidence, 0.7)))), 4) AS total FROM assertions")
def b28_clamped_confidence(spark, d):
    return table(spark, d, "assertions").agg(F.count("*").alias("n"), F.round(F.sum(C.clamp("confidence")), 4).alias("total"))


# --- C: joins ----------------------------------------------------------------------------
_CUST, _NAT, _ORD = _sid("entity", "'commerce'", "'Customer'", "c_custkey"), _sid("entity", "'commerce'", "'Nation'", "n_nationkey"), _sid("entity", "'commerce'", "'Order'", "o_orderkey")


@query(f"SELECT DISTINCT 'located_in' AS predicate, {_CUST} AS subject_id, {_NAT} AS object_id FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT DISTINCT 'placed_by', {_ORD}, {_CUST} FROM orders JOIN customer ON o_custkey = c_custkey")
def c1_relationships(spark, d):
    return J.project_relationships(_tables(spark, d), _MAP).select("predicate", "subject_id", "object_id")


_NORMAL = _case(_NORM, {k: v for k, v in PREDICATE_ALIASES.items()}, _NORM)
_VALID = f"""{_E}, {_A}, {_SP}, v AS (SELECT a.* REPLACE ({_NORMAL} AS predicate), CASE
  WHEN coalesce({_NORMAL} NOT IN ({_list(PREDICATES)}), true) AND NOT coalesce(extractor = 'structured_connector', false) THEN 'invalid_predicate'
  WHEN NOT EXISTS (SELECT 1 FROM e WHERE e.project_slug = a.project_slug AND e.id = a.subject_id) OR NOT EXISTS (SELECT 1 FROM e WHERE e.project_slug = a.project_slug AND e.id = a.object_id) THEN 'missing_entity'
  WHEN NOT EXISTS (SELECT 1 FROM sp WHERE sp.project_slug = a.project_slug AND sp.id = a.evidence_span_id) THEN 'missing_evidence'
  WHEN coalesce(confidence, 0) < 0.5 THEN 'confidence_below_threshold' END AS reason FROM a)"""


def _validated(spark, d):
    g = _graph(spark, d)
    return Q.validate(g.assertions, g.entities, g.spans)


@query(f"WITH {_VALID} SELECT project_slug, id, reason FROM v WHERE reason IS NOT NULL UNION ALL SELECT project_slug, id, 'invalid_entity_type' FROM e WHERE coalesce(type NOT IN ({_list(ENTITY_TYPES)}), true)")
def c2_rejects(spark, d):
    bad = Q.rejected_entities(_graph(spark, d).entities)
    return _validated(spark, d).where("reason is not null").select(P, "id", "reason").unionByName(bad)


@query(f"WITH {_X} SELECT project_slug, id, predicate, s_name, o_name FROM x")
def c3_edges(spark, d):
    return _edges(spark, d).select(P, "id", "predicate", "s_name", "o_name")


_SLUG = "regexp_replace(regexp_replace(lower(trim(coalesce(nullif(normalized_name, ''), name), ' ')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_CANON = f"replace(CASE WHEN {_SLUG} = '' THEN 'untitled' ELSE {_SLUG} END, '-', ' ')"
_RES = f"""r AS (SELECT *, CASE WHEN coalesce(extraction_source = 'structured_connector', false) AND coalesce(domain, '') <> '' AND coalesce(mapped_type, '') <> '' AND coalesce(record_key, '') <> '' THEN {_sid("entity", "project_slug", "'structured'", "domain", "mapped_type", "record_key")}
  ELSE {_sid("entity", "project_slug", "'named'", _CANON, "type")} END AS resolved_id FROM e)"""


@query(f"""WITH {_E}, {_A}, {_RES} SELECT project_slug, {_sid("assertion", "project_slug", "id")} AS id, subject_id, object_id FROM (
SELECT a.project_slug, a.id, coalesce(s.resolved_id, a.subject_id) AS subject_id, coalesce(o.resolved_id, a.object_id) AS object_id FROM a
LEFT JOIN r s ON s.project_slug = a.project_slug AND s.id = a.subject_id LEFT JOIN r o ON o.project_slug = a.project_slug AND o.id = a.object_id)""")
def c4_id_remap(spark, d):
    g = _graph(spark, d)
    return Q.remap_assertions(g.assertions, Q.resolution_key(g.entities)).select(P, "id", "subject_id", "object_id")


@query(f"""WITH {_LIVE} SELECT project_slug, id, name, type, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY project_slug ORDER BY length(name) NULLS FIRST, name NULLS FIRST, id) AS INTEGER) AS rank FROM live
WHERE coalesce(lower(name) IN ('contract 10000', 'vault'), false) OR coalesce(normalized_name IN ('contract 10000', 'vault'), false) OR len(list_filter(coalesce(aliases, []), lambda y: coalesce(lower(y) IN ('contract 10000', 'vault'), false))) > 0) WHERE rank <= 4""")
def c5_exact_lookup(spark, d):
    return V.exact_lookup(_graph(spark, d).entities, ["Contract 10000", "Vault"])


_REL = "CASE WHEN coalesce(confidence, 0) >= 0.95 THEN 2 WHEN extraction_source = 'structured_connector' THEN 3 ELSE 10 END AS relevance"
_NB = f"""{_X}, nb AS (SELECT project_slug, id AS edge_id, {_REL}, subject_id AS entity_id, object_id AS neighbour_id, o_name AS neighbour, 'outgoing' AS direction FROM x
UNION ALL SELECT project_slug, id, {_REL}, object_id, subject_id, s_name, 'incoming' FROM x WHERE subject_id <> object_id)"""


@query(f"""WITH {_NB} SELECT project_slug, entity_id, edge_id, neighbour_id, direction, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY project_slug, entity_id ORDER BY relevance, neighbour NULLS FIRST, edge_id, direction) AS INTEGER) AS rank FROM nb) WHERE rank <= 6""")
def c6_neighbors_top6(spark, d):
    return E.top_neighbours(_edges(spark, d)).select(P, "entity_id", "edge_id", "neighbour_id", "direction", "rank")


@query(f"WITH {_SYM} SELECT project_slug, a, count(*) AS trails FROM sym GROUP BY ALL")
def c7_trails_1hop(spark, d):
    return E.trails(_edges(spark, d), [None]).groupBy(P, F.get("nodes", F.lit(0)).alias("a")).agg(F.count("*").alias("trails"))


@query(f"WITH {_SYM} SELECT u.project_slug, count(*) AS trails FROM sym u JOIN sym v ON u.project_slug = v.project_slug AND u.b = v.a AND u.eid <> v.eid GROUP BY ALL")
def c7_trails_2hop(spark, d):
    counted = E.trail_count_2(_edges(spark, d))
    return counted.where("trails > 0")


@query(f"WITH {_SYM} SELECT u.project_slug, u.a AS first, w.b AS last, count(*) AS trails FROM sym u JOIN sym v ON u.project_slug = v.project_slug AND u.b = v.a AND u.eid <> v.eid JOIN sym w ON v.project_slug = w.project_slug AND v.b = w.a AND w.eid <> v.eid AND w.eid <> u.eid WHERE u.predicate = 'mentions' AND v.predicate = 'uses' AND w.predicate = 'depends_on' GROUP BY ALL")
def c7_trails_3hop(spark, d):
    t = E.trails(_edges(spark, d), ["mentions", "uses", "depends_on"])
    return t.groupBy(P, F.get("nodes", F.lit(0)).alias("first"), F.get("nodes", F.lit(3)).alias("last")).agg(F.count("*").alias("trails"))


_NEED = "list_transform(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda y: length(y) > 2), lambda y: regexp_replace(regexp_replace(y, 'ing$', ''), 's$', ''))"


@query(f"""WITH {_E}, c AS (SELECT project_slug, id, {_NEED.format("concat_ws(' ', name, description, source_path)")} AS have FROM e WHERE {_layer()} = 'repo' AND type IN ('System', 'Package', 'Module', 'File', 'Class', 'DataModel', 'APIEndpoint', 'Workflow')),
m AS (SELECT project_slug, id, {_NEED.format("coalesce(mapped_type, type)")} AS need FROM e WHERE type IN ('DataStore', 'Queue'))
SELECT DISTINCT c.project_slug, c.id AS entity_id, m.id AS summary_id FROM c JOIN m USING (project_slug) WHERE len(need) > 0 AND list_has_all(have, need) ORDER BY 2, 3 LIMIT 100""")
def c10_enrichment(spark, d):
    e = _graph(spark, d).entities
    kinds = ["System", "Package", "Module", "File", "Class", "DataModel", "APIEndpoint", "Workflow"]
    return V.enrichment(e.where((C.layer() == "repo") & F.col("type").isin(kinds)), e.where(F.col("type").isin("DataStore", "Queue")))


@query(f"""WITH {_E}, {_S}, {_SP}, {_CH}, f AS (SELECT project_slug, split_part(source_path, '#', 1) AS path, arg_min(id, struct_pack(o := coalesce(ord, -1), i := id)) AS entity_id FROM e WHERE source_path IS NOT NULL GROUP BY ALL)
SELECT ch.project_slug, ch.id AS chunk_id, f.entity_id, s.path AS source_path, ch.ordinal, CAST(length(coalesce(ch.text, '')) AS INTEGER) AS chars FROM ch JOIN sp ON sp.project_slug = ch.project_slug AND lower(trim(sp.id)) = lower(trim(ch.source_span_id))
JOIN s ON s.project_slug = sp.project_slug AND lower(trim(s.id)) = lower(trim(sp.source_id)) AND s.source_type = 'document' JOIN f ON f.project_slug = s.project_slug AND f.path = s.path""")
def c11_document_chunks(spark, d):
    g = _graph(spark, d)
    return K.document_chunks(g.sources, g.spans, g.chunks, g.entities)


@query(f"""WITH {_S}, {_SP}, {_CH}, n AS (SELECT sp.project_slug, lower(trim(sp.source_id)) AS k, count(DISTINCT sp.id) AS spans, count(DISTINCT ch.id) AS chunks FROM sp LEFT JOIN ch ON ch.project_slug = sp.project_slug AND lower(trim(ch.source_span_id)) = lower(trim(sp.id)) GROUP BY ALL)
SELECT s.project_slug, s.id, s.path, s.source_type, coalesce(spans, 0) AS spans, coalesce(chunks, 0) AS chunks FROM s LEFT JOIN n ON n.project_slug = s.project_slug AND n.k = lower(trim(s.id))""")
def c12_sources(spark, d):
    g = _graph(spark, d)
    return K.span_listing(g.sources, g.spans, g.chunks)


@query(f"""WITH {_SP}, {_CH} SELECT sp.project_slug, lower(trim(sp.source_id)) AS source_id, sp.id AS span_id, sp.start_pos, c.ordinal, coalesce(c.text, sp.text) AS text FROM sp LEFT JOIN (SELECT * FROM ch WHERE text IS NOT NULL) c ON c.project_slug = sp.project_slug AND lower(trim(c.source_span_id)) = lower(trim(sp.id))""")
def c13_source_text(spark, d):
    g = _graph(spark, d)
    return K.source_text(g.spans, g.chunks)


# --- snapshots: changes and what they affect -------------------------------------------------
_LAST2 = """z AS (SELECT project_slug, snapshot_no, dense_rank() OVER (PARTITION BY project_slug ORDER BY snapshot_no DESC) AS r FROM (SELECT DISTINCT project_slug, snapshot_no FROM entity_snapshots WHERE project_slug IS NOT NULL AND snapshot_no IS NOT NULL)),
h AS (SELECT s.project_slug, s.id, z.r, max(struct_pack(a := coalesce(s.delivered_at, TIMESTAMP '0001-01-01'), d := description, c := community, p := source_path, n := name, t := type)) AS x FROM entity_snapshots s JOIN z USING (project_slug, snapshot_no) WHERE z.r <= 2 AND s.id IS NOT NULL GROUP BY ALL),
ch2 AS (SELECT coalesce(n.project_slug, o.project_slug) AS project_slug, coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'modified' END AS change
  FROM (SELECT * FROM h WHERE r = 1) n FULL JOIN (SELECT * FROM h WHERE r = 2) o ON n.project_slug = o.project_slug AND n.id = o.id
  WHERE coalesce(n.project_slug, o.project_slug) IN (SELECT project_slug FROM z WHERE r = 2) AND (o.id IS NULL OR n.id IS NULL OR n.x.d IS DISTINCT FROM o.x.d OR n.x.p IS DISTINCT FROM o.x.p))"""


def _recent_changes(spark, d) -> DataFrame:
    """``(project_slug, id, change)`` of each project's last two snapshots; a change of community alone is none."""
    from weftgraph.operators.snapshot_diff import snapshot_changes

    s = table(spark, d, "entity_snapshots")
    last = s.groupBy(P).agg(F.max("snapshot_no").alias("last"))
    changes = snapshot_changes(s, fields=("description", "source_path")).join(last, [P]).where("snapshot_no = last")
    return changes.select(P, F.col("entity_id").alias("id"), "change").distinct()


@query(f"WITH {_LAST2} SELECT project_slug, change, count(*) AS n FROM ch2 GROUP BY ALL")
def c9_diff_entities(spark, d):
    return _recent_changes(spark, d).groupBy(P, "change").agg(F.count("*").alias("n"))


@query(f"WITH {_LAST2}, {_X} SELECT x.project_slug, x.id, CASE WHEN s.id IS NOT NULL THEN 'downstream' ELSE 'upstream' END AS direction, CASE WHEN s.id IS NOT NULL THEN object_id ELSE subject_id END AS neighbour_id FROM x LEFT JOIN ch2 s ON s.project_slug = x.project_slug AND s.id = x.subject_id LEFT JOIN ch2 o ON o.project_slug = x.project_slug AND o.id = x.object_id WHERE (s.id IS NULL) <> (o.id IS NULL)")
def c14_affected(spark, d):
    return E.affected(_recent_changes(spark, d), _edges(spark, d)).select(P, "id", "direction", "neighbour_id")


@query(f"WITH {_LAST2}, {_E} SELECT change, CAST(count_if(NOT ({_layer()} = 'data' OR coalesce(type = 'BusinessEntity', false))) AS BIGINT) AS architecture, CAST(count_if({_layer()} = 'data' OR coalesce(type = 'BusinessEntity', false)) AS BIGINT) AS business FROM ch2 JOIN e USING (project_slug, id) GROUP BY 1")
def d19_change_counts(spark, d):
    return I.change_counts(_recent_changes(spark, d).join(_graph(spark, d).entities, [P, "id"]))


_PATH1 = "list_filter(string_split(replace(coalesce(source_path, ''), '\\', '/'), '/'), lambda y: y NOT IN ('.', '..'))[1]"
_GRP = f"CASE WHEN coalesce(dataset, '') <> '' THEN dataset || ' · ' || CASE WHEN coalesce(mapped_type, '') <> '' THEN mapped_type ELSE {_public()} END WHEN coalesce(community, '') <> '' THEN community WHEN coalesce({_PATH1}, '') <> '' THEN {_PATH1} ELSE {_public()} END"


@query(f"""WITH {_LAST2}, {_E}, g AS (SELECT CASE WHEN coalesce(dataset, '') <> '' THEN 'Business data' ELSE 'Architecture' END AS category, {_GRP} AS label, CASE WHEN (type <> 'BusinessEntity' OR coalesce(semantic_summary, false)) AND NOT {_opaque('name')} THEN name END AS shown FROM ch2 JOIN e USING (project_slug, id) WHERE change = 'added')
SELECT category, label, count(*) AS n, coalesce(list_sort(list(DISTINCT shown) FILTER (shown IS NOT NULL))[1:5], []) AS representatives FROM g GROUP BY ALL""")
def d16_change_groups(spark, d):
    return I.change_groups(_recent_changes(spark, d).where("change = 'added'").join(_graph(spark, d).entities, [P, "id"]))


@query(f"WITH {_E} SELECT project_slug, id, NOT EXISTS (SELECT 1 FROM entity_snapshots s WHERE s.project_slug = e.project_slug AND s.id = e.id) OR coalesce(stale, false) AS stale FROM e")
def c17_prune_stale(spark, d):
    return M.prune_stale(_graph(spark, d).entities, table(spark, d, "entity_snapshots")).select(P, "id", "stale")


@query(f"WITH {_E} SELECT project_slug, id FROM e WHERE EXISTS (SELECT 1 FROM entity_snapshots s WHERE s.project_slug = e.project_slug AND s.id = e.id)")
def c16_semi_in_snapshots(spark, d):
    return M.prune_delete(_graph(spark, d).entities, table(spark, d, "entity_snapshots")).select(P, "id")


_KC = "kc AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project_slug, id ORDER BY content_hash NULLS FIRST, embedding_model NULLS FIRST) AS rn FROM knowledge_chunks) WHERE rn = 1)"


@query(f"WITH {_KC}, st AS (SELECT * FROM kc WHERE embedding IS NOT NULL) SELECT coalesce(c.project_slug, s.project_slug) AS project_slug, coalesce(c.id, s.id) AS id, CASE WHEN s.id IS NULL THEN 'new' WHEN c.content_hash IS NOT DISTINCT FROM s.content_hash AND c.embedding_model IS NOT DISTINCT FROM s.embedding_model THEN 'unchanged' ELSE 'changed' END AS state FROM kc c LEFT JOIN st s ON s.project_slug = c.project_slug AND s.id = c.id")
def c18_changed_chunks(spark, d):
    now = table(spark, d, "knowledge_chunks").select(P, "id", "content_hash", "embedding_model", F.col("embedding").isNotNull().alias("done"))
    now = M.first_wins(now, (P, "id"), ("content_hash", "embedding_model"))
    kept = M.first_wins(table(spark, d, "knowledge_chunks").select(P, "id", "content_hash", "embedding_model", F.col("embedding").alias("v")), (P, "id"), ("content_hash", "embedding_model")).where("v is not null")
    return K.index_plan(now, kept)


@query(f"WITH {_E}, {_A} SELECT project_slug, id, list_sort(list(DISTINCT span)) AS spans FROM (SELECT project_slug, subject_id AS id, evidence_span_id AS span FROM a UNION ALL SELECT project_slug, object_id, evidence_span_id FROM a UNION ALL SELECT project_slug, id, unnest(source_span_ids) FROM e) WHERE span IS NOT NULL AND id IS NOT NULL GROUP BY ALL")
def c21_evidence_union(spark, d):
    g = _graph(spark, d)
    a = g.assertions.select(P, F.explode(F.array("subject_id", "object_id")).alias("id"), F.col("evidence_span_id").alias("span"))
    both = a.unionByName(g.entities.select(P, "id", F.explode("source_span_ids").alias("span")))
    return both.where("span is not null and id is not null").groupBy(P, "id").agg(F.array_sort(F.collect_set("span")).alias("spans"))


# --- D: aggregations ---------------------------------------------------------------------
@query(f"WITH {_E} SELECT type, count(*) AS n FROM e GROUP BY 1")
def d1_type_counts(spark, d):
    return _graph(spark, d).entities.groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {_A}, {_DEG} SELECT project_slug, id, CAST(fan_in AS BIGINT) AS fan_in, CAST(fan_out AS BIGINT) AS fan_out, degree FROM d")
def d2_degree(spark, d):
    return E.degrees(_graph(spark, d).assertions).select(P, "id", "fan_in", "fan_out", "degree")


@query(f"WITH {_A}, {_DEG} SELECT project_slug, id, CAST(weighted AS BIGINT) AS weighted FROM d")
def d3_weighted_degree(spark, d):
    return E.degrees(_graph(spark, d).assertions).select(P, "id", "weighted")


@query("SELECT 'customer_' || o_custkey AS candidate, c_name AS name, count(DISTINCT o_orderkey) AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY ALL ORDER BY value DESC, name NULLS FIRST, candidate LIMIT 100")
def d4_path_rank(spark, d):
    """Which customers have the most urgent orders: customer - order - priority."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    order = F.concat(F.lit("order_"), F.col("o_orderkey"))
    placed = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.lit("sales").alias(P), F.lit("placed_by").alias("predicate"), order.alias("subject_id"), F.concat(F.lit("customer_"), F.col("o_custkey")).alias("object_id"), F.lit("Customer").alias("o_type"), F.col("c_name").alias("o_name"), F.lit("Order").alias("s_type"), order.alias("s_name"), F.concat(F.lit("p"), order).alias("id"))
    urgent = o.select(F.lit("sales").alias(P), F.lit("has_priority").alias("predicate"), order.alias("subject_id"), F.concat(F.lit("priority_"), F.col("o_orderpriority")).alias("object_id"), F.lit("Priority").alias("o_type"), F.col("o_orderpriority").alias("o_name"), F.lit("Order").alias("s_type"), order.alias("s_name"), F.concat(F.lit("u"), order).alias("id"))
    start = spark.createDataFrame([("sales", "priority_1-URGENT")], f"{P} string, a string")
    return E.path_rank(placed.unionByName(urgent), ["placed_by", "has_priority"], "Customer", "Order", start).select("candidate", "name", "value")


@query(f"WITH {_X} SELECT s_type AS group_type, predicate, count(DISTINCT struct_pack(p := project_slug, i := subject_id)) AS candidates, list_sort(list(DISTINCT s_name) FILTER (s_name IS NOT NULL))[1:3] AS samples FROM x GROUP BY ALL")
def d5_path_count(spark, d):
    e = _edges(spark, d)
    return e.groupBy(F.col("s_type").alias("group_type"), "predicate").agg(F.countDistinct(P, "subject_id").alias("candidates"), F.slice(F.array_sort(F.collect_set("s_name")), 1, 3).alias("samples"))


_T3 = f"{_SYM}, t3 AS (SELECT u.project_slug, u.a AS filter, u.b AS m1, v.b AS m2, w.b AS candidate FROM sym u JOIN sym v ON u.project_slug = v.project_slug AND u.b = v.a AND u.eid <> v.eid JOIN sym w ON v.project_slug = w.project_slug AND v.b = w.a AND w.eid <> v.eid AND w.eid <> u.eid WHERE u.predicate = 'mentions' AND v.predicate = 'uses' AND w.predicate = 'depends_on')"
_TY = "coalesce(nullif(mapped_type, ''), type)"


@query(f"""WITH {_T3} SELECT t.project_slug, t.filter, t.candidate, c.name, count(DISTINCT m.id) AS value FROM (SELECT project_slug, filter, candidate, m1 AS metric FROM t3 UNION SELECT project_slug, filter, candidate, m2 FROM t3) t
JOIN live m ON m.project_slug = t.project_slug AND m.id = t.metric AND {_TY.replace('mapped_type', 'm.mapped_type').replace(', type', ', m.type')} = 'Workflow' JOIN live c ON c.project_slug = t.project_slug AND c.id = t.candidate AND {_TY.replace('mapped_type', 'c.mapped_type').replace(', type', ', c.type')} = 'File' GROUP BY ALL""")
def k3_path_rank(spark, d):
    """For every filter node: files by the workflows on file - depends_on - uses - mentions - node."""
    return E.path_rank(_edges(spark, d), ["depends_on", "uses", "mentions"], "File", "Workflow", limit=None).drop("sources", "paths")


@query(f"WITH {_T3} SELECT t.project_slug, t.filter, count(DISTINCT t.candidate) AS value FROM t3 t JOIN live c ON c.project_slug = t.project_slug AND c.id = t.candidate AND {_TY.replace('mapped_type', 'c.mapped_type').replace(', type', ', c.type')} = 'File' GROUP BY ALL")
def k3_path_count(spark, d):
    return E.path_count(_edges(spark, d), ["depends_on", "uses", "mentions"], "File")


@query(f"WITH {_SYM} SELECT u.project_slug, u.a AS filter, count(DISTINCT u.b) AS value FROM sym u JOIN live c ON c.project_slug = u.project_slug AND c.id = u.b AND {_TY.replace('mapped_type', 'c.mapped_type').replace(', type', ', c.type')} = 'File' WHERE u.predicate = 'uses' GROUP BY ALL")
def k3_direct_count(spark, d):
    return E.path_count(_edges(spark, d), ["uses"], "File")


_START = "(SELECT project_slug, id FROM live WHERE type = 'DataStore')"


@query(f"""WITH {_SYM}, one AS (SELECT sym.* FROM sym SEMI JOIN {_START} st ON st.project_slug = sym.project_slug AND st.id = sym.a)
SELECT * FROM (SELECT b_type AS group_type, [predicate] AS predicates, CAST([] AS VARCHAR[]) AS intermediate_types, 1 AS hops, CAST(count(*) AS BIGINT) AS examples FROM one GROUP BY ALL
UNION ALL SELECT v.b_type, [v.predicate, u.predicate], [u.b_type], 2, count(*) FROM one u JOIN sym v ON u.project_slug = v.project_slug AND u.b = v.a AND u.eid <> v.eid GROUP BY ALL)
ORDER BY examples DESC, hops, group_type, predicates, intermediate_types LIMIT 200""")
def d6_signatures(spark, d):
    start = M.live(_graph(spark, d).entities).where("type = 'DataStore'").select(P, F.col("id").alias("a"))
    return E.signatures(_edges(spark, d), start)


@query()
def d6_signatures_3hop(spark, d):
    start = M.live(_graph(spark, d).entities).where("type = 'DataStore'").select(P, F.col("id").alias("a"))
    return E.signatures(_edges(spark, d), start, hops=3)


@query(f"WITH {_E}, {_A} SELECT 'type' AS what, type AS value FROM e WHERE type IS NOT NULL GROUP BY ALL UNION ALL SELECT 'predicate', predicate FROM a WHERE predicate IS NOT NULL GROUP BY ALL UNION ALL SELECT 'dataset', dataset FROM e WHERE dataset IS NOT NULL GROUP BY ALL")
def d7_catalog(spark, d):
    g = _graph(spark, d)
    parts = [g.entities.select(F.lit("type").alias("what"), F.col("type").alias("value")), g.assertions.select(F.lit("predicate").alias("what"), F.col("predicate").alias("value")), g.entities.select(F.lit("dataset").alias("what"), F.col("dataset").alias("value"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("value is not null").distinct()


@query(f"WITH {_E}, x8 AS (SELECT * FROM e WHERE coalesce(dataset, '') <> '' AND NOT coalesce(semantic_summary, false)) SELECT project_slug, 'dataset' AS kind, dataset AS title, count(*) AS records FROM x8 GROUP BY ALL UNION ALL SELECT project_slug, 'domain', dataset || ': ' || {_public()}, count(*) FROM x8 GROUP BY ALL")
def d8_dataset_summary(spark, d):
    return K.dataset_chunks(_graph(spark, d).entities).select(P, "kind", "title", "records")


@query(f"WITH {_E} SELECT project_slug, split_part(source_path, '#', 1) AS title, CAST(count(*) AS BIGINT) AS records FROM e WHERE {_layer()} = 'repo' AND coalesce(source_path, '') <> '' GROUP BY ALL")
def d9_architecture_summary(spark, d):
    return K.architecture_chunks(_graph(spark, d).entities).select(P, "title", "records")


@query(f"WITH {_X}, y AS (SELECT {_area('s_')} AS source_area, {_area('o_')} AS target_area, predicate FROM x WHERE {_layer('s_')} = 'repo' AND {_layer('o_')} = 'repo' AND predicate IN ({_list(FLOW_PREDICATES)}) AND {_meaningful('s_')} AND {_meaningful('o_')}) SELECT source_area, target_area, predicate, count(*) AS n FROM y WHERE source_area <> '' AND target_area <> '' AND source_area <> target_area GROUP BY ALL ORDER BY n DESC, source_area, target_area, predicate LIMIT 20")
def d10_cross_boundary(spark, d):
    return I.cross_boundaries(_edges(spark, d)).orderBy(F.desc("n"), "source_area", "target_area", "predicate").limit(20)


def _lin(p):
    return f"(coalesce({p}semantic_summary, false) OR coalesce({p}type IN ({_list(LINEAGE_TYPES)}), false))"


def _lab(p):
    return f"CASE WHEN {_layer(p)} = 'repo' OR coalesce({p}semantic_summary, false) THEN {p}name ELSE {_public(p)} END"


@query(f"WITH {_X} SELECT predicate, {_lab('s_')} AS source, {_lab('o_')} AS target, {_public('s_')} AS source_type, {_public('o_')} AS target_type, count(*) AS n, arg_min(struct_pack(v := split_part(source_path, '#', 1)), struct_pack(o := coalesce(ord, -1), i := id)).v AS first_path FROM x WHERE ({_layer('s_')} <> {_layer('o_')} OR {_lin('s_')} OR {_lin('o_')}) AND {_meaningful('s_')} AND {_meaningful('o_')} GROUP BY ALL ORDER BY n DESC, predicate, source NULLS FIRST, target NULLS FIRST, source_type, target_type LIMIT 20")
def d11_lineage(spark, d):
    return I.lineage(_edges(spark, d)).orderBy(F.desc("n"), "predicate", "source", "target", "source_type", "target_type").limit(20)


@query(f"WITH {_E}, {_A} SELECT CASE WHEN coalesce(dataset, '') <> '' THEN dataset ELSE 'Structured data' END AS dataset, {_public()} AS type, count(*) AS n FROM e WHERE {_layer()} = 'data' AND NOT EXISTS (SELECT 1 FROM a WHERE a.project_slug = e.project_slug AND a.subject_id = e.id) AND NOT EXISTS (SELECT 1 FROM a WHERE a.project_slug = e.project_slug AND a.object_id = e.id) GROUP BY ALL")
def d12_orphans(spark, d):
    g = _graph(spark, d)
    return I.orphan_groups(g.entities, g.assertions)


@query(f"WITH {_E} SELECT dataset, count(*) AS records FROM e WHERE coalesce(dataset, '') <> '' GROUP BY 1 HAVING NOT bool_or(coalesce(json_extract_string(CASE WHEN json_valid(metadata_json) THEN metadata_json END, '$.owner'), '') <> '')")
def d13_ownership_gaps(spark, d):
    return I.ownership_gaps(_graph(spark, d).entities)


@query(f"WITH {_A} SELECT project_slug, CAST(count_if(coalesce(source_path, '') = '' AND coalesce(evidence_text, '') = '' AND coalesce(evidence_span_id, '') = '') AS BIGINT) AS without_evidence, count(*) AS relationships FROM a GROUP BY 1")
def d14_evidence_gaps(spark, d):
    return I.evidence_gaps(_graph(spark, d).assertions)


@query(f"WITH {_E} SELECT normalized_name, list_sort(list(DISTINCT {_public()})) AS types FROM e WHERE coalesce(normalized_name, '') <> '' GROUP BY 1 HAVING count(DISTINCT {_public()}) > 1 ORDER BY 1 LIMIT 20")
def d15_conflicts(spark, d):
    return I.conflicts(_graph(spark, d).entities).orderBy("normalized_name").limit(20)


@query(f"WITH {_E} SELECT project_slug, {_layer()} AS layer, type, coalesce(dataset, '') AS dataset, count(*) AS n FROM e GROUP BY ALL")
def d20_facets(spark, d):
    return _graph(spark, d).entities.groupBy(P, C.layer().alias("layer"), "type", F.coalesce("dataset", F.lit("")).alias("dataset")).agg(F.count("*").alias("n"))


@query()
def d21_group_links(spark, d):
    g = _graph(spark, d)
    return R.group_links(_edges(spark, d), R.architecture_groups(g.entities))


@query()
def d22_architecture_groups(spark, d):
    return R.architecture_groups(_graph(spark, d).entities).groupBy("group").agg(F.count("*").alias("members"))


@query(f"WITH {_E}, w AS (SELECT community, unnest(list_distinct(list_filter(regexp_split_to_array(lower(name), '[^a-z]+'), lambda y: length(y) > 3))) AS token, 3 AS weight FROM e WHERE community IS NOT NULL UNION ALL SELECT community, unnest(list_distinct(list_filter(regexp_split_to_array(lower(source_path), '[^a-z]+'), lambda y: length(y) > 3))), 2 FROM e WHERE community IS NOT NULL), t AS (SELECT community, token, sum(weight) AS score FROM w GROUP BY ALL) SELECT community, token, CAST(score AS BIGINT) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY score DESC, token) AS rank FROM t) WHERE rank <= 4")
def d23_community_tokens(spark, d):
    e = _graph(spark, d).entities.where("community is not null")
    tokens = lambda c, w: e.select("community", F.explode(F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda t: F.length(t) > 3))).alias("token"), F.lit(w).alias("weight"))
    score = tokens("name", 3).unionByName(tokens("source_path", 2)).groupBy("community", "token").agg(F.sum("weight").alias("score"))
    w = Window.partitionBy("community").orderBy(F.desc("score"), "token")
    return score.withColumn("rank", F.row_number().over(w)).where("rank <= 4")


@query(f"WITH {_VALID} SELECT reason, predicate, count(*) AS n FROM v WHERE reason IS NOT NULL GROUP BY ALL ORDER BY n DESC, reason, predicate NULLS FIRST LIMIT 25")
def d25_rejects_by_predicate(spark, d):
    return Q.rejects_by(_validated(spark, d), "predicate").orderBy(F.desc("n"), "reason", "predicate").limit(25)


@query(f"WITH {_X} SELECT project_slug, predicate, count(*) AS n FROM x GROUP BY ALL")
def d28_visual_summary(spark, d):
    return _edges(spark, d).groupBy(P, "predicate").agg(F.count("*").alias("n"))


@query(f"SELECT type, count(*) AS record_count FROM (SELECT DISTINCT id, type FROM ({_PROJECTED})) GROUP BY 1")
def d30_member_of(spark, d):
    return J.summaries(J.project_entities(_tables(spark, d), _MAP)).select("type", "record_count")


@query(f"WITH {_E} SELECT project_slug, id, ord, name FROM e")
def d32_first_wins(spark, d):
    return _graph(spark, d).entities.select(P, "id", "ord", "name")


@query("SELECT project_slug, id, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY project_slug, id ORDER BY ingested_at DESC NULLS LAST, content_hash DESC NULLS LAST) AS rn FROM knowledge_chunks) WHERE rn = 1")
def d33_last_wins(spark, d):
    k = table(spark, d, "knowledge_chunks").select(P, "id", "ingested_at", "content_hash")
    return M.first_wins(k, (P, "id"), ("ingested_at",), last=True).select(P, "id", "content_hash")


@query(f"WITH {_E}, {_A} SELECT coalesce(x.project_slug, y.project_slug) AS project_slug, coalesce(n, 0) AS entities, coalesce(m, 0) AS assertions, CAST(coalesce(l, 0) AS BIGINT) AS live_entities, coalesce(n, 0) <> coalesce(l, 0) AS stale_index FROM (SELECT project_slug, count(*) AS n, count_if(NOT coalesce(stale, false)) AS l FROM e GROUP BY 1) x FULL JOIN (SELECT project_slug, count(*) AS m FROM a GROUP BY 1) y ON x.project_slug = y.project_slug")
def d35_index_staleness(spark, d):
    g = _graph(spark, d)
    e = g.entities.groupBy(P).agg(F.count("*").alias("entities"), F.count_if(~F.coalesce("stale", F.lit(False))).alias("live_entities"))
    both = e.join(g.assertions.groupBy(P).agg(F.count("*").alias("assertions")), [P], "full").na.fill(0, ["entities", "assertions", "live_entities"])
    return both.withColumn("stale_index", F.col("entities") != F.col("live_entities"))


@query(f"WITH {_E} SELECT dataset, {_public()} AS record_type, domain, count(*) AS n FROM e WHERE {_layer()} = 'data' GROUP BY ALL")
def d38_data_graph(spark, d):
    return _graph(spark, d).entities.where(C.layer() == "data").groupBy("dataset", C.public_type().alias("record_type"), "domain").agg(F.count("*").alias("n"))


@query(f"WITH {_E} SELECT project_slug, community, arg_min(id, struct_pack(o := coalesce(ord, -1), i := id)) AS first_id FROM e WHERE community IS NOT NULL GROUP BY ALL")
def d39_first_of_community(spark, d):
    return _graph(spark, d).entities.where("community is not null").groupBy(P, "community").agg(F.min(F.struct("ord", "id")).alias("x")).select(P, "community", F.col("x.id").alias("first_id"))


# --- E, F, G: windows, tops and sets -----------------------------------------------------
_DT = "(CASE WHEN coalesce(mapped_type, '') <> '' THEN mapped_type ELSE type END)"
_SCORE = f"sc AS (SELECT e.*, CAST(coalesce(d.weighted, 0) + {_case(_DT, TYPE_WEIGHTS, 0)} + CASE WHEN coalesce(extraction_source = 'structured_connector', false) THEN 3 ELSE 0 END + CASE WHEN coalesce(semantic_summary, false) THEN 2 ELSE 0 END AS BIGINT) AS score FROM e LEFT JOIN d USING (project_slug, id) WHERE {_layer()} = 'data')"


@query(f"WITH {_E}, {_A}, {_DEG}, {_SCORE}, k AS (SELECT *, row_number() OVER (PARTITION BY {_DT} ORDER BY score DESC, name NULLS FIRST, project_slug, id) AS r FROM sc) SELECT project_slug, id, score FROM k WHERE r <= 60 ORDER BY score DESC, name NULLS FIRST, project_slug, id LIMIT 300")
def e1_per_type_cap(spark, d):
    g = _graph(spark, d)
    return R.top_per_type(R.layer_scores(g.entities.where(C.layer() == "data"), g.assertions)).select(P, "id", F.col("score").cast("bigint").alias("score"))


@query()  # its ends of key relationships come from a greedy choice, see e7
def k21_page_worthy(spark, d):
    g = _graph(spark, d)
    return R.page_worthy(g.entities, g.assertions, _edges(spark, d))


@query("WITH v AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS value FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) SELECT o_custkey, value FROM v WHERE value = (SELECT max(value) FROM v)")
def e5_tied_leaders(spark, d):
    v = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.countDistinct("o_orderkey").alias("value"))
    top = v.agg(F.max("value").alias("value"))
    return v.join(F.broadcast(top), "value").select("o_custkey", "value")  # one row


@query(f"WITH {_E}, {_A}, {_DEG} SELECT e.project_slug, e.id, {_public()} AS type, {_area()} AS area, CAST(fan_in AS BIGINT) AS fan_in, CAST(fan_out AS BIGINT) AS fan_out, degree FROM e JOIN d USING (project_slug, id) WHERE {_layer()} = 'repo' AND type IN ({_list(HOTSPOT_TYPES)}) AND {_meaningful()} ORDER BY degree DESC, name, project_slug, id LIMIT 12")
def f6_hotspots(spark, d):
    g = _graph(spark, d)
    return I.hotspots(g.entities, g.assertions).drop("name")


@query(f"WITH {_X} SELECT project_slug, id, CAST({_case('predicate', PREDICATE_WEIGHTS, DEFAULT_PREDICATE_WEIGHT)} AS INTEGER) AS weight FROM x ORDER BY weight DESC, project_slug, id LIMIT 1800")
def f9_links(spark, d):
    g = _graph(spark, d)
    return R.links_within(_edges(spark, d), M.live(g.entities)).select(P, "id", "weight")


@query("SELECT project_slug, id, name FROM (SELECT *, row_number() OVER (PARTITION BY project_slug, id ORDER BY stage, name NULLS FIRST) AS r FROM (SELECT project_slug, id, name, 0 AS stage FROM entities UNION ALL SELECT project_slug, id, name, 1 FROM entity_snapshots)) WHERE r = 1")
def g1_merge(spark, d):
    parts = [table(spark, d, t).select(P, "id", "name") for t in ("entities", "entity_snapshots")]
    return M.merge_graphs(parts, order=("name",))


@query(f"WITH {_E}, {_A}, {_S} SELECT DISTINCT project_slug, split_part(source_path, '#', 1) AS path FROM (SELECT project_slug, source_path FROM e UNION ALL SELECT project_slug, source_path FROM a) c WHERE coalesce(source_path, '') <> '' AND NOT EXISTS (SELECT 1 FROM s WHERE s.project_slug = c.project_slug AND s.path = split_part(c.source_path, '#', 1))")
def g4_cited_minus_declared(spark, d):
    g = _graph(spark, d)
    cited = g.entities.select(P, "source_path").unionByName(g.assertions.select(P, "source_path")).where("coalesce(source_path, '') <> ''").select(P, C.artifact_path("source_path").alias("path")).distinct()
    return cited.join(g.sources.select(P, "path").where("path is not null").distinct(), [P, "path"], "left_anti")


# --- K: graph operators --------------------------------------------------------------------
@query("""SELECT query_id, vec_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM (
SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0) WHERE score IS NOT NULL) WHERE r <= 10""")
def k4_vector_topk(spark, d):
    rows = table(spark, d, "embeddings")
    return V.vector_top_k_each(rows, rows.where("vec_id % 20 = 0"), "vec_id", 10)


@query(f"WITH {_E}, {_RES} SELECT project_slug, resolved_id AS id, CAST(count(*) AS INTEGER) AS mentions FROM r GROUP BY ALL")
def k7_resolution(spark, d):
    return Q.resolve_entities(_graph(spark, d).entities).select(P, "id", "mentions")


@query()
def k7_resolved_names(spark, d):
    return Q.resolve_entities(_graph(spark, d).entities)


@query("SELECT doc_id, CAST(i AS INTEGER) AS ordinal, CAST(i * 2000 AS INTEGER) AS start, CAST(least(2000, n - i * 2000) AS INTEGER) AS size FROM (SELECT doc_id, n, unnest(range(0, (n - 1) // 2000 + 1)) AS i FROM (SELECT doc_id, length(trim(text, ' ')) AS n FROM documents) WHERE n > 0)")
def k9_fixed_segments(spark, d):
    return K.fixed_segments(table(spark, d, "documents"), "doc_id")


@query()
def k9_segments(spark, d):
    return K.segments(table(spark, d, "documents"), "doc_id")


@query()
def k10_chunks(spark, d):
    """Chunks of all five kinds."""
    g = _graph(spark, d)
    e = g.entities
    return K.keyed_chunks([K.dataset_chunks(e), K.architecture_chunks(e), K.entity_chunks(e, g.assertions, g.spans), K.document_rows(g.sources, g.spans, g.chunks, e)])


@query(f"""WITH {_E}, {_A}, {_DEG}, w AS (SELECT e.*, coalesce(d.degree, 0) AS degree, row_number() OVER (PARTITION BY project_slug ORDER BY coalesce(d.degree, 0) DESC, id) AS r FROM e LEFT JOIN d USING (project_slug, id) WHERE {_layer()} = 'repo' AND type IN ({_list(HOTSPOT_TYPES)}) AND NOT {_test()}),
p AS (SELECT *, row_number() OVER (PARTITION BY project_slug, name ORDER BY r DESC) AS n FROM w WHERE r <= 200),
t AS (SELECT *, row_number() OVER (PARTITION BY project_slug, entity_id ORDER BY id) AS k FROM (SELECT project_slug, id, subject_id, object_id, predicate, unnest(list_distinct([subject_id, object_id])) AS entity_id FROM a)),
l AS (SELECT t.project_slug, t.entity_id, list_sort(list(DISTINCT trim(s.name || ' ' || t.predicate || ' ' || o.name, ' '))) AS edges FROM t JOIN e s ON s.project_slug = t.project_slug AND s.id = t.subject_id JOIN e o ON o.project_slug = t.project_slug AND o.id = t.object_id WHERE k <= 20 GROUP BY ALL)
SELECT p.project_slug, p.name AS title, p.degree AS records, coalesce(l.edges, []) AS edges FROM p LEFT JOIN l ON l.project_slug = p.project_slug AND l.entity_id = p.id WHERE n = 1 AND p.name IS NOT NULL""")
def k10_entity_chunks(spark, d):
    g = _graph(spark, d)
    c = K.entity_chunks(g.entities, g.assertions, g.spans.limit(0)).where("title is not null")
    block = F.regexp_extract("text", r"(?s)\nRelationships:\n- (.*?)(?:\nEvidence:\n.*)?$", 1)
    return c.select(P, "title", "records", F.when(block == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.transform(F.split(block, "\n- "), lambda x: F.trim(x)))).alias("edges"))


@query()
def k11_bounded_paths(spark, d):
    start = M.live(_graph(spark, d).entities).where("type = 'DataStore'").select(P, F.col("id").alias("a"))
    return V.bounded_paths(_edges(spark, d), start)


@query(f"WITH {_X}, st AS {_START}, one AS (SELECT DISTINCT x.project_slug, x.subject_id AS id FROM x JOIN st ON st.project_slug = x.project_slug AND st.id = x.object_id), n1 AS (SELECT * FROM one EXCEPT SELECT * FROM st), n2 AS (SELECT DISTINCT x.project_slug, x.subject_id AS id FROM x JOIN n1 ON n1.project_slug = x.project_slug AND n1.id = x.object_id EXCEPT SELECT * FROM n1 EXCEPT SELECT * FROM st) SELECT project_slug, id, 1 AS distance FROM n1 UNION ALL SELECT project_slug, id, 2 FROM n2")
def k15_reverse_impact(spark, d):
    start = M.live(_graph(spark, d).entities).where("type = 'DataStore'").select(P, F.col("id").alias("a"))
    return E.reverse_impact(_edges(spark, d), start)


_RS = f"""{_X}, dx AS (SELECT project_slug, id, count(*) AS degree FROM (SELECT project_slug, subject_id AS id FROM x UNION ALL SELECT project_slug, object_id FROM x) GROUP BY ALL),
rs AS (SELECT x.*, round(CAST({_case('predicate', PREDICATE_WEIGHTS, DEFAULT_PREDICATE_WEIGHT)} + {_case('s_type', TYPE_WEIGHTS, 2)} + {_case('o_type', TYPE_WEIGHTS, 2)} + CASE WHEN coalesce(evidence_text, '') <> '' OR coalesce(evidence_span_id, '') <> '' THEN 1 ELSE 0 END
  + 2 * coalesce(confidence, 0.0) + 0.4 * least(8, ds.degree + dob.degree) - CASE WHEN predicate = 'contains' AND s_type = 'File' THEN 6 ELSE 0 END AS DOUBLE), 6) AS score
  FROM x JOIN dx ds ON ds.project_slug = x.project_slug AND ds.id = x.subject_id JOIN dx dob ON dob.project_slug = x.project_slug AND dob.id = x.object_id)"""


@query(f"WITH {_RS} SELECT project_slug, id, score FROM rs")
def k20_relationship_scores(spark, d):
    return R.relationship_scores(_edges(spark, d)).select(P, "id", "score")


@query()
def e7_key_relationships(spark, d):
    return R.key_relationships(_edges(spark, d))


@query(f"WITH {_E}, {_A} SELECT kind, id, violation FROM (SELECT 'entity' AS kind, id, unnest(list_filter([CASE WHEN coalesce(name, '') = '' THEN 'no name' END, CASE WHEN coalesce(type NOT IN ({_list(ENTITY_TYPES)}), true) THEN 'no such type' END], lambda y: y IS NOT NULL)) AS violation FROM e UNION ALL SELECT 'assertion', id, unnest(list_filter([CASE WHEN coalesce(predicate, '') = '' THEN 'no predicate' END, CASE WHEN NOT coalesce(confidence BETWEEN 0 AND 1, false) THEN 'confidence outside 0..1' END, CASE WHEN coalesce(status NOT IN ({_list(STATUSES)}), true) THEN 'no such status' END, CASE WHEN coalesce(evidence_span_id, '') = '' THEN 'no evidence' END], lambda y: y IS NOT NULL)) FROM a)")
def l6_shape_violations(spark, d):
    g = _graph(spark, d)
    return Q.shape_violations(g.entities, g.assertions)


@query(f"WITH {_E} SELECT DISTINCT project_slug, domain, dataset FROM e WHERE coalesce(domain, '') <> '' AND coalesce(dataset, '') <> ''")
def l7_domains(spark, d):
    return _graph(spark, d).entities.where("coalesce(domain, '') <> '' and coalesce(dataset, '') <> ''").select(P, "domain", "dataset").distinct()
