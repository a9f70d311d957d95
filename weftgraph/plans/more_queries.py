"""Further queries over the graph tables: display, presets, changes and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import columns as C
from weftgraph.model import FLOW_PREDICATES, HOTSPOT_TYPES
from weftgraph.operators import display as D
from weftgraph.operators import edges as E
from weftgraph.operators import insights as I  # noqa: E741
from weftgraph.operators import merge as M
from weftgraph.operators import retrieval as V
from weftgraph.plans import graph_queries as G
from weftgraph.plans.graph_queries import P, _area, _edges, _graph, _layer, _list, _meaningful, _opaque, _public, _recent_changes
from weftgraph.runtime import table

QUERIES: dict[str, G.Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: G.Query) -> G.Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_TEXT = " || ' ' || ".join(f"coalesce({c}, '')" for c in ("name", "type", "mapped_type", "community", "dataset", "source_path", "description"))


@query(f"WITH {G._X}, f AS (SELECT * FROM live WHERE contains(lower({_TEXT}), 'gateway') AND {_layer()} = 'repo') SELECT f.project_slug, f.id FROM f WHERE EXISTS (SELECT 1 FROM x WHERE x.project_slug = f.project_slug AND x.predicate = 'uses' AND (x.subject_id = f.id OR x.object_id = f.id))")
def b18_faceted_filter(spark, d):
    return D.faceted(M.live(_graph(spark, d).entities), _edges(spark, d), "gateway", layer="repo", predicate="uses")


_CODE = r"\.(py|js|jsx|ts|tsx|java|go|rs)$"
_VIS = f"""CASE WHEN {_layer()} = 'data' OR type <> 'Concept' THEN {_public()}
  WHEN regexp_matches(trim(name), '^(GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD)\\s+/') THEN 'APIEndpoint' WHEN ends_with(trim(name), '()') THEN 'Function'
  WHEN regexp_matches(lower(trim(name)), '\\.(py|js|jsx|ts|tsx|java|go|rs|sql|ya?ml|toml|md)$') THEN 'File'
  WHEN regexp_matches(lower(coalesce(source_path, '')), '{_CODE}') AND regexp_matches(trim(name), '^[A-Z][A-Za-z0-9_]+$') THEN 'Class' ELSE type END"""


@query(f"WITH {G._E} SELECT type, {_VIS} AS visual_type, count(*) AS n FROM e GROUP BY ALL")
def b22_visual_types(spark, d):
    return _graph(spark, d).entities.groupBy("type", D.visual_type().alias("visual_type")).agg(F.count("*").alias("n"))


@query(f"WITH {G._X} SELECT project_slug, id, subject_id, object_id, CASE WHEN {_layer('s_')} = 'data' OR {_layer('o_')} = 'data' OR coalesce(extraction_source = 'structured_connector', false) THEN 'data' ELSE 'repo' END AS graph_kind, {G._evidence()} AS evidence_level FROM x")
def b26_links(spark, d):
    return D.link_projection(_edges(spark, d))


@query(f"""WITH {G._E} SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(trim(name)), '^(get|post|put|patch|delete)\\s+/') OR (regexp_matches(lower(trim(name)), '\\b(get|post|put|patch|delete)\\s*\\(') AND contains(name, '/')) THEN 'endpoint'
  WHEN regexp_matches(trim(name), '\\.(py|ts|tsx|js|jsx|md|yaml|yml|toml|json)$') OR regexp_matches(trim(name), '/[^/]*\\.[^/]*$') THEN 'file' WHEN ends_with(trim(name), '()') THEN 'function'
  WHEN regexp_matches(lower(split_part(coalesce(source_path, ''), '#', 1)), '{_CODE}') AND regexp_matches(trim(name), '^[A-Z][^ ]*$') THEN 'class' ELSE 'concept' END AS kind FROM e WHERE name IS NOT NULL) GROUP BY 1""")
def b27_node_kinds(spark, d):
    return _graph(spark, d).entities.where("name is not null").groupBy(D.node_kind().alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT extraction_source, CASE WHEN regexp_matches(lower(extraction_source), 'semantic|llm|inferred') THEN 'extractor_semantic' WHEN regexp_matches(lower(extraction_source), 'ast|code|symbol') THEN 'extractor_ast' ELSE 'extractor' END AS origin, count(*) AS n FROM entities GROUP BY ALL")
def b29_origins(spark, d):
    return table(spark, d, "entities").groupBy("extraction_source", D.origin("extraction_source").alias("origin")).agg(F.count("*").alias("n"))


@query(f"""WITH {G._E}, m AS (SELECT project_slug, id, CASE WHEN json_valid(metadata_json) THEN metadata_json END AS j FROM e)
SELECT project_slug, id, list_sort(list_filter(json_keys(j), lambda k: k NOT IN ({_list(D.HIDDEN_METADATA)}) AND json_type(j, '$.' || k) IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN') AND json_extract_string(j, '$.' || k) <> ''))[1:12] AS attributes FROM m WHERE j IS NOT NULL""")
def b30_display_attributes(spark, d):
    return D.display_attributes(_graph(spark, d).entities)


_CODE_SPANS = "code AS (SELECT DISTINCT sp.project_slug, sp.id, sp.text FROM source_spans sp JOIN (SELECT DISTINCT project_slug, lower(trim(id)) AS k FROM sources WHERE source_type = 'repo_file') s ON s.project_slug = sp.project_slug AND s.k = lower(trim(sp.source_id)) WHERE sp.text IS NOT NULL)"


@query(f"WITH {_CODE_SPANS} SELECT project_slug, 'class' AS kind, name, count(*) AS n FROM (SELECT project_slug, unnest(regexp_extract_all(text, '(?:^|\\n)[ \\t]*(?:export )?class ([A-Za-z_]\\w*)', 1)) AS name FROM code) GROUP BY ALL UNION ALL SELECT project_slug, 'function', name, count(*) FROM (SELECT project_slug, unnest(regexp_extract_all(text, '(?:^|\\n)[ \\t]*(?:async )?def ([A-Za-z_]\\w*)', 1)) AS name FROM code) GROUP BY ALL")
def b31_code_facts(spark, d):
    g = [table(spark, d, t) for t in ("sources", "source_spans")]
    return D.code_facts(*g).groupBy(P, "kind", "name").agg(F.count("*").alias("n"))


_GROUP = "CASE WHEN coalesce({p}community, '') <> '' THEN {p}community WHEN len(list_filter(string_split(coalesce({p}source_path, ''), '/'), lambda y: y <> '')) > 0 THEN array_to_string(list_filter(string_split(coalesce({p}source_path, ''), '/'), lambda y: y <> '')[1:2], '/') ELSE {p}type END"


@query(f"WITH {G._X}, y AS (SELECT {_GROUP.format(p='s_')} AS source, {_GROUP.format(p='o_')} AS target, predicate, confidence FROM x) SELECT source, target, count(*) AS links, round(max(coalesce(confidence, 0.0)), 6) AS confidence FROM y WHERE source <> target GROUP BY ALL")
def c15_group_contraction(spark, d):
    return D.contract(_edges(spark, d)).groupBy("source", "target").agg(F.count("*").alias("links"), F.round(F.max(F.coalesce("confidence", F.lit(0.0))), 6).alias("confidence"))


@query(f"WITH {G._E}, i AS (SELECT community, min(name) AS inferred FROM e WHERE community IS NOT NULL GROUP BY 1), l(community, label) AS (VALUES ('unsorted', 'Not sorted'), ('mapper group', 'Mappers')) SELECT i.community, coalesce(l.label, i.inferred) AS label FROM i LEFT JOIN l USING (community)")
def c19_community_labels(spark, d):
    inferred = _graph(spark, d).entities.where("community is not null").groupBy("community").agg(F.min("name").alias("inferred"))
    return D.override_labels(inferred, {"unsorted": "Not sorted", "mapper group": "Mappers"})


@query(f"""WITH {G._E}, {G._A}, c AS (SELECT a.project_slug, a.id, unnest([a.source_path, s.source_path, o.source_path]) AS path FROM a LEFT JOIN e s ON s.project_slug = a.project_slug AND s.id = a.subject_id LEFT JOIN e o ON o.project_slug = a.project_slug AND o.id = a.object_id)
SELECT project_slug, split_part(path, '#', 1) AS path, count(DISTINCT id) AS assertions FROM c WHERE coalesce(path, '') <> '' GROUP BY ALL""")
def c20_path_citations(spark, d):
    g = _graph(spark, d)
    return D.path_citations(g.entities, g.assertions)


@query(f"""WITH {G._X} SELECT 'modules' AS preset, project_slug, count(*) AS n FROM x WHERE s_type = 'Module' GROUP BY ALL
UNION ALL SELECT 'endpoints', project_slug, count(*) FROM x WHERE predicate IN ('exposes', 'defines') AND o_type = 'APIEndpoint' GROUP BY ALL
UNION ALL SELECT 'persistence', project_slug, count(*) FROM x WHERE predicate IN ('reads_from', 'writes_to', 'stores', 'defines', 'contains') AND (s_type IN ('DataModel', 'Database', 'DataStore') OR o_type IN ('DataModel', 'Database', 'DataStore')) GROUP BY ALL
UNION ALL SELECT 'technology', project_slug, count(*) FROM x WHERE predicate IN ('uses', 'runs_on', 'depends_on', 'deploys_to') AND o_type = 'Technology' GROUP BY ALL
UNION ALL SELECT 'type ' || predicate, project_slug, count(*) FROM x GROUP BY ALL""")
def c22_presets(spark, d):
    return D.presets(_edges(spark, d))


# --- changes -------------------------------------------------------------------------------
_SGRP = G._GRP


def _grp(p: str) -> str:
    out = _SGRP
    for c in ("dataset", "mapped_type", "community", "source_path", "type"):
        out = out.replace(f"coalesce({c},", f"coalesce({p}{c},").replace(f"THEN {c} ", f"THEN {p}{c} ").replace(f" {c} IS NOT NULL", f" {p}{c} IS NOT NULL").replace(f" {c} <> ''", f" {p}{c} <> ''").replace(f"WHEN {c} =", f"WHEN {p}{c} =").replace(f"ELSE {c} END", f"ELSE {p}{c} END")
    return out


@query(f"WITH {G._X} SELECT predicate, {_grp('s_')} AS source, {_grp('o_')} AS target, count(*) AS n FROM x GROUP BY ALL")
def d17_relationship_groups(spark, d):
    return _edges(spark, d).groupBy("predicate", I.entity_group("s_")[1].alias("source"), I.entity_group("o_")[1].alias("target")).agg(F.count("*").alias("n"))


_BUS = f"({_layer()} = 'data' OR coalesce(type = 'BusinessEntity', false))"
_NAME = f"CASE WHEN {_BUS} THEN CASE WHEN coalesce(dataset, '') <> '' THEN dataset ELSE 'Structured data' END || ' · ' || {_public()} ELSE name END"


@query(
    f"""WITH {G._LAST2}, {G._X}, f AS (SELECT x.project_slug, x.predicate, CASE WHEN s.id IS NOT NULL THEN 'downstream' ELSE 'upstream' END AS direction, CASE WHEN s.id IS NOT NULL THEN object_id ELSE subject_id END AS nid FROM x LEFT JOIN ch2 s ON s.project_slug = x.project_slug AND s.id = x.subject_id LEFT JOIN ch2 o ON o.project_slug = x.project_slug AND o.id = x.object_id WHERE (s.id IS NULL) <> (o.id IS NULL)),
k AS (SELECT direction, predicate, {_NAME} AS name, {_public()} AS type, CASE WHEN {_BUS} THEN CASE WHEN coalesce(dataset, '') <> '' THEN dataset ELSE 'Structured data' END WHEN coalesce(community, '') <> '' THEN community ELSE 'Architecture' END AS area FROM f JOIN e ON e.project_slug = f.project_slug AND e.id = f.nid WHERE type <> 'Function' AND NOT (type = 'Concept' AND length(name) > 60))
SELECT direction, name, type, area, count(*) AS relationships, list_sort(list(DISTINCT predicate))[1:5] AS predicates FROM k GROUP BY direction, name, type, area ORDER BY relationships DESC, direction, name, type, area LIMIT 24"""
)
def d18_affected_components(spark, d):
    return I.affected_components(E.affected(_recent_changes(spark, d), _edges(spark, d)), _graph(spark, d).entities)


@query("""WITH z AS (SELECT project_slug, snapshot_no, dense_rank() OVER (PARTITION BY project_slug ORDER BY snapshot_no DESC) AS r FROM (SELECT DISTINCT project_slug, snapshot_no FROM entity_snapshots)),
m AS (SELECT s.project_slug, s.community, count(DISTINCT s.id) FILTER (r = 1) AS new_size, count(DISTINCT s.id) FILTER (r = 2) AS old_size FROM entity_snapshots s JOIN z USING (project_slug, snapshot_no) WHERE r <= 2 AND community IS NOT NULL GROUP BY ALL)
SELECT project_slug, community, old_size, new_size, new_size - old_size AS delta FROM m WHERE old_size > 0 AND new_size > 0 AND old_size <> new_size""")
def d24_community_deltas(spark, d):
    return D.community_deltas(table(spark, d, "entity_snapshots"))


# --- code map, suggestions, tops -----------------------------------------------------------
@query(f"""WITH {G._X}, g AS (SELECT {_GROUP.format(p='')} AS label, count(*) AS members FROM e GROUP BY 1), y AS (SELECT {_GROUP.format(p='s_')} AS source, {_GROUP.format(p='o_')} AS target FROM x),
c AS (SELECT label, count(*) AS links FROM (SELECT source AS label FROM y WHERE source <> target UNION ALL SELECT target FROM y WHERE source <> target) GROUP BY 1)
SELECT g.label, members, coalesce(links, 0) AS external_links FROM g LEFT JOIN c USING (label) ORDER BY members + 2 * coalesce(links, 0) DESC, lower(g.label), g.label LIMIT 40""")
def d29_code_map(spark, d):
    return D.code_map(_graph(spark, d).entities, _edges(spark, d))


@query(f"WITH {G._E}, {G._A}, {G._DEG} SELECT e.project_slug, 'What depends on ' || arg_min(e.name, struct_pack(a := -coalesce(d.degree, 0), b := e.name)) || '?' AS question FROM e LEFT JOIN d USING (project_slug, id) WHERE NOT {_opaque('name')} AND name IS NOT NULL AND NOT coalesce(semantic_summary, false) GROUP BY 1")
def d37_suggestions(spark, d):
    g = _graph(spark, d)
    return D.suggestions(g.entities, g.assertions)


@query(f"WITH {G._X} SELECT project_slug, id, count(*) AS degree FROM (SELECT project_slug, subject_id AS id FROM x UNION ALL SELECT project_slug, object_id FROM x) GROUP BY ALL")
def d40_resolved_degree(spark, d):
    return E.degrees(_edges(spark, d)).select(P, "id", "degree")


@query(f"WITH {G._S} SELECT project_slug, id, path FROM s ORDER BY path NULLS FIRST, project_slug, id LIMIT 2000")
def f5_source_listing(spark, d):
    return _graph(spark, d).sources.orderBy(F.asc_nulls_first("path"), P, "id").limit(2000).select(P, "id", "path")


@query(f"WITH {G._E}, {G._A}, {G._DEG} SELECT project_slug, id FROM e LEFT JOIN d USING (project_slug, id) WHERE type IN ({_list(HOTSPOT_TYPES)}) AND NOT coalesce(stale, false) ORDER BY coalesce(degree, 0) DESC, id, project_slug LIMIT 200")
def f7_indexed_entities(spark, d):
    g = _graph(spark, d)
    ranked = I.with_degrees(M.live(g.entities).where(F.col("type").isin(*HOTSPOT_TYPES)), g.assertions)
    return ranked.orderBy(F.desc("degree"), "id", P).limit(200).select(P, "id")


_BOTH = f"""{G._X}, nb AS (SELECT project_slug, id AS edge_id, confidence, subject_id AS entity_id, 'outgoing' AS direction FROM x
UNION ALL SELECT project_slug, id, confidence, object_id, 'incoming' FROM x)"""


@query(f"""WITH {_BOTH}, t AS (SELECT arg_min(entity_id, struct_pack(a := -n, b := entity_id)) AS id, project_slug FROM (SELECT project_slug, entity_id, count(*) AS n FROM nb GROUP BY ALL) GROUP BY project_slug)
SELECT project_slug, entity_id, direction, edge_id FROM (SELECT nb.*, row_number() OVER (PARTITION BY nb.project_slug, nb.entity_id, direction ORDER BY confidence DESC NULLS LAST, edge_id) AS r FROM nb JOIN t ON t.project_slug = nb.project_slug AND t.id = nb.entity_id) WHERE r <= 40""")
def k18_node_detail(spark, d):
    return D.node_detail(_edges(spark, d))


@query(
    f"""WITH {G._X}, {G._DEG} SELECT
  (SELECT count(*) FROM (SELECT 1 FROM e JOIN d USING (project_slug, id) WHERE {_layer()} = 'repo' AND type IN ({_list(HOTSPOT_TYPES)}) AND {_meaningful()} LIMIT 12)) AS hotspots,
  (SELECT least(20, count(*)) FROM (SELECT DISTINCT sa, ta, predicate FROM (SELECT {_area('s_')} AS sa, {_area('o_')} AS ta, predicate FROM x WHERE {_layer('s_')} = 'repo' AND {_layer('o_')} = 'repo' AND predicate IN ({_list(FLOW_PREDICATES)}) AND {_meaningful('s_')} AND {_meaningful('o_')}) WHERE sa <> '' AND ta <> '' AND sa <> ta)) AS cross_boundaries,
  (SELECT CAST(count(*) AS BIGINT) FROM e WHERE {_layer()} = 'data' AND NOT EXISTS (SELECT 1 FROM a WHERE a.project_slug = e.project_slug AND (a.subject_id = e.id OR a.object_id = e.id))) AS orphans"""
)
def k24_report_counts(spark, d):
    g, e = _graph(spark, d), _edges(spark, d)
    h = I.hotspots(g.entities, g.assertions).agg(F.count("*").alias("hotspots"))
    c = I.cross_boundaries(e).agg(F.least(F.lit(20), F.count("*")).cast("bigint").alias("cross_boundaries"))
    o = I.orphan_groups(g.entities, g.assertions).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"))
    one = lambda df: df.withColumn("k", F.lit(1))
    return one(h).join(one(c), "k").join(one(o), "k").drop("k")  # three single rows


@query(f"WITH {G._KC} SELECT project_slug, count(*) AS chunks, CAST(count_if(embedding IS NOT NULL) AS BIGINT) AS embedded, count_if(embedding IS NOT NULL) = count(*) AS ready FROM kc GROUP BY 1")
def k27_index_status(spark, d):
    k = M.first_wins(table(spark, d, "knowledge_chunks").select(P, "id", "content_hash", "embedding_model", F.col("embedding").isNotNull().alias("done")), (P, "id"), ("content_hash", "embedding_model"))
    return k.groupBy(P).agg(F.count("*").alias("chunks"), F.count_if("done").alias("embedded"), (F.count_if("done") == F.count("*")).alias("ready"))


@query(f"WITH {G._E}, {G._LAST2}, n AS (SELECT project_slug, id, x.d AS description, x.c AS community FROM h WHERE r = 1) SELECT coalesce(e.project_slug, n.project_slug) AS project_slug, coalesce(e.id, n.id) AS id, coalesce(n.description, e.description) AS description, coalesce(n.community, e.community) AS community FROM e FULL JOIN n ON n.project_slug = e.project_slug AND n.id = e.id")
def l1_upsert(spark, d):
    s = table(spark, d, "entity_snapshots")
    last = s.groupBy(P).agg(F.max("snapshot_no").alias("snapshot_no"))
    new = s.join(last, [P, "snapshot_no"]).where("id is not null").groupBy(P, "id").agg(F.max(F.struct("delivered_at", "description", "community", "source_path", "name", "type")).alias("x")).select(P, "id", "x.description", "x.community")
    return M.upsert(_graph(spark, d).entities.select(P, "id", "description", "community"), new)


@query(f"WITH {G._E} SELECT project_slug, count(*) AS n FROM e WHERE project_slug IS DISTINCT FROM 'atlas-core' GROUP BY 1")
def l4_reset_project(spark, d):
    return M.reset_project(_graph(spark, d).entities, "atlas-core").groupBy(P).agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def i0_event_windows(spark, d):
    from weftgraph.streaming.index import event_counts

    return event_counts(table(spark, d, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query(f"WITH {G._KC}, q AS (SELECT embedding AS v FROM kc WHERE embedding IS NOT NULL ORDER BY project_slug, id LIMIT 1), s AS (SELECT kc.project_slug, kc.id, kc.entity_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])), 6) AS score FROM kc, q WHERE embedding IS NOT NULL) SELECT s.id, s.score, e.name FROM (SELECT * FROM s WHERE score IS NOT NULL ORDER BY score DESC, id LIMIT 50) s JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_slug, id ORDER BY ord NULLS FIRST, ingested_at NULLS FIRST) AS rn FROM entities) WHERE rn = 1 AND NOT coalesce(stale, false)) e ON e.project_slug = s.project_slug AND e.id = lower(trim(s.entity_id))")
def c8_hits_to_entities(spark, d):
    k = M.first_wins(table(spark, d, "knowledge_chunks").select(P, "id", "content_hash", "embedding_model", "entity_id", "embedding"), (P, "id"), ("content_hash", "embedding_model"))
    vector = k.where("embedding is not null").orderBy(P, "id").select("embedding").first()
    hits = V.vector_top_k(k, "id", list(vector[0]) if vector else [1.0], 50)
    return V.hits_to_entities(hits, k, _graph(spark, d).entities).select("id", "score", "name")
