"""What a reader of the graph sees: facets, kinds, attributes, presets, maps and suggestions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.columns import artifact_path, edge_evidence, is_opaque, layer, lookup, or_else, path_parts, public_type
from weftgraph.operators.edges import degrees

P = "project_slug"
# Metadata that isn't shown.
HIDDEN_METADATA = (
    "_origin", "community", "community_id", "connector", "dataset_sources", "datasets", "file_type", "id", "label", "mapped_type", "norm_label", "record_key", "row_number",
    "run_id", "seen_at", "source", "source_file", "source_location", "source_paths",
)
SEARCHED = ("name", "type", "mapped_type", "community", "dataset", "source_path", "description")
_CODE = r"\.(py|js|jsx|ts|tsx|java|go|rs)$"


def faceted(entities: DataFrame, edges: DataFrame, text: str = "", layer: str | None = None, dataset: str | None = None, predicate: str | None = None) -> DataFrame:
    """Entities that satisfy every facet given; a predicate facet asks for an edge of that kind."""
    hit = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in SEARCHED])).contains(text.lower())
    if layer:
        hit = hit & (_layer() == layer)
    if dataset:
        hit = hit & (F.col("dataset") == dataset)
    found = entities.where(hit).select(P, "id")
    if predicate:
        ends = edges.where(F.col("predicate") == predicate).select(P, F.explode(F.array("subject_id", "object_id")).alias("id"))
        found = found.join(ends, [P, "id"], "left_semi")
    return found


_layer = layer


def visual_type() -> Column:
    """The public type; concepts that look like an endpoint, function, file or class are shown as such."""
    name = F.trim("name")
    code = F.lower(F.coalesce("source_path", F.lit(""))).rlike(_CODE)
    concept = (
        F.when(name.rlike(r"^(GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD)\s+/"), "APIEndpoint")
        .when(name.endswith("()"), "Function")
        .when(F.lower(name).rlike(r"\.(py|js|jsx|ts|tsx|java|go|rs|sql|ya?ml|toml|md)$"), "File")
        .when(code & name.rlike("^[A-Z][A-Za-z0-9_]+$"), "Class")
        .otherwise(F.col("type"))
    )
    return F.when((layer() == "data") | (F.col("type") != "Concept"), public_type()).otherwise(concept)


def node_kind() -> Column:
    """What an extractor's node is, by its name and file."""
    name = F.trim("name")
    low = F.lower(name)
    verbs = "(get|post|put|patch|delete)"
    return (
        F.when(low.rlike(rf"^{verbs}\s+/") | (low.rlike(rf"\b{verbs}\s*\(") & name.contains("/")), "endpoint")
        .when(name.rlike(r"\.(py|ts|tsx|js|jsx|md|yaml|yml|toml|json)$") | name.rlike(r"/[^/]*\.[^/]*$"), "file")
        .when(name.endswith("()"), "function")
        .when(F.lower(artifact_path(F.coalesce("source_path", F.lit("")))).rlike(_CODE) & name.rlike("^[A-Z][^ ]*$"), "class")
        .otherwise("concept")
    )


def origin(c: str) -> Column:
    low = F.lower(c)
    return F.when(low.rlike("semantic|llm|inferred"), "extractor_semantic").when(low.rlike("ast|code|symbol"), "extractor_ast").otherwise("extractor")


def link_projection(edges: DataFrame) -> DataFrame:
    """Edges as links, with the layer they belong to and how well they are evidenced."""
    data = (layer("s_") == "data") | (layer("o_") == "data") | F.coalesce(F.col("extraction_source") == "structured_connector", F.lit(False))
    return edges.select(P, "id", "subject_id", "object_id", F.when(data, "data").otherwise("repo").alias("graph_kind"), edge_evidence().alias("evidence_level"))


def display_attributes(entities: DataFrame) -> DataFrame:
    """``(project_slug, id, attributes)``: names of the first twelve scalar metadata that are shown."""
    parsed = F.from_json("metadata_json", "map<string,string>")
    shown = F.map_filter(parsed, lambda k, v: ~k.isin(*HIDDEN_METADATA) & v.isNotNull() & (v != "") & ~v.rlike(r"^[\[{]"))
    return entities.where(parsed.isNotNull()).select(P, "id", F.slice(F.array_sort(F.map_keys(shown)), 1, 12).alias("attributes"))


def code_facts(sources: DataFrame, spans: DataFrame) -> DataFrame:
    """``(project_slug, kind, name)`` of classes and functions that code spans define."""
    code = sources.where("source_type = 'repo_file'").select(P, F.lower(F.trim("id")).alias("k")).distinct()
    own = spans.where("text is not null").select(P, "id", F.lower(F.trim("source_id")).alias("k"), "text").join(code, [P, "k"], "left_semi").select(P, "id", "text").distinct()
    classes = F.regexp_extract_all("text", F.lit(r"(?:^|\n)[ \t]*(?:export )?class ([A-Za-z_]\w*)"), F.lit(1))
    functions = F.regexp_extract_all("text", F.lit(r"(?:^|\n)[ \t]*(?:async )?def ([A-Za-z_]\w*)"), F.lit(1))
    return own.select(P, F.lit("class").alias("kind"), F.explode(classes).alias("name")).unionByName(own.select(P, F.lit("function").alias("kind"), F.explode(functions).alias("name")))


def map_group(p: str = "") -> Column:
    """The community, else the first two parts of the path, else the type."""
    parts = F.filter(path_parts(f"{p}source_path"), lambda x: x != "")
    return or_else(f"{p}community", F.when(F.size(parts) > 0, F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.col(f"{p}type")))


def contract(edges: DataFrame) -> DataFrame:
    """Edges between groups; those within one are dropped."""
    return edges.withColumn("source", map_group("s_")).withColumn("target", map_group("o_")).where("source <> target")


def override_labels(inferred: DataFrame, given: Mapping[str, str]) -> DataFrame:
    """Labels of communities: those given by a sidecar file win over inferred ones."""
    label = lookup(F.col("community"), given, F.col("inferred")) if given else F.col("inferred")
    return inferred.select("community", label.alias("label"))


def path_citations(entities: DataFrame, assertions: DataFrame) -> DataFrame:
    """``(project_slug, path, assertions)``: how many cite a path, by themselves or an end."""
    e = entities.select(P, "id", "source_path")
    s = e.select(P, F.col("id").alias("subject_id"), F.col("source_path").alias("sp"))
    o = e.select(P, F.col("id").alias("object_id"), F.col("source_path").alias("op"))
    both = assertions.join(s, [P, "subject_id"], "left").join(o, [P, "object_id"], "left")
    cited = both.select(P, "id", F.explode(F.array("source_path", "sp", "op")).alias("path")).where("coalesce(path, '') <> ''")
    return cited.groupBy(P, artifact_path("path").alias("path")).agg(F.countDistinct("id").alias("assertions"))


def presets(edges: DataFrame) -> DataFrame:
    """How many edges each preset view has, per project, in one pass over the edges."""
    stores = ("DataModel", "Database", "DataStore")
    p, s, o = F.col("predicate"), F.col("s_type"), F.col("o_type")
    names = F.array_compact(F.array(
        F.when(s == "Module", "modules"), F.when(p.isin("exposes", "defines") & (o == "APIEndpoint"), "endpoints"),
        F.when(p.isin("reads_from", "writes_to", "stores", "defines", "contains") & (s.isin(*stores) | o.isin(*stores)), "persistence"),
        F.when(p.isin("uses", "runs_on", "depends_on", "deploys_to") & (o == "Technology"), "technology"), F.concat(F.lit("type "), p),
    ))
    return edges.select(P, F.explode(names).alias("preset")).groupBy("preset", P).agg(F.count("*").alias("n"))


def community_deltas(snapshots: DataFrame) -> DataFrame:
    """Communities in a project's last two snapshots whose number of members changed."""
    w = Window.partitionBy(P).orderBy(F.desc("snapshot_no"))
    last = snapshots.select(P, "snapshot_no").distinct().withColumn("r", F.row_number().over(w)).where("r <= 2")
    sizes = snapshots.join(last, [P, "snapshot_no"]).where("community is not null").groupBy(P, "community").agg(F.countDistinct(F.when(F.col("r") == 2, F.col("id"))).alias("old_size"), F.countDistinct(F.when(F.col("r") == 1, F.col("id"))).alias("new_size"))
    return sizes.where("old_size > 0 and new_size > 0 and old_size <> new_size").withColumn("delta", F.expr("new_size - old_size"))


def code_map(entities: DataFrame, edges: DataFrame, limit: int = 40) -> DataFrame:
    """The largest groups, counting members once and links to other groups twice."""
    members = entities.groupBy(map_group().alias("label")).agg(F.count("*").alias("members"))
    links = contract(edges).select(F.explode(F.array("source", "target")).alias("label")).groupBy("label").agg(F.count("*").alias("external_links"))
    both = members.join(links, "label", "left").na.fill(0, ["external_links"])
    return both.orderBy(F.desc(F.expr("members + 2 * external_links")), F.lower("label"), "label").limit(limit)


def suggestions(entities: DataFrame, assertions: DataFrame) -> DataFrame:
    """A question per project about its best connected entity with a readable name."""
    named = entities.where(~is_opaque("name") & F.col("name").isNotNull() & ~F.coalesce("semantic_summary", F.lit(False)))
    ranked = named.join(degrees(assertions).select(P, "id", "degree"), [P, "id"], "left")
    best = ranked.groupBy(P).agg(F.min(F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), "name")).alias("x"))
    return best.select(P, F.concat(F.lit("What depends on "), F.col("x.name"), F.lit("?")).alias("question"))


def node_detail(edges: DataFrame, limit: int = 40) -> DataFrame:
    """Of each project's best connected entity up to ``limit`` outgoing and incoming edges."""
    cols = [P, F.col("id").alias("edge_id"), "confidence"]
    ends = edges.select(*cols, F.col("subject_id").alias("entity_id"), F.lit("outgoing").alias("direction")).unionByName(edges.select(*cols, F.col("object_id").alias("entity_id"), F.lit("incoming").alias("direction")))
    best = ends.groupBy(P, "entity_id").agg(F.count("*").alias("n")).groupBy(P).agg(F.min(F.struct((-F.col("n")).alias("n"), "entity_id")).alias("x")).select(P, F.col("x.entity_id").alias("entity_id"))
    w = Window.partitionBy(P, "entity_id", "direction").orderBy(F.desc_nulls_last("confidence"), "edge_id")
    return ends.join(best, [P, "entity_id"], "left_semi").withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).select(P, "entity_id", "direction", "edge_id")
