"""Findings over one graph, and the shape of changes between two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.columns import area, artifact_path, is_actionable, is_business, is_lineage, is_meaningful, is_opaque, layer, or_else, public_type
from weftgraph.model import FLOW_PREDICATES
from weftgraph.operators.edges import degrees

P = "project_slug"
#: What the findings need to know of an edge's ends.
END_FACTS = ("name", "type", "mapped_type", "extraction_source", "connector", "source_path", "community", "semantic_summary", "dataset")


def with_degrees(entities: DataFrame, assertions: DataFrame) -> DataFrame:
    return entities.join(degrees(assertions), [P, "id"], "left").na.fill(0, ["fan_in", "fan_out", "degree", "weighted"])


def hotspots(entities: DataFrame, assertions: DataFrame, limit: int = 12) -> DataFrame:
    """The components of an architecture with most relationships; unrelated ones are none."""
    top = with_degrees(entities.where(is_actionable()), assertions).orderBy(F.desc("degree"), "name", P, "id").limit(limit).where("degree > 0")
    return top.select(P, "id", "name", public_type().alias("type"), area().alias("area"), "fan_in", "fan_out", "degree")


def cross_boundaries(edges: DataFrame) -> DataFrame:
    """Flows between areas of the repository, counted by (area, area, predicate)."""
    crossing = edges.where((layer("s_") == "repo") & (layer("o_") == "repo") & F.col("predicate").isin(*FLOW_PREDICATES) & is_meaningful("s_") & is_meaningful("o_"))
    pairs = crossing.select(area("s_").alias("source_area"), area("o_").alias("target_area"), "predicate")
    return pairs.where("source_area <> '' and target_area <> '' and source_area <> target_area").groupBy("source_area", "target_area", "predicate").agg(F.count("*").alias("n"))


def lineage(edges: DataFrame) -> DataFrame:
    """Lineage between code and data, counted by predicate, ends and their types; first_path is of the first in order."""
    label = lambda p: F.when((layer(p) == "repo") | F.coalesce(f"{p}semantic_summary", F.lit(False)), F.col(f"{p}name")).otherwise(public_type(p))
    wanted = edges.where(((layer("s_") != layer("o_")) | is_lineage("s_") | is_lineage("o_")) & is_meaningful("s_") & is_meaningful("o_"))
    rows = wanted.select("predicate", label("s_").alias("source"), label("o_").alias("target"), public_type("s_").alias("source_type"), public_type("o_").alias("target_type"), artifact_path("source_path").alias("path"), F.struct(F.coalesce("ord", F.lit(-1)), "id").alias("at"))
    return rows.groupBy("predicate", "source", "target", "source_type", "target_type").agg(F.count("*").alias("n"), F.min_by("path", "at").alias("first_path"))


def orphan_groups(entities: DataFrame, assertions: DataFrame) -> DataFrame:
    """Data entities without relationship, by dataset and type: an anti-join on the ends."""
    ends = assertions.select(P, F.col("subject_id").alias("id")).unionByName(assertions.select(P, F.col("object_id").alias("id"))).distinct()
    alone = entities.where(layer() == "data").join(ends, [P, "id"], "left_anti")
    return alone.groupBy(or_else("dataset", F.lit("Structured data")).alias("dataset"), public_type().alias("type")).agg(F.count("*").alias("n"))


def owner_of(metadata: str = "metadata_json") -> Column:
    return F.get_json_object(metadata, "$.owner")


def ownership_gaps(entities: DataFrame) -> DataFrame:
    """Datasets of which no row names an owner."""
    known = F.coalesce(owner_of(), F.lit("")) != ""
    return entities.where(F.coalesce("dataset", F.lit("")) != "").groupBy("dataset").agg(F.count("*").alias("records"), F.max(known).alias("owned")).where("not owned").drop("owned")


def evidence_gaps(assertions: DataFrame) -> DataFrame:
    bare = F.lit(True)
    for c in ("source_path", "evidence_text", "evidence_span_id"):
        bare = bare & (F.coalesce(c, F.lit("")) == "")
    return assertions.groupBy(P).agg(F.count_if(bare).alias("without_evidence"), F.count("*").alias("relationships"))


def conflicts(entities: DataFrame) -> DataFrame:
    """Names that stand for several types."""
    types = entities.where(F.coalesce("normalized_name", F.lit("")) != "").groupBy("normalized_name").agg(F.array_sort(F.collect_set(public_type())).alias("types"))
    return types.where(F.size("types") > 1)


def entity_group(p: str = "") -> tuple[Column, Column]:
    """Category and label under which a changed entity is counted."""
    path = F.get(F.filter(F.split(F.replace(F.coalesce(f"{p}source_path", F.lit("")), F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin(".", "..")), F.lit(0))
    of_data = F.concat(F.col(f"{p}dataset"), F.lit(" · "), or_else(f"{p}mapped_type", public_type(p)))
    has = F.coalesce(f"{p}dataset", F.lit("")) != ""
    return F.when(has, "Business data").otherwise("Architecture"), F.when(has, of_data).otherwise(or_else(f"{p}community", or_else(path, public_type(p))))


def change_groups(changed: DataFrame, representatives: int = 5) -> DataFrame:
    """Changed entities by group, each with its first names (in order of name)."""
    category, label = entity_group()
    shown = ((F.col("type") != "BusinessEntity") | F.coalesce("semantic_summary", F.lit(False))) & ~is_opaque("name")
    named = changed.select(category.alias("category"), label.alias("label"), F.when(shown, F.col("name")).alias("shown"))
    return named.groupBy("category", "label").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("shown")), 1, representatives).alias("representatives"))


def change_counts(changed: DataFrame) -> DataFrame:
    """Per change, architecture and business counts."""
    b = is_business()
    return changed.groupBy("change").agg(F.count_if(~b).alias("architecture"), F.count_if(b).alias("business"))


def affected_components(flagged: DataFrame, neighbours: DataFrame, limit: int = 24) -> DataFrame:
    """Roll-up of edges with one changed end by what their other end is."""
    facts = neighbours.select(P, F.col("id").alias("neighbour_id"), *[F.col(c).alias(f"n_{c}") for c in END_FACTS])
    kept = flagged.join(facts, [P, "neighbour_id"]).where("n_type <> 'Function' and not (n_type = 'Concept' and length(n_name) > 60)")
    b = is_business("n_")
    dataset = or_else("n_dataset", F.lit("Structured data"))
    kind = F.when(b, or_else("n_mapped_type", public_type("n_"))).otherwise(public_type("n_"))
    name = F.when(b, F.concat(dataset, F.lit(" · "), kind)).otherwise(F.col("n_name"))
    where = F.when(b, dataset).otherwise(or_else("n_community", F.lit("Architecture")))
    rolled = kept.groupBy("direction", name.alias("name"), kind.alias("type"), where.alias("area")).agg(F.count("*").alias("relationships"), F.slice(F.array_sort(F.collect_set("predicate")), 1, 5).alias("predicates"))
    return rolled.orderBy(F.desc("relationships"), "direction", "name", "type", "area").limit(limit)
