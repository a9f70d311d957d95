"""Validation of assertions and resolution of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.columns import canonical_name, is_opaque, normal_predicate, or_else, stable_id
from weftgraph.model import ENTITY_TYPES, PREDICATES, STATUSES

P = "project_slug"


def validate(assertions: DataFrame, entities: DataFrame, spans: DataFrame, least: float = 0.5) -> DataFrame:
    """Each assertion, its predicate normalised, with the first rule it breaks as ``reason``, null if none.

    invalid_predicate (not for the structured extractor), missing_entity, missing_evidence,
    confidence_below_threshold, in this order.  Three left joins on distinct ids.
    """
    assertions = assertions.withColumn("predicate", normal_predicate("predicate"))
    ids = entities.select(P, "id").distinct()
    s = ids.select(P, F.col("id").alias("subject_id"), F.lit(True).alias("_s"))
    o = ids.select(P, F.col("id").alias("object_id"), F.lit(True).alias("_o"))
    e = spans.select(P, F.col("id").alias("evidence_span_id")).distinct().withColumn("_e", F.lit(True))
    flagged = assertions.join(s, [P, "subject_id"], "left").join(o, [P, "object_id"], "left").join(e, [P, "evidence_span_id"], "left")
    structured = F.coalesce(F.col("extractor") == "structured_connector", F.lit(False))
    reason = (
        F.when(~F.coalesce(F.col("predicate").isin(*PREDICATES), F.lit(False)) & ~structured, "invalid_predicate")
        .when(F.col("_s").isNull() | F.col("_o").isNull(), "missing_entity")
        .when(F.col("_e").isNull(), "missing_evidence")
        .when(F.coalesce("confidence", F.lit(0.0)) < least, "confidence_below_threshold")
    )
    return flagged.select(*assertions.columns, reason.alias("reason"))


def rejected_entities(entities: DataFrame) -> DataFrame:
    """``(project_slug, id, reason)`` of entities of a type the model doesn't have."""
    bad = ~F.coalesce(F.col("type").isin(*ENTITY_TYPES), F.lit(False))
    return entities.where(bad).select(P, "id", F.lit("invalid_entity_type").alias("reason"))


def accepted(validated: DataFrame, violations: DataFrame | None = None) -> DataFrame:
    """What passes, as validated; nothing does if there is any violation of a shape."""
    good = validated.where("reason is null").withColumn("status", F.lit("validated")).drop("reason")
    if violations is None:
        return good
    any_ = violations.agg((F.count("*") > 0).alias("_any"))
    return good.join(F.broadcast(any_.where("_any")), F.lit(True), "left_anti")  # one row at most


def rejects_by(validated: DataFrame, *by: str) -> DataFrame:
    return validated.where("reason is not null").groupBy("reason", *by).agg(F.count("*").alias("n"))


def shape_violations(entities: DataFrame, assertions: DataFrame) -> DataFrame:
    """``(kind, id, violation)`` of rows that break the shapes of the model."""
    e = entities.select(
        F.lit("entity").alias("kind"), "id",
        F.explode(F.array_compact(F.array(
            F.when(F.coalesce("name", F.lit("")) == "", "no name"),
            F.when(~F.coalesce(F.col("type").isin(*ENTITY_TYPES), F.lit(False)), "no such type"),
        ))).alias("violation"),
    )
    a = assertions.select(
        F.lit("assertion").alias("kind"), "id",
        F.explode(F.array_compact(F.array(
            F.when(F.coalesce("predicate", F.lit("")) == "", "no predicate"),
            F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence outside 0..1"),
            F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "no such status"),
            F.when(F.coalesce("evidence_span_id", F.lit("")) == "", "no evidence"),
        ))).alias("violation"),
    )
    return e.unionByName(a)


def resolution_key(entities: DataFrame) -> DataFrame:
    """With ``resolved_id``: by domain, type and key for structured rows, else by name and type."""
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    structured = F.coalesce(F.col("extraction_source") == "structured_connector", F.lit(False)) & full("domain") & full("mapped_type") & full("record_key")
    named = stable_id("entity", P, F.lit("named"), canonical_name(or_else("normalized_name", F.col("name"))), "type")
    return entities.withColumn("resolved_id", F.when(structured, stable_id("entity", P, F.lit("structured"), "domain", "mapped_type", "record_key")).otherwise(named))


def resolve_entities(entities: DataFrame) -> DataFrame:
    """One row per resolved id, folded over its rows in their order.

    The first row seeds.  A row whose name displays better (opaque, then one word, then
    several; of those the shorter) replaces the name; description and path are the better
    row's or else the other's; aliases and spans are sorted unions.  Small states are folded
    with a higher-order function; a group is as large as one thing's mentions.
    """
    keyed = resolution_key(entities)
    name = F.coalesce("name", F.lit(""))
    words = F.size(F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != ""))
    rank = F.when(is_opaque("name"), 0).when(words > 1, 2).otherwise(1)
    arr = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    item = F.struct(
        "ord", "id", name.alias("name"), rank.alias("rank"), (-F.length(name)).alias("short"), F.col("description"), F.col("source_path"),
        F.array_compact(arr("aliases")).alias("aliases"), F.array_compact(arr("source_span_ids")).alias("spans"), "type", "community", "extraction_source",
    )
    groups = keyed.groupBy(P, "resolved_id").agg(F.array_sort(F.collect_list(item)).alias("rows"))

    def step(s, e):
        better = (e["rank"] > s["rank"]) | ((e["rank"] == s["rank"]) & (e["short"] > s["short"]))
        pick = lambda f: F.when(better, e[f]).otherwise(s[f])
        other = lambda f: F.when(better, s[f]).otherwise(e[f])
        return F.struct(
            pick("name").alias("name"), pick("rank").alias("rank"), pick("short").alias("short"),
            or_else(pick("description"), other("description")).alias("description"), or_else(pick("source_path"), other("source_path")).alias("source_path"),
            F.array_sort(F.array_except(F.array_union(F.array_union(s["aliases"], e["aliases"]), F.array(other("name"))), F.array(pick("name")))).alias("aliases"),
            F.array_sort(F.array_union(s["spans"], e["spans"])).alias("spans"),
        )

    first = F.get("rows", F.lit(0))
    seed = F.struct(*[first[f].alias(f) for f in ("name", "rank", "short", "description", "source_path")], F.array_sort(F.array_distinct(first["aliases"])).alias("aliases"), F.array_sort(F.array_distinct(first["spans"])).alias("spans"))
    folded = groups.select(P, "resolved_id", F.size("rows").alias("mentions"), first.alias("f"), F.aggregate(F.slice("rows", 2, F.size("rows")), seed, step).alias("s"))
    return folded.select(
        P, F.col("resolved_id").alias("id"), F.col("f.type").alias("type"), F.col("s.name").alias("name"), canonical_name("s.name").alias("normalized_name"),
        "s.description", "s.source_path", "s.aliases", F.col("s.spans").alias("source_span_ids"), "f.community", "f.extraction_source", "mentions",
    )


def remap_assertions(assertions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Ends follow ``mapping(project_slug, id, resolved_id)``, others stay; ids are hashed anew from the old ones."""
    s = mapping.select(P, F.col("id").alias("subject_id"), F.col("resolved_id").alias("_s"))
    o = mapping.select(P, F.col("id").alias("object_id"), F.col("resolved_id").alias("_o"))
    moved = assertions.join(s, [P, "subject_id"], "left").join(o, [P, "object_id"], "left")
    moved = moved.withColumn("subject_id", F.coalesce("_s", "subject_id")).withColumn("object_id", F.coalesce("_o", "object_id")).drop("_s", "_o")
    return moved.withColumn("id", stable_id("assertion", P, "id"))
