"""Ranking and pruning of a graph for display."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.columns import architecture_group, is_visible_architecture, layer, or_else, predicate_weight, stable_id, type_weight
from weftgraph.model import SECTIONS
from weftgraph.operators.edges import degrees

P = "project_slug"
DATA_LIMIT, PER_TYPE, LINK_LIMIT, GROUP_LIMIT, PAGES_PER_TYPE = 300, 60, 1800, 30, 250


def display_type(p: str = ""):
    return or_else(f"{p}mapped_type", F.col(f"{p}type"))


def layer_scores(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Weighted degree, type priority, 3 if authoritative, 2 for summaries."""
    d = degrees(links).select(P, "id", "weighted")
    authority = F.when(F.coalesce(F.col("extraction_source") == "structured_connector", F.lit(False)), 3).otherwise(0)
    summary = F.when(F.coalesce("semantic_summary", F.lit(False)), 2).otherwise(0)
    scored = nodes.join(d, [P, "id"], "left")
    return scored.withColumn("score", F.coalesce("weighted", F.lit(0)) + type_weight(display_type(), 0) + authority + summary).drop("weighted")


def top_per_type(scored: DataFrame, limit: int = DATA_LIMIT, per_type: int = PER_TYPE) -> DataFrame:
    """Each type is cut to its best before the whole is, so none crowds out the others.

    Both cuts are group limits, taken in each partition before rows move.
    """
    w = Window.partitionBy(display_type()).orderBy(F.desc("score"), "name", P, "id")
    kept = scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_type).drop("_r")
    return kept.orderBy(F.desc("score"), "name", P, "id").limit(limit)


def links_within(links: DataFrame, nodes: DataFrame, limit: int = LINK_LIMIT) -> DataFrame:
    ids = nodes.select(P, "id")
    inside = links.join(ids.withColumnRenamed("id", "subject_id"), [P, "subject_id"], "left_semi").join(ids.withColumnRenamed("id", "object_id"), [P, "object_id"], "left_semi")
    return inside.withColumn("weight", predicate_weight("predicate")).orderBy(F.desc("weight"), P, "id").limit(limit)


def architecture_groups(entities: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """``(project_slug, id, group)`` of visible architecture; the smallest groups become one."""
    shown = entities.where((layer() == "repo") & is_visible_architecture()).select(P, "id", architecture_group().alias("label"))
    sizes = shown.groupBy("label").agg(F.count("*").alias("n"))
    many = sizes.orderBy(F.desc("n"), "label").limit(limit + 1)
    ranked = many.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("n"), "label"))).withColumn("_all", F.count("*").over(Window.partitionBy()))
    keep = ranked.where((F.col("_all") <= limit) | (F.col("_r") <= max(1, limit - 1))).select("label", F.lit(True).alias("_keep"))
    grouped = shown.join(F.broadcast(keep), "label", "left")  # at most ``limit`` rows
    return grouped.select(P, "id", F.when(F.col("_keep"), F.col("label")).otherwise("Other architecture").alias("group"))


def group_links(links: DataFrame, groups: DataFrame, limit: int = 240) -> DataFrame:
    """Links contracted to their groups; those within a group vanish."""
    s = groups.select(P, F.col("id").alias("subject_id"), F.col("group").alias("source"))
    o = groups.select(P, F.col("id").alias("object_id"), F.col("group").alias("target"))
    both = links.join(s, [P, "subject_id"]).join(o, [P, "object_id"]).where("source <> target")
    rolled = both.groupBy("source", "target", "predicate").agg(F.count("*").alias("members"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))
    top = rolled.orderBy(F.desc("members"), "source", "target", "predicate").limit(limit)
    return top.select(stable_id("group_link", "source", "predicate", "target").alias("id"), "source", "target", "predicate", "members", "confidence")


def page_worthy(entities: DataFrame, assertions: DataFrame, edges: DataFrame, per_type: int = PAGES_PER_TYPE) -> DataFrame:
    """All of the repository, of each type of data the best by weighted degree, and the ends of key relationships."""
    d = degrees(assertions).select(P, "id", "weighted")
    data = entities.where(layer() == "data").join(d, [P, "id"], "left")
    w = Window.partitionBy(display_type()).orderBy(F.desc(F.coalesce("weighted", F.lit(0))), "name", P, "id")
    best = data.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_type)
    key = edges.select(P, "id", "subject_id", "object_id").join(key_relationships(edges).select(P, "id"), [P, "id"], "left_semi")
    ends = key.select(P, F.explode(F.array("subject_id", "object_id")).alias("id"))
    return entities.where(layer() == "repo").select(P, "id").unionByName(best.select(P, "id")).unionByName(ends).distinct()


def relationship_scores(edges: DataFrame) -> DataFrame:
    """Score of an edge: its predicate, its ends' types and degrees among ``edges``, evidence and confidence."""
    d = degrees(edges).select(P, "id", "degree")
    both = edges.join(d.select(P, F.col("id").alias("subject_id"), F.col("degree").alias("sd")), [P, "subject_id"], "left").join(d.select(P, F.col("id").alias("object_id"), F.col("degree").alias("od")), [P, "object_id"], "left")
    evidence = F.when((F.coalesce("evidence_text", F.lit("")) != "") | (F.coalesce("evidence_span_id", F.lit("")) != ""), 1).otherwise(0)
    dull = F.when((F.col("predicate") == "contains") & (F.col("s_type") == "File"), 6).otherwise(0)
    total = F.coalesce("sd", F.lit(0)) + F.coalesce("od", F.lit(0))
    score = predicate_weight("predicate") + type_weight("s_type", 2) + type_weight("o_type", 2) + evidence + 2 * F.coalesce("confidence", F.lit(0.0)) + 0.4 * F.least(F.lit(8), total) - dull
    return both.withColumn("score", F.round(score.cast("double"), 6)).drop("sd", "od")


def key_relationships(edges: DataFrame, per_section: int = 12) -> DataFrame:
    """``(project_slug, section, position, id, score)``: diverse best edges of each section.

    Edges are tried by score, ties in their order (``ord``, id), sections in turn; an edge is
    taken once.  Quotas: three per source path, four per pair of types, four per predicate, one
    ``contains`` of a file per source path.  Edges that no quota tells apart (same section,
    predicate, types and source) beyond those that earlier sections might take and three more
    can't be chosen, so they are cut before the exchange; the rest of a project streams through
    one task in order, which keeps counters only and stops choosing when a section is full.
    """
    scored = relationship_scores(edges).withColumn("source", or_else("source_path", or_else("s_source_path", F.lit("synthetic"))))
    parts = None
    for n, (section, predicates, types) in enumerate(SECTIONS):
        kinds = [F.col("s_type"), F.col("o_type"), display_type("s_"), display_type("o_")]
        by_type = F.lit(False)
        for k in kinds[:2] if "BusinessEntity" in types else kinds:
            by_type = by_type | k.isin(*(["BusinessEntity"] if "BusinessEntity" in types else types))
        belongs = F.col("predicate").isin(*predicates) | (by_type & (F.col("predicate") != "contains"))
        part = scored.where(F.coalesce(belongs, F.lit(False))).select(P, F.lit(n).alias("n"), F.lit(section).alias("section"), "id", "ord", "source", "predicate", "s_type", "o_type", "score")
        parts = part if parts is None else parts.unionByName(part)
    alike = Window.partitionBy(P, "n", "predicate", "s_type", "o_type", "source").orderBy(F.desc("score"), F.asc_nulls_first("ord"), "id")
    best = parts.withColumn("_r", F.row_number().over(alike)).where(F.col("_r") <= per_section * (len(SECTIONS) - 1) + 3).drop("_r")
    ordered = best.repartition(P).sortWithinPartitions(P, "n", F.desc("score"), F.asc_nulls_first("ord"), "id")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, at, taken = object(), None, set()
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if r["project_slug"] != project:
                    project, at, taken = r["project_slug"], None, set()
                if r["n"] != at:
                    at, chosen = r["n"], 0
                    counts: Counter = Counter()
                quotas = [(("source", r["source"]), 3), (("pair", r["s_type"], r["o_type"]), 4), (("predicate", r["predicate"]), 4)]
                if r["predicate"] == "contains" and r["s_type"] == "File":
                    quotas.append((("contains", r["source"]), 1))
                if chosen >= per_section or r["id"] in taken or any(counts[k] >= most for k, most in quotas):
                    continue
                counts.update(k for k, _ in quotas)
                chosen += 1
                taken.add(r["id"])
                out.append((project, r["section"], chosen, r["id"], r["score"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64()), strict=True)], names=["project_slug", "section", "position", "id", "score"])

    return ordered.mapInArrow(choose, "project_slug string, section string, position int, id string, score double")
