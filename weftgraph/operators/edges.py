"""Edges, neighbourhoods and bounded paths.

A hub is pre-aggregated wherever only counts are wanted (``signatures`` never builds paths),
and each hop filters by its predicate before it joins, so only edges of the asked path move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.columns import or_else, predicate_weight
from weftgraph.operators.merge import live
from weftgraph.runtime import Workspace

P = "project_slug"


def resolved_edges(entities: DataFrame, assertions: DataFrame, facts: Sequence[str] = ("name", "type")) -> DataFrame:
    """Assertions whose two ends exist, both not stale; ends' facts as ``s_*`` and ``o_*``."""
    ends = live(entities)
    s = ends.select(P, F.col("id").alias("subject_id"), *[F.col(c).alias(f"s_{c}") for c in facts])
    o = ends.select(P, F.col("id").alias("object_id"), *[F.col(c).alias(f"o_{c}") for c in facts])
    return live(assertions).join(s, [P, "subject_id"]).join(o, [P, "object_id"])


def both_ways(edges: DataFrame) -> DataFrame:
    """``(project_slug, eid, predicate, a, b)`` in either direction; a self-loop once."""
    there = edges.select(P, F.col("id").alias("eid"), "predicate", F.col("subject_id").alias("a"), F.col("object_id").alias("b"))
    back = there.where("a <> b").select(P, "eid", "predicate", F.col("b").alias("a"), F.col("a").alias("b"))
    return there.unionByName(back)


def trails(edges: DataFrame, predicates: Sequence[str | None], start: DataFrame | None = None) -> DataFrame:
    """``(project_slug, nodes, eids)`` of undirected trails with these predicates in turn (None: any).

    No edge is used twice, nodes may repeat.  ``start(project_slug, a)`` bounds where they begin.
    """
    if not 1 <= len(predicates) <= 3:
        raise ValueError("a trail has one to three hops")
    sym = both_ways(edges)

    def hop(k: int) -> DataFrame:
        here = sym if predicates[k] is None else sym.where(F.col("predicate") == predicates[k])
        return here.select(P, F.col("a").alias("at"), F.col("b").alias("next"), "eid")

    frontier = hop(0)
    if start is not None:
        frontier = frontier.join(start.select(P, F.col("a").alias("at")).distinct(), [P, "at"], "left_semi")
    path = frontier.select(P, F.array("at", "next").alias("nodes"), F.array("eid").alias("eids"), F.col("next").alias("at"))
    for k in range(1, len(predicates)):
        path = path.join(hop(k), [P, "at"]).where(~F.array_contains("eids", F.col("eid")))
        path = path.select(P, F.array_append("nodes", F.col("next")).alias("nodes"), F.array_append("eids", F.col("eid")).alias("eids"), F.col("next").alias("at"))
    return path.drop("at")


def trail_count_2(edges: DataFrame) -> DataFrame:
    """``(project_slug, trails)`` of two hops, counted without building any: sum of d * (d - 1).

    d is the number of edge ends at a node; a self-loop is one edge and has one end.
    """
    ends = both_ways(edges).groupBy(P, "a").agg(F.count("*").alias("d"))
    return ends.groupBy(P).agg(F.sum(F.expr("d * (d - 1)")).alias("trails"))


def degrees(assertions: DataFrame) -> DataFrame:
    """``(project_slug, id, fan_in, fan_out, degree, weighted)``; a self-loop counts twice."""
    w = predicate_weight("predicate").alias("w")
    out = assertions.select(P, F.col("subject_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"), w)
    into = assertions.select(P, F.col("object_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), w)
    both = out.unionByName(into).where("id is not null")
    return both.groupBy(P, "id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"), F.count("*").alias("degree"), F.sum("w").alias("weighted"))


def top_neighbours(edges: DataFrame, limit: int = 6, preferred: Sequence[str] = (), direction: str = "either") -> DataFrame:
    """For each entity its ``limit`` most relevant edges; a self-loop counts once, as outgoing.

    Relevance: a preferred predicate (one that contains a term) is 0, a confidence of 0.95 is 2,
    a structured source 3, else 10; then the neighbour's name, edge and direction.  With
    preferred terms only such edges are taken, with a direction only those of it.
    """
    if direction not in ("either", "outgoing", "incoming"):
        raise ValueError("direction is either, outgoing or incoming")
    told = F.lit(False)
    for term in preferred:
        told = told | F.coalesce(F.lower("predicate").contains(term.lower()), F.lit(False))
    structured = F.coalesce(F.col("extraction_source") == "structured_connector", F.lit(False))
    relevance = F.when(told, 0).when(F.coalesce("confidence", F.lit(0.0)) >= 0.95, 2).when(structured, 3).otherwise(10)
    cols = [P, F.col("id").alias("edge_id"), "predicate", "confidence", relevance.alias("relevance")]
    kept = edges.where(told) if preferred else edges
    out = kept.select(*cols, F.col("subject_id").alias("entity_id"), F.col("object_id").alias("neighbour_id"), F.col("o_name").alias("neighbour"), F.lit("outgoing").alias("direction"))
    into = kept.where("subject_id <> object_id").select(*cols, F.col("object_id").alias("entity_id"), F.col("subject_id").alias("neighbour_id"), F.col("s_name").alias("neighbour"), F.lit("incoming").alias("direction"))
    both = out if direction == "outgoing" else into if direction == "incoming" else out.unionByName(into)
    w = Window.partitionBy(P, "entity_id").orderBy("relevance", F.asc_nulls_first("neighbour"), "edge_id", "direction")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def _ends(edges: DataFrame) -> DataFrame:
    """``(project_slug, node, name, type, path)`` of the ends of edges; the mapped type where there is one."""
    def side(p: str) -> DataFrame:
        mapped = or_else(f"{p}mapped_type", F.col(f"{p}type")) if f"{p}mapped_type" in edges.columns else F.col(f"{p}type")
        path = F.col(f"{p}source_path") if f"{p}source_path" in edges.columns else F.lit(None).cast("string")
        return edges.select(P, F.col("subject_id" if p == "s_" else "object_id").alias("node"), F.col(f"{p}name").alias("name"), mapped.alias("type"), path.alias("path"))

    return side("s_").unionByName(side("o_")).distinct()


def path_rank(edges: DataFrame, predicates: Sequence[str], group_type: str, metric_type: str, start: DataFrame | None = None, limit: int | None = 100, lowest: bool = False, samples: int = 3) -> DataFrame:
    """Candidates of a type by the distinct nodes of ``metric_type`` on their paths to a filter node.

    ``(project_slug, filter, candidate, name, value, sources, paths)``.  Paths are undirected
    trails of two or three hops whose predicates are ``predicates`` in turn from the candidate;
    ``start(project_slug, a)`` are the filter nodes, every node if None.  sources and paths are
    the first ``samples`` by name; they are picked before they are collected.
    """
    if not 2 <= len(predicates) <= 3:
        raise ValueError("a ranked path has two or three hops")
    t = trails(edges, list(reversed(predicates)), start)
    ends = _ends(edges)
    last = len(predicates)
    nodes = t.select(P, F.get("nodes", F.lit(0)).alias("filter"), F.get("nodes", F.lit(last)).alias("candidate"), F.explode(F.slice("nodes", 2, last - 1)).alias("metric"))
    metric = ends.where(F.col("type") == metric_type).select(P, F.col("node").alias("metric"), F.col("name").alias("m_name"), F.col("path").alias("m_path"))
    candidate = ends.where(F.col("type") == group_type).select(P, F.col("node").alias("candidate"), "name", F.col("path").alias("c_path"))
    pairs = nodes.distinct().join(metric, [P, "metric"]).join(candidate, [P, "candidate"])
    key = [P, "filter", "candidate", "name"]
    w = Window.partitionBy(*key).orderBy(F.asc_nulls_first("m_name"), "metric")
    line = F.concat_ws(" → ", F.coalesce("name", "candidate"), F.coalesce("m_name", "metric"))
    first = F.col("_r") <= samples
    ranked = pairs.withColumn("_r", F.row_number().over(w)).groupBy(*key).agg(
        F.countDistinct("metric").alias("value"),
        F.array_sort(F.collect_set(F.when(first, F.coalesce("m_path", "c_path")))).alias("sources"), F.array_sort(F.collect_set(F.when(first, line))).alias("paths"),
    )
    return ranked if limit is None else ranked.orderBy(F.asc("value") if lowest else F.desc("value"), F.asc_nulls_first("name"), P, "filter", "candidate").limit(limit)


def path_count(edges: DataFrame, predicates: Sequence[str], group_type: str, start: DataFrame | None = None) -> DataFrame:
    """``(project_slug, filter, value)``: distinct candidates of a type on paths of one to three hops to each filter node."""
    t = trails(edges, list(reversed(predicates)), start).select(P, F.get("nodes", F.lit(0)).alias("filter"), F.get("nodes", F.lit(len(predicates))).alias("candidate")).distinct()
    candidate = _ends(edges).where(F.col("type") == group_type).select(P, F.col("node").alias("candidate")).distinct()
    return t.join(candidate, [P, "candidate"], "left_semi").groupBy(P, "filter").agg(F.count("*").alias("value"))


def signatures(edges: DataFrame, start: DataFrame, limit: int = 200, hops: int = 2) -> DataFrame:
    """Kinds of paths of two hops at most, or three, from the start nodes, with how many there are.

    ``(group_type, predicates, intermediate_types, hops, examples)``.  Counts are carried
    along node by node, so a hub costs its number of predicates, not its paths.
    """
    if hops not in (2, 3):
        raise ValueError("signatures have two or three hops at most")
    space = Workspace(edges.sparkSession) if hops == 3 else None
    if space:  # the plan of three hops reads its edges some twenty times
        edges = space.cut(edges.select(P, "id", "predicate", "subject_id", "object_id", "s_type", "o_type"))
    typed = edges.select(P, F.col("id").alias("eid"), "predicate", F.col("subject_id").alias("a"), F.col("object_id").alias("b"), F.col("o_type").alias("b_type"))
    back = edges.where("subject_id <> object_id").select(P, F.col("id").alias("eid"), "predicate", F.col("object_id").alias("a"), F.col("subject_id").alias("b"), F.col("s_type").alias("b_type"))
    sym = typed.unionByName(back)
    one = sym.join(start.select(P, "a").distinct(), [P, "a"], "left_semi")
    hop1 = one.groupBy(F.col("b_type").alias("group_type"), F.array("predicate").alias("predicates"), F.array().cast("array<string>").alias("intermediate_types"), F.lit(1).alias("hops")).agg(F.count("*").alias("examples"))
    reach = one.groupBy(P, F.col("b").alias("a"), F.col("predicate").alias("p1"), F.col("b_type").alias("mid")).agg(F.count("*").alias("n"))
    onward = sym.groupBy(P, "a", F.col("predicate").alias("p2"), F.col("b_type").alias("group_type")).agg(F.count("*").alias("m"))
    pairs = reach.join(onward, [P, "a"]).groupBy("group_type", "p1", "p2", "mid").agg(F.sum(F.expr("n * m")).alias("examples"))
    # take off those that go back over the edge they came by
    returning = one.join(edges.select(P, F.col("id").alias("eid"), "subject_id", "object_id", "s_type", "o_type"), [P, "eid"])
    back_type = F.when(F.col("b") == F.col("object_id"), F.col("s_type")).otherwise(F.col("o_type"))
    loops = returning.select("predicate", F.col("b_type").alias("mid"), F.when(F.col("a") == F.col("b"), F.col("b_type")).otherwise(back_type).alias("group_type"))
    loops = loops.groupBy("group_type", F.col("predicate").alias("p1"), F.col("predicate").alias("p2"), "mid").agg(F.count("*").alias("less"))
    hop2 = pairs.join(loops, ["group_type", "p1", "p2", "mid"], "left").withColumn("examples", F.expr("examples - coalesce(less, 0)")).where("examples > 0")
    hop2 = hop2.select("group_type", F.array("p2", "p1").alias("predicates"), F.array("mid").alias("intermediate_types"), F.lit(2).alias("hops"), "examples")
    found = hop1.unionByName(hop2) if hops == 2 else hop1.unionByName(hop2).unionByName(_third_hop(edges, sym, one, space))
    return found.orderBy(F.desc("examples"), "hops", "group_type", "predicates", "intermediate_types").limit(limit)


def _third_hop(edges: DataFrame, sym: DataFrame, one: DataFrame, space: Workspace) -> DataFrame:
    """Signatures of three hops a - b - c - d: all walks, less those that use an edge twice.

    With the first two edges apart, the third is the second again (back to b) or the first
    again (c is an end of it); the two exclude each other.
    """
    a_type = edges.select(P, F.col("id").alias("eid"), F.col("subject_id").alias("a"), F.col("s_type").alias("a_type")).unionByName(edges.where("subject_id <> object_id").select(P, F.col("id").alias("eid"), F.col("object_id").alias("a"), F.col("o_type").alias("a_type")))
    first = space.cut(one.join(a_type, [P, "eid", "a"]).groupBy(P, "a", "a_type", "b", F.col("b_type").alias("m1"), F.col("predicate").alias("p1")).agg(F.count("*").alias("n")))
    second = sym.groupBy(P, F.col("a").alias("b"), F.col("b").alias("c"), F.col("predicate").alias("p2"), F.col("b_type").alias("m2")).agg(F.count("*").alias("m"))
    onward = sym.groupBy(P, F.col("a").alias("c"), F.col("predicate").alias("p3"), F.col("b_type").alias("group_type")).agg(F.count("*").alias("k"))
    key = ["p1", "m1", "p2", "m2"]
    there = first.groupBy(P, "b", "p1", "m1").agg(F.sum("n").alias("n")).join(second, [P, "b"]).groupBy(P, "c", *key).agg(F.sum(F.expr("n * m")).alias("w"))
    returned = first.groupBy(P, F.col("a").alias("c"), "p1", "m1", F.col("p1").alias("p2"), F.col("a_type").alias("m2")).agg((-F.sum("n")).alias("w"))
    two = space.cut(there.unionByName(returned).groupBy(P, "c", *key).agg(F.sum("w").alias("w")).where("w > 0"))
    walks = two.join(onward, [P, "c"]).groupBy(*key, "p3", "group_type").agg(F.sum(F.expr("w * k")).alias("examples"))
    again2 = two.groupBy(*key, F.col("p2").alias("p3"), F.col("m1").alias("group_type")).agg((-F.sum("w")).alias("examples"))
    ends = first.withColumn("c", F.explode(F.array_distinct(F.array("a", "b"))))  # of the first edge
    both = ends.join(second, [P, "b", "c"]).withColumn("pairs", F.expr("n * m - CASE WHEN p1 = p2 AND c = a THEN n ELSE 0 END"))
    again1 = both.groupBy(*key, F.col("p1").alias("p3"), F.expr("CASE WHEN c = a THEN m1 ELSE a_type END").alias("group_type")).agg((-F.sum("pairs")).alias("examples"))
    total = walks.unionByName(again2).unionByName(again1).groupBy(*key, "p3", "group_type").agg(F.sum("examples").alias("examples")).where("examples > 0")
    return total.select("group_type", F.array("p3", "p2", "p1").alias("predicates"), F.array("m2", "m1").alias("intermediate_types"), F.lit(3).alias("hops"), "examples")


def reverse_impact(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """``(project_slug, id, distance)`` of what depends on the start nodes, breadth first."""
    into = edges.select(P, F.col("object_id").alias("at"), F.col("subject_id").alias("id")).distinct()
    seen = start.select(P, F.col("a").alias("id")).distinct().withColumn("distance", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.select(P, F.col("id").alias("at")).join(into, [P, "at"]).select(P, "id").distinct()
        frontier = step.join(seen.select(P, "id"), [P, "id"], "left_anti").withColumn("distance", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen.where("distance > 0")


def affected(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with exactly one changed end, and the other end: ``(…, neighbour_id, direction)``."""
    c = changed.select(P, "id").distinct()
    s = c.select(P, F.col("id").alias("subject_id"), F.lit(True).alias("s_changed"))
    o = c.select(P, F.col("id").alias("object_id"), F.lit(True).alias("o_changed"))
    flagged = edges.join(s, [P, "subject_id"], "left").join(o, [P, "object_id"], "left")
    one = flagged.where("coalesce(s_changed, false) <> coalesce(o_changed, false)")
    first = F.coalesce("s_changed", F.lit(False))
    return one.withColumn("neighbour_id", F.when(first, F.col("object_id")).otherwise(F.col("subject_id"))).withColumn("direction", F.when(first, "downstream").otherwise("upstream")).drop("s_changed", "o_changed")
