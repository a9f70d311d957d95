"""Consolidating pairwise matches into groups.

Method: random contraction.  In every round each vertex hooks to the neighbour that comes
first in a fresh hash order, edges are relabelled by that mapping and deduplicated, and the
mapping is kept; when no edge is left the mappings are expanded backwards.  Rounds hook in
turn within the open neighbourhood (this folds a star, however large, into one edge) and
within the closed one, where a vertex may keep itself (this halves long chains).  The number of rounds grows with the
logarithm of the number of vertices.

Only joins and combining aggregations on vertex ids are used: a hub with a third of all
edges is pre-aggregated before the exchange, and its join side, which has the edges, is one
that adaptive execution may split (the other side has unique keys).  Each round's edges
and mapping are tables in the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.runtime import Workspace


def link_rows(rows: DataFrame, centre: str, others: str) -> tuple[DataFrame, DataFrame]:
    """Edges and vertices of a table whose rows link ``centre`` and the array ``others``.

    All non-null ids of a row are linked, whether centre is null or not: to the least one.
    """
    ids = rows.select(F.array_compact(F.array_distinct(F.concat(F.array(centre), F.coalesce(others, F.array().cast("array<string>"))))).alias("ids"))
    ids = ids.where(F.size("ids") > 0)
    vertices = ids.select(F.explode("ids").alias("v")).distinct()
    edges = ids.where(F.size("ids") > 1).select(F.array_min("ids").alias("a"), F.explode("ids").alias("b")).where("a <> b").distinct()
    return edges, vertices


def components(edges: DataFrame, space: Workspace, max_rounds: int = 200) -> DataFrame:
    """``(v, root)`` for every vertex of ``edges(a, b)``; root is some vertex of its group."""
    edges = space.cut(edges.where("a <> b"))
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        turn = len(maps)
        if turn >= max_rounds:
            raise RuntimeError(f"{max_rounds} rounds did not contract the graph")
        rank = lambda c, turn=turn: F.xxhash64(F.lit(turn), c)
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.v", "e.w")
        first = ends.groupBy("v").agg(F.min(F.struct(rank("w").alias("h"), "w")).alias("n"))
        hooked = F.least("n", F.struct(rank("v").alias("h"), F.col("v").alias("w"))) if turn % 2 else F.col("n")
        mapping = space.cut(first.select("v", hooked["w"].alias("r")))
        a = mapping.select(F.col("v").alias("a"), F.col("r").alias("ra"))
        b = mapping.select(F.col("v").alias("b"), F.col("r").alias("rb"))
        fresh = edges.join(a, "a").join(b, "b").where("ra <> rb")
        fresh = space.cut(fresh.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        space.drop(edges)
        edges = fresh
        maps.append(mapping)
    if not maps:
        space.keep_only(edges)
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    label = maps[-1].select("v", F.col("r").alias("root"))
    for mapping in reversed(maps[:-1]):
        deeper = label.select(F.col("v").alias("r"), "root")
        label = space.cut(mapping.join(deeper, "r", "left").select("v", F.coalesce("root", "r").alias("root")))
    space.keep_only(label if len(maps) > 1 else maps[0])
    return label


def consolidate(rows: DataFrame, centre: str = "canonical_entity_id", others: str = "matched_entities") -> DataFrame:
    """``(group_id, entity_id)``, one row per non-null id in either column.

    group_id is the least id (string order) linked directly or indirectly.  Ids without
    partner form their own group; null ids, null or empty arrays and null elements link
    nothing; repeated and mirrored rows change nothing.  No row gives an empty result, and
    other columns aren't read.
    """
    space = Workspace(rows.sparkSession)
    edges, vertices = link_rows(rows, centre, others)
    label = components(edges, space)
    least = label.groupBy("root").agg(F.min(F.least("v", "root")).alias("group_id"))
    grouped = label.join(least, "root").select("group_id", F.col("v").alias("entity_id"))
    alone = vertices.join(label, "v", "left_anti").select(F.col("v").alias("group_id"), F.col("v").alias("entity_id"))
    return grouped.unionByName(alone)
