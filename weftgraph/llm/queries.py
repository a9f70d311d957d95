"""Queries of the language-model operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.codefiles import code_files, pointing_entities
from weftgraph.llm.cutting import cut_items
from weftgraph.llm.grouping import consolidate
from weftgraph.llm.leaks import find_leaks
from weftgraph.llm.matching import match_entities
from weftgraph.llm.personal import find_personal
from weftgraph.llm.tokens import encode_documents
from weftgraph.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_matches(spark: SparkSession, d: str) -> DataFrame:
    return match_entities(table(spark, d, "entities"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_matches(spark, d).select("id_a", "id_b")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return consolidate(table(spark, d, "resolution_results"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    parts = [cut_items(table(spark, d, t), ["project_slug", "id"]).select(F.lit(t).alias("table_name"), "project_slug", F.col("id").alias("record_id"), "ordinal", "text") for t in ("source_spans", "chunks")]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    # an item is cut in two pieces at least
    return p4_pieces(spark, d).where("ordinal = 1 and record_id is not null").select("table_name", "record_id").distinct()


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    return code_files(table(spark, d, "sources"), table(spark, d, "source_spans"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    files = p5_files(spark, d)
    entities = pointing_entities(table(spark, d, "entities"), files)
    both = files.select(F.lit("sources").alias("table_name"), F.col("id").alias("record_id")).unionByName(entities.select(F.lit("entities").alias("table_name"), F.col("id").alias("record_id")))
    return both.distinct()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_documents(table(spark, d, "documents"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "golden_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    leaks = _leaks(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("words").alias("longest_words"))
    return table(spark, d, "golden_items").select("item_id").join(leaks, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"), "longest_words")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = find_personal(table(spark, d, "documents")).select("doc_id", F.explode("found").alias("f"))
    return found.select("doc_id", "f.kind", "f.value").distinct()


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return find_personal(table(spark, d, "documents")).select("doc_id", "text", F.size("found").alias("replaced"))


QUERIES: dict[str, Query] = {
    "p2_found": p2_found, "p2_matches": p2_matches,
    "p3_found": p3_found, "p4_found": p4_found, "p4_pieces": p4_pieces,
    "p5_found": p5_found, "p5_files": p5_files,
    "p7_ids": p7_ids,
    "p8_found": p8_found, "p8_items": p8_items,
    "p9_found": p9_found, "p9_redacted": p9_redacted,
}

SQL: dict[str, str] = {
    "p3_found": """
WITH RECURSIVE ids AS (
  SELECT list_distinct(list_filter(list_append(coalesce(matched_entities, []), canonical_entity_id), lambda x: x IS NOT NULL)) AS ids FROM resolution_results),
vertices AS (SELECT DISTINCT unnest(ids) AS v FROM ids),
edges AS (
  SELECT DISTINCT list_min(ids) AS a, unnest(ids) AS b FROM ids WHERE len(ids) > 1),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(v, w) AS (
  SELECT v, v FROM vertices
  UNION
  SELECT r.v, e.b FROM reach r JOIN both_ways e ON r.w = e.a)
SELECT min(w) AS group_id, v AS entity_id FROM reach GROUP BY v
""",
    "p4_found": """
SELECT DISTINCT 'source_spans' AS table_name, id AS record_id FROM source_spans WHERE length(text) > 2000 AND id IS NOT NULL
UNION ALL SELECT DISTINCT 'chunks', id FROM chunks WHERE length(text) > 2000 AND id IS NOT NULL
""",
}
