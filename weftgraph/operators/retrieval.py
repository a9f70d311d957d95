"""Search, exact lookup, vector retrieval and bounded traversal."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.columns import canonical_name
from weftgraph.operators.edges import both_ways
from weftgraph.operators.merge import live

P = "project_slug"


def search_entities(entities: DataFrame, query: str, limit: int = 50, layer: str | None = None) -> DataFrame:
    """Substring search in names and aliases: exact first, then prefix, then inside; shorter first."""
    if not 1 <= limit <= 50:
        raise ValueError("limit is between 1 and 50")
    q = query.strip().lower()
    name, normal = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("normalized_name", F.lit("")))
    alias = F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.coalesce(F.lower(a).contains(q), F.lit(False)))
    hit = name.contains(q) | normal.contains(q) | alias
    if layer:
        structured = F.coalesce(F.col("extraction_source") == "structured_connector", F.lit(False))
        hit = hit & (structured if layer == "data" else ~structured)
    rank = F.when(name == q, 0).when(name.startswith(q), 1).otherwise(2)
    found = live(entities).where(hit).select(P, "id", "name", "type", rank.alias("rank"), F.length(name).alias("length"))
    return found.orderBy("rank", "length", "name", P, "id").limit(limit)


def exact_lookup(entities: DataFrame, names: Sequence[str], limit: int = 4) -> DataFrame:
    """Entities whose name, normalized name or an alias is one of ``names``, per project the first."""
    low = [n.strip().lower() for n in names]
    alias = F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.coalesce(F.lower(a).isin(low), F.lit(False)))
    hit = F.coalesce(F.lower("name").isin(low), F.lit(False)) | F.coalesce(F.col("normalized_name").isin(low), F.lit(False)) | alias
    w = Window.partitionBy(P).orderBy(F.length("name"), "name", "id")
    return live(entities).where(hit).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(P, "id", "name", "type", "rank")


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine similarity in double precision; null where a vector is null, zero or of other size."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    size = sum(x * x for x in query) ** 0.5
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    if not size:
        return F.lit(None).cast("double")
    return F.when((F.size(vector) == len(query)) & (norm > 0), dot / (norm * F.lit(float(size))))


def vector_top_k(rows: DataFrame, key: str, query: Sequence[float], k: int = 4, vector: str = "embedding") -> DataFrame:
    """Exact nearest rows by cosine: one pass, of which each task keeps its best ``k``."""
    if not 1 <= k <= 50:
        raise ValueError("k is between 1 and 50")
    scored = rows.select(key, F.round(cosine(F.col(vector), query), 6).alias("score")).where("score is not null")
    return scored.orderBy(F.desc("score"), key).limit(k)


#: Query vectors a block has on average; a block is sent to every task.
QUERY_BLOCK = 2048


def vector_top_k_each(rows: DataFrame, queries: DataFrame, key: str, k: int = 10, vector: str = "embedding") -> DataFrame:
    """``(query_id, key, score, rank)``: the exact ``k`` nearest rows of every query vector by cosine.

    Queries are taken in blocks of a bounded number; of each block every batch of rows gives its
    best ``k`` a query by one matrix product, and the best of those are kept by a group limit.
    Scores are rounded to six digits, ties go by key.  Null, zero and wrongly sized vectors (other
    than the first query's) have no score; empty tables give no rows.
    """
    if not 1 <= k <= 50:
        raise ValueError("k is between 1 and 50")
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    count = asked.count()
    blocks = -(-count // QUERY_BLOCK)
    kind = rows.schema[key].dataType.simpleString()
    out = rows.sparkSession.createDataFrame([], f"query_id {kind}, {key} {kind}, score double")
    own = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == block).limit(2 * QUERY_BLOCK + 1).collect()
        if len(part) > 2 * QUERY_BLOCK:
            raise ValueError("queries repeat a key too often for blocks of a bounded size")
        if not part:
            continue
        size = len(part[0]["v"])
        part = [r for r in part if len(r["v"]) == size and any(r["v"])]
        matrix = np.array([r["v"] for r in part], dtype=np.float64).reshape(len(part), size)
        matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
        sent = rows.sparkSession.sparkContext.broadcast(([r["k"] for r in part], matrix))

        def best(batches: Iterator[pa.RecordBatch], sent=sent, size=size) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for batch in batches:
                keep = [n for n, v in enumerate(batch.column("v").to_pylist()) if len(v) == size and any(v)]
                if not keep or not ids:
                    continue
                taken = batch.take(pa.array(keep))
                order = np.argsort(np.argsort(np.array(taken.column("k").to_pylist()), kind="stable"), kind="stable")
                x = np.array(taken.column("v").to_pylist(), dtype=np.float64)
                scores = np.round(q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 6)
                top = np.lexsort((np.broadcast_to(order, scores.shape), -scores), axis=1)[:, :k]
                at = pa.array(top.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(ids, taken.column("k").type).take(pa.array(np.repeat(np.arange(len(ids)), top.shape[1]))), taken.column("k").take(at), pa.array(np.take_along_axis(scores, top, axis=1).ravel())], names=["query_id", key, "score"])

        out = out.unionByName(own.mapInArrow(best, f"query_id {kind}, {key} {kind}, score double"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hits_to_entities(hits: DataFrame, chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """Each hit chunk's entity, if it is in the project and not stale."""
    e = live(entities).select(P, F.col("id").alias("entity_id"), "name")
    on = [P, "id"] if P in hits.columns else ["id"]
    return hits.join(chunks.select(P, "id", F.lower(F.trim("entity_id")).alias("entity_id")), on).join(e, [P, "entity_id"])


def bounded_paths(edges: DataFrame, start: DataFrame, limit: int = 6) -> DataFrame:
    """Up to ``limit`` paths of one or two hops from each start entity, the surest and shortest first."""
    sym = both_ways(edges).join(edges.select(P, F.col("id").alias("eid"), "confidence"), [P, "eid"])
    one = sym.join(start.select(P, F.col("a")).distinct(), [P, "a"], "left_semi")
    sure = F.coalesce("confidence", F.lit(0.0)) >= 0.95
    first = one.select(P, F.col("a").alias("start"), F.col("b").alias("at"), F.array("eid").alias("eids"), F.array("predicate").alias("predicates"), sure.alias("sure"), F.lit(1).alias("hops"))
    more = sym.select(P, F.col("a").alias("at"), F.col("b").alias("end"), "eid", "predicate", sure.alias("sure2"))
    second = first.join(more, [P, "at"]).where(~F.array_contains("eids", F.col("eid"))).select(
        P, "start", F.col("end").alias("at"), F.array_append("eids", F.col("eid")).alias("eids"), F.array_append("predicates", F.col("predicate")).alias("predicates"), (F.col("sure") | F.col("sure2")).alias("sure"), F.lit(2).alias("hops"))
    w = Window.partitionBy(P, "start").orderBy(F.desc("sure"), "hops", "at", "eids")
    return first.unionByName(second).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def enrichment(architecture: DataFrame, summaries: DataFrame, limit: int = 100) -> DataFrame:
    """Pairs of a component and a data summary all of whose words the component's texts have.

    An inverted index by word: each summary is looked up under one of its words, the others
    are verified, so no cross product is formed.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")), " "), lambda w: F.length(w) > 2))
    stem = lambda w: F.regexp_replace(F.regexp_replace(w, "ing$", ""), "s$", "")
    text = F.concat_ws(" ", "name", "description", "source_path")
    a = architecture.select(P, F.col("id").alias("entity_id"), F.transform(words(text), stem).alias("have"))
    s = summaries.select(P, F.col("id").alias("summary_id"), F.transform(words(F.coalesce("mapped_type", "type")), stem).alias("need")).where(F.size("need") > 0)
    keyed = s.withColumn("word", F.array_max("need"))
    spread = a.select(P, "entity_id", "have", F.explode("have").alias("word"))
    pairs = spread.join(keyed, [P, "word"]).where(F.size(F.array_except("need", "have")) == 0)
    return pairs.select(P, "entity_id", "summary_id").distinct().orderBy("entity_id", "summary_id").limit(limit)


def canonical_conflicts(entities: DataFrame) -> DataFrame:
    """Entities whose stored normalized name isn't that of their name."""
    return entities.where("name is not null").select(P, "id", "normalized_name", canonical_name("name").alias("canonical")).where(~F.col("normalized_name").eqNullSafe(F.col("canonical")))
