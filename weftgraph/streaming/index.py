"""Keeping an index table up to date from a stream of chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.operators.merge import changed_rows, first_wins
from weftgraph.sources.sinks import _fs, replace_table

KEY = ("project_slug", "id")


def apply_batch(batch: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame]) -> None:
    """Embeds what is new or changed in a batch and merges it into the table at ``path``.

    Of several rows of a chunk the last by ``ord`` counts.  A batch that comes again changes
    nothing: its hashes are already there.
    """
    spark = batch.sparkSession
    latest = first_wins(batch, KEY, ("ord",), last=True)
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        replace_table(embed(latest), path)
        return
    stored = spark.read.parquet(path)
    known = stored.select(*KEY, F.col("content_hash").alias("_known"))
    fresh = latest.join(known, list(KEY), "left").where(~F.col("content_hash").eqNullSafe(F.col("_known"))).drop("_known")
    if fresh.isEmpty():
        return
    kept = stored.join(fresh.select(*KEY), list(KEY), "left_anti")
    replace_table(kept.unionByName(embed(fresh), allowMissingColumns=True), path)


def sync_index(current: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame], model: str = "default") -> dict[str, int]:
    """Makes the table at ``path`` that of ``current``: embeds new and changed chunks, deletes the others that are gone.

    A chunk is unchanged if its hash and the model are; its vector is kept.  Only projects that
    ``current`` has are touched.  Returns how many chunks are in each state.
    """
    spark = current.sparkSession
    now = first_wins(current, KEY, ("content_hash",)).withColumn("embedding_model", F.lit(model))
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        replace_table(embed(now), path)
        return {"new": now.count()}
    stored = spark.read.parquet(path)
    projects = now.select("project_slug").distinct()
    other, mine = stored.join(projects, ["project_slug"], "left_anti"), stored.join(projects, ["project_slug"], "left_semi")
    plan = changed_rows(now, mine, KEY, ("content_hash", "embedding_model"))
    counts = {r["state"]: r["count"] for r in plan.groupBy("state").count().collect()}  # four states at most
    if set(counts) <= {"unchanged"}:
        return counts
    kept = mine.join(plan.where("state = 'unchanged'"), list(KEY), "left_semi")
    fresh = now.join(plan.where("state in ('new', 'changed')"), list(KEY), "left_semi")
    replace_table(other.unionByName(kept).unionByName(embed(fresh), allowMissingColumns=True), path)
    return counts


def bridges(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``(project_slug, chunk_id, entity_id, ordinal)`` and ``(project_slug, chunk_id, span_id)`` of chunks, to replace old ones."""
    about = chunks.select("project_slug", F.col("id").alias("chunk_id"), F.posexplode("entity_ids").alias("ordinal", "entity_id")).where("entity_id is not null")
    by = chunks.select("project_slug", F.col("id").alias("chunk_id"), F.explode("source_span_ids").alias("span_id")).where("span_id is not null").distinct()
    return about, by


def index_stream(chunks: DataFrame, path: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Runs ``apply_batch`` on what is there, then ends; started again, it goes on from there."""
    return chunks.writeStream.foreachBatch(lambda batch, _: apply_batch(batch, path, embed)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are dropped by the engine."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
