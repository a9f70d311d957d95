"""References to records that do not exist.

Method: the distinct non-null foreign keys are anti-joined with the parent keys ('missing')
and joined with the parents that are deleted or came late; the few flawed keys are joined
back to the references, and counted per table and period.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    """A column of ``table`` (a string, or an array of strings) naming ids of ``parent``."""

    table: str
    column: str
    parent: str
    is_array: bool = False


GRAPH_REFERENCES = (
    Reference("source_spans", "source_id", "sources"),
    Reference("chunks", "source_span_id", "source_spans"),
    Reference("entities", "source_span_ids", "source_spans", True),
    Reference("knowledge_chunks", "entity_id", "entities"),
)

#: Stands for a null project of a referring record; it equals no parent's project.
NO_PROJECT = "\x00null"


def clean_key(c: Column) -> Column:
    """Without surrounding white space, in lower case."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def _referring(df: DataFrame, ref: Reference) -> DataFrame:
    """One row for each distinct reference of each undeleted record."""
    targets = F.col(ref.column) if ref.is_array else F.array(ref.column)
    records = df.select(
        F.lit(ref.table).alias("table_name"), F.lit(ref.parent).alias("parent"), F.coalesce("project_slug", F.lit(NO_PROJECT)).alias("project_slug"), F.col("id").alias("record_id"),
        "ingested_at", F.col("deleted_at").isNotNull().alias("gone"), F.explode_outer(targets).alias("ref"),
    ).where("record_id is not null")
    return records.select("table_name", "parent", "project_slug", "record_id", clean_key(F.col("ref")).alias("ref_id"), "ingested_at", "gone")


def orphan_references(tables: Mapping[str, DataFrame], references: tuple[Reference, ...] = GRAPH_REFERENCES) -> DataFrame:
    """Rows ``(table_name, project_slug, record_id, ref_id, state, ingested_at)``.

    state is 'missing' (no target of that project), else 'deleted' (every such target id has
    a deleted row), else 'late' (the target's earliest ingested_at is after the record's;
    never if either is unknown).  Records with any deleted row have no cases.  Null and
    blank references and records with null id don't count; a null project_slug matches no
    target.  Repeated rows and references give one case; ingested_at is the record's
    earliest.  Empty tables give no rows, other columns aren't read.
    """
    refs = None
    for ref in references:
        part = _referring(tables[ref.table], ref)
        refs = part if refs is None else refs.unionByName(part)
    # Distinct references first, then the records' facts from them: no group is gathered.
    record = ["table_name", "parent", "project_slug", "record_id"]
    pairs = refs.groupBy(*record, "ref_id").agg(F.min("ingested_at").alias("seen"), F.max("gone").alias("gone"))
    whole = pairs.groupBy(*record).agg(F.min("seen").alias("ingested_at"), F.max("gone").alias("gone")).where("not gone").drop("gone")
    live = pairs.where("ref_id <> ''").select(*record, "ref_id").join(whole, record)

    parents = None
    for name in sorted({r.parent for r in references}):
        part = tables[name].select(F.lit(name).alias("parent"), "project_slug", clean_key(F.col("id")).alias("ref_id"), "ingested_at", F.col("deleted_at").isNotNull().alias("gone"))
        parents = part if parents is None else parents.unionByName(part)
    key = ["parent", "project_slug", "ref_id"]
    parents = parents.where("ref_id is not null").groupBy(*key).agg(F.min("ingested_at").alias("parent_at"), F.max("gone").alias("parent_gone"))

    keys = live.groupBy(*key).agg(F.min("ingested_at").alias("first_at"))
    missing = keys.join(parents, key, "left_anti").select(*key, F.lit("missing").alias("state"), F.lit(None).cast(live.schema["ingested_at"].dataType).alias("parent_at"))
    flawed = keys.join(parents, key).where("parent_gone or parent_at > first_at")
    flawed = flawed.select(*key, F.when(F.col("parent_gone"), "deleted").otherwise("late").alias("state"), "parent_at")
    bad = missing.unionByName(flawed)

    back = live.join(bad, key).where("state <> 'late' or parent_at > ingested_at")
    return back.select("table_name", F.nullif(F.col("project_slug"), F.lit(NO_PROJECT)).alias("project_slug"), "record_id", "ref_id", "state", "ingested_at")


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per table, state and month of ingested_at ('unknown' where that is null)."""
    period = F.coalesce(F.date_format("ingested_at", "yyyy-MM"), F.lit("unknown"))
    return orphans.groupBy("table_name", period.alias("period"), "state").agg(F.count("*").alias("orphans"), F.countDistinct("ref_id").alias("distinct_refs"))
