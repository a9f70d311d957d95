"""Union, de-duplication and state changes of graph tables.

Rows with a null id or project are kept as rows of the null key.  Everything is one
combining aggregation or one equi-join on (project, id).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """One row per key: the first by ``order`` (nulls first), or the last.

    Of rows that tie in ``order`` each column takes its least (or greatest) value, so the result
    is the same on every run.  Each column is an aggregate of its own, so a query that needs
    three columns scans and exchanges those and ``order`` only; rows of a key are combined
    before the exchange, so a hot key does no harm.  Columns must be orderable, which maps are not.
    """
    pick = F.max if last else F.min
    keys = [F.col(f"`{c}`") for c in key]
    own = [c for c in df.columns if c not in key]
    best = df.groupBy(*keys).agg(*[pick(F.struct(*[F.col(f"`{o}`").alias(f"_{k}") for k, o in enumerate(order)], F.col(f"`{c}`").alias("_own")))["_own"].alias(c) for c in own])
    return best.select(*[F.col(f"`{c}`") for c in df.columns])


def merge_graphs(parts: Sequence[DataFrame], key: Sequence[str] = ("project_slug", "id"), order: Sequence[str] = ("ord",)) -> DataFrame:
    """Union of stages by key; a row of an earlier stage wins, then the first by ``order``."""
    union = None
    for stage, part in enumerate(parts):
        part = part.withColumn("_stage", F.lit(stage))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    return first_wins(union, key, ("_stage", *order)).drop("_stage")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str] = ("project_slug", "id")) -> DataFrame:
    """Values of ``new`` win where not null, absent ones are kept; an upserted row isn't stale."""
    values = [c for c in old.columns if c not in key]
    n = new.select(*key, *[F.col(c).alias(f"_new_{c}") if c in new.columns else F.lit(None).alias(f"_new_{c}") for c in values], F.lit(True).alias("_is_new"))
    both = old.join(n, list(key), "full")
    cols = [F.when(F.col("_is_new"), F.lit(False)).otherwise(F.col("stale")).alias("stale") if c == "stale" else F.coalesce(f"_new_{c}", c).alias(c) for c in values]
    return both.select(*key, *cols)


def prune_stale(rows: DataFrame, current: DataFrame, key: Sequence[str] = ("project_slug", "id")) -> DataFrame:
    """Rows whose key isn't current become stale, their status (if there is one) superseded."""
    seen = current.select(*key).distinct().withColumn("_seen", F.lit(True))
    out = rows.join(seen, list(key), "left").withColumn("_gone", F.col("_seen").isNull())
    out = out.withColumn("stale", F.col("_gone") | F.coalesce("stale", F.lit(False)))
    if "status" in rows.columns:
        out = out.withColumn("status", F.when(F.col("_gone"), "superseded").otherwise(F.col("status")))
    return out.drop("_seen", "_gone")


def prune_delete(rows: DataFrame, current: DataFrame, key: Sequence[str] = ("project_slug", "id")) -> DataFrame:
    return rows.join(current.select(*key).distinct(), list(key), "left_semi")


def reset_project(rows: DataFrame, project: str) -> DataFrame:
    return rows.where(~F.col("project_slug").eqNullSafe(F.lit(project)))


def diff_ids(before: DataFrame, now: DataFrame, key: Sequence[str] = ("project_slug", "id")) -> DataFrame:
    """``(*key, change)`` of keys that are new or gone; for assertions, whose id says all they are."""
    b, n = before.select(*key).distinct(), now.select(*key).distinct()
    return n.join(b, list(key), "left_anti").withColumn("change", F.lit("added")).unionByName(b.join(n, list(key), "left_anti").withColumn("change", F.lit("removed")))


def live(rows: DataFrame) -> DataFrame:
    """Without stale rows."""
    return rows.where(~F.coalesce("stale", F.lit(False)))


def changed_rows(current: DataFrame, stored: DataFrame, key: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """``(*key, state)``: new, changed, unchanged or deleted, by the columns compared (null-safe)."""
    c = current.select(*key, *[F.col(x).alias(f"_c_{x}") for x in compare], F.lit(True).alias("_current"))
    s = stored.select(*key, *[F.col(x).alias(f"_s_{x}") for x in compare], F.lit(True).alias("_stored"))
    same = F.lit(True)
    for x in compare:
        same = same & F.col(f"_c_{x}").eqNullSafe(F.col(f"_s_{x}"))
    state = F.when(F.col("_current").isNull(), "deleted").when(F.col("_stored").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return c.join(s, list(key), "full").select(*key, state.alias("state"))
