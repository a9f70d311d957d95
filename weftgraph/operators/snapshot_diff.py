"""What changed between full snapshots.

Method: snapshots are sorted by key and cut into content-defined chunks (a key whose
hash is divisible by ``rows_per_chunk`` begins a chunk, so an insertion moves no other
cut).  Chunks of two consecutive snapshots with the same digest are discarded whole; the
rows of the others are merge-joined on the key and classified.

Values are digested where they are read: a row moves as its key, its version and one 64-bit
digest per compared field, never with its values.  All snapshots of a key land in the same
range partition, so a chunk meets its counterpart without a third exchange: one aggregation
(which keeps the delivery that counts and combines on the map side, so that a hot id is
harmless) and one range exchange, whatever the number of snapshots.  The pass over a
partition holds one chunk, never a snapshot.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.runtime import size_bound

#: Broadcast the list of snapshots only below this many (group, version) pairs.
STEP_LIMIT = 200_000


def snapshot_changes(
    snapshots: DataFrame,
    group: str = "project_slug",
    version: str = "snapshot_no",
    key: str = "id",
    delivered: str = "delivered_at",
    fields: Sequence[str] = ("description", "community", "source_path"),
    rows_per_chunk: int = 16,
) -> DataFrame:
    """Rows ``(group, version, entity_id, change, field)`` of every consecutive pair.

    A version is compared with the latest earlier one that its group delivered; the first
    has no rows.  change is 'added' or 'removed' with field '', or 'modified' with one row
    per changed field.  Of several rows of a key in one snapshot the latest delivered
    counts (null delivery is the earliest; equal times: the greatest digests, so the result
    is the same on every run).  Values are compared by 64-bit digests, null and '' differ.  Rows
    with null group, version or key are no records.  Empty input gives an empty result;
    further columns, also ones with clashing names, are not read.
    """
    own = snapshots.select(
        F.col(group).alias("g"), F.col(version).cast("int").alias("v"), F.col(key).alias("k"),
        F.col(delivered).alias("at"), *[F.xxhash64(f, F.col(f).isNull()).alias(f"f{i}") for i, f in enumerate(fields)],
    ).where("g is not null and v is not null and k is not null")
    values = [f"f{i}" for i in range(len(fields))]
    latest = own.groupBy("g", "v", "k").agg(F.max(F.struct("at", *values)).alias("x")).select("g", "v", "k", *[F.col(f"x.{c}").alias(c) for c in values])

    w = Window.partitionBy("g").orderBy("v")
    steps = own.select("g", "v").distinct().select("g", "v", F.lag("v").over(w).alias("before"), F.lead("v").over(w).alias("after"))
    if size_bound(steps, STEP_LIMIT):
        steps = F.broadcast(steps)

    ordered = latest.join(steps, ["g", "v"]).repartitionByRange("g", "k").sortWithinPartitions("g", "k", "v")
    marked = ordered.select(
        "*", (F.pmod(F.xxhash64("k"), F.lit(rows_per_chunk)) == 0).alias("cut"), F.xxhash64("k", *values).alias("d1"), F.xxhash64(F.lit(7919), "k", *values).alias("d2"),
    )
    out = T.StructType([T.StructField("g", T.StringType()), T.StructField("v", T.IntegerType()), T.StructField("k", T.StringType()), T.StructField("change", T.StringType()), T.StructField("field", T.StringType())])
    names = list(fields)
    found = marked.mapInArrow(lambda batches: _diff(batches, names), out)
    return found.select(F.col("g").alias(group), F.col("v").alias(version), F.col("k").alias("entity_id"), "change", "field")


def _shifted_equal(x: pa.ChunkedArray) -> np.ndarray:
    """For each row but the first, whether it equals the one before; nulls are equal."""
    a, b = x.slice(1), x.slice(0, len(x) - 1)
    same = pc.fill_null(pc.equal(a, b), False).to_numpy()
    return same | (pc.is_null(a).to_numpy() & pc.is_null(b).to_numpy())


def _diff(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        t = pa.Table.from_batches(held)
        starts = _starts(t)
        # the last chunk may go on in the next batch
        last = int(np.flatnonzero(starts)[-1]) if len(t) else 0
        if last:
            yield from _diff_rows(t.slice(0, last), starts[:last], names)
            held = t.slice(last).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        if len(t):
            yield from _diff_rows(t, _starts(t), names)


def _starts(t: pa.Table) -> np.ndarray:
    starts = np.ones(len(t), dtype=bool)
    if len(t) > 1:
        same_group, same_key = _shifted_equal(t["g"]), _shifted_equal(t["k"])
        cut = t["cut"].to_numpy()[1:].astype(bool)
        starts[1:] = ~same_group | (cut & ~(same_group & same_key))
    return starts


def _digests(slot: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each (chunk, version): its slot number, and two sums of row digests."""
    order = np.argsort(slot, kind="stable")
    slots, first = np.unique(slot[order], return_index=True)
    with np.errstate(over="ignore"):
        return slots, np.add.reduceat(d1[order], first), np.add.reduceat(d2[order], first), np.searchsorted(slots, slot)


def _diff_rows(t: pa.Table, starts: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    none = np.iinfo(np.int32).min
    v = t["v"].to_numpy().astype(np.int64)
    before = pc.fill_null(t["before"], none).to_numpy().astype(np.int64)
    after = pc.fill_null(t["after"], none).to_numpy().astype(np.int64)
    chunk = np.cumsum(starts)
    shift = np.int64(1) << 32
    slot = lambda version: chunk * shift + (version - none)
    slots, s1, s2, own = _digests(slot(v), t["d1"].to_numpy(), t["d2"].to_numpy())

    def unmatched(other: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(slots, slot(other)), len(slots) - 1)
        equal = (slots[at] == slot(other)) & (s1[at] == s1[own]) & (s2[at] == s2[own])
        return (other != none) & ~equal

    new, old = unmatched(before), unmatched(after)
    keep = np.flatnonzero(new | old)
    if not len(keep):
        return
    t, v, before, after, new, old = t.take(pa.array(keep)).combine_chunks(), v[keep], before[keep], after[keep], new[keep], old[keep]
    n = len(keep)
    same = np.zeros(n, dtype=bool)
    if n > 1:
        same[1:] = _shifted_equal(t["g"]) & _shifted_equal(t["k"])
    joined = np.zeros(n, dtype=bool)  # with the row before: same key, and consecutive versions
    joined[1:] = same[1:] & (v[:-1] == before[1:])
    followed = np.zeros(n, dtype=bool)
    followed[:-1] = joined[1:]

    parts = [(np.flatnonzero(new & ~joined), v, "added", ""), (np.flatnonzero(old & ~followed), after, "removed", "")]
    for i, name in enumerate(names):
        differs = np.zeros(n, dtype=bool)
        if n > 1:
            differs[1:] = ~_shifted_equal(t[f"f{i}"])
        parts.append((np.flatnonzero(new & joined & differs), v, "modified", name))
    for rows, version, change, field in parts:
        if len(rows):
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [t["g"].take(at).combine_chunks(), pa.array(version[rows].astype(np.int32)), t["k"].take(at).combine_chunks(), pa.array([change] * len(rows)), pa.array([field] * len(rows))],
                names=["g", "v", "k", "change", "field"],
            )
