"""Declarative mapping of tables to entities and relationships.

A mapping is compiled to ``select`` and ``join``: nothing is evaluated row by row in Python.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.columns import normal_predicate, or_else, stable_id
from weftgraph.operators.merge import first_wins


@dataclass(frozen=True)
class EntityMapping:
    """How rows of ``source`` become entities of ``type``."""

    alias: str
    source: str
    type: str
    key: Sequence[str]
    name: str  # a template such as ``{p_name} {p_partkey}``
    properties: Sequence[str] = ()
    redact: Sequence[str] = ()


@dataclass(frozen=True)
class RelationshipMapping:
    """``from_alias`` rows whose ``from_key`` is the key of a ``to_alias`` entity."""

    predicate: str
    from_alias: str
    from_key: Sequence[str]
    to_alias: str


@dataclass(frozen=True)
class DatasetMapping:
    dataset: str
    domain: str
    entities: Sequence[EntityMapping]
    relationships: Sequence[RelationshipMapping] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        aliases = {e.alias for e in self.entities}
        for e in self.entities:
            if not (e.source and e.key and e.name):
                raise ValueError(f"mapping {e.alias} needs source, key and name")
        for r in self.relationships:
            if {r.from_alias, r.to_alias} - aliases:
                raise ValueError(f"relationship {r.predicate} names an unknown alias")


def key_of(columns: Sequence[str]) -> Column:
    """Parts joined by ``|``; empty if any part is."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    some_empty = F.lit(False)
    for p in parts:
        some_empty = some_empty | (p == "")
    return F.when(some_empty, "").otherwise(F.concat_ws("|", *parts))


def from_template(template: str, columns: Sequence[str]) -> Column:
    """``{column}`` is replaced by its value, or by nothing if there is no such column."""
    parts = []
    for piece in re.split(r"(\{[^{}]*\})", template):
        if re.fullmatch(r"\{[^{}]*\}", piece):
            parts.append(F.coalesce(F.col(piece[1:-1]).cast("string"), F.lit("")) if piece[1:-1] in columns else F.lit(""))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def map_entities(rows: DataFrame, m: EntityMapping, domain: str, dataset: str) -> DataFrame:
    """``(id, type, name, record_key, domain, dataset, properties)``; rows with empty key are skipped."""
    key = key_of(m.key)
    props = [F.when(F.col(c).isNotNull(), F.lit("[redacted]")).alias(c) if c in m.redact else F.col(c).cast("string").alias(c) for c in m.properties if c in rows.columns]
    name = from_template(m.name, rows.columns)
    return rows.where(key != "").select(
        stable_id("entity", F.lit(domain), F.lit(m.type), key).alias("id"), F.lit(m.type).alias("type"), or_else(name, key).alias("name"), key.alias("record_key"),
        F.lit(domain).alias("domain"), F.lit(dataset).alias("dataset"), F.to_json(F.struct(*props)).alias("properties") if props else F.lit("{}").alias("properties"),
    )


def project_entities(tables: Mapping[str, DataFrame], mapping: DatasetMapping) -> DataFrame:
    """All entities of a mapping, one per id: the first by name and properties."""
    parts = None
    for m in mapping.entities:
        part = map_entities(tables[m.source], m, mapping.domain, mapping.dataset)
        parts = part if parts is None else parts.unionByName(part)
    return first_wins(parts, ("id",), ("type", "name", "properties"))


def project_relationships(tables: Mapping[str, DataFrame], mapping: DatasetMapping) -> DataFrame:
    """``(id, predicate, subject_id, object_id)``: equi-joins on keys; unmatched ones are dropped."""
    by_alias = {m.alias: m for m in mapping.entities}
    parts = None
    for r in mapping.relationships:
        a, b = by_alias[r.from_alias], by_alias[r.to_alias]
        left = tables[a.source].select(key_of(a.key).alias("sk"), key_of(r.from_key).alias("ok")).where("sk <> '' and ok <> ''").distinct()
        right = tables[b.source].select(key_of(b.key).alias("ok")).where("ok <> ''").distinct()
        ends = left.join(right, "ok").select(stable_id("entity", F.lit(mapping.domain), F.lit(a.type), "sk").alias("subject_id"), stable_id("entity", F.lit(mapping.domain), F.lit(b.type), "ok").alias("object_id"))
        part = ends.select(stable_id("assertion", F.lit(mapping.dataset), F.lit(r.predicate), "subject_id", "object_id").alias("id"), normal_predicate(F.lit(r.predicate)).alias("predicate"), "subject_id", "object_id")
        parts = part if parts is None else parts.unionByName(part)
    return parts.distinct()


def summaries(entities: DataFrame) -> DataFrame:
    """Records of each dataset and type."""
    return entities.groupBy("dataset", "type").agg(F.count("*").alias("record_count"))


def inspect(tables: Mapping[str, DataFrame]) -> list[tuple[str, int, list[str]]]:
    """``(source, records, sorted columns)`` of each table."""
    return [(name, df.count(), sorted(df.columns)) for name, df in sorted(tables.items())]
