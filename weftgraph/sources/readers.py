"""Readers of structured records, documents and extractor graphs."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.columns import or_else, stable_id, value_kind

VIRTUAL = ("__source", "__path", "__parent", "__grandparent")
DOCUMENT_ENDINGS = (".md", ".mdx", ".rst", ".txt")
DOCUMENT_BYTES = 2_000_000


def read_records(spark: SparkSession, connector: str, path: str, **options) -> DataFrame:
    """Records of a csv, json, jsonl, parquet, sqlite or postgres source."""
    readers = {"csv": read_csv, "json": read_json, "jsonl": read_jsonl, "parquet": read_parquet, "sqlite": read_sqlite, "postgres": read_postgres, "postgresql": read_postgres, "aurora": read_postgres}
    if connector not in readers:
        raise ValueError(f"no connector {connector!r}; there are {', '.join(sorted(readers))}")
    return readers[connector](spark, path, **options)


def with_virtual(df: DataFrame, path: str, source: str | None = None) -> DataFrame:
    """Adds the columns that every source has: its name, path and the two folders above."""
    folder = os.path.dirname(path)
    values = (source or os.path.splitext(os.path.basename(path.rstrip("/")))[0], path, os.path.basename(folder), os.path.basename(os.path.dirname(folder)))
    return df.withColumns({c: F.lit(v) for c, v in zip(VIRTUAL, values, strict=True)})


def require(df: DataFrame, columns: Sequence[str], source: str) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns) - set(VIRTUAL)):
        raise ValueError(f"{source} lacks the required columns {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, path: str, required: Sequence[str] = (), row_limit: int | None = None, infer: bool = False) -> DataFrame:
    """Texts as they are; ``infer`` adds ``<column>__kind``, the type each value is read as."""
    df = require(spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=True), required, path)
    if infer:
        df = df.withColumns({f"{c}__kind": value_kind(F.col(f"`{c}`")) for c in df.columns})
    return with_virtual(limited(df, row_limit), path)


def read_json(spark: SparkSession, path: str, required: Sequence[str] = (), row_limit: int | None = None) -> DataFrame:
    """An array of records, or an object with the array ``records``; else no rows."""
    df = spark.read.json(path, multiLine=True)
    if df.columns == ["records"] or "records" in df.columns and isinstance(df.schema["records"].dataType, T.ArrayType):
        df = df.select(F.explode("records").alias("r")).select("r.*")
    return with_virtual(limited(require(df, required, path), row_limit), path)


def read_jsonl(spark: SparkSession, path: str, required: Sequence[str] = (), row_limit: int | None = None) -> DataFrame:
    df = spark.read.json(path)
    return with_virtual(limited(require(df, required, path), row_limit), path)


def read_parquet(spark: SparkSession, path: str, required: Sequence[str] = (), row_limit: int | None = None) -> DataFrame:
    """With ``row_number``, 1 for a file's first row."""
    df = require(spark.read.parquet(path), required, path)
    df = df.select("*", (F.col("_metadata.row_index") + 1).alias("row_number")) if "row_number" not in df.columns else df
    return with_virtual(limited(df, row_limit), path)


def read_sqlite(spark: SparkSession, path: str, include_tables: Sequence[str] = (), row_limit: int | None = None, source: str | None = None, required: Sequence[str] = ()) -> DataFrame:
    """One table of a local database file; texts where the column has no other type."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        names = [r[0] for r in db.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name")]
        names = [n for n in names if not include_tables or n in include_tables]
        name = source or (names[0] if names else None)
        if name not in names:
            raise ValueError(f"{path} has no table {name}")
        quoted = '"' + name.replace('"', '""') + '"'
        info = db.execute(f"pragma table_info({quoted})").fetchall()
        rows = db.execute(f"select * from {quoted}" + (f" limit {int(row_limit)}" if row_limit else "")).fetchall()
    kinds = {"INT": T.LongType(), "REAL": T.DoubleType(), "FLOA": T.DoubleType(), "DOUB": T.DoubleType()}
    fields = [T.StructField(c[1], next((t for k, t in kinds.items() if (c[2] or "").upper().startswith(k)), T.StringType())) for c in info]
    cast = [[None if v is None else int(v) if isinstance(f.dataType, T.LongType) else float(v) if isinstance(f.dataType, T.DoubleType) else str(v) for v, f in zip(r, fields, strict=True)] for r in rows]
    return with_virtual(require(spark.createDataFrame(cast, T.StructType(fields)), required, name), path, name)


def read_postgres(spark: SparkSession, path: str, include_tables: Sequence[str] = (), source: str | None = None, **options) -> DataFrame:
    """A table over JDBC; ``path`` names the environment variable that holds the address."""
    if not include_tables:
        raise ValueError("include_tables is needed for a database source")
    url = os.environ.get(path)
    if not url:
        raise ValueError(f"the environment variable {path} isn't set")
    name = source or include_tables[0]
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    for k, v in options.items():
        reader = reader.option(k, v)
    return with_virtual(reader.load(), path, name)


def limited(df: DataFrame, row_limit: int | None) -> DataFrame:
    return df if row_limit is None else df.limit(row_limit)


def read_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Texts of a folder tree, and the files that are too large: ``(path, text)``, ``(path, length)``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = F.lower(F.col("path"))
    wanted = F.lit(False)
    for ending in DOCUMENT_ENDINGS:
        wanted = wanted | named.endswith(ending)
    files = files.where(wanted & ~F.col("path").rlike(r"/(?:\.[^/]+|node_modules|__pycache__)/"))
    texts = files.where(F.col("length") <= DOCUMENT_BYTES).select("path", F.decode("content", "utf-8").alias("text"))
    return texts.where(F.trim("text") != ""), files.where(F.col("length") > DOCUMENT_BYTES).select("path", "length")


GRAPH_NODE = "struct<id:string,node_id:string,label:string,name:string,type:string,kind:string,file_type:string,file:string,source_file:string,path:string,community:string>"
GRAPH_EDGE = "struct<id:string,source:string,`from`:string,target:string,`to`:string,relation:string,type:string,relationship:string,confidence:string,context:string,evidence:string>"


def read_extractor_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of an extractor's JSON: ``nodes`` and ``edges`` or ``links``, maybe under ``graph``.

    Of repeated node ids the last wins; edges with an unknown end are dropped.
    """
    part = f"nodes:array<{GRAPH_NODE}>,edges:array<{GRAPH_EDGE}>,links:array<{GRAPH_EDGE}>"
    raw = spark.read.schema(f"{part.replace(':array', ' array', 3)}, graph struct<{part}>").json(path, multiLine=True)
    nodes = raw.select(F.posexplode(F.coalesce("nodes", "graph.nodes")).alias("ord", "n"))
    first = lambda p, *names: _first([F.col(f"{p}.`{n}`") for n in names])
    nodes = nodes.select("ord", first("n", "id", "node_id", "label").alias("raw_id"), first("n", "label", "name", "id").alias("name"), first("n", "type", "kind", "file_type").alias("raw_type"), first("n", "source_file", "file", "path").alias("source_path"), first("n", "community").alias("community"))
    nodes = nodes.where("raw_id is not null").groupBy("raw_id").agg(F.max_by(F.struct("name", "raw_type", "source_path", "community"), "ord").alias("x")).select("raw_id", "x.*")
    edges = raw.select(F.explode(F.coalesce("edges", "links", "graph.edges", "graph.links")).alias("e"))
    edges = edges.select(first("e", "source", "from").alias("source"), first("e", "target", "to").alias("target"), first("e", "relation", "relationship", "type").alias("relation"), F.col("e.confidence").alias("confidence"), first("e", "context", "evidence").alias("evidence"))
    known = nodes.select("raw_id")
    edges = edges.join(known.withColumnRenamed("raw_id", "source"), "source", "left_semi").join(known.withColumnRenamed("raw_id", "target"), "target", "left_semi")
    return nodes.withColumn("id", stable_id("entity", F.lower("name"), "raw_type")), edges


def _first(columns: Sequence[Column]) -> Column:
    out = columns[-1]
    for c in reversed(columns[:-1]):
        out = or_else(c, out)
    return out


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """``(records, fingerprint)`` of a table, whatever the order of its rows and columns."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    lanes = [F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(20,0)")).cast("string") for seed in (1, 2)]
    return df.agg(F.count("*").alias("records"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *lanes), 256).alias("fingerprint"))
