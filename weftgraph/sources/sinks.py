"""Writing graphs, snapshots and rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.quality import rejects_by


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def replace_table(df: DataFrame, path: str) -> None:
    """Writes beside the table, partitioned by project, moves the old one aside, then puts it in its place.

    A failed write leaves the table as it was, a failed move puts it back; the new one may read the old.
    """
    spark = df.sparkSession
    fresh = f"{path}__new"
    writer = df.write.mode("overwrite")
    (writer.partitionBy("project_slug") if "project_slug" in df.columns else writer).parquet(fresh)
    fs, old = _fs(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}__old")
    fs.delete(aside, True)
    had = fs.exists(old)
    if had and not fs.rename(old, aside):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(fresh), old):
        if had:
            fs.rename(aside, old)
        raise OSError(f"{fresh} could not be moved to {path}")
    fs.delete(aside, True)


def snapshot(df: DataFrame, root: str) -> None:
    """``root/current`` becomes ``root/previous``, and df the current one."""
    spark = df.sparkSession
    fs, current = _fs(spark, f"{root}/current")
    previous = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/previous")
    df.write.mode("overwrite").parquet(f"{root}/next")
    fs.delete(previous, True)
    if fs.exists(current):
        fs.rename(current, previous)
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/next"), current)


def write_rejects(validated: DataFrame, path: str) -> int:
    """Rejected rows as JSON lines and their counts; without any, what was there is removed."""
    spark = validated.sparkSession
    rejected = validated.where("reason is not null")
    n = rejected.count()
    fs, p = _fs(spark, path)
    fs.delete(p, True)
    if n:
        rejected.write.json(f"{path}/rows")
        rejects_by(validated, "predicate").orderBy(F.desc("n"), "predicate").limit(25).coalesce(1).write.json(f"{path}/summary")
    return n


def write_graph_json(nodes: DataFrame, links: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    links.write.mode("overwrite").json(f"{path}/links")
