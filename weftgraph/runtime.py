"""Session, tables and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Configuration every session of this engine wants; a cluster's own settings win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter makes it."""
    b = SparkSession.builder.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is absent (tests on one machine) a local folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="weftgraph-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/weftgraph-{uuid.uuid4().hex}"


#: Whether what a query has shuffled is deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Tables written to the shared folder: they cut lineage and outlive executors.

    With ``tidy``, what a cut has shuffled is deleted at once; else it stays on disk until the
    driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession, tidy: bool = False):
        self.spark, self.root, self.count, self.held, self.tidy = spark, shared_dir(spark), 0, set(), tidy

    def cut(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.root}/t{self.count}"
        before = self.spark.conf.get(CLEANUP, "false")
        if self.tidy:
            self.spark.conf.set(CLEANUP, "true")
        try:
            (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
        finally:
            if self.tidy:
                self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._weft_path = path
        self.held.add(path)
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a cut table that no later step reads."""
        self._delete(df._weft_path)

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all cut tables but these, which a result still reads."""
        for path in self.held - {t._weft_path for t in tables}:
            self._delete(path)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.held.discard(path)


def size_bound(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows; decides if a side may be broadcast."""
    return df.limit(limit + 1).count() <= limit
