"""Tables kept in the folder that all executors share, and deleted when nothing reads them any more."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Where the session names none, a local session (tests) gets one below
    /tmp/checkpoints; on a cluster that is an error, as its machines share no folder of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = "/tmp/checkpoints/quadmill"
    spark.sparkContext.setCheckpointDir(base)
    return base


def _system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class Scope:
    """The tables of one computation.  ``drop`` deletes tables whose readers are written; leaving the scope deletes all
    but those named in ``leave``, which a returned DataFrame still reads: they go when the session ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        """df written once as Parquet and read back: its lineage ends there, and a lost executor costs a re-read, not a recomputation."""
        path = f"{shared_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def append(self, df: DataFrame, path: str | None = None) -> str:
        """df added to the table at ``path``, a new one if none is given; ``table`` reads it."""
        new = path is None
        path = path or f"{shared_dir(self.spark)}/rows-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").mode("append").parquet(path)
        if new:
            self.tables.append((df, path))
        return path

    def table(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        for df, path in [x for x in self.tables if any(x[0] is t for t in tables)]:
            system, at = _system(self.spark, path)
            system.delete(at, True)
        self.tables = [x for x in self.tables if not any(x[0] is t for t in tables)]

    def leave(self, table: DataFrame) -> DataFrame:
        for df, path in self.tables:
            if df is table:
                system, at = _system(self.spark, path)
                system.deleteOnExit(at)
        self.tables = [x for x in self.tables if x[0] is not table]
        return table

    def collect(self) -> None:
        """Spark deletes the shuffle files of a plan once the driver's JVM has collected it.

        The scheduler holds the last plan until another one runs, so a job of one row comes first."""
        gc.collect()
        self.spark.range(0, 1, 1, 1).collect()
        self.spark._jvm.System.gc()

    def __enter__(self) -> Scope:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[df for df, _ in self.tables])
        self.collect()


def keep(df: DataFrame, tag: str) -> DataFrame:
    """df kept until the session ends."""
    scope = Scope(df.sparkSession)
    return scope.leave(scope.keep(df, tag))
