"""Trees of PNG tiles: scanned and decoded by Spark's binary file source, written by a Python data source."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quadmill.operators import paths, tiles


def scan(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, length and modificationTime of the files below root; no content is read.  Names that begin with . or _ are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    return files.select("path", "length", "modificationTime")


def catalog(spark: SparkSession, root: str, template: str = "OSM", least_z: int = 1) -> DataFrame:
    """x, y, z and path of the files whose paths are of the template."""
    return paths.parsed(scan(spark, root), template, least_z)


def read_tiles(spark: SparkSession, root: str, template: str = "OSM", least_z: int = 1) -> DataFrame:
    """The decoded tiles below root.  Of files for one tile the last by path counts; what is no PNG is left out."""
    tiles.configure(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = {c: paths.coordinate(F.col("path"), template, c).alias(c) for c in "xyz"}
    files = files.select(at["z"], at["x"], at["y"], "path", "content").where((F.col("z") >= least_z) & F.col("x").isNotNull() & F.col("y").isNotNull())
    return tiles.decode(files.groupBy("z", "x", "y").agg(F.max_by("content", "path").alias("content")))


class PngTree(DataSource):
    """``format("png_tree")``: rows z, x, y, png as files; options path (root, any URI that pyarrow knows) and template."""

    @classmethod
    def name(cls) -> str:
        return "png_tree"

    def writer(self, schema, overwrite):  # noqa: ANN001
        return _Writer(self.options["path"], self.options.get("template", "OSM"))


class _Writer(DataSourceArrowWriter):
    def __init__(self, root: str, template: str):
        self.root, self.template = root, template

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyarrow import fs

        if "://" in self.root or self.root.startswith("file:"):
            system, root = fs.FileSystem.from_uri(self.root)
        else:
            system, root = fs.LocalFileSystem(), posixpath.abspath(self.root)
        form, order = paths.FORMATS[self.template], {"OSM": "zxy", "ZXY": "zzxy", "XYZ": "zxyz"}[self.template]
        for batch in iterator:
            for z, x, y, png in zip(*(batch.column(c).to_pylist() for c in ("z", "x", "y", "png"))):
                at = dict(z=z, x=x, y=y)
                target = posixpath.join(root, form % tuple(at[c] for c in order))
                system.create_dir(posixpath.dirname(target), recursive=True)
                # whole files only: a task that is tried again, or twice at once, replaces them
                part = f"{posixpath.dirname(target)}/.{posixpath.basename(target)}.{id(batch)}"
                with system.open_output_stream(part) as f:
                    f.write(png)
                system.move(part, target)
        return WriterCommitMessage()


def write_tiles(df: DataFrame, root: str, template: str = "OSM", level: int = 9) -> None:
    """The tiles as the smallest lossless PNGs below root."""
    if template not in paths.FORMATS:
        raise ValueError(f"unknown template {template}; use one of {paths.TEMPLATES}")
    df.sparkSession.dataSource.register(PngTree)
    tiles.encode(df, level).write.format("png_tree").option("template", template).mode("append").save(root)


def remove(spark: SparkSession, files: list[str]) -> None:
    """Deletes source files, after what replaces them is written."""
    jvm = spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for f in files:
        at = jvm.org.apache.hadoop.fs.Path(f)
        at.getFileSystem(conf).delete(at, False)
