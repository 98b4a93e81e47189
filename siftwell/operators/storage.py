"""Versions of an index below one folder.

``<root>/versions/<id>/<table>`` hold the tables, ``<root>/CURRENT`` names the version that readers open.
A build writes a new version and then replaces CURRENT by a rename, so a reader sees a whole
index or the one before; a failed build deletes its version.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FORMAT = 1


class IndexFormatError(ValueError):
    """A folder that holds no index that this library reads, with the reason."""


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Bounds an Arrow batch, and so a Python worker's memory, for this session: plans run after the call."""
    bytes_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if bytes_of(spark.conf.get(key)) > size:
        spark.conf.set(key, str(size))


def local_rows(spark: SparkSession, rows: list[tuple], schema: str | StructType) -> DataFrame:
    """A few rows, as part of the plan.  Rows given to createDataFrame are read by Python workers, which stand beside those that analyze."""
    kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not rows:
        return spark.range(0).selectExpr(*(f"cast(null as {f.dataType.simpleString()}) as {f.name}" for f in kinds))
    arrow = to_arrow_schema(kinds)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow))


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.jvm = spark, spark._jvm

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def fs(self, name: str):
        return self.path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def delete(self, name: str) -> None:
        self.fs(name).delete(self.path(name), True)

    def size(self, name: str) -> int:
        return self.fs(name).getContentSummary(self.path(name)).getLength()

    def read(self, name: str) -> str:
        if not self.fs(name).exists(self.path(name)):
            raise IndexFormatError(f"{name} doesn't exist")
        stream = self.fs(name).open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        own = f"{name}.{uuid.uuid4().hex}"
        stream = self.fs(name).create(self.path(own), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs(name).getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self.path(own), self.path(name), options)


class Version:
    """A version that is being written; used as a context manager it goes if the block fails."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.name = uuid.uuid4().hex
        self.folder = f"{self.root}/versions/{self.name}"

    def __enter__(self) -> Version:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            self.files.delete(self.folder)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def publish(self) -> None:
        """Makes readers open this version.  The version before stays, older ones go."""
        now, versions = f"{self.root}/CURRENT", f"{self.root}/versions"
        before = self.files.read(now).strip() if self.files.fs(now).exists(self.files.path(now)) else None
        self.files.replace(now, self.name)
        published = max((s.getModificationTime() for s in self.files.fs(versions).listStatus(self.files.path(versions)) if s.getPath().getName() == before), default=0)
        for s in self.files.fs(versions).listStatus(self.files.path(versions)):
            name = s.getPath().getName()
            # a build that runs at the same time has a younger folder
            if name not in (self.name, before) and s.getModificationTime() < published:
                self.files.delete(f"{versions}/{name}")
