"""What the operators share: word patterns, the shared work folder, saved tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Only where that is unset (tests, a
    single machine) a temporary folder is made, once for each application; on a
    cluster an unset folder is an error, as a machine's own folder is seen by no other.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="siftwell-")
        sc.setCheckpointDir(_own[sc.applicationId])
    return _own[sc.applicationId]


class Workspace:
    """Saved tables of one operator run, in a folder of their own below the shared one.

    ``save`` writes a DataFrame as Parquet and reads it back, which cuts lineage: a lost
    executor costs a re-read, not a recomputation.  ``drop`` deletes a table that is
    needed no more.  What is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/siftwell-{name}-{uuid.uuid4().hex}"
        path = self._path(self.root)
        self._fs(path).mkdirs(path)
        self._fs(path).deleteOnExit(path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self._path(f"{self.root}/{name}")
            self._fs(path).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of an Arrow batch, and so a Python worker's memory, for this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it as ``name`` in ``body``.

    A lambda variable is bound once; a column that a lambda refers to may be inlined by the
    optimizer and evaluated for each element.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def whole_row(docs: DataFrame) -> Column:
    """All columns as one, so that no name of theirs clashes with a helper's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_or_empty(docs: DataFrame, text: str = "text") -> Column:
    return F.coalesce(docs[text].cast("string"), F.lit(""))
