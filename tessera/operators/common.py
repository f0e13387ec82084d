"""Durable cuts of lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of cuts that this process has made and not dropped.
_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset and Spark runs in one JVM, as in tests, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.add(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _made.discard(folder)


def folders_of(df: DataFrame) -> set[str]:
    names = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
    return {p for p in _made if p.rpartition("/")[2] in names}


def drop_cut(df: DataFrame) -> None:
    """Delete the folder of a ``cut`` that nothing reads any more."""
    for folder in folders_of(df):
        _delete(df.sparkSession, folder)


def made() -> frozenset[str]:
    """The cuts of this process that stand; for ``release``."""
    return frozenset(_made)


def release(spark: SparkSession, since: frozenset[str], keep: DataFrame) -> None:
    """Delete the cuts made since ``made()`` said ``since``, but for those that ``keep`` reads; for callers that have written what they wanted."""
    for folder in _made - since - folders_of(keep):
        _delete(spark, folder)
