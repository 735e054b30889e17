"""Intermediate tables in the folder that driver and executors share, so that lost executors cost the running stage only."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@cache
def _own_root(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="tracequarry-")


def scratch_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where the session is local, as in tests."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_root(spark.sparkContext.applicationId)


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Deletes a folder when the application ends."""
    files, p = _hadoop(spark, path)
    files.deleteOnExit(p)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and written to the shared folder: later reads survive lost executors and carry no lineage.

    The table is deleted when the application ends, or by forget()."""
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/tracequarry/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    delete_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that written() gave and that nothing will read again."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            files, p = _hadoop(df.sparkSession, path)
            files.delete(p, True)
