"""Folders for tables that operators write between their steps, where driver and executors share them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that new_folder has named, by application.
_MADE: dict[str, list[str]] = {}


def new_folder(spark: SparkSession, name: str = "table") -> str:
    """A new folder name below spark.checkpoint.dir, so that no earlier result loses its files.

    Only a session in one process (tests) may do without that setting: a temporary folder is made and set.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (spark.master is {master!r})")
        top = "file://" + tempfile.mkdtemp(prefix="mapweave-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def staged(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to a new folder and read from there: its lineage is cut, and lost executors lose nothing of it."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder that new_folder has named and nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _MADE[spark.sparkContext.applicationId].remove(path)


def forget(*read: DataFrame) -> None:
    """Delete the staged folders that these tables read, which nothing may read any more. Other files stay."""
    for df in read:
        names = {f.split("/")[-2] for f in df.inputFiles()}
        for path in [p for p in _MADE.get(df.sparkSession.sparkContext.applicationId, []) if p.rsplit("/", 1)[1] in names]:
            drop(df.sparkSession, path)


def clear(spark: SparkSession) -> int:
    """Delete what new_folder has named for this application so far, when results have been read or written; how many there were."""
    paths, jvm = _MADE.pop(spark.sparkContext.applicationId, []), spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)
