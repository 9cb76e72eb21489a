"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only on a single machine (master local) a temporary one may stand in for it,
    kept in the session for the next call; on a cluster it has to be named.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("turnlake.shared.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="turnlake-")
        spark.conf.set("turnlake.shared.dir", named)
    return named.rstrip("/")


def folder(spark: SparkSession, name: str = "turnlake") -> str:
    """The path of a new folder there."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    """(the path's file system, the path) as Hadoop has them, so that any store that Spark reads will do."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), found


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """The paths right below a folder, sorted; none if it is not there."""
    files, at = _files(spark, path)
    return sorted(x.getPath().toString() for x in files.listStatus(at)) if files.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that written() made; what was computed from them has to be written by then."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if re.search(r"/turnlake-[0-9a-f]{32}$", path):
                delete(df.sparkSession, path)
