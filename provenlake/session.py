"""Session helpers: lineage cuts in the shared folder.

Written tables are deleted when the JVM ends, or earlier by ``discard``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a folder of our own in local mode (tests) and an error on a cluster."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="provenlake-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Writes ``df`` once as a table in the shared folder; returns it as read back, and its path.

    Unlike checkpoint() this computes the plan once, and keeps column pruning.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = _path(df.sparkSession, path)
    p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(p)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    p = _path(spark, path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
