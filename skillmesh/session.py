"""Shared-folder helpers.

Intermediate files go under the folder the cluster names in
``spark.checkpoint.dir`` (a shared file system on a real cluster), never a
machine-local temporary folder.  Only when the session has none (local
tests) is a fresh ``/tmp`` folder set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    Uses the folder already set on the context or named by
    ``spark.checkpoint.dir``.  Only a local-mode session without either
    gets a fresh ``/tmp`` folder; on a cluster that would be a
    machine-local path, so it is an error instead.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder (HDFS, object store) for intermediate files")
        conf = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/skillmesh-{name}-{uuid.uuid4().hex[:12]}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path that nothing reads any more, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
