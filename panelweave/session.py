"""Session settings and the shared working folder used for checkpoints."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


_local_dirs: dict[str, str] = {}
_owners: list[list[str]] = []


def local_session(cores: str = "8", app: str = "panelweave") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    It is whatever the cluster names in ``spark.checkpoint.dir``.  Only where
    nothing is set (local tests) is a fresh local folder made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_dirs[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    if _owners:
        _owners[-1].append(path)
    return path


@contextlib.contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Owns the tables that are written to the shared folder inside it and removes them at its end.

    Results that are still needed must be written elsewhere, or collected, before it ends.
    """
    own: list[str] = []
    _owners.append(own)
    try:
        yield
    finally:
        _owners.remove(own)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in own:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def pin(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: write it once to the shared folder and read it back.

    The written table outlives lost executors, is computed once however many
    branches read it, and its size is known to the optimizer, which may then
    broadcast it when (and only when) it is small.
    """
    path = fresh_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

