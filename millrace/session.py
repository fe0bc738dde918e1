"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; `conf` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


@lru_cache(maxsize=None)
def _local_base(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="millrace-")


def workspace(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`.

    Only a local master, where all tasks share one machine, may fall back to a temporary
    folder; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_base(context.applicationId)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never handed out twice."""
    path = f"{_own_scratch(spark)}/{name}-{uuid.uuid4().hex}"
    getattr(_open, "paths", []).append(path)
    return path


_open = threading.local()


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete what the calling thread gets from `scratch` inside the block when it ends."""
    before, _open.paths = getattr(_open, "paths", []), []
    try:
        yield
    finally:
        for path in _open.paths:
            delete_path(spark, path)
        _open.paths = before


def materialized(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to scratch and read back: its rows stay as they are, and are removed with
    the scratch folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _own_scratch(spark: SparkSession) -> str:
    return f"{workspace(spark)}/millrace/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete everything this Spark application got from `scratch`."""
    delete_path(spark, _own_scratch(spark))


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def make_dirs(spark: SparkSession, path: str) -> str:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)
    return path


def move_path(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder; False if the target is there already."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    files = make(source).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(make(target).getParent())
    return not files.exists(make(target)) and files.rename(make(source), make(target))


def list_folders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit a glob pattern, as URIs write them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [status.getPath().toUri().getRawPath() for status in found or []]


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
