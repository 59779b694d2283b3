"""Reading the parquet tables of a data directory, and writing intermediate ones."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

OUTBOX = "dionysus_outbox_without_changesets"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir. Only a local session without it gets one of our own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="weirflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def spread(df: DataFrame, task_bytes: int = 32 << 20) -> DataFrame:
    """df over all cores if it is so small that its files would be read in fewer tasks than there are; larger tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * task_bytes else df


_scopes = threading.local()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside this block are removed at its end; nothing may read them afterwards."""
    before, _scopes.paths = getattr(_scopes, "paths", None), []
    try:
        yield
    finally:
        for path in _scopes.paths:
            _remove(spark, path)
        _scopes.paths = before


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there stays until the enclosing `scratch` block ends, or the process does."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    paths = getattr(_scopes, "paths", None)
    if paths is None:
        atexit.register(_remove, spark, path)
    else:
        paths.append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder (see folder) and read it back, so that later steps neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.option("compression", "snappy").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may already be gone
        pass
