"""Cutting lineage, and a folder for tables that are written on the way: both in the place all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one if all runs on this machine; a cluster must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="quillspark-")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint df in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """Plans made in here remove their shuffle files, which else stay until the driver collects its garbage."""
    conf, name = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        yield
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def cut_clean(df: DataFrame) -> DataFrame:
    """Checkpoint df and remove the shuffle files that making it took."""
    with _cleaning(df.sparkSession):
        return cut(df.select("*"))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, smaller than a checkpoint; the shuffle files that making it took are removed."""
    path = new_folder(df.sparkSession, name)
    with _cleaning(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a checkpoint that nothing reads any more; ``df``: as it came from cut or cut_clean."""
    path = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if path.isDefined():
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path.get())
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
