"""The shared folder and durable intermediate tables."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target


class NoSharedFolder(RuntimeError):
    """A cluster's session that names no folder which driver and executors share."""


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set, a local one with a local master, an error with another."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise NoSharedFolder("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        remove_at_end(spark, found)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
        remove_at_end(spark, context.getCheckpointDir())
    return found


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Makes the folder, and has it removed when the driver's JVM ends; tables that read it are of no use after that."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)


@functools.cache
def run_dir(shared: str, application: str) -> str:
    """The folder of this application in the shared one."""
    path = f"{shared.rstrip('/')}/codehealth-{uuid.uuid4().hex}"
    remove_at_end(SparkSession.builder.getOrCreate(), path)
    return path


def new_dir(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other run uses; it is removed when the driver ends."""
    return f"{run_dir(shared_dir(spark), spark.sparkContext.applicationId)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, what: str) -> DataFrame:
    """``df`` computed once as ``cut`` does, for many rows: compressed columns take a fraction of a checkpoint's disk."""
    path = new_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, *jobs: Callable) -> list:
    """What ``jobs`` return, all of them run at once, so that small ones of one fill the cores that others leave idle."""
    shared_dir(spark)
    bound = inheritable_thread_target(spark)
    if bound is spark:  # no thread of its own in the JVM for each here
        return [job() for job in jobs]
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [x.result() for x in [pool.submit(bound(job)) for job in jobs]]
