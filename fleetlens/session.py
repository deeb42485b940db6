"""Session settings the jobs rely on, and the shared folder for cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession
from pyspark.util import inheritable_thread_target

_SETTINGS = {
    # Timestamps without an offset are UTC.
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key is legal in a log line: the last one wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # What a Python worker holds at once, besides one row.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables, as the cluster names it.

    Only a local session that names none (a test) gets a temporary one: on a cluster each
    executor would write to a disk of its own.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="fleetlens-")
    return _own_dir


def materialize(df, name: str, **options):
    """Cut lineage through a written table that survives executor loss."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fleetlens/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.parquet(path)


def together(spark: SparkSession, makers: list[Callable]) -> list:
    """What independent makers return, in order; the jobs they start run side by side.

    One that waits for its last tasks leaves the cluster to the others. The first error is raised
    when all have ended.
    """
    if not makers:
        return []
    with ThreadPoolExecutor(len(makers)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(make)) for make in makers]
    return [job.result() for job in running]
