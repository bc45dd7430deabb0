"""Session settings and the shared folder that jobs may write intermediate tables to."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
_MERGE_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"

_fallback_root: str | None = None
_shipped_to: str | None = None


def session(master: str | None = None, app: str = "tallypost", **conf) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE, RocksDB state."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config(_PROVIDER, STATE_STORE)
        .config(_CHANGELOG, "true")
        .config(_MERGE_SESSIONS, "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Give the Python workers this package, once per context: functions are sent by name."""
    global _shipped_to
    context = spark.sparkContext
    if _shipped_to != context.applicationId:
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="tallypost-package-")
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
        _shipped_to = context.applicationId
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Give a session made elsewhere what the operators need.

    Times are UTC, stream state goes to RocksDB (off the heap, changes only per batch),
    and sessions of a stream are merged before the shuffle, so that one id cannot flood a task.
    The number of shuffle partitions, which also is the number of state stores per
    stateful step, is the caller's to set.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set(_PROVIDER, STATE_STORE)
    spark.conf.set(_CHANGELOG, "true")
    spark.conf.set(_MERGE_SESSIONS, "true")
    return ship(spark)


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach, named by the cluster in spark.checkpoint.dir.

    Where the setting is absent, a temporary folder stands in for it on a single machine;
    on a cluster executors would write to disks of their own, so that is an error.
    """
    global _fallback_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _fallback_root is None:
        _fallback_root = tempfile.mkdtemp(prefix="tallypost-")
    return _fallback_root


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/tallypost/{label}-{uuid.uuid4().hex}"


def side_by_side(spark: SparkSession, steps: Iterable[Callable]) -> list:
    """Results of steps that run at the same time, so that the cores have work while one of them waits."""
    steps = [inheritable_thread_target(spark)(step) for step in steps]  # with the caller's job settings
    with ThreadPoolExecutor(max(1, len(steps))) as pool:
        return [done.result() for done in [pool.submit(step) for step in steps]]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage and fixes the rows, so that a lost executor cannot make two
    uses of `df` see different values.
    """
    return stage_at(df, workspace(df.sparkSession, label))


def stage_at(df: DataFrame, path: str) -> DataFrame:
    """The same at a path of one's own; a table that was written there in full is kept as it is."""
    spark = df.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
