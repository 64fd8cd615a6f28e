"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only: they can be applied to a session somebody else built.
RUNTIME_SETTINGS = {
    # report times are UTC and are compared as instants
    "spark.sql.session.timeZone": "UTC",
    # a repeated JSON key keeps its last value instead of failing the line
    "spark.sql.variant.allowDuplicateKeys": "true",
    # let tail windows of up to this size cut rows before the shuffle
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    # merge session windows inside each task before shuffling
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


# Settings only a new session can take.
BUILD_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # no call-site bookkeeping for every column expression built in Python
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str, master: str | None = None, **settings: str) -> SparkSession:
    """A session with all settings; ``settings`` use ``__`` for dots in names."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**BUILD_SETTINGS, **RUNTIME_SETTINGS}.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to ``spark`` and return it."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="vigil-"))
    return context.getCheckpointDir()


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; Spark creates it on first write."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def settle(table: DataFrame, label: str) -> DataFrame:
    """Write a small table that is read several times, and return it read back.

    Several results over one summary would each scan the whole history again.
    The written table also survives the loss of executors.
    """
    path = fresh_folder(table.sparkSession, label)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)
