"""Session helpers.

Settings are chosen for correctness (ANSI on, UTC) and for large inputs
(AQE with partition coalescing and skew-join splitting).  On a cluster the
builder picks up whatever the deployment already set; we only fill in keys
that are unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoints go once the DataFrames that read them are gone
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # no Python stack trace kept for every Column: it takes milliseconds a call
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "growthlab") -> SparkSession:
    """Return (or create) a session with the library defaults applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.driver.memory", os.environ.get("GROWTHLAB_DRIVER_MEM", "16g"))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, set at most once per session.

    ``spark.checkpoint.dir`` (the cluster's shared folder) is used as it is; a
    scratch folder is made only when that setting is absent, in local mode.
    Lineage is cut with reliable checkpoints into this folder
    (``functions.ordered.materialize``), never ``localCheckpoint``."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    d = spark.conf.get("spark.checkpoint.dir", None)
    if current and (not d or _plain(current).startswith(_plain(d))):
        return current
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            # a machine-local folder is not reachable by the other executors
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on the cluster's "
                               "distributed file system) before running growthlab jobs")
        # local mode (tests): a scratch folder of this machine
        d = tempfile.mkdtemp(prefix="growthlab-ckpt-", dir="/tmp")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir()


def _plain(path: str) -> str:
    """Path without its scheme, so ``file:/x`` and ``file:///x`` compare equal."""
    return "/" + path.split(":", 1)[-1].strip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for an intermediate table, in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
