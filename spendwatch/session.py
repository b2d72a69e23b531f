"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC day boundaries, ANSI arithmetic, AQE for
# runtime coalescing and skew splitting, static partition overwrite (the
# delete-then-insert semantics of the daily loads).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # small but CPU-heavy stages (windows over daily series, tree levels) stay spread over the cores
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.sources.partitionOverwriteMode": "static",
    # folders are listed by a few tasks of many folders, not by a task each
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "spendwatch",
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings above.

    On a cluster leave ``master`` and ``shuffle_partitions`` as None so that
    spark-submit decides; tests pass ``local[N]`` and a number.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k, v in conf.items():
        if not k.startswith("spark.ui") and not k.startswith("spark.driver"):
            try:
                spark.conf.set(k, v)
            except Exception:  # static conf on a reused session
                pass
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    A cluster sets ``spark.checkpoint.dir`` (or the context's checkpoint
    directory) to shared storage.  Only a local session without one (tests)
    gets a private scratch folder; a cluster session without one is an error.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not re.match(r"local(\[|$)", sc.master):    # local-cluster has executors of its own
            # a machine-local folder would not survive a lost executor
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS / object store)")
        d = tempfile.mkdtemp(prefix="spendwatch-ckpt-", dir=os.environ.get("SPENDWATCH_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d
