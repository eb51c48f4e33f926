"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "panelweave", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the settings the engine relies on.

    Only behaviour is set here (time zone, adaptive execution, Arrow). Cluster
    sizing belongs to spark-submit; callers may override anything via ``conf``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Staged copies go when nothing refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # A row handed to Python may hold a whole series: keep batches small.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
        # Tables already split by series join on (series, date) without another shuffle.
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        # Banks of models are built from many columns; do not record a Python stack for each.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # Panels are small after aggregation and the work per row is not: keep the cores busy.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory.

    ``spark.checkpoint.dir`` names that directory on a cluster. A local folder
    is used only where the setting is absent, and then only with a local master.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp" if os.path.isdir("/tmp") else None)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
