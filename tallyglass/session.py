"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings the operators rely on.  Event times are UTC throughout, and a
# page of up to `windowGroupLimitThreshold` rows may be trimmed before its shuffle.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": "200000",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: what the cluster names in
    ``spark.checkpoint.dir``, else the context's checkpoint directory.

    Only a local master, where driver and executors share one disk, may fall back
    to a temporary folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    folder = named or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyglass-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; never reused, never cleared."""
    return f"{shared_folder(spark).rstrip('/')}/tallyglass/{label}-{uuid.uuid4().hex}"
