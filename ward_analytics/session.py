"""Session settings and the shared work folder."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import SparkSession

#: Settings for any deployment. The number of shuffle partitions is left to it: on a cluster start
#: high (``spark.sql.adaptive.coalescePartitions.initialPartitionNum``), AQE merges by size.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Tables bucketed by patient join by patient and more without moving rows.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # No call-site lookup for each column expression: it doubles the time to declare a query.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def local_session(
    app: str, cpus: int = 8, memory: str = "8g", conf: Mapping[str, str] | None = None
) -> SparkSession:
    """A session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for key, value in {**BASE_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that all executors share: below ``spark.checkpoint.dir``, else below the warehouse.

    What a query writes there is read when its result is; it is the caller's to remove afterwards, by its
    name or together with the shared folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/work"
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def require_utc(spark: SparkSession) -> None:
    """Tables keep times without zone, in UTC; under another session zone they would shift."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC, not {zone}")
