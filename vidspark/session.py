"""Session defaults for local runs and for clusters."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Settings that hold on any cluster size; sizes of executors are left to the deployment.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
}


def build_session(master: str | None = None, app: str = "vidspark", **extra: str) -> SparkSession:
    """A session with the defaults above; ``extra`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    for k, v in extra.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


_SHIPPED: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Send the package to the workers once per application, as they may start in any folder.

    The zip is made on the driver, from which Spark hands it to the executors.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(home)
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "vidspark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    at = os.path.join(folder, name)
                    z.write(at, os.path.relpath(at, root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED[app] = path
