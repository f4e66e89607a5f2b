"""Session settings, the shared scratch folder and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def build_session(app: str = "fleetlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on.

    ANSI mode stays on (parsers use ``try_`` forms). Adaptive execution turns joins with a small side into
    broadcasts by measured size, splits skewed join partitions and merges small shuffle partitions, so no
    operator here hints a broadcast.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        # streaming state on disk with incremental checkpoints, so that its size is not bound by memory
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # no Python call sites in JVM errors; looking them up doubles the time to build large expressions
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for files that a job writes and reads back.

    It lies in the folder named by ``spark.checkpoint.dir``, which every executor can reach; where that is
    unset, beside the tables of ``spark.sql.warehouse.dir``, which they share as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python functions can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(package)
    # Spark serves the file from the driver; the driver alone reads it
    path = os.path.join(tempfile.mkdtemp(prefix="fleetlens-"), "fleetlens.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
