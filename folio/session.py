"""Session helpers for tests, benchmarks and scripts.

Library code never creates a session; it receives one. These helpers are
for local runs only.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", app: str = "folio", shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("FOLIO_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def in_one_process(spark: SparkSession) -> bool:
    return re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is not None


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers of a ``local[...]`` session import this package from any working directory.

    On a cluster the package comes with ``--py-files`` or is installed.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped and in_one_process(spark):
        here = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="folio-py-"), "folio"), "zip", os.path.dirname(here), os.path.basename(here))
        spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent, the folder given to ``setCheckpointDir``
    is taken. A session that runs in one process (``local[...]``, as in
    tests) may have neither and gets a fresh temporary folder, kept for the
    session; on a cluster that is an error, because executors do not share
    the driver's disk.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not in_one_process(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="folio-ckpt-"))
        root = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root
