"""Spark session settings and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "streamatlas") -> SparkSession:
    """A local session for tests and the benchmark. On a cluster the caller brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("STREAMATLAS_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def share_package(spark: SparkSession) -> None:
    """Lets Python workers of this machine import the package wherever the driver found it. On a cluster the package is installed on the executors or
    shipped with `--py-files`; the path added here is then of no effect."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in known:
        environment["PYTHONPATH"] = os.pathsep.join([home, *known])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that `checkpoint()` writes to.

    On a cluster the shared folder is named by `spark.checkpoint.dir`; it is read from the session and used as it is.
    Only where it is unset (tests) a fresh local folder is taken.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current:
        return current
    if not configured and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = configured or tempfile.mkdtemp(prefix="streamatlas-ckpt-")
    sc.setCheckpointDir(folder)
    return folder
