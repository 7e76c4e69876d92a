"""Session helpers: a tuned local session, and shipping the package to Python workers."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "treeline") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TREELINE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that were not started with it on their path.

    Workers on the driver's machine inherit PYTHONPATH; elsewhere the package is sent once per
    application as a zip through the driver's file server.
    """
    sc = spark.sparkContext
    if getattr(sc, "_treeline_shipped", False):
        return
    root = str(PACKAGE.parent)
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        target = Path(tempfile.mkdtemp(prefix="treeline-")) / "treeline_pkg.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in PACKAGE.rglob("*.py"):
                z.write(p, p.relative_to(PACKAGE.parent))
        sc.addPyFile(str(target))
        if root not in sys.path:
            sys.path.insert(0, root)
    sc._treeline_shipped = True


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder that spark.checkpoint.dir names: what follows starts from its
    rows, not its plan. Only a local session without that setting gets a folder of its own."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = f"file://{tempfile.gettempdir()}/treeline-checkpoints"
        sc.setCheckpointDir(root)
    return df.checkpoint(eager=True)
