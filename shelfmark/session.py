"""Session defaults for local runs, tests and the benchmark.

On a cluster the session comes from the platform; nothing here is required.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, app: str = "shelfmark", memory: str = "8g") -> SparkSession:
    """A local session with the settings the library is tuned for."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", memory))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    The session's own setting wins. A temporary folder is used only when none
    is set and the session runs in local mode, where driver and tasks share it.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="shelfmark-ckpt-")
    context.setCheckpointDir(folder)
    return folder


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers once per session, so that queries run from any working folder."""
    context = spark.sparkContext
    if getattr(context, "_shelfmark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="shelfmark-ship-")  # the driver serves the archive from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "shelfmark.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._shelfmark_shipped = True
