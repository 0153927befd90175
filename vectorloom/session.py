"""Sessions: settings the engine is meant to run with, and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent

#: Settings of a local session. On a cluster the deployment sets partitions and memory; nothing below is required.
LOCAL = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", **settings: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("vectorloom")
    return builder.config(map=LOCAL | settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session without the setting gets a folder of its own."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="vectorloom-"))
        path = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """df as it is now, written to the shared folder: whatever reads it again, also after lost executors, reads the same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless their PYTHONPATH already has it."""
    sc = spark.sparkContext
    if str(PACKAGE.parent) in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_vectorloom_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="vectorloom-")) / "vectorloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    sc.addPyFile(str(path))
    sc._vectorloom_shipped = True
