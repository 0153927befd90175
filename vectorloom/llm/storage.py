"""Intermediate tables in the shared checkpoint folder.

Iterative operators cut lineage by writing a table to the folder named by ``spark.checkpoint.dir`` and reading it
back: the files survive the loss of any executor, and a table that is used twice is computed once.
"""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame

from ..session import shared_dir


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it. ``release`` deletes it."""
    _collect(df)
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._vectorloom_path = path
    return kept


def _collect(df: DataFrame) -> None:
    """Collect the driver's garbage: Spark deletes the shuffle files behind tables written before only when it is collected."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def settle(df: DataFrame, seconds: float = 1.5) -> None:
    """Let shuffle files of tables just written be deleted before a step that needs as much room again.

    Python's hold on the plan behind a table ends up to a second after the table is written, so this waits for it; the
    scheduler's ends with its next job, so this runs a trivial one.
    """
    df.sparkSession.range(1).count()
    time.sleep(seconds)
    _collect(df)
    time.sleep(0.2)


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``keep`` once everything derived from them is itself written."""
    for df in tables:
        path = getattr(df, "_vectorloom_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
