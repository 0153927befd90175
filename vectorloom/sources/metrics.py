"""Training metrics as CSV: header epoch,accuracy,cost,learning_rate."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "epoch,accuracy,cost,learning_rate"


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, accuracy, cost, learning_rate) as doubles. Blank lines are skipped and columns beyond the fourth ignored.

    Another header, one that is repeated, a number that does not parse, or no rows raises ValueError.
    """
    # One row an epoch, so a file is read whole and the place of a line in it is known.
    return checked(spark.read.text(path, wholetext=True))


def checked(files: DataFrame) -> DataFrame:
    """The rows of metrics files, given whole in ``value``; raises as ``read_metrics`` does."""
    lines = files.select(F.posexplode(F.split("value", "\n")).alias("at", "line")).withColumn("line", F.trim(F.regexp_replace("line", "\r$", "")))
    cols = [F.expr(f"try_cast(get(split(line, ','), {i}) AS DOUBLE)").alias(c) for i, c in enumerate(HEADER.split(","))]
    rows = lines.where("line <> '' or at = 0").select("at", "line", *cols)
    broken = F.expr("epoch IS NULL OR accuracy IS NULL OR cost IS NULL OR learning_rate IS NULL")
    head = F.col("at") == 0
    seen = rows.agg(F.count_if(~head).alias("n"), F.count_if(~head & broken).alias("bad"), F.count_if(head & (F.col("line") == HEADER)).alias("heads"), F.count_if(head).alias("files")).first()
    if not seen["files"] or seen["heads"] != seen["files"]:
        raise ValueError(f"the header must be {HEADER}")
    if seen["bad"] or not seen["n"]:
        raise ValueError(f"{seen['bad']} bad rows of {seen['n']}")
    return rows.where("at > 0").drop("at", "line")


def write_metrics(df: DataFrame, path: str) -> None:
    """One file in order of the epochs, numbers with 6, 6 and 8 decimals. One row an epoch: small by definition."""
    line = F.format_string("%d,%.6f,%.6f,%.8f", F.col("epoch").cast("long"), F.col("accuracy").cast("double"), F.col("cost").cast("double"), F.col("learning_rate").cast("double"))
    with open(path + ".tmp", "w") as f:
        f.write(HEADER + "\n")
        for r in df.orderBy("epoch").select(line.alias("line")).toLocalIterator():
            f.write(r["line"] + "\n")
    os.replace(path + ".tmp", path)


class MetricsLog:
    """A metrics file that is written while a run goes on: each row is flushed, so a run that is cut off leaves its epochs.

    ``progress`` also prints what a test pass gave: right answers of all, and their share.
    """

    def __init__(self, path: str, tests: int = 0, progress: Callable[[str], None] | None = None):
        self.file, self.tests, self.progress = open(path, "w"), tests, progress
        self._put(HEADER)

    def _put(self, line: str) -> None:
        self.file.write(line + "\n")
        self.file.flush()

    def __call__(self, row: tuple) -> None:
        epoch, accuracy, cost, rate = row
        self._put(f"{epoch},{accuracy:.6f},{cost:.6f},{rate:.8f}")
        if self.progress:
            self.progress(f"Epoch {epoch}: test {round(accuracy * self.tests)}/{self.tests} ({100 * accuracy:.2f}%), cost {cost:.6f}")

    def close(self) -> None:
        self.file.close()
