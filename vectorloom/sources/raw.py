"""Raw float files: little-endian 32-bit numbers, row by row."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profile import numbered

#: Bytes of one read; a matrix is cut into ranges of whole rows of about this size, one task each.
RANGE_BYTES = 64 << 20


def read_matrix(spark: SparkSession, path: str, rows: int, cols: int, mode: str = "strict") -> DataFrame:
    """(row_id, features) of a matrix file. Every task opens the file and reads only its range of rows.

    permissive: a longer file is cut off, a shorter one is filled up with zeros. strict: an empty file, a size that is
    no multiple of four, or one that is not that of the matrix raises ValueError. The path must be readable by every
    executor (a shared mount).
    """
    if rows < 1 or cols < 1 or mode not in ("strict", "permissive"):
        raise ValueError("rows and cols must be positive, mode strict or permissive")
    size = os.path.getsize(path)
    if mode == "strict" and (size == 0 or size % 4 or size != rows * cols * 4):
        raise ValueError(f"{path} has {size} bytes; {rows * cols * 4} were expected")
    step = max(1, RANGE_BYTES // (4 * cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in b.column(0).to_pylist():
                n = min(step, rows - start)
                with open(path, "rb") as f:
                    f.seek(start * cols * 4)
                    data = f.read(n * cols * 4)
                values = np.zeros(n * cols, "<f4")
                got = np.frombuffer(data[: len(data) // 4 * 4], "<f4")
                values[: len(got)] = got
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * cols)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + n)), pa.ListArray.from_arrays(offsets, pa.array(values))], ["row_id", "features"])

    starts = spark.range(0, rows, step, max(1, -(-rows // step)))
    return starts.mapInArrow(run, "row_id long, features array<float>")


def read_floats(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, features of one number): a strict read of a file of any whole number of floats."""
    size = os.path.getsize(path)
    if size == 0 or size % 4:
        raise ValueError(f"{path} is empty or no whole number of floats")
    return read_matrix(spark, path, size // 4, 1)


def write_matrix(df: DataFrame, path: str, id_col: str = "row_id", features_col: str = "features") -> None:
    """One file in order of the id: every task writes its rows at their place, so nothing passes through the driver.

    The path must be writable by every executor (a shared mount). A task that is run again writes the same bytes at the
    same place. Vectors of different lengths raise ValueError; no rows give an empty file.
    """
    data = df.select(F.col(id_col).alias("id"), F.col(features_col).cast("array<float>").alias("x"))
    size = data.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high"), F.count_if(F.col("x").isNull()).alias("nulls")).first()
    if size["nulls"] or size["low"] != size["high"]:
        raise ValueError("vectors must be present and of one length")
    rows, n = numbered(data, ["id"])
    part, width = path + ".tmp", size["low"] or 0
    with open(part, "wb") as f:
        f.truncate(n * width * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(part, "r+b") as f:
            for b in batches:
                at, values = b.column(0).to_numpy(), np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), "<f4").reshape(-1, width)
                edges = np.flatnonzero(np.diff(at) != 1) + 1
                for places, block in zip(np.split(at, edges), np.split(values, edges)):
                    if len(places):
                        f.seek(int(places[0]) * width * 4)
                        f.write(np.ascontiguousarray(block).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([0])], ["done"])

    rows.select("pos", "x").sortWithinPartitions("pos").mapInArrow(run, "done long").count()
    os.replace(part, path)
