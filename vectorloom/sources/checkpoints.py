"""Model checkpoints: parameters only, as Parquet or in the binary format.

Fixed values of the binary format: the magic, 7 bytes; version 1; unsigned 32-bit count; then for every parameter rows,
cols and 32-bit floats, row by row, all little-endian.
"""

from __future__ import annotations

import os
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC, VERSION = b"KMLCP01", 1
SCHEMA = "param_idx int, rows int, cols int, data array<float>, version int"


def as_table(spark: SparkSession, params: list[np.ndarray]) -> DataFrame:
    return spark.createDataFrame([(i, *p.shape, [float(v) for v in p.ravel()], VERSION) for i, p in enumerate(params)], SCHEMA)


def encode(params: list[np.ndarray]) -> bytes:
    body = [struct.pack("<II", *p.shape) + np.ascontiguousarray(p, "<f4").tobytes() for p in params]
    return MAGIC + struct.pack("<II", VERSION, len(params)) + b"".join(body)


def decode(data: bytes, shapes: list[tuple[int, int]]) -> list[np.ndarray]:
    """Parameters; everything is checked before anything is returned. Raises ValueError."""
    head = len(MAGIC) + 8
    if data[: len(MAGIC)] != MAGIC or len(data) < head:
        raise ValueError("not a checkpoint")
    version, count = struct.unpack_from("<II", data, len(MAGIC))
    if version != VERSION or count != len(shapes):
        raise ValueError("another version or number of parameters")
    at, out = head, []
    for shape in shapes:
        if len(data) < at + 8 or struct.unpack_from("<II", data, at) != tuple(shape):
            raise ValueError("a parameter has another shape")
        n = shape[0] * shape[1]
        if len(data) < at + 8 + 4 * n:
            raise ValueError("the checkpoint is cut off")
        out.append(np.frombuffer(data, "<f4", n, at + 8).reshape(shape).copy())
        at += 8 + 4 * n
    return out


def save(params: list[np.ndarray], path: str) -> None:
    with open(path + ".tmp", "wb") as f:
        f.write(encode(params))
    os.replace(path + ".tmp", path)


def load(path: str, shapes: list[tuple[int, int]]) -> list[np.ndarray]:
    with open(path, "rb") as f:
        return decode(f.read(), shapes)


def save_table(spark: SparkSession, params: list[np.ndarray], path: str) -> None:
    as_table(spark, params).coalesce(1).write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str, shapes: list[tuple[int, int]]) -> list[np.ndarray]:
    """Shapes and versions are compared in one join before anything is returned."""
    kept = spark.read.parquet(path)
    want = spark.createDataFrame([(i, *s) for i, s in enumerate(shapes)], "param_idx int, r int, c int")
    both = kept.join(want, "param_idx", "full")
    bad = both.where(~F.coalesce((F.col("rows") == F.col("r")) & (F.col("cols") == F.col("c")) & (F.col("version") == VERSION) & (F.size("data") == F.col("r") * F.col("c")), F.lit(False))).count()
    if bad:
        raise ValueError(f"{bad} parameters do not fit")
    return [np.array(r["data"], np.float32).reshape(r["rows"], r["cols"]) for r in kept.orderBy("param_idx").collect()]
