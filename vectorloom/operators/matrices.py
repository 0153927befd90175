"""Matrices as tables: coordinate form (i, j, v), row vectors (row_id, features), and products of both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def to_coo(rows: DataFrame, id_col: str = "row_id", features_col: str = "features") -> DataFrame:
    return rows.select(F.col(id_col).cast("long").alias("i"), F.posexplode(F.col(features_col).cast("array<double>")).alias("j", "v"))


def to_rows(coo: DataFrame) -> DataFrame:
    """(row_id, features), entries in order of j; absent entries are left out, so give every entry of a dense matrix."""
    return coo.groupBy(F.col("i").alias("row_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("features"))


def zeros(spark: SparkSession, rows: int, cols: int, value: float = 0.0) -> DataFrame:
    return spark.range(rows).select(F.col("id").alias("row_id"), F.array_repeat(F.lit(float(value)), cols).alias("features"))


def transpose(coo: DataFrame) -> DataFrame:
    return coo.select(F.col("j").cast("long").alias("i"), F.col("i").alias("j"), "v")


def matmul(a: DataFrame, b: DataFrame, transpose_a: bool = False, transpose_b: bool = False, accumulate: DataFrame | None = None) -> DataFrame:
    """(i, j, v) of a . b. A transposed operand only swaps its column names; accumulate adds a matrix before the sum."""
    a = a.select(*[F.col(c).cast("long").alias(n) for c, n in ((("j", "i"), ("i", "k")) if transpose_a else (("i", "i"), ("j", "k")))], F.col("v").alias("x"))
    b = b.select(*[F.col(c).cast("long").alias(n) for c, n in ((("j", "k"), ("i", "j")) if transpose_b else (("i", "k"), ("j", "j")))], F.col("v").alias("y"))
    terms = a.join(b, "k").select("i", "j", (F.col("x") * F.col("y")).alias("v"))
    if accumulate is not None:
        terms = terms.unionByName(accumulate.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v"))
    return terms.groupBy("i", "j").agg(F.sum("v").alias("v"))


def combine(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """(i, j, v) of a + sign b; an entry that one lacks counts as 0."""
    both = a.select("i", "j", "v").unionByName(b.select("i", "j", (F.col("v") * sign).alias("v")))
    return both.groupBy("i", "j").agg(F.sum("v").alias("v"))


def max_abs_error(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.alias("a").join(b.alias("b"), ["i", "j"], "full").agg(F.max(F.abs(F.coalesce("a.v", F.lit(0.0)) - F.coalesce("b.v", F.lit(0.0)))).alias("max_abs_error"))


def stack(batch: pa.RecordBatch, name: str = "features") -> np.ndarray:
    """A list column of equal lengths as a matrix; raises if it is ragged, holds null vectors or null entries."""
    column = batch.column(batch.schema.get_field_index(name))
    if column.null_count or (n := len(column)) == 0:
        if len(column) == 0:
            return np.zeros((0, 0))
        raise ValueError("feature vectors must not be null")
    widths = np.diff(column.offsets.to_numpy())
    values = column.flatten()
    if widths.min() != widths.max() or widths[0] == 0 or values.null_count:
        raise ValueError("feature vectors must be full and of one length of at least 1")
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, widths[0])


def gram(df: DataFrame, extra: list[str] = (), features_col: str = "features") -> tuple[np.ndarray, int]:
    """X'X of [1, features, extra columns] over all rows: one (d + 2)-square sum a partition, added up by Spark.

    The result has the row count, sums and second moments; it is all that linear regression and principal components
    need. d is bounded by the width of a vector, never by the number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = stack(b)
                more = [b.column(b.schema.get_field_index(e)).to_numpy(zero_copy_only=False).astype(np.float64)[:, None] for e in extra]
                x = np.hstack([np.ones((len(x), 1)), x, *more])
                if total is not None and total.shape[0] != x.shape[1]:
                    raise ValueError("feature vectors must be of one length")
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            d = total.shape[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(np.full(d * d, d)), pa.array(total.ravel())], ["cell", "d", "v"])

    rows = df.select(F.col(features_col).cast("array<double>").alias("features"), *[F.col(e).cast("double").alias(e) for e in extra]).mapInArrow(run, "cell long, d long, v double")
    sums = rows.groupBy("cell").agg(F.min("d").alias("d"), F.max("d").alias("most"), F.sum("v").alias("v")).collect()
    if not sums:
        raise ValueError("at least one row is needed")
    if any(r["d"] != r["most"] for r in sums):
        raise ValueError("feature vectors must be of one length")
    d = sums[0]["d"]
    out = np.zeros(d * d)
    for r in sums:
        out[r["cell"]] = r["v"]
    out = out.reshape(d, d)
    return out, int(round(out[0, 0]))


def covariance(df: DataFrame, features_col: str = "features") -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, population covariance, rows)."""
    g, n = gram(df, features_col=features_col)
    mean = g[0, 1:] / n
    return mean, g[1:, 1:] / n - np.outer(mean, mean), n


def covariance_table(df: DataFrame, features_col: str = "features") -> DataFrame:
    """(i, j, cov) of all features, i <= j: as many rows as the square of the width, whatever the number of vectors."""
    _, cov, _ = covariance(df, features_col)
    i, j = np.triu_indices(len(cov))
    return df.sparkSession.createDataFrame(pa.table({"i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)), "cov": pa.array(cov[i, j])}))
