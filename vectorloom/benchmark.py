"""Command line of the matrix benchmark: python -m vectorloom.benchmark --output report.json.

Exit code 2 for wrong arguments, 1 if the report cannot be written.
"""

from __future__ import annotations

import argparse
import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.rng import PCG32
from .operators import matrices
from .sources import reports

WARM_UP, LARGEST = 2, 2048


def operands(spark: SparkSession, size: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Two square matrices, uniform in [-1, 1), drawn one after the other from one stream and kept as 32-bit numbers."""
    draw, out = PCG32(seed), []
    for _ in range(2):
        m = draw.fill(size, size, -1.0, 1.0).astype(np.float32)
        rows = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "row_id long, features array<float>")
        out.append(matrices.to_coo(rows))
    return out[0], out[1]


def largest_error(a: DataFrame, b: DataFrame) -> float:
    """Of the product kept as 32-bit numbers against the product in doubles."""
    exact = matrices.matmul(a, b)
    return matrices.max_abs_error(exact.withColumn("v", F.col("v").cast("float").cast("double")), exact).first()["max_abs_error"]


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="vectorloom.benchmark")
    parser.add_argument("--output", required=True)
    parser.add_argument("--size", type=int, default=128)
    parser.add_argument("--iterations", type=int, default=10)
    parser.add_argument("--seed", type=int, default=5489)
    try:
        given = parser.parse_args(arguments)
        if not 1 <= given.size <= LARGEST or given.iterations < 1 or given.seed < 0:
            parser.error(f"size from 1 to {LARGEST}, at least one iteration, seed not negative")
    except SystemExit as stop:
        return int(stop.code or 0)
    if spark is None:
        from .session import local_session

        spark = local_session()
    a, b = (m.persist() for m in operands(spark, given.size, given.seed))
    report = reports.benchmark(spark, "spark.square_matmul", lambda: matrices.matmul(a, b), 2.0 * given.size**3, given.iterations, WARM_UP, given.seed)
    report["metrics"]["maximum_absolute_error"] = largest_error(a, b)
    try:
        reports.write_benchmark(report, given.output)
    except OSError as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
