"""Random streams. PCG32 is exact, so draws agree wherever the generator is specified; it runs on the driver.

A stream is sequential by definition, so it is for seeds, initial weights and orders of bounded size. Columns of random
numbers over large tables use ``uniform`` instead, which is a hash of the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MULTIPLIER = 6364136223846793005
DEFAULT_SEED, DEFAULT_SEQUENCE = 0x853C49E6748FEA9B, 0xDA3E39CB94B95BDB
_M64, _M32 = (1 << 64) - 1, (1 << 32) - 1


class PCG32:
    """XSH-RR with 64-bit state, seeded with the generator's published constants unless told otherwise."""

    def __init__(self, seed: int = DEFAULT_SEED, sequence: int = DEFAULT_SEQUENCE):
        self.state, self.increment = 0, (sequence << 1 | 1) & _M64
        self.u32()
        self.state = (self.state + seed) & _M64
        self.u32()

    def u32(self) -> int:
        old = self.state
        self.state = (old * MULTIPLIER + self.increment) & _M64
        mixed, turn = ((old >> 18 ^ old) >> 27) & _M32, old >> 59
        return (mixed >> turn | mixed << (-turn & 31)) & _M32

    def unit(self) -> float:
        """In [0, 1), of 24 bits."""
        return (self.u32() >> 8) / 2**24

    def fill(self, rows: int, cols: int, low: float, high: float) -> np.ndarray:
        """Uniform in [low, high), row by row."""
        return np.array([self.unit() * (high - low) + low for _ in range(rows * cols)]).reshape(rows, cols)


def draws(spark: SparkSession, count: int, seed: int = DEFAULT_SEED, sequence: int = DEFAULT_SEQUENCE) -> DataFrame:
    """(i, u32, unit): the first draws of a stream."""
    one, two = PCG32(seed, sequence), PCG32(seed, sequence)
    return spark.createDataFrame([(i, one.u32(), two.unit()) for i in range(count)], "i int, u32 long, unit double")


def transposition_orders(n: int, epochs: int, generator: PCG32) -> Iterator[np.ndarray]:
    """The order of rows in each epoch: n random swaps of two places, carried on from epoch to epoch."""
    order = np.arange(n)
    for _ in range(epochs):
        for _ in range(n):
            a, b = generator.u32() % n, generator.u32() % n
            order[a], order[b] = order[b], order[a]
        yield order.copy()


def uniform(seed: int, *keys: Column | str) -> Column:
    """In [0, 1), a hash of the keys: the same for a row wherever it is computed, at any number of tasks."""
    h = F.xxhash64(F.lit(seed), *[F.col(k) if isinstance(k, str) else k for k in keys])
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def bootstrap_weights(df: DataFrame, trees: int, seed: int, id_col: str = "row_id") -> DataFrame:
    """df with (tree_id, weight): a sample with replacement for every tree, as Poisson(1) counts, rows of weight 0 left out.

    Each row draws its own counts, so sampling is one pass without a shuffle at any size.
    """
    u = uniform(seed, "tree_id", id_col)
    p, cut, weight = 0.36787944117144233, 0.0, F.lit(7)
    steps = []
    for k in range(7):
        cut += p
        steps.append((cut, k))
        p /= k + 1
    for c, k in reversed(steps):
        weight = F.when(u < c, k).otherwise(weight)
    return df.withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("weight", weight).where("weight > 0")


def split_rows(df: DataFrame, share: float, seed: int = 42, id_col: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Two parts of about share and 1 - share, by a hash of the id: stable when rows are added."""
    u = uniform(seed, id_col)
    return df.where(u < share), df.where(u >= share)
