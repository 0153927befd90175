"""Bucketed comparison: rows that share a key meet in one Python task and are compared as matrices.

A key held by more than ``limit`` rows is cut into blocks, and every pair of its blocks becomes a bucket of its own,
so no task ever holds more than two blocks of a bucket and no pair is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .images import BROADCAST_IDS, matrix

#: So many heavy keys, of 16 bytes each, may be broadcast; a longer list is joined by shuffling.
BROADCAST_KEYS = 10_000


def bucketed(rows: DataFrame, keys: DataFrame, limit: int, two_sided: bool = False, total: int | None = None) -> DataFrame:
    """``rows`` (k, side, row_id, ...) spread over buckets and sorted by them within each partition.

    ``keys``: the same k and side without the rest, cheap to read, to be counted (``total``: so many at most, if known). One-sided: side is 0, and the pairs
    of a bucket are those of its rows, or of side 0 with side 1 where a block meets another. Two-sided: the pairs are
    of side 0 with side 1.
    """
    rest = [c for c in rows.columns if c not in ("k", "side")]
    n = F.ceil(F.col("n") / limit).cast("int")
    by = ["k", "side"] if two_sided else ["k"]
    heavy = _crowded(keys, by, limit, total).groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    if two_sided:
        heavy = heavy.groupBy("k").agg(F.max(F.when(F.col("side") == 0, n)).alias("n0"), F.max(F.when(F.col("side") == 1, n)).alias("n1"))
        heavy = heavy.select("k", F.coalesce("n0", F.lit(1)).alias("n0"), F.coalesce("n1", F.lit(1)).alias("n1"))
    else:
        heavy = heavy.select("k", n.alias("n0"), n.alias("n1"))
    found = heavy.limit(BROADCAST_KEYS + 1).collect()
    if found:
        heavy = F.broadcast(rows.sparkSession.createDataFrame(found, heavy.schema)) if len(found) <= BROADCAST_KEYS else heavy
        own = F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1"))
        other = F.when(F.col("side") == 0, F.col("n1")).otherwise(F.col("n0"))
        wide = rows.join(heavy, "k", "left").withColumns({"n0": F.coalesce("n0", F.lit(1)), "n1": F.coalesce("n1", F.lit(1))})
        wide = wide.withColumn("own", F.pmod(F.xxhash64("row_id"), own).cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), (other - 1).cast("int"))))
        if two_sided:
            low, high, side = F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("met")), F.when(F.col("side") == 0, F.col("met")).otherwise(F.col("own")), F.col("side")
        else:
            low, high, side = F.least("own", "met"), F.greatest("own", "met"), (F.col("own") > F.col("met")).cast("tinyint")
        rows = wide.select(F.when((F.col("n0") == 1) & (F.col("n1") == 1), F.col("k")).otherwise(F.xxhash64("k", low, high)).alias("k"), side.cast("tinyint").alias("side"), *rest)
    return rows.repartition("k").sortWithinPartitions("k")


def _crowded(keys: DataFrame, by: list[str], limit: int, total: int | None) -> DataFrame:
    """The rows of ``keys`` that may belong to a key of more than ``limit`` rows.

    Keys are counted by a hash into eight times as many bins as there can be crowded keys, so a bin holds limit / 8
    rows on average and what travels is one number a bin and task; only keys in bins above the limit are counted one
    by one. At most an eighth of the bins can be above it.
    """
    total = keys.count() if total is None else total
    if total <= limit:
        return keys.limit(0)
    bins = max(1024, 8 * total // limit)
    placed = keys.withColumn("bin", F.pmod(F.xxhash64(*by), F.lit(bins)).cast("int"))
    full = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("bin")
    found = full.limit(BROADCAST_KEYS + 1).collect()
    if not found:
        return keys.limit(0)
    return placed.join(F.broadcast(full) if len(found) <= BROADCAST_KEYS else full, "bin", "left_semi").drop("bin")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Whole buckets of two or more rows from a sorted partition: a table with its buckets' starts and ends."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None and rest.num_rows:
            table = pa.concat_tables([rest, table])
        if table.num_rows == 0:
            continue
        keys = table.column("k").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        rest = table.slice(cut)
        if cut:
            yield from _bounds(table.slice(0, cut), keys[:cut])
    if rest is not None and rest.num_rows:
        yield from _bounds(rest, rest.column("k").to_numpy())


def _bounds(table: pa.Table, keys: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    edges = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])
    many = ends - starts > 1
    if many.any():
        yield table.combine_chunks(), starts[many], ends[many]


def squared(x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    """Squared distances between rows; exact for whole numbers while they stay below 2**24."""
    y = x if y is None else y
    out = x @ y.T
    out *= -2
    out += (x * x).sum(1)[:, None]
    out += (y * y).sum(1)[None]
    return out


def local_labels(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of every row of a bucket, the smallest id that links reach within the bucket. near: symmetric, true on the diagonal."""
    label = ids
    while True:
        new = np.where(near, label[None], np.iinfo(np.int64).max).min(axis=1)
        if (new == label).all():
            return label
        label = new


def sketch_ties(tight: float, bound: float, scale: np.ndarray, cross: bool = False, edge: float = 0.0, tail: int = 0):
    """For mapInArrow over ``bucketed`` rows (k, side, row_id, sketch): (a, b, loose) of rows that may belong together.

    A sketch holds a byte for each entry of ``scale``, its unit. Rows up to ``tight`` apart are tied to the smallest id that they reach so:
    at most one tie a row and bucket, however many pairs there are. All other pairs up to ``bound`` apart come out one
    by one as loose ones, since ties that reach far would chain everything together. ``tail`` bytes follow the sketch;
    with ``edge`` the first of them adds so much a unit to a pair's bound, the larger one counting. A length of 1 is
    added for rounding. cross: only rows of different sides are compared.
    """

    scale, width, bound = scale.astype(np.float32), len(scale), bound + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in groups(batches):
            ids, side = table.column("row_id").to_numpy(), table.column("side").to_numpy()
            rows = matrix(table.column("sketch"), width + tail)
            more = rows[:, width].astype(np.float32) * edge if edge else np.zeros(len(rows), np.float32)
            rows = rows[:, :width]
            out = []

            def add(a: np.ndarray, b: np.ndarray, loose: bool, out: list = out) -> None:
                if len(a):
                    out.append((np.maximum(a, b), np.minimum(a, b), np.full(len(a), loose)))

            pair = ends - starts == 2
            if pair.any():  # most buckets, all at once
                s = starts[pair]
                s = s[(ids[s] != ids[s + 1]) & ((side[s] != side[s + 1]) | (not cross and side[s] == 0))]
                d = np.square((rows[s].astype(np.float32) - rows[s + 1]) * scale).sum(axis=1)
                near = d <= tight * tight
                maybe = ~near & (d <= np.square(bound + np.maximum(more[s], more[s + 1])))
                add(ids[s[near]], ids[s[near] + 1], False)
                add(ids[s[maybe]], ids[s[maybe] + 1], True)
            for s, e in zip(starts[~pair].tolist(), ends[~pair].tolist()):
                mixed = side[s:e].any()
                if cross and (not mixed or side[s:e].all()):
                    continue
                own, wider = ids[s:e], more[s:e]
                d = squared(rows[s:e].astype(np.float32) * scale)
                near = d <= tight * tight
                np.fill_diagonal(near, True)
                maybe = d <= (np.square(bound + np.maximum(wider[:, None], wider[None])) if wider.any() else bound * bound)
                if mixed:
                    apart = side[s:e, None] != side[None, s:e]
                    near &= apart | np.eye(e - s, dtype=bool)
                    maybe &= apart
                label = local_labels(near, own)
                moved = label != own
                add(own[moved], label[moved], False)
                i, j = np.nonzero(np.triu(maybe & ~near, 1))
                kept = (label[i] != label[j]) & (own[i] != own[j])
                add(own[i[kept]], own[j[kept]], True)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["a", "b", "loose"])

    return run


TIES = "a long, b long, loose boolean"


def with_levels(labels: DataFrame, table: DataFrame) -> DataFrame:
    """(k, side, row_id, levels): the images of ``table`` that have a label (node, label), with it. Levels move once at most."""
    few = labels.count() <= BROADCAST_IDS
    found = table.select("row_id", "side", "levels").join(F.broadcast(labels) if few else labels, F.col("node") == F.col("row_id"))
    return found.select(F.col("label").alias("k"), "side", "row_id", "levels")


def paired_levels(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """(a, side_a, levels_a, b, side_b, levels_b) of loose pairs. Only images that a pair names are moved."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("row_id")).distinct()
    few = ids.count() <= BROADCAST_IDS
    named = table.join(F.broadcast(ids) if few else ids, "row_id", "left_semi").groupBy("row_id").agg(F.first("side").alias("side"), F.first("levels").alias("levels"))
    for end in ("a", "b"):
        pairs = pairs.join(named.select(F.col("row_id").alias(end), F.col("side").alias(f"side_{end}"), F.col("levels").alias(f"levels_{end}")), end)
    return pairs.select("a", "side_a", "levels_a", "b", "side_b", "levels_b")
