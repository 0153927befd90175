"""Near-same images: what the two near-duplicate operators share, from feature statistics to exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import TIES, bucketed, groups, paired_levels, sketch_ties, squared, with_levels
from .components import components
from .images import EDGE_STEP, PIXELS, SIDE, SPECTRUM_BYTES, SPECTRUM_SIZE, SPECTRUM_STEP, amplitudes, copies, edges, matrix
from .storage import keep, release

#: Squared distance of amplitudes up to which images that share a key are grouped; those beyond, up to the bound, are
#: measured pair by pair. It decides the work only: drawings within it are mostly of one hand.
GROUPED = 45_000
PLACEMENTS = [(y, x) for y in (0, -1, 1) for x in (0, -1, 1)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, s, q = 0, np.zeros(SPECTRUM_SIZE), np.zeros(SPECTRUM_SIZE)
    for batch in batches:
        x = matrix(batch.column(0), SPECTRUM_BYTES)[:, :SPECTRUM_SIZE].astype(np.float64)
        n, s, q = n + len(x), s + x.sum(axis=0), q + (x * x).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(range(SPECTRUM_SIZE), pa.int32()), pa.array([n] * SPECTRUM_SIZE, pa.int64()), pa.array(s), pa.array(q)], ["i", "n", "s", "q"])


def scale(images: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, and mean and deviation of every spectrum term over them: 84 partial sums a partition, 84 rows to the driver."""
    rows = images.select("sketch").mapInArrow(_sums, "i int, n long, s double, q double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("i").collect()
    n = rows[0]["n"] if rows else 0
    mean = np.array([r["s"] for r in rows] or [0.0] * SPECTRUM_SIZE) / max(1, n)
    return n, mean, np.sqrt(np.maximum(np.array([r["q"] for r in rows] or [0.0] * SPECTRUM_SIZE) / max(1, n) - mean * mean, 1e-6))


def moved(levels: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """Every image moved by (dy, dx), level 0 filling in."""
    src = levels.reshape(-1, SIDE, SIDE)
    out = np.zeros_like(src)
    out[:, max(dy, 0) : SIDE + min(dy, 0), max(dx, 0) : SIDE + min(dx, 0)] = src[:, max(-dy, 0) : SIDE + min(-dy, 0), max(-dx, 0) : SIDE + min(-dx, 0)]
    return out.reshape(len(levels), PIXELS)


def closest(x: np.ndarray, y: np.ndarray, reach: int) -> np.ndarray:
    """The least squared distance of every row of x to every row of y over the nine placements of either.

    Exact wherever it decides: float sums may round above 2**24, so values close to ``reach`` are done again in integers.
    """
    best = None
    for dy, dx in PLACEMENTS:
        d = squared(moved(x, dy, dx), y)
        if dy or dx:
            np.minimum(d, squared(x, moved(y, dy, dx)), out=d)
        best = d if best is None else np.minimum(best, d, out=best)
    for i, j in zip(*np.nonzero(np.abs(best - reach) <= 64)):
        one, two = x[i : i + 1].astype(np.int64), y[j : j + 1].astype(np.int64)
        best[i, j] = min(min(((moved(one, *p) - two) ** 2).sum(), ((one - moved(two, *p)) ** 2).sum()) for p in PLACEMENTS)
    return best


def _closest_pairs(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The same row by row, in integers."""
    best = None
    one, two = one.astype(np.int32), two.astype(np.int32)
    for p in PLACEMENTS:
        d = np.minimum(((moved(one, *p) - two) ** 2).sum(axis=1), ((one - moved(two, *p)) ** 2).sum(axis=1))
        best = d if best is None else np.minimum(best, d)
    return best


def _near_pairs(one: np.ndarray, two: np.ndarray, reach: int, upper: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of all near-same rows of two blocks; with ``upper`` the blocks are one and i < j.

    The amplitudes of all frequencies bound the distance from below, so only pairs within reach by them are measured;
    where these are many, whole blocks are.
    """
    x = amplitudes(one)
    wide = np.maximum(edges(one)[:, None], (edges(one) if upper else edges(two))[None])
    maybe = squared(x, x if upper else amplitudes(two)) <= np.square(np.sqrt(np.float32(reach)) + wide + 1)
    if upper:
        maybe = np.triu(maybe, 1)
    i, j = np.nonzero(maybe)
    if len(i) > 1000 and len(i) > maybe.size / 20:
        d = closest(one.astype(np.float32), two.astype(np.float32), reach)
        i, j = np.nonzero(np.triu(d <= reach, 1) if upper else d <= reach)
        return i, j, d[i, j]
    d = np.concatenate([np.zeros(0, np.int64), *(_closest_pairs(one[i[k : k + 1024]], two[j[k : k + 1024]]) for k in range(0, len(i), 1024))])
    return i[d <= reach], j[d <= reach], d[d <= reach]


def _verify(reach: int, cross: bool, extra):
    """For mapInArrow over bucketed levels: (a, b, distance, *extra) of near-same pairs.

    extra: None, or names of integer columns and a function of both pixel matrices that gives them. cross: a is of side
    0 and b of side 1; else a is the smaller id.
    """
    names, more = extra or ([], None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in groups(batches):
            ids, side, rows = table.column("row_id").to_numpy(), table.column("side").to_numpy(), matrix(table.column("levels"), PIXELS)
            out = []

            def add(a: np.ndarray, b: np.ndarray, d: np.ndarray, x: np.ndarray, y: np.ndarray, out: list = out) -> None:
                if len(a):
                    if not cross:
                        a, b = np.minimum(a, b), np.maximum(a, b)
                    out.append((a, b, d.astype(np.int64), *(np.asarray(c, np.int32) for c in (more(x, y) if more else ()))))

            pair = ends - starts == 2
            s = starts[pair]
            s = s[(ids[s] != ids[s + 1]) & ((side[s] != side[s + 1]) | (not cross and side[s] == 0))]
            for at in range(0, len(s), 1024):
                p = s[at : at + 1024]
                d = _closest_pairs(rows[p], rows[p + 1])
                p, d = p[d <= reach], d[d <= reach]
                one, two = (p + (side[p] == 1), p + (side[p] == 0)) if cross else (p, p + 1)
                add(ids[one], ids[two], d, rows[one], rows[two])
            for s, e in zip(starts[~pair].tolist(), ends[~pair].tolist()):
                at = s + np.unique(ids[s:e], return_index=True)[1]  # a repeated delivery of an image is the same image
                one, two = (at[side[at] == 0], at[side[at] == 1]) if cross or side[at].any() else (at, at)
                if len(one) and len(two):
                    i, j, d = _near_pairs(rows[one], rows[two], reach, two is at)
                    add(ids[one[i]], ids[two[j]], d, rows[one[i]], rows[two[j]])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["a", "b", "distance", *names])

    return run


def _verify_pairs(reach: int, cross: bool, extra):
    """The same for mapInArrow over (a, side_a, levels_a, b, side_b, levels_b)."""
    names, more = extra or ([], None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                a, b = batch.column(0).to_numpy(), batch.column(3).to_numpy()
                x, y = matrix(batch.column(2), PIXELS), matrix(batch.column(5), PIXELS)
                d = _closest_pairs(x, y)
                swap = batch.column(1).to_numpy() > batch.column(4).to_numpy() if cross else a > b
                kept = d <= reach
                if kept.any():
                    a, b = np.where(swap, b, a)[kept], np.where(swap, a, b)[kept]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a, b, d[kept].astype(np.int64), *(np.asarray(c, np.int32) for c in (more(x[kept], y[kept]) if more else ())))], ["a", "b", "distance", *names])

    return run


def near_same(table: DataFrame, placed: DataFrame, total: int, reach: int, block: int, cross: bool, extra=None) -> DataFrame:
    """(a, b, distance, *extra) of all near-same pairs among representatives that candidate keys bring together.

    ``placed``: (row_id, side, sketch, keys), ``total`` keys at most. Rows that share a key and whose amplitudes allow
    them to be near-same are candidates: similar ones are tied to groups, in which every pair is measured exactly in
    all placements, the others are measured pair by pair. The bound on amplitudes excludes no near-same pair, whatever
    it differs in. Levels travel once.
    """
    keyed = placed.select(F.explode("keys").alias("k"), "side", "row_id", "sketch")
    keys = placed.select(F.explode("keys").alias("k"), "side")
    scale_ = np.full(SPECTRUM_SIZE, SPECTRUM_STEP)
    bound = reach**0.5 + np.sqrt((scale_**2).sum())  # each of two rounded terms may be half a step off
    ties = keep(bucketed(keyed, keys, block, cross, total).mapInArrow(sketch_ties(min(bound, GROUPED**0.5), bound, scale_, cross, EDGE_STEP, SPECTRUM_BYTES - SPECTRUM_SIZE), TIES), "ties")
    drafts = components(ties.where("not loose").select("a", "b"))
    members = with_levels(drafts, table)
    sides = with_levels(drafts, table.withColumn("levels", F.lit(None))).select("k", "side")
    schema = ", ".join(["a long, b long, distance long", *(f"{n} int" for n in (extra[0] if extra else ()))])
    grouped = bucketed(members, sides, block, cross).mapInArrow(_verify(reach, cross, extra), schema)
    paired = paired_levels(ties.where("loose").select("a", "b").distinct(), table).mapInArrow(_verify_pairs(reach, cross, extra), schema)
    found = keep(grouped.unionAll(paired).dropDuplicates(["a", "b"]), "pairs")
    release(drafts, ties)
    return found


def with_copies(pairs: DataFrame, same: DataFrame, limit: int = 2000) -> DataFrame:
    """Pairs (a, b) of representatives as pairs (left, right) of all images with their content. same: see ``copies``.

    A representative of more than ``limit`` copies is cut into parts, and a pair meets each part of its ends under a key
    of its own, so no key brings more than ``limit`` images to a pair.
    """
    every = same.select("rep", "row_id").unionAll(same.select("rep", F.col("rep").alias("row_id")).distinct())
    parts = same.groupBy("rep").agg(F.ceil((F.count(F.lit(1)) + 1) / limit).cast("int").alias("parts"))
    every = every.join(parts, "rep").withColumn("part", F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int")).drop("parts")
    for end, new in (("a", "left"), ("b", "right")):
        met = pairs.join(parts.withColumnRenamed("rep", end), end, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        pairs = met.join(every.select(F.col("rep").alias(end), F.col("row_id").alias(new), "part"), [end, "part"], "left").withColumn(new, F.coalesce(new, end)).drop("part")
    return pairs
