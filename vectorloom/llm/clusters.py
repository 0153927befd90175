"""Problem 1: clusters of mutually similar images by grid density clustering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import TIES, bucketed, groups, local_labels, paired_levels, sketch_ties, squared, with_levels
from .components import components
from .images import COSINE_SIZE, COSINE_STEP, PIXELS, copies, cosine_sketch, deliveries, fit_sample, fixed_binary, matrix, no_sketch, representatives, sketched
from .storage import keep, release

#: Each grid quantises its own subset of the cosine coefficients of an image.
GRIDS, DIMENSIONS, WIDTH, SEED = 7, 14, 220.0, 7
#: Coefficients that travel with a cell. They are principal ones, fitted on at most so many images, those with the
#: smallest hashes of their ids; any orthonormal basis bounds distances from below, so the fit decides the work only.
SENT, FIT_ROWS = 128, 20_000
#: Squared distance over them up to which cell mates are grouped; those beyond, up to the bound, are measured pair by pair.
GROUPED = 240_000


@lru_cache(maxsize=4)
def _plan(grids: int, dimensions: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    pick = np.stack([rng.permutation(COSINE_SIZE)[:dimensions] for _ in range(grids)])
    return pick, rng.random((grids, dimensions)).astype(np.float32), rng.integers(1, 2**62, (grids, dimensions + 1)) | 1


def cells(sketch: np.ndarray, grids: int = GRIDS, dimensions: int = DIMENSIONS, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """The cell of every image in every grid (n x grids, int64; the grid's number is part of the cell)."""
    pick, shift, mix = _plan(grids, dimensions, seed)
    at = sketch.astype(np.float32) * (COSINE_STEP / width)
    out = np.empty((len(sketch), grids), np.int64)
    with np.errstate(over="ignore"):
        for g in range(grids):
            h = (np.floor(at[:, pick[g]] + shift[g]).astype(np.int64) * mix[g, :-1]).sum(axis=1) + g * mix[g, -1]
            out[:, g] = (h ^ (h >> 29)) * np.int64(-7046029254386353131)
    return out


def long_lists(rows: np.ndarray) -> pa.Array:
    """An int64 matrix as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


class Principal:
    """Coefficients in an orthonormal basis as bytes, with a step of each its own; far ones are cut off at the ends."""

    def __init__(self, sample: np.ndarray):
        x = sample.astype(np.float32)
        self.mean = x.mean(axis=0) if len(x) else np.zeros(PIXELS, np.float32)
        values, vectors = np.linalg.eigh(np.cov(x - self.mean, rowvar=False) if len(x) > 1 else np.eye(PIXELS))
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, :SENT]).astype(np.float32)
        self.step = np.maximum(2.0, np.sqrt(np.maximum(values[::-1][:SENT], 0)) * 3 / 127).astype(np.float32)

    def sketch(self, levels: np.ndarray) -> np.ndarray:
        """Bytes whose distances, times the steps, bound those of the images from below, up to rounding by a step each."""
        return np.clip((levels.astype(np.float32) - self.mean) @ self.basis / self.step + 128.5, 0, 255).astype(np.uint8)


def _place(principal=None):
    """For mapInArrow over (row_id, levels): the cells of every image and, with ``principal``, its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                levels = matrix(batch.column(1), PIXELS)
                found = [batch.column(0), long_lists(cells(cosine_sketch(levels)))]
                if principal is not None:
                    found.append(fixed_binary(principal.value.sketch(levels)))
                yield pa.RecordBatch.from_arrays(found, ["row_id", "cells", "sketch"][: len(found)])

    return run


def linked(x: np.ndarray, reach: int) -> np.ndarray:
    """Which rows of x are at most ``reach`` apart. Float sums may round, so close calls are done again in integers."""
    d = squared(x)
    out = d <= reach
    for i, j in zip(*np.nonzero(np.abs(d - reach) <= 64)):
        out[i, j] = ((x[i].astype(np.int64) - x[j].astype(np.int64)) ** 2).sum() <= reach
    return out


def _links(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in groups(batches):
            ids, side, rows = table.column("row_id").to_numpy(), table.column("side").to_numpy(), matrix(table.column("levels"), PIXELS)
            a, b = [], []
            for s, e in zip(starts.tolist(), ends.tolist()):
                near = linked(rows[s:e].astype(np.float32), reach)
                np.fill_diagonal(near, True)
                label = local_labels(near, ids[s:e])
                moved = label != ids[s:e]
                a.append(ids[s:e][moved])
                b.append(label[moved])
            if a and (a := np.concatenate(a)).size:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _linked_pairs(reach: int):
    """For mapInArrow over ``paired_levels``: the pairs that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = np.square(matrix(batch.column(2), PIXELS).astype(np.int32) - matrix(batch.column(5), PIXELS)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], ["a", "b"]).filter(pa.array(d <= reach))

    return run


def image_clusters(df: DataFrame, id_col: str = "row_id", features_col: str = "features", reach: int = 450_000, least: int = 3, block: int = 2048) -> DataFrame:
    """(row_id, cluster_id): every member of a cluster of at least ``least`` images; the cluster's id is its smallest.

    Two images are linked when their squared level distance is at most ``reach``; a cluster is whatever links join.

    1. Features are quantised: seven grids, each over fourteen of the lowest cosine coefficients. Images with the same
       content are placed once.
    2. Cells are counted. A cell is dense from two images on, the fewest that can be linked; crowded ones are cut into
       blocks.
    3. Dense cells are adjacent where grids overlap, that is where they share an image. Cell mates are compared by
       their principal coefficients, which bound their distance from below: similar ones are tied to the smallest id
       among them, and minimum labels spread over the ties of all cells until none changes. Mates that are not tied but
       may be linked by the bound stay pairs.
    4. Every pair within a label, and every such pair of mates, is measured exactly, and minimum labels spread over the
       links.

    So no two images are ever joined wrongly, and no link within a cell is lost, whatever its images differ in; an
    image is missed only if no grid puts it into one cell with any of its links (measured in the README). Null ids,
    null, short or non-finite vectors take no part; repeated deliveries of an id count once; equal images are members
    each; an empty table gives an empty result.
    """
    table = keep(sketched(deliveries(df, id_col, features_col), no_sketch).drop("sketch"), "levels")
    same = keep(copies(table), "copies")
    reps = representatives(table, same).select("row_id", "levels")
    fitted = Principal(fit_sample(table, FIT_ROWS))
    principal = df.sparkSession.sparkContext.broadcast(fitted)
    side = F.lit(0).cast("tinyint").alias("side")
    keyed = reps.mapInArrow(_place(principal), "row_id long, cells array<long>, sketch binary").select(F.explode("cells").alias("k"), side, "row_id", "sketch")
    keys = reps.mapInArrow(_place(), "row_id long, cells array<long>").select(F.explode("cells").alias("k"))
    bound = reach**0.5 + np.sqrt((fitted.step.astype(np.float64) ** 2).sum())  # each of two rounded coefficients may be half a step off
    ties = keep(bucketed(keyed, keys, block, total=table.count() * GRIDS).mapInArrow(sketch_ties(min(bound, GROUPED**0.5), bound, fitted.step), TIES), "ties")
    drafts = components(ties.where("not loose").select("a", "b"))
    members = with_levels(drafts, table)
    grouped = bucketed(members, drafts.select(F.col("label").alias("k")), block).mapInArrow(_links(reach), "a long, b long")
    paired = paired_levels(ties.where("loose").select("a", "b").distinct(), table).mapInArrow(_linked_pairs(reach), "a long, b long")
    links = keep(grouped.unionAll(paired), "links")
    release(drafts, ties)
    # Every image is tied to the representative of its content, so copies alone can make a cluster too.
    labels = components(links.unionAll(same.select(F.col("row_id").alias("a"), F.col("rep").alias("b"))))
    release(links, table, same)
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return labels.join(sizes, "label").select(F.col("node").alias("row_id"), F.col("label").alias("cluster_id"))


def cluster_report(df: DataFrame, clusters: DataFrame, id_col: str = "row_id", features_col: str = "features", typical: int = 3) -> DataFrame:
    """(cluster_id, size, rank, row_id, shared): each cluster's size and its most typical members, best first.

    A member is typical if it stands in cells that many of its cluster share: ``shared`` is the number of members in
    the densest of its cells. Ties go to the smaller id.
    """
    placed = sketched(deliveries(df, id_col, features_col), no_sketch).select("row_id", "levels").mapInArrow(_place(), "row_id long, cells array<long>")
    members = keep(clusters.select("row_id", "cluster_id").join(placed, "row_id").groupBy("row_id", "cluster_id").agg(F.first("cells").alias("cells")), "members")
    each = members.select("row_id", "cluster_id", F.explode("cells").alias("k"))
    counts = each.groupBy("cluster_id", "k").agg(F.count(F.lit(1)).alias("n"))
    best = each.join(counts, ["cluster_id", "k"]).groupBy("cluster_id", "row_id").agg(F.max("n").alias("shared"))
    # The first of each of 64 parts of a cluster, then the first of these: a huge cluster is never gathered.
    order = [F.col("shared").desc(), F.col("row_id")]
    first = best.withColumn("part", F.pmod(F.xxhash64("row_id"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id", "part").orderBy(*order))).where(F.col("rank") <= typical)
    top = first.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order))).where(F.col("rank") <= typical)
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    out = keep(top.join(sizes, "cluster_id").select("cluster_id", "size", "rank", "row_id", "shared"), "typical")
    release(members)
    return out
