"""Problem 4: the most similar vectors for every vector, by NN-descent and greedy graph search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import bucketed, groups, squared
from .images import BROADCAST_IDS, PIXELS, copies, deliveries, fit_sample, fixed_binary, matrix, no_sketch, representatives, sketched
from .storage import keep, release, settle

#: The projection and the trees are fitted on at most so many images, those with the smallest hashes of their ids.
FIT_ROWS = 20_000
#: Dimensions of the projected vectors, one byte each.
DIMS = 48
#: Trees that seed the graph, the images a leaf should hold, and levels of a tree at most.
TREES, LEAF, DEEPEST = 3, 900, 14
#: Neighbours kept in the graph, and those of them that an NN-descent round joins (forward, and as many backward).
KEPT, JOINED, ROUNDS = 12, 4, 1
#: Greedy search: rounds, nodes expanded in each, and candidates measured exactly.
SEARCH, EXPANDED, MEASURED = 3, 64, 300
#: Queries searched together; their projections and levels, 832 bytes each, are what is broadcast.
QUERY_BLOCK = 20_000
#: The whole table: images a cell should hold, cells an image is placed in, images that each cell's centre is fitted on.
CELL, PLACED, FIT_EACH = 700, 2, 8
#: Cells with a centre at most.
MOST_CELLS = 1 << 16
#: Centres are kept in groups of about so many, of which an image is compared with the nearest few.
CENTRES, PROBED = 256, 6


class Bins:
    """Finer parts of cells that the fitted sample is too small to tell apart: quantiles along a few fixed directions.

    Its size does not depend on the number of images; ``parts`` is how many parts a cell is cut into.
    """

    def __init__(self, projected: np.ndarray, parts: float, rng: np.random.Generator):
        self.directions, self.cuts, x = [], [], projected.astype(np.float32)
        while parts >= 2 and len(x) and len(self.cuts) < DIMS:
            n = min(64, 1 << int(np.log2(parts)))
            w = rng.standard_normal(DIMS).astype(np.float32)
            self.directions.append(w)
            self.cuts.append(np.quantile(x @ w, np.arange(1, n) / n).astype(np.float32))
            parts /= n

    def __call__(self, cells: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Cells (n x any, -1 for none) with the part of each row in them."""
        for w, cut in zip(self.directions, self.cuts):
            cells = np.where(cells < 0, cells, cells * (len(cut) + 1) + np.searchsorted(cut, x @ w)[:, None])
        return cells


class Index:
    """What is fitted on the sample: a projection to DIMS bytes, and trees that cut the projected space into leaves.

    Its size is bounded: trees are at most DEEPEST levels deep, and leaves that would be too large are cut by ``Bins``.
    """

    def __init__(self, sample: np.ndarray, total: int, seed: int = 3):
        x = sample.astype(np.float32)
        self.mean = x.mean(axis=0) if len(x) else np.zeros(PIXELS, np.float32)
        _, vectors = np.linalg.eigh(np.cov(x - self.mean, rowvar=False) if len(x) > 1 else np.eye(PIXELS))
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, :DIMS]).astype(np.float32)
        spread = np.abs((x - self.mean) @ self.basis).max(initial=1.0)
        self.step = np.float32(spread / 126)
        rng = np.random.default_rng(seed)
        self.depth = min(DEEPEST, max(0, int(np.ceil(np.log2(max(1, total / LEAF))))))
        p = self.project(sample).astype(np.float32)
        self.trees = [self._tree(p, rng) for _ in range(TREES)]
        self.bins = Bins(p, total / LEAF / 2**self.depth, rng)

    def _tree(self, p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Planes of a complete tree: each halves the sample in its node between two images drawn from it."""
        planes, cuts = np.zeros((2**self.depth, DIMS), np.float32), np.zeros(2**self.depth, np.float32)
        node = np.ones(len(p), np.int64)
        for n in range(1, 2**self.depth):
            own = np.flatnonzero(node == n)
            w = p[rng.choice(own)] - p[rng.choice(own)] if len(own) > 1 else rng.standard_normal(DIMS).astype(np.float32)
            if not w.any():
                w = rng.standard_normal(DIMS).astype(np.float32)
            at = p[own] @ w
            planes[n], cuts[n] = w, np.median(at) if len(own) else float(w.sum() * 128)
            node[own] = 2 * n + (at > cuts[n])
        return planes, cuts

    def project(self, levels: np.ndarray) -> np.ndarray:
        out = np.empty((len(levels), DIMS), np.uint8)
        for i in range(0, len(levels), 2048):
            out[i : i + 2048] = np.clip((levels[i : i + 2048].astype(np.float32) - self.mean) @ self.basis / self.step + 128.5, 0, 255)
        return out

    def leaves(self, projected: np.ndarray) -> np.ndarray:
        x = projected.astype(np.float32)
        out = np.empty((len(x), TREES), np.int64)
        for t, (planes, cuts) in enumerate(self.trees):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (np.einsum("ij,ij->i", x, planes[node]) > cuts[node])
            out[:, t] = node
        return self.bins(out, x) * TREES + np.arange(TREES)


def _project(index) -> object:
    """For mapInArrow over (row_id, levels): (row_id, vec, leaves)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = index.value.project(matrix(batch.column(1), PIXELS))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * TREES), pa.array(index.value.leaves(p).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), fixed_binary(p), lists], ["row_id", "vec", "leaves"])

    return run


def level_table(images: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(table, twins, rows): the levels of all deliveries, read and cleaned once; the ids (rep, row_id) of equal content."""
    table = keep(sketched(images.withColumn("side", F.lit(0).cast("tinyint")), no_sketch).drop("sketch"), "levels")
    return table, keep(copies(table).select("rep", "row_id"), "twins"), table.count()


def _lists(ids: np.ndarray, near: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
    k = near.shape[1]
    offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * k)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(near.ravel())), pa.ListArray.from_arrays(offsets, pa.array(dist.ravel().astype(np.int32)))], ["row_id", "near", "dist"])


def _leaf_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each image's KEPT nearest within its leaf (or the other block of its leaf), padded with itself at distance -1."""
    for table, starts, ends in groups(batches):
        ids, side, vec = table.column("row_id").to_numpy(), table.column("side").to_numpy(), matrix(table.column("vec"), DIMS)
        for s, e in zip(starts.tolist(), ends.tolist()):
            own = ids[s:e]
            x = vec[s:e].astype(np.float32)
            d = squared(x)
            d[own[:, None] == own[None]] = np.inf
            if side[s:e].any():
                d[side[s:e, None] == side[None, s:e]] = np.inf
            k = min(KEPT, e - s - 1)
            at = np.argpartition(d, k - 1, axis=1)[:, :k]
            dist = np.take_along_axis(d, at, 1)
            near = own[at]
            bad = ~np.isfinite(dist)
            near[bad], dist[bad] = np.broadcast_to(own[:, None], near.shape)[bad], -1
            yield _lists(own, near, dist)


def _best(lists: DataFrame) -> DataFrame:
    """(row_id, near, dist): lists of an image merged into its KEPT nearest, in order, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in groups_any(batches):
            ids = table.column("k").to_numpy()
            near, dist = table.column("near").combine_chunks(), table.column("dist").combine_chunks()
            lengths = np.diff(near.offsets.to_numpy())
            i, n, d = np.repeat(ids, lengths), near.flatten().to_numpy(), dist.flatten().to_numpy()
            ok = d >= 0
            i, n, d = i[ok], n[ok], d[ok]
            o = np.lexsort((n, d, i))
            i, n, d = i[o], n[o], d[o]
            same = np.r_[False, (i[1:] == i[:-1]) & (n[1:] == n[:-1]) & (d[1:] == d[:-1])]
            i, n, d = i[~same], n[~same], d[~same]
            if not len(i):
                continue
            head = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            rank = np.arange(len(i)) - np.repeat(head, np.diff(np.r_[head, len(i)]))
            kept = rank < KEPT
            i, n, d = i[kept], n[kept], d[kept]
            head = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            offsets = pa.array(np.r_[head, len(i)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(i[head]), pa.ListArray.from_arrays(offsets, pa.array(n)), pa.ListArray.from_arrays(offsets, pa.array(d))], ["row_id", "near", "dist"])

    sorted_ = lists.select(F.col("row_id").alias("k"), "near", "dist").repartition("k").sortWithinPartitions("k")
    return sorted_.mapInArrow(run, "row_id long, near array<long>, dist array<int>")


def groups_any(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, None, None]]:
    """Whole keys of a sorted partition, single rows included."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        keys = table.column("k").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        rest = table.slice(cut)
        if cut:
            yield table.slice(0, cut).combine_chunks(), None, None
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), None, None


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of a common node are compared with each other; pairs better than either's worst neighbour come out."""
    width = 2 * JOINED + 1
    for table, starts, ends in groups(batches):
        ids, worst, vec = table.column("row_id").to_numpy(), table.column("worst").to_numpy(), matrix(table.column("vec"), DIMS)
        for at in range(0, len(starts), 4096):
            s, n = starts[at : at + 4096], np.minimum(ends[at : at + 4096] - starts[at : at + 4096], width)
            slot = np.minimum(s[:, None] + np.arange(width), len(ids) - 1)
            real = np.arange(width)[None] < n[:, None]
            own = np.where(real, ids[slot], -1)
            x = vec[slot].astype(np.float32)
            x2 = (x * x).sum(axis=2)
            d = x2[:, :, None] + x2[:, None] - 2 * np.matmul(x, x.transpose(0, 2, 1))
            good = real[:, :, None] & real[:, None] & (own[:, :, None] != own[:, None]) & (d < np.where(real, worst[slot], -1)[:, :, None])
            g, i, j = np.nonzero(good)
            if len(g):  # a list for each node of each bucket
                head = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])])
                offsets = pa.array(np.r_[head, len(g)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(own[g, i][head]), pa.ListArray.from_arrays(offsets, pa.array(own[g, j])), pa.ListArray.from_arrays(offsets, pa.array(d[g, i, j].astype(np.int32)))], ["row_id", "near", "dist"])


LISTS = "row_id long, near array<long>, dist array<int>"


def _seeded(vectors: DataFrame) -> DataFrame:
    """The graph by brute force within leaves."""
    placed = vectors.select(F.explode("leaves").alias("k"), F.lit(0).cast("tinyint").alias("side"), "row_id", "vec")
    return keep(_best(bucketed(placed, placed.select("k"), 4 * LEAF).mapInArrow(_leaf_lists, LISTS)), "graph")


def _improved(graph: DataFrame, vectors: DataFrame) -> DataFrame:
    """The graph after a round of NN-descent."""
    first = graph.select("row_id", F.explode(F.slice("near", 1, JOINED)).alias("other"))
    back = first.select(F.col("other").alias("k"), F.col("row_id").alias("u"))
    # A hub's backward neighbours are thinned in two steps, so it is never sorted as one group.
    salted = back.withColumn("h", F.xxhash64("k", "u")).withColumn("salt", F.pmod("h", F.lit(16)))
    thin = salted.withColumn("r", F.row_number().over(Window.partitionBy("k", "salt").orderBy("h"))).where(F.col("r") <= JOINED)
    thin = thin.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("h"))).where(F.col("r") <= JOINED)
    meet = first.select(F.col("row_id").alias("k"), F.col("other").alias("u")).unionAll(thin.select("k", "u")).unionAll(graph.select(F.col("row_id").alias("k"), F.col("row_id").alias("u"))).distinct()
    worst = graph.select(F.col("row_id").alias("u"), F.when(F.size("dist") < KEPT, F.lit(2**31 - 1)).otherwise(F.element_at("dist", -1)).alias("worst"))
    carried = meet.join(worst.join(vectors.select(F.col("row_id").alias("u"), "vec"), "u"), "u").select("k", F.col("u").alias("row_id"), "worst", "vec")
    better = carried.repartition("k").sortWithinPartitions("k").mapInArrow(_local_join, LISTS)
    new = keep(_best(graph.unionAll(better)), "graph")
    release(graph)
    return new


def build_graph(images: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(table, vectors, graph, twins): vectors (row_id, vec), graph (row_id, near, dist) of KEPT neighbours in order.

    Both are over representatives: of images with equal content the one with the smallest id. twins (rep, row_id) are
    the others, table what ``level_table`` gives.

    Seeded by brute force within the leaves of random projection trees, then improved by NN-descent rounds: a node's
    nearest JOINED neighbours, and as many nodes of which it is one, are joined at the node and compared with each
    other. Distances are of the projected vectors. A node's backward neighbours are sampled, as the method does.
    """
    spark = images.sparkSession
    table, twins, total = level_table(images)
    index = spark.sparkContext.broadcast(Index(fit_sample(table, FIT_ROWS), total))
    vectors = keep(representatives(table, twins).select("row_id", "levels").mapInArrow(_project(index), "row_id long, vec binary, leaves array<long>").dropDuplicates(["row_id"]), "vectors")
    graph = _seeded(vectors)
    for _ in range(rounds):
        settle(graph)
        graph = _improved(graph, vectors)
    return table, vectors, graph, twins


def _centres(x: np.ndarray, count: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    out = x[rng.choice(len(x), min(count, len(x)), replace=False)]
    for _ in range(rounds):
        at = np.concatenate([((out * out).sum(1)[None] - 2 * x[i : i + 4096] @ out.T).argmin(1) for i in range(0, len(x), 4096)])
        n, total = np.bincount(at, minlength=len(out)), np.zeros_like(out)
        np.add.at(total, at, x)
        out = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], out)
    return out


class Cells:
    """Cells of about CELL images around centres in the projected space; an image is placed in its PLACED nearest.

    At most MOST_CELLS have a centre; with more images, cells are cut into parts by ``Bins``. Centres are fitted in groups around heads, so placing an image costs a look at all heads and at a few groups'
    centres, whatever the number of cells.
    """

    def __init__(self, projected: np.ndarray, total: int, seed: int = 5):
        x, rng = projected.astype(np.float32), np.random.default_rng(seed)
        count = min(MOST_CELLS, max(1, round(total / CELL)))
        self.bins = Bins(x, total / CELL / count, rng)
        self.heads = _centres(x, max(1, round(count / CENTRES)), rng)
        near = np.concatenate([((self.heads**2).sum(1)[None] - 2 * x[i : i + 4096] @ self.heads.T).argmin(1) for i in range(0, len(x), 4096)])
        self.heads = self.heads[np.unique(near)]
        self.groups = [_centres(x[near == g], max(1, round(count * (near == g).mean())), rng) for g in np.unique(near)]
        self.first = np.cumsum([0, *(len(g) for g in self.groups)])

    def place(self, projected: np.ndarray) -> np.ndarray:
        """n x PLACED cells, -1 where there are fewer."""
        x = projected.astype(np.float32)
        probed = min(PROBED, len(self.heads))
        probe = np.argsort((self.heads**2).sum(1)[None] - 2 * x @ self.heads.T, axis=1, kind="stable")[:, :probed]
        cost, cell = np.full((len(x), probed * PLACED), np.inf, np.float32), np.full((len(x), probed * PLACED), -1, np.int64)
        for g in np.unique(probe).tolist():
            rows, slot = np.nonzero(probe == g)
            d = (self.groups[g] ** 2).sum(1)[None] - 2 * x[rows] @ self.groups[g].T
            for n in range(min(PLACED, d.shape[1])):
                at = d.argmin(1)
                cost[rows, slot * PLACED + n], cell[rows, slot * PLACED + n] = d[np.arange(len(rows)), at], self.first[g] + at
                d[np.arange(len(rows)), at] = np.inf
        best = np.argsort(cost, axis=1, kind="stable")[:, :PLACED]
        return self.bins(np.take_along_axis(cell, best, 1), x)


def _place(cells) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                index, found = cells.value
                placed = found.place(index.project(matrix(b.column(1), PIXELS)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * placed.shape[1]), pa.array(placed.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists, b.column(1)], ["row_id", "cells", "levels"])

    return run


def _measured_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each image's KEPT nearest by level distance within its cell (or the other block of its cell), ties to smaller ids.

    Floats choose, with room for their rounding; what is chosen is measured again in integers.
    """
    for table, starts, ends in groups(batches):
        ids, side, levels = table.column("row_id").to_numpy(), table.column("side").to_numpy(), matrix(table.column("levels"), PIXELS)
        for s, e in zip(starts.tolist(), ends.tolist()):
            own, first = np.unique(ids[s:e], return_index=True)
            x, half = levels[s:e][first], side[s:e][first]
            y = x.astype(np.float32)
            norm = (y * y).sum(axis=1)
            parts = [np.flatnonzero(half == 0), np.flatnonzero(half == 1)]
            mixed = len(parts[1]) > 0
            for left, right in [(parts[0], parts[1]), (parts[1], parts[0])] if mixed else [(parts[0], parts[0])]:
                k = min(KEPT, len(right) - (not mixed))
                for i in range(0, len(left) if k > 0 else 0, 512):
                    at = left[i : i + 512]
                    d = y[at] @ y[right].T
                    d *= -2
                    d += norm[right][None]
                    d += norm[at][:, None]
                    if not mixed:
                        d[np.arange(len(at)), at] = np.inf
                    a, b = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k] + 64)
                    b = right[b]
                    exact = np.concatenate([((x[at[a[j : j + 4096]]].astype(np.int32) - x[b[j : j + 4096]]) ** 2).sum(axis=1) for j in range(0, len(a), 4096)])
                    o = np.lexsort((own[b], exact, a))
                    a, b, exact = a[o], b[o], exact[o]
                    head = np.searchsorted(a, np.arange(len(at)))
                    kept = np.arange(len(a)) - head[a] < k
                    yield _lists(own[at], own[b[kept]].reshape(-1, k), exact[kept].reshape(-1, k))


def _spread(found: DataFrame, twins: DataFrame, owners: DataFrame, k: int) -> DataFrame:
    """(query, neighbours): from lists of representatives the k nearest of all images, as (d, row_id) in order.

    found: (query, row_id, d) among representatives of equal content; twins: (rep, row_id) as ``copies`` gives them;
    owners: (query, rep), the images that are asked for. A group of copies stands for its k + 1 smallest ids, of which
    no list needs more; the group of the query itself is at distance 0.
    """
    members = twins.unionAll(twins.select("rep", F.col("rep").alias("row_id")).distinct())
    least = members.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("row_id"))).where(F.col("n") <= k + 1)
    least = keep(least.groupBy(F.col("rep").alias("row_id")).agg(F.collect_list("row_id").alias("ids")), "least")
    rows = found.select("query", "row_id", F.col("d").cast("long").alias("d")).unionAll(least.select(F.col("row_id").alias("query"), "row_id", F.lit(0).cast("long").alias("d")))
    rows = rows.join(least, "row_id", "left").select("query", F.explode(F.coalesce("ids", F.array("row_id"))).alias("row_id"), "d")
    lists = rows.groupBy(F.col("query").alias("rep")).agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "row_id"))), 1, k + 1).alias("near"))
    return owners.join(lists, "rep").select("query", F.slice(F.filter("near", lambda x: x["row_id"] != F.col("query")), 1, k).alias("neighbours"))


def all_nearest(images: DataFrame, k: int = 10) -> DataFrame:
    """(row_id, neighbour, distance, rank): the k most similar other images of every image, by exact level distance.

    ``images``: what ``deliveries`` gives; k is at most KEPT. Images of equal content are represented by the smallest
    id. Every representative is placed in the PLACED nearest of cells in the projected space, and every pair within a
    cell is measured exactly; equal distances go to the smaller id. A neighbour that shares no cell with the image is
    missed (recall in the README). Crowded cells are compared in blocks, so no pair of a cell is left out.
    """
    spark = images.sparkSession
    table, twins, total = level_table(images)
    levels = fit_sample(table, min(FIT_EACH * MOST_CELLS, max(FIT_ROWS, FIT_EACH * round(total / CELL))))
    if not len(levels):
        release(table, twins)
        return spark.createDataFrame([], "row_id long, neighbour long, distance long, rank int")
    index = Index(levels[:FIT_ROWS], 1)
    cells = spark.sparkContext.broadcast((index, Cells(index.project(levels), total)))
    rest = representatives(table, twins).select("row_id", "levels")
    side = F.lit(0).cast("tinyint").alias("side")
    placed = rest.mapInArrow(_place(cells), "row_id long, cells array<long>, levels binary")
    keyed = placed.select(F.explode("cells").alias("k"), side, "row_id", "levels").where("k >= 0")
    keys = placed.select(F.explode("cells").alias("k"))
    lists = bucketed(keyed, keys, 4 * LEAF, total=total * PLACED).mapInArrow(_measured_lists, "row_id long, near array<long>, dist array<int>")
    graph = keep(_best(lists), "graph")
    found = graph.select(F.col("row_id").alias("query"), F.explode(F.arrays_zip("near", "dist")).alias("m")).select("query", F.col("m.near").alias("row_id"), F.col("m.dist").alias("d"))
    own = table.select(F.col("row_id").alias("query")).distinct().join(twins.select(F.col("row_id").alias("query"), "rep"), "query", "left").select("query", F.coalesce("rep", "query").alias("rep"))
    out = _spread(found, twins, own, k).select(F.col("query").alias("row_id"), F.posexplode("neighbours").alias("rank", "m"))
    out = keep(out.select("row_id", F.col("m.row_id").alias("neighbour"), F.col("m.d").alias("distance"), (F.col("rank") + 1).alias("rank")), "nearest")
    release(table, twins, graph)
    return out


def _distances(queries) -> object:
    """Projected distances of candidate vectors to their queries: (query, row_id, d)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, vecs = queries.value
        for b in batches:
            if b.num_rows:
                q = np.searchsorted(keys, b.column(0).to_numpy())
                x = matrix(b.column(2), DIMS).astype(np.int32) - vecs[q]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.einsum("ij,ij->i", x, x).astype(np.int32))], ["query", "row_id", "d"])

    return run


def _exact(queries) -> object:
    """Level distances of candidates to their queries: (query, row_id, d)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, levels = queries.value
        for b in batches:
            if b.num_rows:
                lists = b.column(2)
                n = np.diff(lists.offsets.to_numpy())
                query, rows = lists.flatten().to_numpy(), matrix(b.column(1), PIXELS)
                at, q = np.repeat(np.arange(b.num_rows), n), np.searchsorted(keys, query)
                d = np.concatenate([((rows[at[i : i + 4096]].astype(np.int32) - levels[q[i : i + 4096]]) ** 2).sum(axis=1) for i in range(0, len(at), 4096)])
                yield pa.RecordBatch.from_arrays([pa.array(query), b.column(0).take(pa.array(at)), pa.array(d.astype(np.int64))], ["query", "row_id", "d"])

    return run


def _top(rows: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "row_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def nearest(images: DataFrame, wanted: DataFrame, k: int = 10) -> DataFrame:
    """(query, neighbour, distance, rank): the k most similar other images of each image in ``wanted`` (query = row_id).

    ``images``: what ``deliveries`` gives. The graph is built over all images; a query starts at its own node and its
    neighbours, and each round expands its best unexpanded candidates by their neighbours; its best MEASURED
    candidates by projected distance are then measured exactly. Equal distances go to the smaller id.

    Queries are searched in blocks, whose vectors are all that is broadcast. A small share of neighbours is missed
    (measured in the README). Images of equal content are one node of the graph; what is found is expanded to their
    smallest ids after the exact measurement. Queries that are no valid image give nothing; an image has fewer than k neighbours only
    if there are fewer images; repeated deliveries and repeated queries count once.
    """
    table, vectors, graph, twins = build_graph(images)
    rep = twins.select(F.col("row_id").alias("query"), "rep")
    owners = keep(wanted.select(F.col("query").cast("long").alias("query")).where("query is not null").distinct().join(rep, "query", "left").select("query", F.coalesce("rep", "query").alias("rep")), "owners")
    asked = keep(owners.select(F.col("rep").alias("query")).distinct().join(vectors, F.col("query") == F.col("row_id")).select("query", "vec"), "asked")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = []
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block) if blocks > 1 else asked
        found.append(_search(table, vectors, graph, part, k))
    every = reduce(DataFrame.unionAll, found).select("query", F.col("neighbour").alias("row_id"), F.col("distance").alias("d"))
    out = _spread(every, twins, owners, k).select("query", F.posexplode("neighbours").alias("rank", "m"))
    out = keep(out.select("query", F.col("m.row_id").alias("neighbour"), F.col("m.d").alias("distance"), (F.col("rank") + 1).alias("rank")), "nearest")
    release(table, vectors, graph, asked, owners, twins, *found)
    return out


def _arrow_map(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    keys = table.column(0).to_numpy()
    order = np.argsort(keys)
    return keys[order], matrix(table.column(1), width)[order]


def _search(table: DataFrame, vectors: DataFrame, graph: DataFrame, part: DataFrame, k: int) -> DataFrame:
    sc = table.sparkSession.sparkContext
    queries = sc.broadcast(_arrow_map(part.toArrow(), DIMS))
    seen = keep(part.join(graph, F.col("query") == F.col("row_id")).select("query", F.explode(F.arrays_zip("near", "dist")).alias("m")).select("query", F.col("m.near").alias("row_id"), F.col("m.dist").alias("d"), F.lit(0).alias("open")), "seen")
    for r in range(SEARCH):
        front = seen if r == 0 else _top(seen.where("open = 0"), EXPANDED)
        edges = front.select("query", "row_id").join(graph.select("row_id", "near"), "row_id").select("query", F.explode("near").alias("row_id")).distinct().where("query <> row_id")
        fresh = edges.join(seen.select("query", "row_id"), ["query", "row_id"], "left_anti")
        added = fresh.join(vectors.select("row_id", "vec"), "row_id").select("query", "row_id", "vec").mapInArrow(_distances(queries), "query long, row_id long, d int").withColumn("open", F.lit(0))
        old = seen.select("query", "row_id", "d", F.lit(1).alias("open")) if r == 0 else seen.select("query", "row_id", "d", "open").join(front.select("query", "row_id", F.lit(1).alias("now")), ["query", "row_id"], "left").select("query", "row_id", "d", F.greatest("open", F.coalesce("now", F.lit(0))).alias("open"))
        new = keep(_top(old.unionAll(added), 2 * MEASURED).drop("rank"), "seen")
        release(seen)
        seen = new
    best = keep(_top(seen, MEASURED).groupBy("row_id").agg(F.collect_list("query").alias("queries")), "candidates")
    # At most MEASURED candidates of each of QUERY_BLOCK queries, so the lists may go to where the levels are.
    own = table.select("row_id", "levels").join(F.broadcast(part.select(F.col("query").alias("row_id"))), "row_id", "left_semi").dropDuplicates(["row_id"])
    levels = sc.broadcast(_arrow_map(own.toArrow(), PIXELS))
    measured = table.select("row_id", "levels").join(F.broadcast(best), "row_id").mapInArrow(_exact(levels), "query long, row_id long, d long").dropDuplicates(["query", "row_id"])
    out = keep(_top(measured, k).select("query", F.col("row_id").alias("neighbour"), F.col("d").alias("distance"), "rank"), "nearest")
    release(best, seen)
    return out


def both_splits(train: DataFrame, test: DataFrame, id_col: str = "row_id", features_col: str = "features") -> DataFrame:
    return deliveries(train, id_col, features_col).unionAll(deliveries(test, id_col, features_col)).select("row_id", "features")
