"""Decision trees and forests (Gini, exhaustive midpoints).

A table of bounded size is grown exactly in one task; a larger one level by level, each level being one aggregate of
(tree, node, feature, value, class) counts and windows over the distinct values. Trees are lists of nodes in preorder
(exact) or level order: (feature, threshold, left, right, label), feature -1 for leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng, vec
from .learners import ONE_TASK_BYTES, Model, _need
from .matrices import stack
from .preprocessing import check_features

TIE = 1e-7
Node = tuple[int, float, int, int, int]


def _majority(labels: np.ndarray) -> int:
    values, counts = np.unique(labels, return_counts=True)
    return int(values[counts.argmax()])


def _candidates(x: np.ndarray, onehot: np.ndarray, parent: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Midpoints of one feature in ascending order, with their gains."""
    order = np.argsort(x, kind="stable")
    v, left = x[order], np.cumsum(onehot[order], axis=0)
    n, at = len(v), np.flatnonzero(v[1:] > v[:-1])
    at = at[(at + 1 >= least) & (n - at - 1 >= least)]
    low, high = left[at], left[-1] - left[at]
    nl, nr = at + 1, n - at - 1
    impurity = (nl * (1 - ((low / nl[:, None]) ** 2).sum(1)) + nr * (1 - ((high / nr[:, None]) ** 2).sum(1))) / n
    return v[at] + (v[at + 1] - v[at]) * 0.5, parent - impurity


def grow(x: np.ndarray, y: np.ndarray, max_depth: int, min_split: int, min_leaf: int, max_features: int = 0, seed: int = 0) -> list[Node]:
    """An exact tree. The first candidate is taken even without gain; a later one must be better by more than 1e-7,
    or as good within 1e-7 with a smaller feature, or the same feature and a smaller threshold."""
    nodes: list[Node] = []
    classes = np.unique(y)
    onehot = (y[:, None] == classes[None]).astype(np.float64)

    def build(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append((-1, 0.0, -1, -1, _majority(y[rows])))
        counts = onehot[rows].sum(axis=0)
        if depth >= max_depth or len(rows) < min_split or (counts > 0).sum() <= 1:
            return me
        features = np.arange(x.shape[1])
        if 0 < max_features < len(features):
            features = np.random.default_rng([seed, me]).permutation(features)[:max_features]
        parent, best = 1 - ((counts / len(rows)) ** 2).sum(), None
        for f in features.tolist():
            for t, gain in zip(*(a.tolist() for a in _candidates(x[rows, f], onehot[rows], parent, min_leaf))):
                if best is None or gain > best[0] + TIE or (abs(gain - best[0]) <= TIE and (f, t) < best[1:]):
                    best = (gain, f, t)
        if best is None or best[0] < -TIE:
            return me
        below = x[rows, best[1]] <= best[2]
        left, right = rows[below], rows[~below]
        if len(left) < min_leaf or len(right) < min_leaf:
            return me
        a = build(left, depth + 1)
        b = build(right, depth + 1)
        nodes[me] = (best[1], best[2], a, b, nodes[me][4])
        return me

    build(np.arange(len(y)), 0)
    return nodes


def best_splits(df: DataFrame, by: list[str], min_leaf: int = 1, features_col: str = "features", label_col: str = "label", weight: Column | None = None, subset: str | None = None) -> DataFrame:
    """by + (feature, threshold, gain): the best split of every group, with gains rounded to 7 places before ties go to
    the smaller feature and threshold.

    Rows are counted per distinct value before they travel. A group's features are windows of their own, so what one
    task sorts is the distinct values of one feature, not the rows. subset: a column with the features to look at.
    """
    w = F.lit(1).cast("double") if weight is None else weight.cast("double")
    each = df.select(*by, *([subset] if subset else []), F.col(label_col).alias("y"), w.alias("w"), F.posexplode(vec.double(features_col)).alias("feature", "x"))
    cells = (each.where(F.array_contains(subset, F.col("feature"))) if subset else each).groupBy(*by, "feature", "x", "y").agg(F.sum("w").alias("c"))
    key = [*by, "feature"]
    up_to = Window.partitionBy(*key, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    classes = df.select(*by, F.col(label_col).alias("y")).groupBy(*by).agg(F.collect_set("y").alias("ys"))
    values = cells.groupBy(*key, "x").agg(F.map_from_entries(F.collect_list(F.struct("y", "c"))).alias("m"))
    dense = values.join(classes, by) if by else values.join(F.broadcast(classes))
    dense = dense.select(*key, "x", F.explode("ys").alias("y"), "m").select(*key, "x", "y", F.coalesce(F.col("m")[F.col("y")], F.lit(0.0)).alias("c"))
    run = dense.withColumn("l", F.sum("c").over(up_to)).withColumn("t", F.sum("c").over(Window.partitionBy(*key, "y")))
    sides = run.groupBy(*key, "x").agg(F.sum("l").alias("nl"), F.sum(F.col("t") - F.col("l")).alias("nr"), F.sum(F.col("l") * F.col("l")).alias("ql"), F.sum((F.col("t") - F.col("l")) * (F.col("t") - F.col("l"))).alias("qr"), F.sum(F.col("t") * F.col("t")).alias("q"), F.sum("t").alias("n"))
    nxt = F.lead("x").over(Window.partitionBy(*key).orderBy("x"))
    cut = sides.withColumn("next", nxt).where(F.col("next").isNotNull() & (F.col("nl") >= min_leaf) & (F.col("nr") >= min_leaf))
    gain = (1 - F.col("q") / (F.col("n") * F.col("n"))) - (F.col("nl") - F.col("ql") / F.col("nl") + F.col("nr") - F.col("qr") / F.col("nr")) / F.col("n")
    cut = cut.select(*by, "feature", (F.col("x") + (F.col("next") - F.col("x")) * 0.5).alias("threshold"), F.round(gain, 7).alias("gain"))
    best = cut.groupBy(*by).agg(F.min(F.struct((-F.col("gain")).alias("g"), "feature", "threshold")).alias("m"))
    return best.select(*by, F.col("m.feature").alias("feature"), F.col("m.threshold").alias("threshold"), (-F.col("m.g")).alias("gain"))


def grow_by_level(df: DataFrame, trees: int, max_depth: int, min_split: int, min_leaf: int, width: int = 0, max_features: int = 0, seed: int = 0) -> list[list[Node]]:
    """Trees of df(tree_id, weight, features, label), all at once, one level a round; the driver holds only nodes.

    If max_features is between 0 and width, every node draws so many features of its own, as ``grow`` does.
    """
    out: list[list[list]] = [[] for _ in range(trees)]
    data = df.select("tree_id", "weight", vec.double("features").alias("features"), F.col("label").cast("int").alias("label"), F.lit(0).alias("node")).persist()
    open_ = {(t, 0) for t in range(trees)}
    for t in range(trees):
        out[t].append([-1, 0.0, -1, -1, 0])
    for depth in range(max_depth + 1):
        counts = data.where("node >= 0").groupBy("tree_id", "node", "label").agg(F.sum("weight").alias("w"))
        per = counts.groupBy("tree_id", "node").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("classes"), F.min(F.struct((-F.col("w")).alias("v"), "label")).alias("m"))
        stats = {(r["tree_id"], r["node"]): r for r in per.collect()}
        for (t, node), r in stats.items():
            out[t][node][4] = r["m"]["label"]
        grow_ = [k for k, r in stats.items() if k in open_ and depth < max_depth and r["n"] >= min_split and r["classes"] > 1]
        if not grow_:
            break
        few = 0 < max_features < width
        own = lambda t, n: np.random.default_rng([seed + t, n]).permutation(width)[:max_features].tolist() if few else None
        going = df.sparkSession.createDataFrame([(t, n, own(t, n)) for t, n in grow_], "tree_id int, node int, subset array<int>")
        splits = best_splits(data.join(F.broadcast(going), ["tree_id", "node"]), ["tree_id", "node"], min_leaf, weight=F.col("weight"), subset="subset" if few else None).where(F.col("gain") >= -TIE).collect()
        open_, rows = set(), []
        for r in splits:
            t, node = r["tree_id"], r["node"]
            a = len(out[t])
            out[t] += [[-1, 0.0, -1, -1, 0], [-1, 0.0, -1, -1, 0]]
            out[t][node][:4] = [r["feature"], r["threshold"], a, a + 1]
            open_ |= {(t, a), (t, a + 1)}
            rows.append((t, node, r["feature"], float(r["threshold"]), a))
        if not rows:
            break
        step = F.broadcast(df.sparkSession.createDataFrame(rows, "tree_id int, node int, f int, cut double, a int"))
        new = data.join(step, ["tree_id", "node"], "left").withColumn("node", F.when(F.col("a").isNull(), -1).when(F.get("features", F.col("f")) <= F.col("cut"), F.col("a")).otherwise(F.col("a") + 1)).drop("f", "cut", "a").persist()
        new.count()
        data.unpersist()
        data = new
    data.unpersist()
    return [[tuple(n) for n in t] for t in out]


def descend(nodes: list[Node], x: np.ndarray) -> np.ndarray:
    table = np.array([n[:4] for n in nodes], dtype=np.float64)
    feature, cut, left, right = table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int)
    label, at = np.array([n[4] for n in nodes]), np.zeros(len(x), int)
    while True:
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            return label[at]
        below = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
        at = np.where(inner, np.where(below, left[at], right[at]), at)


class DecisionTreeClassifier(Model):
    fitted = ("nodes",)

    def __init__(self, max_depth: int = 16, min_samples_split: int = 2, min_samples_leaf: int = 1, max_features: int = 0, seed: int = 0):
        _need(max_depth >= 1 and min_samples_split >= 2 and min_samples_leaf >= 1 and max_features >= 0, "depth and leaf size are at least 1, split size at least 2")
        self.max_depth, self.min_split, self.min_leaf, self.max_features, self.seed = max_depth, min_samples_split, min_samples_leaf, max_features, seed
        self.nodes: list[Node] | None = None
        self.feature_count = 0

    @property
    def node_count(self) -> int:
        self._ready()
        return len(self.nodes)

    def fit(self, df: DataFrame, features_col: str = "features", label_col: str = "label", one_task_bytes: int = ONE_TASK_BYTES) -> DecisionTreeClassifier:
        rows, self.feature_count = check_features(df, features_col)
        _need(self.max_features <= self.feature_count, "more features to draw than there are")
        data = df.select(vec.double(features_col).alias("features"), F.col(label_col).cast("int").alias("label"))
        if rows * self.feature_count * 8 <= one_task_bytes:
            args = self.max_depth, self.min_split, self.min_leaf, self.max_features, self.seed

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                parts = [b for b in batches if b.num_rows]
                if parts:
                    nodes = grow(np.vstack([stack(b) for b in parts]), np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in parts]), *args)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*nodes)], ["f", "t", "l", "r", "y"])

            got = data.coalesce(1).mapInArrow(run, "f long, t double, l long, r long, y long").collect()
            self.nodes = [tuple(r) for r in got]
        else:
            one = data.withColumns({"tree_id": F.lit(0), "weight": F.lit(1)})
            self.nodes = grow_by_level(one, 1, self.max_depth, self.min_split, self.min_leaf, self.feature_count, self.max_features, self.seed)[0]
        return self

    def predict(self, df: DataFrame, features_col: str = "features", out: str = "predicted") -> DataFrame:
        self._ready()
        return df.withColumn(out, _tree_column(self.nodes, vec.double(features_col))) if len(self.nodes) <= 200 else _predict_udf(df, [self.nodes], features_col, out)


def _tree_column(nodes: list[Node], x: Column, at: int = 0) -> Column:
    f, t, left, right, label = nodes[at]
    return F.lit(int(label)) if f < 0 else F.when(F.get(x, F.lit(int(f))) <= t, _tree_column(nodes, x, left)).otherwise(_tree_column(nodes, x, right))


def _predict_udf(df: DataFrame, trees: list[list[Node]], features_col: str, out: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("int")
    def vote(features: pd.Series) -> pd.Series:
        if not len(features):
            return pd.Series([], dtype="int32")
        x = np.vstack(features.to_numpy())
        labels = np.stack([descend(t, x) for t in shared.value])
        classes = np.unique(labels)
        return pd.Series(classes[(labels[None] == classes[:, None, None]).sum(axis=1).argmax(axis=0)].astype("int32"))

    return df.withColumn(out, vote(vec.double(features_col)))


class RandomForestClassifier(Model):
    """Trees over bootstrap samples; the parallel axis is the tree. Votes; ties go to the smallest label.

    A table of bounded size is broadcast and every tree grows in its own task with its own feature subsets. A larger
    one is never gathered: rows carry Poisson bootstrap counts (in place of n draws, which no row can make on its own)
    and all trees grow level by level together, every node with a feature subset of its own too.
    """

    fitted = ("trees",)

    def __init__(self, trees: int = 100, max_depth: int = 16, min_samples_split: int = 2, min_samples_leaf: int = 1, max_features: int = 0, seed: int = 5489):
        _need(trees >= 1 and max_depth >= 1 and min_samples_split >= 2 and min_samples_leaf >= 1 and max_features >= 0, "trees, depth and leaf size are at least 1, split size at least 2")
        self.count, self.max_depth, self.min_split, self.min_leaf, self.max_features, self.seed = trees, max_depth, min_samples_split, min_samples_leaf, max_features, seed
        self.trees: list[list[Node]] | None = None

    @property
    def tree_count(self) -> int:
        self._ready()
        return len(self.trees)

    def fit(self, df: DataFrame, id_col: str = "row_id", features_col: str = "features", label_col: str = "label", one_task_bytes: int = ONE_TASK_BYTES // 4) -> RandomForestClassifier:
        rows, width = check_features(df, features_col)
        _need(self.max_features <= width, "more features to draw than there are")
        data = df.select(F.col(id_col).alias("row_id"), vec.double(features_col).alias("features"), F.col(label_col).cast("int").alias("label"))
        spark = df.sparkSession
        if rows * width * 8 > one_task_bytes:
            self.trees = grow_by_level(rng.bootstrap_weights(data, self.count, self.seed), self.count, self.max_depth, self.min_split, self.min_leaf, width, self.max_features or max(1, int(width**0.5)), self.seed)
            return self
        table = data.orderBy("row_id").toArrow().combine_chunks().to_batches()[0]
        shared = spark.sparkContext.broadcast((stack(table), table.column(2).to_numpy(zero_copy_only=False)))
        m = self.max_features or max(1, int(width**0.5))
        args, seed = (self.max_depth, self.min_split, self.min_leaf, m), self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, y = shared.value
            for b in batches:
                for t in b.column(0).to_pylist():
                    own = np.random.default_rng([seed, t]).integers(0, len(y), len(y))
                    nodes = grow(x[own], y[own], *args, seed + t)
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(nodes)), pa.array(range(len(nodes))), *(pa.array(c) for c in zip(*nodes))], ["tree", "i", "f", "t", "l", "r", "y"])

        got = spark.range(0, self.count, 1, min(self.count, 2 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "tree long, i long, f long, t double, l long, r long, y long").orderBy("tree", "i").collect()
        self.trees = [[] for _ in range(self.count)]
        for r in got:
            self.trees[r["tree"]].append(tuple(r)[2:])
        return self

    def predict(self, df: DataFrame, features_col: str = "features", out: str = "predicted") -> DataFrame:
        self._ready()
        return _predict_udf(df, self.trees, features_col, out)
