"""Classical learners: fit is a bounded number of aggregates over the table, predict is a projection.

Parameter errors raise ValueError when a learner is made, use before fit raises NotFittedError. Float sums are double.
Fitted state is plain attributes; ``as_dataframe`` gives it as (param, idx, value).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vec
from .matrices import covariance, gram, stack
from .preprocessing import NotFittedError, check_features

#: Tables up to so many bytes of doubles are iterated in one task; above it each iteration is a pass of partial sums.
ONE_TASK_BYTES = 256 << 20
#: Queries whose vectors are broadcast together.
QUERY_BYTES = 64 << 20


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


class Model:
    fitted: tuple[str, ...] = ()

    def _ready(self) -> None:
        if any(getattr(self, name) is None for name in self.fitted):
            raise NotFittedError(f"fit {type(self).__name__} first")

    def as_dataframe(self, spark: SparkSession) -> DataFrame:
        self._ready()
        rows = [(name, i, float(v)) for name in self.fitted for i, v in enumerate(np.ravel(getattr(self, name)).tolist())]
        return spark.createDataFrame(rows, "param string, idx int, value double")


class PCA(Model):
    """Principal components by power iteration from the uniform vector and deflation; raises where too little is left."""

    fitted = ("mean", "components")

    def __init__(self, components: int, max_iterations: int = 500, tolerance: float = 1e-6):
        _need(components >= 1 and max_iterations >= 1 and tolerance > 0, "components, iterations and tolerance must be positive")
        self.count, self.max_iterations, self.tolerance = components, max_iterations, tolerance
        self.mean = self.components = None

    def fit(self, df: DataFrame, features_col: str = "features") -> PCA:
        mean, cov, _ = covariance(df, features_col)
        d = len(mean)
        _need(self.count <= d, "more components than features")
        found = []
        for _ in range(self.count):
            v = np.full(d, 1 / np.sqrt(d))
            for _ in range(self.max_iterations):
                w = cov @ v
                norm = np.linalg.norm(w)
                _need(norm > vec.F32_EPSILON, "insufficient remaining variance")
                w = w / norm
                done = ((w - v) ** 2).sum() <= self.tolerance**2
                v = w
                if done:
                    break
            cov = cov - (v @ cov @ v) * np.outer(v, v)
            found.append(v)
        self.mean, self.components = mean.tolist(), [v.tolist() for v in found]
        return self

    def transform(self, df: DataFrame, features_col: str = "features", out: str = "projected") -> DataFrame:
        self._ready()
        centred = vec.sub(features_col, vec.vector(self.mean))
        return df.withColumn("_c", centred).withColumn(out, F.array(*[vec.dot("_c", vec.vector(c)) for c in self.components])).drop("_c")


class KMeans(Model):
    """Lloyd's iteration from farthest-first seeds, the first being the smallest row_id; an empty cluster keeps its centre."""

    fitted = ("centers",)

    def __init__(self, clusters: int, max_iterations: int = 300, tolerance: float = 1e-4):
        _need(clusters >= 1 and max_iterations >= 1 and tolerance >= 0, "clusters and iterations must be positive")
        self.clusters, self.max_iterations, self.tolerance = clusters, max_iterations, tolerance
        self.centers, self.seeds, self.iterations = None, None, 0

    def fit(self, df: DataFrame, id_col: str = "row_id", features_col: str = "features") -> KMeans:
        n, width = check_features(df, features_col)
        _need(n >= self.clusters, "more clusters than rows")
        data = df.select(F.col(id_col).alias("row_id"), vec.double(features_col).alias("features"))
        if n * width * 8 <= ONE_TASK_BYTES:
            self._fit_in_one_task(data)
        else:
            self._fit_by_passes(data.persist())
        return self

    def _fit_in_one_task(self, data: DataFrame) -> None:
        k, most, tolerance = self.clusters, self.max_iterations, self.tolerance

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [b for b in batches if b.num_rows]
            ids, x = np.concatenate([b.column(0).to_numpy() for b in parts]), np.vstack([stack(b) for b in parts])
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            seeds, low = [0], ((x - x[0]) ** 2).sum(axis=1)
            while len(seeds) < k:
                seeds.append(int(low.argmax()))
                low = np.minimum(low, ((x - x[seeds[-1]]) ** 2).sum(axis=1))
            centers, passes = x[seeds].copy(), 0
            for passes in range(1, most + 1):
                at = np.stack([((x - c) ** 2).sum(axis=1) for c in centers]).argmin(axis=0)
                count = np.bincount(at, minlength=k)
                new = centers.copy()
                for c in np.flatnonzero(count):
                    new[c] = x[at == c].mean(axis=0)
                moved = ((new - centers) ** 2).sum()
                centers = new
                if moved <= tolerance**2:
                    break
            yield pa.RecordBatch.from_arrays([pa.array([ids[seeds].tolist()]), pa.array([centers.tolist()]), pa.array([passes])], ["s", "c", "n"])

        r = data.coalesce(1).mapInArrow(run, "s array<long>, c array<array<double>>, n long").first()
        self.seeds, self.centers, self.iterations = r["s"], r["c"], r["n"]

    def _fit_by_passes(self, data: DataFrame) -> None:
        first = data.orderBy("row_id").limit(1).collect()[0]
        self.seeds, centers = [first["row_id"]], [list(first["features"])]
        while len(centers) < self.clusters:
            far = F.array_min(self._distances(centers))
            r = data.select("row_id", "features", far.alias("d")).orderBy(F.desc("d"), "row_id").limit(1).collect()[0]
            self.seeds.append(r["row_id"])
            centers.append(list(r["features"]))
        for self.iterations in range(1, self.max_iterations + 1):
            at = data.select(vec.argmin(self._distances(centers)).alias("cluster"), F.posexplode("features").alias("pos", "x"))
            new = [list(c) for c in centers]
            for r in at.groupBy("cluster", "pos").agg(F.avg("x").alias("m")).collect():
                new[r["cluster"]][r["pos"]] = r["m"]
            moved = float(((np.array(new) - np.array(centers)) ** 2).sum())
            centers = new
            if moved <= self.tolerance**2:
                break
        data.unpersist()
        self.centers = centers

    @staticmethod
    def _distances(centers: list[list[float]]) -> Column:
        return F.array(*[vec.squared_distance("features", vec.vector(c)) for c in centers])

    def predict(self, df: DataFrame, features_col: str = "features", out: str = "cluster") -> DataFrame:
        self._ready()
        d = F.array(*[vec.squared_distance(features_col, vec.vector(c)) for c in self.centers])
        return df.withColumn(out, vec.argmin(d))


class LinearRegression(Model):
    """Full-batch descent from zero over all iterations, gradient error x / n plus l2 w, the bias unpenalised.

    The recursion needs only X'X, X'y and the sums, which one pass gives; it then runs on the driver at no further cost.
    """

    fitted = ("weights", "bias")

    def __init__(self, learning_rate: float = 0.05, iterations: int = 1000, l2: float = 0.0):
        _need(learning_rate > 0 and iterations >= 1 and l2 >= 0, "learning rate and iterations must be positive, l2 not negative")
        self.learning_rate, self.iterations, self.l2 = learning_rate, iterations, l2
        self.weights = self.bias = None

    def fit(self, df: DataFrame, features_col: str = "features", target_col: str = "target") -> LinearRegression:
        g, n = gram(df, [target_col], features_col)
        xx, xy, sx, sy = g[1:-1, 1:-1] / n, g[1:-1, -1] / n, g[0, 1:-1] / n, g[0, -1] / n
        w, b = np.zeros(len(sx)), 0.0
        for _ in range(self.iterations):
            gw, gb = xx @ w + b * sx - xy + self.l2 * w, sx @ w + b - sy
            w, b = w - self.learning_rate * gw, b - self.learning_rate * gb
        self.weights, self.bias = w.tolist(), float(b)
        return self

    def predict(self, df: DataFrame, features_col: str = "features", out: str = "predicted") -> DataFrame:
        self._ready()
        return df.withColumn(out, vec.dot(features_col, vec.vector(self.weights)) + F.lit(self.bias))


def _batches_matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield stack(b), b.column(b.schema.get_field_index("y")).to_numpy(zero_copy_only=False).astype(np.float64)


def _descend(df: DataFrame, width: int, rows: int, outputs: int, steps: int, gradient, update) -> tuple[np.ndarray, np.ndarray]:
    """Full-batch descent over df(features, y). gradient(x, y, w, b) -> (loss, gw, gb) sums; update changes w, b in place.

    A table of bounded size is iterated within one task; a larger one is cached and each step adds up one partial sum
    a partition. Both give the same parameters up to the order of additions.
    """
    if rows * (width + 1) * 8 <= ONE_TASK_BYTES:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = list(_batches_matrix(batches))
            if parts:
                x, y = np.vstack([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                w, b, losses = np.zeros((width, outputs)), np.zeros(outputs), []
                for _ in range(steps):
                    loss, gw, gb = gradient(x, y, w, b)
                    losses.append(loss / rows)
                    update(w, b, gw / rows, gb / rows)
                yield pa.RecordBatch.from_arrays([pa.array([w.ravel().tolist()]), pa.array([b.tolist()]), pa.array([losses])], ["w", "b", "l"])

        r = df.coalesce(1).mapInArrow(run, "w array<double>, b array<double>, l array<double>").first()
        return np.array(r["w"]).reshape(width, outputs), np.array(r["b"]), r["l"]
    cached, w, b, losses = df.persist(), np.zeros((width, outputs)), np.zeros(outputs), []
    for _ in range(steps):

        def part(batches: Iterator[pa.RecordBatch], w: np.ndarray = w, b: np.ndarray = b) -> Iterator[pa.RecordBatch]:
            loss, gw, gb = 0.0, np.zeros((width, outputs)), np.zeros(outputs)
            for x, y in _batches_matrix(batches):
                step = gradient(x, y, w, b)
                loss, gw, gb = loss + step[0], gw + step[1], gb + step[2]
            cells = np.concatenate([[loss], gw.ravel(), gb])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "v"])

        rows_ = cached.mapInArrow(part, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).orderBy("cell").collect()
        v = np.array([r["v"] for r in rows_])
        losses.append(v[0] / rows)
        update(w, b, v[1 : 1 + width * outputs].reshape(width, outputs) / rows, v[1 + width * outputs :] / rows)
    cached.unpersist()
    return w, b, losses


class LogisticRegression(Model):
    """Binary, labels 0 and 1: full-batch descent from zero over all iterations, l2 on the weights only."""

    fitted = ("weights", "bias")

    def __init__(self, learning_rate: float = 0.1, iterations: int = 500, l2: float = 0.0):
        _need(learning_rate > 0 and iterations >= 1 and l2 >= 0, "learning rate and iterations must be positive, l2 not negative")
        self.learning_rate, self.iterations, self.l2 = learning_rate, iterations, l2
        self.weights = self.bias = None

    def fit(self, df: DataFrame, features_col: str = "features", label_col: str = "label") -> LogisticRegression:
        rows, width = check_features(df, features_col, F.col(label_col).isNull() | ~F.col(label_col).isin(0, 1), "labels must be 0 or 1")
        lr, l2 = self.learning_rate, self.l2

        def gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple:
            s = x @ w[:, 0] + b[0]
            e = np.exp(-np.abs(s))
            err = np.where(s >= 0, 1 / (1 + e), e / (1 + e)) - y
            return 0.0, (err @ x)[:, None], np.array([err.sum()])

        def update(w: np.ndarray, b: np.ndarray, gw: np.ndarray, gb: np.ndarray) -> None:
            w -= lr * (gw + l2 * w)
            b -= lr * gb

        data = df.select(vec.double(features_col).alias("features"), F.col(label_col).cast("double").alias("y"))
        w, b, _ = _descend(data, width, rows, 1, self.iterations, gradient, update)
        self.weights, self.bias = w[:, 0].tolist(), float(b[0])
        return self

    def predict_probability(self, df: DataFrame, features_col: str = "features", out: str = "probability") -> DataFrame:
        self._ready()
        return df.withColumn("_s", vec.dot(features_col, vec.vector(self.weights)) + F.lit(self.bias)).withColumn(out, vec.sigmoid("_s")).drop("_s")

    def predict(self, df: DataFrame, threshold: float = 0.5, features_col: str = "features", out: str = "predicted") -> DataFrame:
        _need(0 < threshold < 1, "the threshold lies between 0 and 1")
        return self.predict_probability(df, features_col, "_p").withColumn(out, (F.col("_p") >= threshold).cast("int")).drop("_p")


class SoftmaxClassifier(Model):
    """Softmax regression on class indexes: full-batch steps from zero; a step's loss is that before its update."""

    fitted = ("weights", "bias")

    def __init__(self, features: int, classes: int):
        _need(features >= 1 and classes >= 2, "at least one feature and two classes")
        self.features, self.classes, self.weights, self.bias, self.losses = features, classes, None, None, []

    def fit(self, df: DataFrame, learning_rate: float, steps: int, features_col: str = "features", label_col: str = "label") -> SoftmaxClassifier:
        rows, width = check_features(df, features_col)
        _need(width == self.features, "the vectors have another width")
        classes = self.classes

        def gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple:
            z = x @ w + b
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            at = y.astype(int)
            if ((at < 0) | (at >= classes)).any():
                raise ValueError("a label is out of range")
            loss = -np.log(p[np.arange(len(x)), at]).sum()
            p[np.arange(len(x)), at] -= 1
            return loss, x.T @ p, p.sum(axis=0)

        def update(w: np.ndarray, b: np.ndarray, gw: np.ndarray, gb: np.ndarray) -> None:
            w -= learning_rate * gw
            b -= learning_rate * gb

        data = df.select(vec.double(features_col).alias("features"), F.col(label_col).cast("double").alias("y"))
        w, b, self.losses = _descend(data, width, rows, classes, steps, gradient, update)
        self.weights, self.bias = w.tolist(), b.tolist()
        return self

    def predict(self, df: DataFrame, features_col: str = "features", out: str = "predicted") -> DataFrame:
        self._ready()
        return df.withColumn(out, vec.argmax(vec.affine(features_col, self.weights, self.bias)))


def _nearer(best_d: np.ndarray, best_l: np.ndarray, q: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best (distance, label) lists of queries q after rows x with labels y.

    A matrix product cuts what cannot be among the best, with room for its rounding; the rest is summed in the order of
    the entries, like a row-wise fold.
    """
    m, k = best_d.shape
    q2, x2 = (q * q).sum(axis=1), (x * x).sum(axis=1)
    near = q @ x.T
    near *= -2
    near += q2[:, None]
    near += x2[None]
    cut = best_d[:, -1]
    if len(x) >= k:
        cut = np.minimum(cut, np.partition(near, k - 1, axis=1)[:, k - 1])
    i, j = np.nonzero(near <= (cut + 1e-9 * (1 + q2 + x2.max()))[:, None])
    exact = np.concatenate([np.zeros(0), *(np.cumsum((q[i[a : a + 65536]] - x[j[a : a + 65536]]) ** 2, axis=1)[:, -1] for a in range(0, len(i), 65536))])
    row, d, label = np.concatenate([np.repeat(np.arange(m), k), i]), np.concatenate([best_d.ravel(), exact]), np.concatenate([best_l.ravel(), y[j]])
    order = np.lexsort((label, d, row))
    at = order[np.searchsorted(row[order], np.arange(m))[:, None] + np.arange(k)]
    return d[at], label[at]


class KNearestNeighbors(Model):
    """The majority among the k nearest by squared distance, ordered by (distance, label); ties go to the smaller label.

    The stored table never moves: each of its tasks measures its rows against a broadcast block of queries and keeps
    k candidates a query, which are then merged. Queries of unbounded number are taken in blocks of bounded bytes.
    """

    fitted = ("train",)

    def __init__(self, neighbors: int = 5):
        _need(neighbors >= 1, "at least one neighbour")
        self.k, self.train = neighbors, None

    def fit(self, df: DataFrame, features_col: str = "features", label_col: str = "label") -> KNearestNeighbors:
        self.train = df.select(vec.double(features_col).alias("features"), F.col(label_col).cast("int").alias("label"))
        return self

    def neighbours(self, queries: DataFrame, id_col: str = "row_id", features_col: str = "features") -> DataFrame:
        """(query, label, distance, rank)."""
        self._ready()
        spark, k = queries.sparkSession, self.k
        asked = queries.select(F.col(id_col).cast("long").alias("q"), vec.double(features_col).alias("features"))
        n, width = check_features(asked)
        blocks = max(1, -(-n * width * 8 // QUERY_BYTES))
        out = None
        for block in range(blocks):
            part = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block) if blocks > 1 else asked
            table = part.toArrow().combine_chunks()
            if not table.num_rows:
                continue
            shared = spark.sparkContext.broadcast((table.column("q").to_numpy(), stack(table.to_batches()[0])))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                ids, q = shared.value
                best_d, best_l = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int32).max)
                for b in batches:
                    for at in range(0, b.num_rows, 4096):
                        piece = b.slice(at, 4096)
                        x, y = stack(piece), piece.column(1).to_numpy(zero_copy_only=False)
                        for s in range(0, len(ids), 1024):
                            best_d[s : s + 1024], best_l[s : s + 1024] = _nearer(best_d[s : s + 1024], best_l[s : s + 1024], q[s : s + 1024], x, y)
                ok = np.isfinite(best_d)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k).reshape(-1, k)[ok]), pa.array(best_l[ok].astype(np.int32)), pa.array(best_d[ok])], ["query", "label", "distance"])

            found = self.train.mapInArrow(run, "query long, label int, distance double")
            out = found if out is None else out.unionAll(found)
        rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "label"))
        return out.withColumn("rank", rank).where(F.col("rank") <= k)

    def predict(self, queries: DataFrame, id_col: str = "row_id", features_col: str = "features") -> DataFrame:
        """(row_id, predicted)."""
        from .profile import majority

        votes = majority(self.neighbours(queries, id_col, features_col), ["query"])
        return votes.select(F.col("query").alias(id_col), F.col("label").alias("predicted"))


class GaussianNaiveBayes(Model):
    """Class means and population variances plus an absolute smoothing; the smallest class wins ties."""

    fitted = ("classes", "priors", "means", "variances")

    def __init__(self, smoothing: float = 1e-6):
        _need(smoothing > 0, "smoothing must be positive")
        self.smoothing = smoothing
        self.classes = self.priors = self.means = self.variances = None

    def statistics(self, df: DataFrame, features_col: str = "features", label_col: str = "label") -> DataFrame:
        """(label, pos, n, mean, variance)."""
        x = df.select(F.col(label_col).cast("int").alias("label"), F.posexplode(vec.double(features_col)).alias("pos", "x"))
        return x.groupBy("label", "pos").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") + self.smoothing).alias("variance"))

    def fit(self, df: DataFrame, features_col: str = "features", label_col: str = "label") -> GaussianNaiveBayes:
        rows, width = check_features(df, features_col)
        stats = self.statistics(df, features_col, label_col).orderBy("label", "pos").collect()
        self.classes = sorted({r["label"] for r in stats})
        of = {c: [r for r in stats if r["label"] == c] for c in self.classes}
        self.priors = [float(np.log(of[c][0]["n"] / rows)) for c in self.classes]
        self.means = [[r["mean"] for r in of[c]] for c in self.classes]
        self.variances = [[r["variance"] for r in of[c]] for c in self.classes]
        return self

    def scores(self, features_col: str = "features") -> Column:
        self._ready()
        x, out = vec.of_width(vec.double(features_col), len(self.means[0])), []
        for prior, m, v in zip(self.priors, self.means, self.variances):
            base = prior - 0.5 * float(np.sum(1.8378770664 + np.log(v)))
            z = F.arrays_zip(x.alias("x"), vec.vector(m).alias("m"), vec.vector(1 / np.array(v)).alias("w"))
            out.append(F.lit(base) - F.lit(0.5) * F.aggregate(z, F.lit(0.0), lambda s, t: s + (t["x"] - t["m"]) * (t["x"] - t["m"]) * t["w"]))
        return F.array(*out)

    def predict(self, df: DataFrame, features_col: str = "features", out: str = "predicted") -> DataFrame:
        best = vec.argmax(self.scores(features_col))
        return df.withColumn(out, F.get(F.array(*[F.lit(c) for c in self.classes]), best))
