"""Mini-batch training. Steps depend on each other, so a run is one task and runs are the parallel axis."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rng, vec
from ..operators.matrices import stack
from ..operators.preprocessing import NotFittedError
from .graph import Graph, run
from .stored import StoredRows, new_folder, remove, store

OPTIMIZERS = ("sgd", "momentum", "nesterov", "rmsprop", "adam", "adamw")
#: Training and test rows of together at most so many bytes are sent to every run whole; more are packed in files of the
#: shared folder, from which a run reads a batch at a time.
MOST_BYTES = 64 << 20
#: Test rows that are evaluated at once.
TEST_ROWS = 4096
SCHEMA = "run_id string, epoch long, accuracy double, cost double, learning_rate double, params array<array<double>>"


@dataclass
class Training:
    epochs: int = 10
    batch_size: int = 50
    learning_rate: float = 0.01
    optimizer: str = "momentum"
    momentum: float = 0.9
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8
    weight_decay: float = 0.0
    clip: float = 0.0

    def validate(self) -> None:
        if self.optimizer not in OPTIMIZERS:
            raise ValueError(f"no optimizer {self.optimizer}")
        if self.epochs < 1 or self.batch_size < 1 or self.learning_rate <= 0:
            raise ValueError("epochs, batch size and learning rate must be positive")


def update(kind: Training, step: int, w: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray) -> None:
    """One optimizer step in place. ``step`` counts from 1. Only adam and adamw decay weights; rmsprop decays by beta2."""
    lr = kind.learning_rate
    if kind.optimizer == "sgd":
        w -= lr * g
    elif kind.optimizer in ("momentum", "nesterov"):
        m *= kind.momentum
        m += g
        w -= lr * (m if kind.optimizer == "momentum" else kind.momentum * m + g)
    elif kind.optimizer == "rmsprop":
        v *= kind.beta2
        v += (1 - kind.beta2) * g * g
        w -= lr * g / (np.sqrt(v) + kind.epsilon)
    else:
        if kind.optimizer == "adam":
            g = g + kind.weight_decay * w
        else:
            w *= 1 - lr * kind.weight_decay
        m *= kind.beta1
        m += (1 - kind.beta1) * g
        v *= kind.beta2
        v += (1 - kind.beta2) * g * g
        w -= lr * (m / (1 - kind.beta1**step)) / (np.sqrt(v / (1 - kind.beta2**step)) + kind.epsilon)


@dataclass
class Rows:
    """Features and one-hot labels in memory, read as ``StoredRows`` are."""

    x: np.ndarray
    y: np.ndarray

    def __len__(self) -> int:
        return len(self.x)

    def __getitem__(self, at: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        return self.x[at], self.y[at]


def fit_arrays(g: Graph, kind: Training, x: np.ndarray, y: np.ndarray, tx: np.ndarray, ty: np.ndarray, generator: rng.PCG32 | None = None, report: Callable[[tuple], None] | None = None) -> list[tuple]:
    """``fit_rows`` on arrays."""
    return fit_rows(g, kind, Rows(x, y), Rows(tx, ty), generator, report)


def fit_rows(g: Graph, kind: Training, rows: Rows | StoredRows, tests: Rows | StoredRows, generator: rng.PCG32 | None = None, report: Callable[[tuple], None] | None = None) -> list[tuple]:
    """Train g's parameters; (epoch, accuracy, cost, learning rate) on the test rows after every epoch.

    ``generator`` is the one that made the weights, so that a run draws from one stream; ``report`` is given every
    epoch's row as soon as it is known.

    The order of rows is swapped about before each epoch; an incomplete last batch is dropped. Gradients are averaged
    over the batch, then clipped by their joint norm (0: not), then given to the optimizer.
    """
    kind.validate()
    if not len(rows) or not len(tests) or kind.batch_size > len(rows):
        raise ValueError("training needs a full batch and test rows")
    params = g.parameters()
    state = [(np.zeros_like(p.value), np.zeros_like(p.value)) for p in params]
    batches, out = len(rows) // kind.batch_size, []
    for epoch, order in enumerate(rng.transposition_orders(len(rows), kind.epochs, generator or rng.PCG32())):
        for b in range(batches):
            x, y = rows[order[b * kind.batch_size : (b + 1) * kind.batch_size]]
            g.clear_gradients()
            g.accumulate({id(g.input): x[:, :, None], id(g.target): y[:, :, None]})
            mean = [p.grad / kind.batch_size for p in params]
            norm = np.sqrt(sum((m * m).sum() for m in mean))
            if kind.clip > 0 and norm > kind.clip:
                mean = [m * (kind.clip / norm) for m in mean]
            for p, m, s in zip(params, mean, state):
                update(kind, epoch * batches + b + 1, p.value, m, *s)
        right = cost = 0.0
        for at in range(0, len(tests), TEST_ROWS):
            x, y = tests[at : at + TEST_ROWS]
            val = run(g.backward, {id(g.input): x[:, :, None], id(g.target): y[:, :, None]})
            shown = np.broadcast_to(val[id(g.output)], (len(y), g.output.rows, 1))
            right += (shown[:, :, 0].argmax(axis=1) == y.argmax(axis=1)).sum()
            cost += val[id(g.cost)].sum()
        out.append((epoch + 1, right / len(tests), cost / len(tests), kind.learning_rate))
        if report:
            report(out[-1])
    return out


def _vectors(df: DataFrame, features: str, label: str, classes: int) -> tuple[np.ndarray, np.ndarray]:
    t = df.select(vec.double(features).alias("features"), vec.one_hot(label, classes).alias("y"), F.col("row_id")).orderBy("row_id").toArrow().combine_chunks()
    if not t.num_rows:
        raise ValueError("at least one row is needed")
    return stack(t.to_batches()[0]), stack(t.to_batches()[0], "y")


def train_runs(train: DataFrame, test: DataFrame, build: Callable[[rng.PCG32], Graph], runs: dict[str, Training], classes: int, features: str = "features", label: str = "label") -> DataFrame:
    """(run_id, epoch, accuracy, cost, learning_rate, params): every run trained in its own task; params in the last epoch.

    A run draws its weights and then its orders of rows from one generator, the same for all runs. Rows above
    ``MOST_BYTES`` are read from files, which are deleted when the runs have ended.
    """
    spark = train.sparkSession
    width = build(rng.PCG32()).input.rows
    if (train.count() + test.count()) * (width + classes) * 8 > MOST_BYTES:
        folder = new_folder(spark)
        try:
            for df, name in ((train, "train"), (test, "test")):
                store(df, f"{folder}/{name}", width, classes, features, label)
            done = _runs(spark, build, runs, lambda: [StoredRows(f"{folder}/{name}", width, classes) for name in ("train", "test")]).collect()
        finally:
            remove(folder)
        return spark.createDataFrame(done, SCHEMA)
    shared = spark.sparkContext.broadcast((_vectors(train, features, label, classes), _vectors(test, features, label, classes)))
    return _runs(spark, build, runs, lambda: [Rows(*arrays) for arrays in shared.value])


def _runs(spark: SparkSession, build: Callable[[rng.PCG32], Graph], runs: dict[str, Training], data: Callable[[], list[Rows | StoredRows]]) -> DataFrame:
    kinds = {k: asdict(v) for k, v in runs.items()}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                generator = rng.PCG32()
                g = build(generator)
                rows = fit_rows(g, Training(**kinds[name]), *data(), generator)
                last = [[p.value.ravel().tolist() for p in g.parameters()] if r is rows[-1] else None for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *(pa.array(c) for c in zip(*rows)), pa.array(last, pa.list_(pa.list_(pa.float64())))], ["run_id", "epoch", "accuracy", "cost", "learning_rate", "params"])

    ids = spark.createDataFrame([(k,) for k in runs], "run_id string").repartition(len(runs), "run_id")
    return ids.mapInArrow(task, SCHEMA)


def load_params(g: Graph, params: list[list[float]]) -> Graph:
    for p, values in zip(g.parameters(), params, strict=True):
        p.value = np.array(values).reshape(p.rows, p.cols)
    return g


def predict(g: Graph, df: DataFrame, features: str = "features", out: str = "probabilities") -> DataFrame:
    """df with the graph's output, evaluated over Arrow batches; a deep graph as one column expression would be inlined
    by the optimizer wherever a node is used twice. Small chains may use ``graph.with_output``."""
    if not g.forward:
        raise NotFittedError("compile the graph first")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = run(g.forward, {id(g.input): stack(b, "_x")[:, :, None]})[id(g.output)]
                y = np.broadcast_to(y, (b.num_rows, g.output.rows, 1)).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(y.tolist(), pa.list_(pa.float64()))], [*b.schema.names[:-1], out])

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    return df.withColumn("_x", vec.double(features)).mapInArrow(task, schema)


def metrics_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([tuple(float(v) if i else int(v) for i, v in enumerate(r)) for r in rows], "epoch int, accuracy double, cost double, learning_rate double")


__all__ = ["OPTIMIZERS", "Training", "fit_arrays", "fit_rows", "load_params", "metrics_table", "predict", "replace", "train_runs", "update"]
