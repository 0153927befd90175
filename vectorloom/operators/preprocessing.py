"""Scaling, encoding and dataset validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec


class NotFittedError(RuntimeError):
    """A model was used before it was fitted."""


def check_features(df: DataFrame, features_col: str = "features", bad: Column | None = None, message: str = "") -> tuple[int, int]:
    """(rows, width) in one aggregate; raises ValueError on no rows, null or empty vectors, or different lengths, and
    with ``message`` if any row is ``bad``."""
    n = F.size(F.col(features_col))
    r = df.agg(F.count(F.lit(1)).alias("rows"), F.min(n).alias("least"), F.max(n).alias("most"), F.count(features_col).alias("present"), F.count_if(F.lit(False) if bad is None else bad).alias("bad")).first()
    if not r["rows"]:
        raise ValueError("at least one row is needed")
    if r["present"] != r["rows"] or r["least"] < 1 or r["least"] != r["most"]:
        raise ValueError("feature vectors must be present and of one length of at least 1")
    if r["bad"]:
        raise ValueError(message)
    return r["rows"], r["least"]


def column_moments(df: DataFrame, features_col: str = "features") -> DataFrame:
    """(pos, mean, std) of every feature: population deviation. Rows are pre-aggregated where they are read."""
    x = df.select(F.posexplode(F.col(features_col).cast("array<double>")).alias("pos", "x"))
    return x.groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


@dataclass
class StandardScaler:
    """(x - mean) / deviation; a deviation of at most the float epsilon counts as 1, so constants become 0."""

    mean: list[float] | None = None
    scale: list[float] | None = None

    def fit(self, df: DataFrame, features_col: str = "features") -> StandardScaler:
        check_features(df, features_col)
        rows = column_moments(df, features_col).orderBy("pos").collect()
        self.mean = [r["mean"] for r in rows]
        self.scale = [1.0 if r["std"] <= vec.F32_EPSILON else r["std"] for r in rows]
        return self

    def transform(self, df: DataFrame, features_col: str = "features", out: str = "scaled") -> DataFrame:
        if self.mean is None:
            raise NotFittedError("fit the scaler first")
        z = F.arrays_zip(vec.of_width(vec.double(features_col), len(self.mean)).alias("x"), vec.vector(self.mean).alias("m"), vec.vector(self.scale).alias("s"))
        # Zipping would pad a null vector with nulls.
        return df.withColumn(out, F.when(F.col(features_col).isNotNull(), F.transform(z, lambda t: (t["x"] - t["m"]) / t["s"])))

    def as_dataframe(self, spark: SparkSession) -> DataFrame:
        if self.mean is None:
            raise NotFittedError("fit the scaler first")
        rows = [(name, i, float(v)) for name in ("mean", "scale") for i, v in enumerate(getattr(self, name))]
        return spark.createDataFrame(rows, "param string, idx int, value double")


def normalise_pixels(df: DataFrame, features_col: str = "features", out: str = "features") -> DataFrame:
    """Bytes 0..255 as fractions."""
    return df.withColumn(out, F.transform(vec.double(features_col), lambda x: x / 255))


def unit_pixels(df: DataFrame, features_col: str = "features", out: str = "features") -> DataFrame:
    """Pixels in [0, 1], whether a vector holds fractions or, where an entry exceeds 2, bytes."""
    f = vec.double(features_col)
    clamp = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return df.withColumn(out, vec.bind(F.array_max(f) > 2, lambda wide: F.transform(f, lambda x: clamp(F.when(wide, x / 255).otherwise(x)))))


def invalid_rows(df: DataFrame, width: int, classes: int = 10, features_col: str = "features", label_col: str = "label") -> DataFrame:
    """df with ``problem``: the first of null features, wrong size, not finite, null label, not whole, out of range; null if none."""
    return df.withColumn("problem", F.coalesce(features_problem(width, features_col), label_problem(classes, label_col)))


def features_problem(width: int, features_col: str = "features") -> Column:
    """The first of null features, wrong size and not finite, or null: small to carry where the vectors need not travel."""
    f = F.col(features_col).cast("array<double>")
    bad = F.exists(f, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(f.isNull(), "no features").when(F.size(f) != width, "wrong size").when(bad, "not finite")


def label_problem(classes: int = 10, label_col: str = "label") -> Column:
    """The first of null label, not whole and out of range, or null."""
    label = F.col(label_col).cast("double")
    return F.when(label.isNull() | F.isnan(label), "no label").when(label != F.floor(label), "label not whole").when((label < 0) | (label >= classes), "label out of range")
