"""Dataset profiles: the aggregates behind the dataset report, percentiles and head samples."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def profile(df: DataFrame, features_col: str = "features") -> DataFrame:
    """(n, values, min, max, mean, variance) over all entries of all vectors; variance is not below 0.

    Entries are folded within their row, so nothing is exploded and one number a task and column travels.
    """
    x = F.col(features_col).cast("array<double>")
    fold = lambda f: F.aggregate(x, F.lit(0.0), f)
    rows = df.select(F.size(x).cast("long").alias("c"), F.array_min(x).alias("lo"), F.array_max(x).alias("hi"), fold(lambda s, v: s + v).alias("s"), fold(lambda s, v: s + v * v).alias("q"))
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("values"), F.min("lo").alias("min"), F.max("hi").alias("max"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("values")
    return sums.select("n", "values", "min", "max", mean.alias("mean"), F.greatest(F.lit(0.0), F.col("q") / F.col("values") - mean * mean).alias("variance"))


def histogram(df: DataFrame, label_col: str = "label", classes: int = 10) -> DataFrame:
    """(label, n, percent) of every class, absent ones with 0; percent is of the largest class."""
    counts = df.groupBy(F.col(label_col).cast("long").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    full = df.sparkSession.range(classes).withColumnRenamed("id", "label").join(counts, "label", "left").fillna(0, ["n"])
    top = full.agg(F.max("n").alias("top"))  # one row
    return full.join(F.broadcast(top)).select("label", "n", F.when(F.col("top") > 0, 100.0 * F.col("n") / F.col("top")).otherwise(0.0).alias("percent"))


def percentile(df: DataFrame, value_col: str, quantiles: list[float], by: list[str] = ()) -> DataFrame:
    """by + exact nearest-rank percentiles (the value at rank ceil(q n), nulls left out) of numbers, columns p<100 q>.

    No task holds a group: values are counted where they are read, each group's values are cut into 64 ranges at
    approximate quantiles, and only the range in which a rank falls is put in order. Without ``by`` and without rows
    there is one row of nulls; a group without values has nulls.
    """
    names = {q: f"p{q * 100:g}".replace(".", "_") for q in quantiles}
    keys = [*by, "_all"]
    names = [f"p{q * 100:g}".replace(".", "_") for q in quantiles]

    def meet(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
        """A join on columns that may be null."""
        other = right.withColumnsRenamed({c: f"_r{i}" for i, c in enumerate(on)})
        return left.join(other, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_r{i}")) for i, c in enumerate(on)]), how).drop(*[f"_r{i}" for i in range(len(on))])

    rows = df.select(*by, F.lit(0).alias("_all"), F.col(value_col).alias("_v"))
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("_v", [i / 64 for i in range(1, 64)], 2000).alias("_cuts"), F.count("_v").alias("_n"))
    counts = rows.where("_v is not null").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    at = meet(counts, cuts, keys).withColumn("_part", F.size(F.filter("_cuts", lambda x: x < F.col("_v")))).drop("_cuts")
    parts = at.groupBy(*keys, "_part").agg(F.sum("_c").alias("_pc"), F.max("_n").alias("_n"))
    parts = parts.withColumn("_before", F.sum("_pc").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_pc"))
    ranks = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(q) * F.col("_n"))).alias("r")) for i, q in enumerate(quantiles)]))
    wanted = parts.withColumn("_q", ranks).where((F.col("_q.r") > F.col("_before")) & (F.col("_q.r") <= F.col("_before") + F.col("_pc"))).select(*keys, "_part", "_before", F.col("_q.i").alias("_i"), F.col("_q.r").alias("_rank"))
    near = meet(at, wanted, [*keys, "_part"])
    up_to = F.sum("_c").over(Window.partitionBy(*keys, "_i").orderBy("_v")) + F.col("_before")
    hit = near.withColumn("_up", up_to).where(F.col("_up") >= F.col("_rank")).groupBy(*keys, "_i").agg(F.min("_v").alias("_v"))
    wide = hit.groupBy(*keys).agg(*[F.min(F.when(F.col("_i") == i, F.col("_v"))).alias(n) for i, n in enumerate(names)])
    out = meet(cuts.select(*keys), wide, keys, "left").select(*by, *names)
    return out if by else out.agg(*[F.min(n).alias(n) for n in names])


def head(df: DataFrame, n: int, by: str = "row_id") -> DataFrame:
    """The first n rows in order of ``by``: a partial top-n in each task."""
    return df.orderBy(by).limit(n)


def sample_grid(df: DataFrame, n: int = 64, id_col: str = "row_id", features_col: str = "features") -> DataFrame:
    """The first n samples with entries clamped to [0, 1] and NaN as 0; n from 1 to 500."""
    if not 1 <= n <= 500:
        raise ValueError("the sample limit is from 1 to 500")
    clamp = F.transform(F.col(features_col).cast("array<double>"), lambda x: F.when(F.isnan(x), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))))
    return df.orderBy(id_col).limit(n).withColumn(features_col, clamp)


def classes(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.select(label_col).distinct().orderBy(label_col)


def majority(df: DataFrame, by: list[str], label_col: str = "label") -> DataFrame:
    """by + (label, votes): the most frequent label of every group; ties go to the smallest label."""
    counts = df.groupBy(*by, label_col).agg(F.count(F.lit(1)).alias("votes"))
    best = counts.groupBy(*by).agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col(label_col).alias("label"))).alias("m"))
    return best.select(*by, F.col("m.label").alias("label"), (-F.col("m.v")).alias("votes"))


def gini(df: DataFrame, by: list[str], label_col: str = "label") -> DataFrame:
    """by + (n, gini): 1 minus the sum of squared class shares."""
    counts = df.groupBy(*by, label_col).agg(F.count(F.lit(1)).alias("c"))
    sums = counts.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("c").cast("double") * F.col("c")).alias("q"))
    return sums.select(*by, "n", (1 - F.col("q") / (F.col("n").cast("double") * F.col("n"))).alias("gini"))


def accuracy(df: DataFrame, predicted: str = "predicted", label: str = "label") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(predicted) == F.col(label)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, predicted: str = "predicted", label: str = "label") -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))


def mini_batches(df: DataFrame, size: int, order: list[str]) -> DataFrame:
    """df with (pos, batch): rows in order, cut into batches of ``size``; an incomplete last batch is dropped."""
    if size < 1:
        raise ValueError("a batch has at least one row")
    rows, n = numbered(df, order)
    return rows.withColumn("batch", F.floor(F.col("pos") / size)).where(F.col("pos") < n // size * size)


def numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df with its position in ``order`` (pos, from 0), and the number of rows.

    Rows are put into ranges and ranked within each; the ranges' counts, a row each, are summed to offsets. The ranged
    rows are written once to the shared folder, so that ranks and counts are of the same ranges however either is
    planned or recomputed.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranked = checkpointed(ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order))))
    sizes = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("c")).orderBy("_part").collect()
    before, n = [], 0
    for r in sizes:
        before.append((r["_part"], n))
        n += r["c"]
    offsets = df.sparkSession.createDataFrame(before, "_part int, _before long")
    return ranked.join(F.broadcast(offsets), "_part").withColumn("pos", F.col("_in") - 1 + F.col("_before")).drop("_part", "_in", "_before"), n


def zipped(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """(pos, columns of both): the rows of two tables of equal length side by side, each in its own order."""
    (a, n), (b, m) = numbered(left, left_order), numbered(right, right_order)
    if n != m:
        raise ValueError(f"{n} and {m} rows cannot be put side by side")
    return a.join(b, "pos")
