"""Problem 3: samples that match target category shares, by divisor-method priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .images import PIXELS


def valid_images(df: DataFrame, id_col: str = "row_id", features_col: str = "features") -> DataFrame:
    """(row_id) of images: ids with a delivery of 784 finite entries. Nothing is exploded; the array is read once."""
    f = F.col(features_col)
    finite = F.forall(f, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where((F.size(f) == PIXELS) & finite & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("row_id")).distinct()


def current_labels(labels: DataFrame, id_col: str = "row_id", label_col: str = "label", at_col: str = "labelled_at") -> DataFrame:
    """(row_id, label): the label with the latest time, whatever it holds; at one time the largest value counts.

    A null time is earlier than any other. One aggregate, so relabelled ids cost no more than a partial maximum.
    """
    last = F.max(F.struct(F.col(at_col).alias("at"), F.col(label_col).cast("double").alias("label")))
    return labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("row_id")).agg(last.alias("m")).select("row_id", "m.label")


def usable(labels: DataFrame, classes: int = 10) -> DataFrame:
    """Whole labels from 0 to classes - 1, as ints; the rest (null, NaN, fractional, out of range) is dropped."""
    x = F.col("label")
    return labels.where(x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < classes) & (x == F.floor(x))).withColumn("label", x.cast("int"))


def plan_cells(targets: DataFrame) -> DataFrame:
    """(plan_id, label, share, size, floor), one row each: repeated rows count once, the largest of clashing values holds.

    A null share or floor counts as 0; rows without plan, label or size take no part; negative values count as 0.
    """
    least = lambda c, kind: F.greatest(F.coalesce(F.max(F.col(c).cast(kind)), F.lit(0).cast(kind)), F.lit(0).cast(kind))
    return targets.where("plan_id is not null and label is not null and sample_size is not null").groupBy("plan_id", "label").agg(least("target_share", "double").alias("share"), least("sample_size", "long").alias("size"), least("min_rows", "long").alias("floor"))


def ranked(pool: DataFrame, targets: DataFrame, seed: int = 11) -> DataFrame:
    """(plan_id, label, share, size, floor, row_id, rank): every row of the pool in the random order of its label in each plan.

    The order is that of a hash of plan, seed and id; ties go by id. No label is ranked in one task: rows are ranked
    within 1,024 ranges of their random number, and the ranges' counts are summed to offsets.
    """
    drawn = pool.join(plan_cells(targets), "label").withColumn("draw", F.xxhash64("plan_id", F.lit(seed), "row_id"))
    drawn = drawn.withColumn("slot", F.shiftrightunsigned("draw", 54).cast("int")).withColumn("u", F.col("draw").bitwiseAND((1 << 54) - 1))
    counts = drawn.groupBy("plan_id", "label", "slot").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("plan_id", "label").orderBy("slot")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("plan_id", "label", "slot").orderBy("u", "row_id"))
    return drawn.withColumn("in_slot", rank).join(before, ["plan_id", "label", "slot"]).withColumn("rank", F.col("in_slot") + F.col("before")).select("plan_id", "label", "share", "size", "floor", "row_id", "rank")


def quota_sample(pool: DataFrame, targets: DataFrame, seed: int = 11) -> DataFrame:
    """(plan_id, label, row_id, priority, rank): for each plan a sample of its size.

    pool: (row_id, label). The row of rank r in its label has priority (r - 0.5) / share, and rows up to the label's
    floor come before all others; the plan takes its ``size`` smallest priorities. When a label runs out, the seats
    that its share would have had go to the next priorities by themselves. Labels of share 0 give their floor only. If
    floors alone exceed the size, the floors are kept and the sample is larger.
    """
    return chosen(ranked(pool, targets, seed))


def chosen(rows: DataFrame) -> DataFrame:
    """The sample of what ``ranked`` gives. A plan's cut is found from counts per range of priorities, not by a global sort."""
    held = F.col("rank") <= F.col("floor")
    rows = rows.withColumn("held", held).withColumn("priority", F.when(F.col("share") > 0, (F.col("rank") - 0.5) / F.col("share")))
    rows = rows.where(F.col("held") | (F.col("priority").isNotNull() & (F.col("rank") <= F.col("size"))))
    free = rows.where("not held").withColumn("bin", F.floor(F.log2("priority") * 64))
    bins = free.groupBy("plan_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    kept = rows.where("held").groupBy("plan_id").agg(F.count(F.lit(1)).alias("kept"))
    bins = bins.withColumn("ahead", F.sum("n").over(Window.partitionBy("plan_id").orderBy("bin")) - F.col("n")).join(kept, "plan_id", "left")
    seats = free.join(bins.select("plan_id", "bin", "ahead", F.coalesce("kept", F.lit(0)).alias("kept")), ["plan_id", "bin"]).where(F.col("ahead") + F.col("kept") < F.col("size"))
    place = F.row_number().over(Window.partitionBy("plan_id", "bin").orderBy("priority", "label"))
    seats = seats.withColumn("place", place + F.col("ahead") + F.col("kept")).where(F.col("place") <= F.col("size"))
    cols = ["plan_id", "label", "row_id", "priority", "rank"]
    return rows.where("held").select(cols).unionAll(seats.select(cols))


def quota_report(pool: DataFrame, targets: DataFrame, seed: int = 11) -> DataFrame:
    """(plan_id, label, available, wanted, drawn, met, short): what the drawn sample gives against the targets.

    ``wanted`` is the larger of the floor and the rounded share, ``drawn`` the rows of the label in the sample and
    ``met`` whether they reach what is wanted. A target is missed either because the label is ``short`` (``available``,
    its last rank, is below what is wanted) or because other labels' floors took its seats or rounding did.
    """
    rows, key = ranked(pool, targets, seed), ["plan_id", "label"]
    have = rows.groupBy(key).agg(F.max("rank").alias("available"))
    took = chosen(rows).groupBy(key).agg(F.count(F.lit(1)).alias("drawn"))
    out = plan_cells(targets).join(have, key, "left").join(took, key, "left").fillna(0, ["available", "drawn"])
    wanted = F.greatest("floor", F.round(F.col("share") * F.col("size")).cast("long"))
    out = out.select(*key, "available", wanted.alias("wanted"), "drawn")
    return out.withColumn("met", F.col("drawn") >= F.col("wanted")).withColumn("short", F.col("available") < F.col("wanted"))


def image_pool(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(row_id, label) of images with a usable current label."""
    return valid_images(images).join(usable(current_labels(labels)), "row_id")
