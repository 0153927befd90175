"""Connected components by contraction, as joins: no component is ever held by one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import keep, release


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node of every node's component. ``edges``: (a, b), either way round, no nulls.

    In each round every node points to the neighbour, or itself, of the smallest hash, edges are moved to what their
    ends point to, and edges within one node vanish. Hashes make even a sorted chain shrink by a constant share a
    round, so rounds grow with the logarithm of the longest chain, and each works on what is left. Then every node
    follows its pointers, and the smallest node takes the label. A hub's neighbours are reduced to partial minima where
    they are read; in the joins its rows meet one row of the other side, which adaptive execution cuts up where they
    are too many for a task.
    """
    left = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    steps = []
    for _ in range(max_rounds):
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(left.select(F.col("b"), F.col("a")))
        low = ends.groupBy("node").agg(F.min(F.struct(F.xxhash64("other").alias("h"), F.col("other").alias("to"))).alias("m"))
        step = keep(low.select("node", F.when(F.col("m.h") < F.xxhash64("node"), F.col("m.to")).otherwise(F.col("node")).alias("to")), "steps")
        steps.append(step)
        moved = left.join(step.withColumnsRenamed({"node": "a", "to": "x"}), "a").join(step.withColumnsRenamed({"node": "b", "to": "y"}), "b")
        rest = keep(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        release(left)
        left = rest
        if left.isEmpty():
            break
    else:
        raise RuntimeError(f"edges are left after {max_rounds} rounds")
    out = steps[0].withColumnRenamed("to", "root")
    for step in steps[1:]:
        out = out.join(step.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    roots = keep(out, "roots")
    least = roots.groupBy("root").agg(F.min("node").alias("label"))
    labels = keep(roots.join(least, "root").select("node", "label"), "labels")
    release(left, roots, *steps)
    return labels
