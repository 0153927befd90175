"""Problem 6: filling containers of fixed capacity, by cost-balanced packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096


def sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens): one token for each UTF-8 byte. Null and empty texts have none and are no items."""
    return df.select(F.col(id_col).alias("doc_id"), F.octet_length(F.col(text_col)).cast("long").alias("tokens")).where("tokens > 0 and doc_id is not null")


def parts(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part, parts, tokens): items above the capacity are divided into full parts and a rest, others stay whole."""
    n = F.ceil(F.col("tokens") / capacity).cast("int")
    cut = items.select("doc_id", "tokens", n.alias("parts"), F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    return cut.select("doc_id", "part", "parts", F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("part") * capacity).alias("tokens"))


def _pack(lengths: np.ndarray, capacity: int, attention: float) -> np.ndarray:
    """Containers of items in descending order of length: each goes to the cheapest container that still has room.

    The cost of a container is the sum over its items of length + attention * length**2 / capacity; of containers of
    equal cost the one opened first is taken. Containers are opened when no open one has room. Open containers are
    kept by room, each room's in a heap by cost, and a tree holds the cheapest of every range of rooms, so a placement
    is one look-up over all rooms that suffice rather than a scan.
    """
    import heapq

    none = (float("inf"), -1)
    leaves = 1 << capacity.bit_length()
    least = [none] * (2 * leaves)
    rooms: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]

    def update(room: int) -> None:
        at = leaves + room
        least[at] = rooms[room][0] if rooms[room] else none
        while at > 1:
            at >>= 1
            new = min(least[2 * at], least[2 * at + 1])
            if least[at] == new:
                break
            least[at] = new

    left: list[int] = []
    out = np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        at = leaves + length
        spent, box = least[at]
        while at > 1:
            if not at & 1:
                spent, box = min((spent, box), least[at + 1])
            at >>= 1
        if box < 0:
            spent, box = 0.0, len(left)
            left.append(capacity)
        else:
            heapq.heappop(rooms[left[box]])
            update(left[box])
        out[i] = box
        left[box] -= length
        if left[box]:
            heapq.heappush(rooms[left[box]], (spent + length + attention * length * length / capacity, box))
            update(left[box])
    return out


def _packer(capacity: int, attention: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []
        shard = None

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(pending).combine_chunks()
            length = t.column("tokens").to_numpy()
            order = np.lexsort((t.column("part").to_numpy(), t.column("doc_id").to_numpy(), -length))
            box = np.empty(len(length), np.int64)
            box[order] = _pack(length[order], capacity, attention)
            return pa.RecordBatch.from_arrays([pa.array(box), *(t.column(c).combine_chunks() for c in ("shard", "doc_id", "part", "parts", "tokens"))], ["box", "shard", "doc_id", "part", "parts", "tokens"])

        for batch in batches:
            s = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            for at in np.split(np.arange(len(s)), np.flatnonzero(np.diff(s)) + 1) if len(s) else []:
                if pending and s[at[0]] != shard:
                    yield flush()
                    pending.clear()
                shard = s[at[0]]
                pending.append(batch.slice(int(at[0]), len(at)))
        if pending:
            yield flush()

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, attention: float = 1.0, shard_items: int = 20_000) -> DataFrame:
    """(container, doc_id, part, parts, tokens, offset): the contents of every container, in order of ``offset``.

    items: (doc_id, tokens). Only an item above the capacity is divided; its full parts have containers of their own
    and its rest is packed like any other item. Items are spread by a hash over shards of about ``shard_items`` items,
    so a shard is a bounded, representative mix; each shard is packed on its own, in descending order, by the estimated
    linear plus quadratic attention cost (see ``_pack``). At 20,000 items a shard the unfilled last containers of a
    shard are well under 0.1 % of its room.

    Items without a size or of size 0 take no part; equal sizes are ordered by id and part; an empty table gives an
    empty result.
    """
    cut = parts(items.where("tokens > 0 and doc_id is not null"), capacity)
    whole = cut.where(F.col("tokens") == capacity).select(F.concat(F.lit("f-"), F.col("doc_id"), F.lit("-"), F.col("part")).alias("container"), "doc_id", "part", "parts", "tokens", F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("tokens") < capacity)
    n = items.count()
    shards = max(1, -(-n // shard_items))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards)).cast("int")).repartition(shards, "shard").sortWithinPartitions("shard")
    kind = dict(items.dtypes)["doc_id"]
    packed = rest.select("shard", "doc_id", "part", "parts", "tokens").mapInArrow(_packer_with_offsets(capacity, attention), f"box long, shard int, doc_id {kind}, part int, parts int, tokens long, offset long")
    return whole.unionAll(packed.select(F.concat(F.lit("s-"), F.col("shard"), F.lit("-"), F.col("box")).alias("container"), "doc_id", "part", "parts", "tokens", "offset"))


def _packer_with_offsets(capacity: int, attention: float):
    base = _packer(capacity, attention)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in base(batches):
            box, length = b.column(0).to_numpy(), b.column(5).to_numpy()
            order = np.lexsort((b.column(3).to_numpy(), b.column(2).to_numpy(), -length, box))
            total = np.cumsum(length[order]) - length[order]
            first = np.r_[True, np.diff(box[order]) != 0]
            offset = np.empty(len(box), np.int64)
            offset[order] = total - np.repeat(total[first], np.diff(np.r_[np.flatnonzero(first), len(box)]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(offset)], [*b.schema.names, "offset"])

    return run


def pack_report(packed: DataFrame, capacity: int = CAPACITY, attention: float = 1.0) -> DataFrame:
    """(containers, items, tokens, fill, cost, deviation, overfull): how full and how evenly costly the containers are.

    ``fill`` is the share of all room that is used; ``cost`` and ``deviation`` are of the containers' estimated cost;
    ``overfull`` counts containers above the capacity, which must be 0. No containers give one row of zeros and nulls.
    """
    n = F.col("tokens").cast("double")
    boxes = packed.groupBy("container").agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"), F.sum(n + n * n * (attention / capacity)).alias("cost"))
    all_ = boxes.agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.avg("cost").alias("cost"), F.stddev_pop("cost").alias("deviation"), F.coalesce(F.sum((F.col("tokens") > capacity).cast("long")), F.lit(0)).alias("overfull"))
    return all_.select("containers", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.col("tokens") / (F.col("containers") * capacity)).alias("fill"), "cost", "deviation", "overfull")
