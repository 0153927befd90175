"""Problem 2: test images that also stand in the training split, by winnowing fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .images import FAINT, PIXELS, SPECTRUM_BYTES, SPECTRUM_SIZE, copies, deliveries, faint, fixed_binary, matrix, representatives, sketched, spectrum
from .near import PLACEMENTS, keep, moved, near_same, release, scale, with_copies

#: Tokens are spectrum terms in steps of 2 deviations; a gram is 10 tokens; of 11 grams in a row the least is selected.
STEP, GRAM, WINDOW = 2.0, 10, 11


def winnow(sketch: np.ndarray, mean: np.ndarray, dev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of all grams (n x positions), and which of them are selected.

    Two records that agree in WINDOW + GRAM - 1 tokens in a row select a gram in common. The position is part of the
    hash: terms have fixed places, so only a seed at the same place of both records means anything, and the seeds of a
    pair lie on one diagonal.
    """
    token = np.floor((sketch - mean) / (dev * STEP) + 0.37).astype(np.int64) + 50
    n = token.shape[1] - GRAM + 1
    h = np.zeros((len(token), n), np.int64)
    with np.errstate(over="ignore"):
        for j in range(GRAM):
            h = h * np.int64(1_000_003) + token[:, j : j + n]
        h = (h + np.arange(n)) * np.int64(-7046029254386353131)
        h = (h ^ (h >> 29)) * np.int64(-4658895280553007687)
        h ^= h >> 31
    at = np.lib.stride_tricks.sliding_window_view(h, WINDOW, axis=1).argmin(axis=2) + np.arange(n - WINDOW + 1)
    chosen = np.zeros(h.shape, bool)
    np.put_along_axis(chosen, at, True, axis=1)
    return h, chosen


def _placer(mean: np.ndarray, dev: np.ndarray, reach: int, bits=None):
    """For mapInArrow over (row_id, side, sketch): the same with the selected gram hashes, of side 0 those in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                side, sketch = batch.column(1).to_numpy(), matrix(batch.column(2), SPECTRUM_BYTES)
                h, chosen = winnow(sketch[:, :SPECTRUM_SIZE], mean, dev)
                h = np.concatenate([h, np.full((len(h), 1), FAINT)], axis=1)
                chosen = np.concatenate([chosen, faint(sketch, reach)[:, None]], axis=1)
                if bits is not None:
                    chosen &= (side == 1)[:, None] | bits.value.holds(h)
                offsets = np.concatenate([[0], chosen.sum(axis=1).cumsum()]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[chosen]))
                full = pa.array(chosen.any(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fixed_binary(sketch), keys], ["row_id", "side", "sketch", "keys"]).filter(full)

    return run


class KeyFilter:
    """A bit set of hashed keys of at most 2**26 bits (8 MB): the other split's keys pass it before they travel."""

    def __init__(self, count: int, most: int = 26):
        self.mask = (1 << max(10, min(most, (16 * count).bit_length()))) - 1
        self.bits = np.zeros(self.mask + 1 >> 3, np.uint8)

    def put(self, keys: np.ndarray) -> None:
        at = keys & self.mask
        np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def key_filter(keyed: DataFrame, count: int) -> KeyFilter:
    """The filter over all ``keys`` of a table, or-ed over tasks: at most four sets reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = KeyFilter(count)
        for b in batches:
            part.put(b.column(0).flatten().to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([part.bits.tobytes()], pa.binary())], ["bits"])

    out = KeyFilter(count)
    for row in keyed.select("keys").coalesce(4).mapInArrow(run, "bits binary").collect():
        out.bits |= np.frombuffer(row["bits"], np.uint8)
    return out


def _chained(mean: np.ndarray, dev: np.ndarray, tolerance: int):
    """Of near-same images: pixels that agree in the best placement, and fingerprint tokens under the chain of seeds."""

    def run(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = x.astype(np.int16), y.astype(np.int16)
        agreeing = np.max([np.maximum((np.abs(moved(one, *p) - two) <= tolerance).sum(axis=1), (np.abs(one - moved(two, *p)) <= tolerance).sum(axis=1)) for p in PLACEMENTS], axis=0)
        (h, own), (g, other) = (winnow(spectrum(z)[:, :SPECTRUM_SIZE], mean, dev) for z in (x, y))
        seeds = ((h == g) & own & other).astype(np.int32)
        padded = np.pad(seeds, ((0, 0), (GRAM - 1, GRAM - 1)))
        return agreeing, (np.lib.stride_tricks.sliding_window_view(padded, GRAM, axis=1).max(axis=2) > 0).sum(axis=1)

    return ["agreeing", "chained"], run


def cross_split_pairs(train: DataFrame, test: DataFrame, id_col: str = "row_id", features_col: str = "features", reach: int = 80_000, block: int = 2048, tolerance: int = 8) -> DataFrame:
    """(train_row_id, test_row_id, distance, coverage, chained) of near-same images of different splits.

    Records are sequences of quantised spectrum terms, which moves leave alone. Selected gram hashes are seeds, joined
    across the splits; train seeds that no test image has are dropped by a filter before they travel. Seeds of a pair
    lie at the same places of both records, so they are collinear and their chain is their union; faint images are seeds
    of each other. Seeds are extended
    over the whole record, by the amplitudes of all its terms, and what can be near-same by these is aligned: the exact
    least distance in nine placements of either image. ``coverage`` is the share of pixels that agree within
    ``tolerance`` levels in the best placement, ``chained`` the share of the record's terms under the chain.

    A pair is missed only if no chain of seeds joins its images (measured in the README). Ids must be unique over both
    tables together. Null ids, null, short or non-finite vectors take no part; repeated deliveries count once; equal
    images pair with every copy; an empty split gives an empty result.
    """
    images = deliveries(train, id_col, features_col, 0).unionAll(deliveries(test, id_col, features_col, 1))
    table = keep(sketched(images, spectrum), "levels")
    same = keep(copies(table), "copies")
    reps = representatives(table, same).select("row_id", "side", "sketch")
    total, mean, dev = scale(reps)
    schema = "row_id long, side tinyint, sketch binary, keys array<long>"
    asked = reps.where("side = 1").mapInArrow(_placer(mean, dev, reach), schema)
    seeds = asked.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("n")).first()["n"]
    bits = train.sparkSession.sparkContext.broadcast(key_filter(asked, seeds))
    placed = reps.mapInArrow(_placer(mean, dev, reach, bits), schema)
    found = near_same(table, placed, total * (SPECTRUM_SIZE - GRAM + 2), reach, block, cross=True, extra=_chained(mean, dev, tolerance))
    pairs = keep(with_copies(found, same), "overlap")
    release(table, same, found)
    return pairs.select(F.col("left").alias("train_row_id"), F.col("right").alias("test_row_id"), "distance", (F.col("agreeing") / PIXELS).alias("coverage"), (F.col("chained") / SPECTRUM_SIZE).alias("chained"))


def overlap_report(pairs: DataFrame, train: DataFrame, test: DataFrame, id_col: str = "row_id", source_col: str = "source") -> DataFrame:
    """(split, source, records, pairs, mean_coverage) per split and source; a null source is its own row.

    An id delivered from several sources counts under the smallest of them, null last.
    """
    out = []
    for split, df, col in (("train", train, "train_row_id"), ("test", test, "test_row_id")):
        source = df.select(F.col(id_col).alias(col), F.col(source_col).alias("source")).where(F.col(col).isNotNull()).groupBy(col).agg(F.min("source").alias("source"))
        hits = pairs.groupBy(col).agg(F.count(F.lit(1)).alias("pairs"), F.sum("coverage").alias("c"))
        out.append(hits.join(source, col, "left").groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("pairs").alias("pairs"), (F.sum("c") / F.sum("pairs")).alias("mean_coverage")).select(F.lit(split).alias("split"), "source", "records", "pairs", "mean_coverage"))
    return out[0].unionAll(out[1])
