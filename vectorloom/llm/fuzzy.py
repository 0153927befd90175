"""Problem 5: near-duplicate images by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .images import FAINT, SPECTRUM_BYTES, copies, deliveries, faint, matrix, representatives, sketched, spectrum
from .near import keep, near_same, release, scale, with_copies

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the perfect binary Golay code of length 23.
GENERATOR, LENGTH, REDUNDANCY = 0xC75, 23, 11
SEGMENTS, TERMS, THRESHOLDS = 3, 23, (-0.8, 0.0, 0.8)
#: Doubtful bits of a segment that are tried the other way, one bit of a key at a time; keys of an image at most.
DOUBTFUL = 2
KEYS = SEGMENTS * (SEGMENTS - 1) // 2 * (1 + 2 * DOUBTFUL)


def _remainder(word: int) -> int:
    for i in range(LENGTH - 1, REDUNDANCY - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - REDUNDANCY)
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the error of up to three bits that each syndrome stands for."""
    low = np.array([_remainder(i) for i in range(1 << 12)], np.int64)
    high = np.array([_remainder(i << 12) for i in range(1 << 11)], np.int64)
    error = np.zeros(1 << REDUNDANCY, np.int64)
    for weight in range(4):
        for bits in combinations(range(LENGTH), weight):
            word = sum(1 << b for b in bits)
            error[_remainder(word)] = word
    return low, high, error


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to every 23-bit word; all words are within three bits of one."""
    low, high, error = _tables()
    return (words ^ error[low[words & 4095] ^ high[words >> 12]]) >> REDUNDANCY


@lru_cache(maxsize=1)
def _layout(seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).permutation(TERMS * len(THRESHOLDS))[: SEGMENTS * LENGTH].reshape(SEGMENTS, LENGTH)


def fuzzy_keys(sketch: np.ndarray, mean: np.ndarray, dev: np.ndarray, doubtful: int = DOUBTFUL) -> np.ndarray:
    """Keys of every image: (n x pairs of segments * (1 + 2 doubtful), int64), with repeats.

    69 bits tell where each of the 23 lowest spectrum terms lies against three thresholds, cut into three segments of
    23 bits. A segment stands for the codeword nearest to it and for those nearest after each of its most doubtful
    bits, the ones closest to their threshold, is flipped. By the pigeonhole principle few errors leave two of three
    segments nearly clean, so keys join the codewords of two segments, at most one of them with a bit flipped.
    """
    z = (sketch[:, :TERMS].astype(np.float32) - mean[:TERMS].astype(np.float32)) / dev[:TERMS].astype(np.float32)
    margin = np.concatenate([z - t for t in THRESHOLDS], axis=1)
    words = []
    for part in _layout():
        m = margin[:, part]
        word = ((m > 0) * (1 << np.arange(LENGTH, dtype=np.int64))).sum(axis=1)
        doubt = np.argpartition(np.abs(m), doubtful, axis=1)[:, :doubtful]
        words.append([decode(word), *(decode(word ^ (1 << doubt[:, i])) for i in range(doubtful))])
    tried = [(0, 0), *((0, i + 1) for i in range(doubtful)), *((i + 1, 0) for i in range(doubtful))]
    keys = [(words[a][i] << 12 | words[b][j]) + (c << 24) for c, (a, b) in enumerate(combinations(range(SEGMENTS), 2)) for i, j in tried]
    with np.errstate(over="ignore"):
        return np.stack(keys, axis=1) * np.int64(-7046029254386353131)


def _placer(mean: np.ndarray, dev: np.ndarray, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sketch = matrix(batch.column(2), SPECTRUM_BYTES)
                keys = fuzzy_keys(sketch, mean, dev)
                keys = np.concatenate([keys, np.where(faint(sketch, reach), FAINT, keys[:, 0])[:, None]], axis=1)
                keys.sort(axis=1)
                new = np.ones(keys.shape, bool)
                new[:, 1:] = keys[:, 1:] != keys[:, :-1]
                offsets = np.concatenate([[0], new.sum(axis=1).cumsum()]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[new]))], ["row_id", "side", "sketch", "keys"])

    return run


def fuzzy_classes(df: DataFrame, id_col: str = "row_id", features_col: str = "features", reach: int = 80_000, block: int = 2048) -> tuple[DataFrame, DataFrame]:
    """Near-same images as classes: pairs (a, b, distance) of representatives of equal content, and members (rep, row_id).

    The fingerprint is taken from the amplitude spectrum, which ignores moves; its bits become keys by ``fuzzy_keys``;
    images that share a key and may be near-same by their amplitudes become candidates; every pair of a candidate
    group is then measured exactly in nine placements. Faint images share a key of their own. Members are the images that are not their own representative,
    so a group of copies costs its rows and no pairs.

    A pair is missed only if no chain of shared keys joins it (measured in the README). Null ids, null, short or
    non-finite vectors take no part; repeated deliveries count once; an empty table gives an empty result.
    """
    table = keep(sketched(deliveries(df, id_col, features_col), spectrum), "levels")
    same = keep(copies(table).select("rep", "row_id"), "copies")
    reps = representatives(table, same).select("row_id", "side", "sketch")
    total, mean, dev = scale(reps)
    placed = reps.mapInArrow(_placer(mean, dev, reach), "row_id long, side tinyint, sketch binary, keys array<long>")
    found = near_same(table, placed, total * (KEYS + 1), reach, block, cross=False)
    release(table)
    return found, same


def fuzzy_pairs(df: DataFrame, id_col: str = "row_id", features_col: str = "features", reach: int = 80_000, block: int = 2048) -> DataFrame:
    """(row_id_a, row_id_b): different images at most ``reach`` apart, as they stand or moved by a pixel, smaller id first.

    ``fuzzy_classes`` with every class expanded: also images of equal content are paired with each other.
    """
    found, same = fuzzy_classes(df, id_col, features_col, reach, block)
    own = same.select(F.col("rep").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = with_copies(found.select("a", "b").unionAll(own), same).where("a <> b or left < right")
    return pairs.select(F.least("left", "right").alias("row_id_a"), F.greatest("left", "right").alias("row_id_b"))


def fuzzy_groups(df: DataFrame, id_col: str = "row_id", features_col: str = "features", reach: int = 80_000, block: int = 2048) -> DataFrame:
    """(row_id, group_id, links): every image with a near-same partner, the smallest id of its group and its pairs.

    Copies are counted, not paired: an image's links are all copies of its partners and the other copies of itself.
    """
    found, same = fuzzy_classes(df, id_col, features_col, reach, block)
    sizes = same.groupBy("rep").agg((F.count(F.lit(1)) + 1).alias("n"))
    ends = found.select("a", "b").unionAll(found.select("b", "a"))
    near = ends.join(sizes.select(F.col("rep").alias("b"), "n"), "b", "left").groupBy(F.col("a").alias("rep")).agg(F.sum(F.coalesce("n", F.lit(1))).alias("near"))
    linked = near.join(sizes, "rep", "full").select("rep", (F.coalesce("near", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).alias("links"))
    labels = components(found.select("a", "b"))
    # The smallest id of a class is its representative's, so the smallest of a group is a representative.
    groups = linked.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("rep", "links", F.coalesce("label", "rep").alias("group_id"))
    members = same.select("rep", "row_id").unionAll(linked.select("rep", F.col("rep").alias("row_id")))
    return members.join(groups, "rep").select("row_id", "group_id", "links")
