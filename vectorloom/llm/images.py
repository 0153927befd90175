"""Image vectors: cleaning, whole-number levels, and fixed linear features.

An image is 28x28 pixels, row-major. A delivery is valid if it has 784 finite entries; its levels are whole numbers
0..255 after dividing by 255 where an entry exceeds 2 and clamping to [0, 1]. All features below are fixed functions
of the levels, so they need no fitting and mean the same for every table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 28
PIXELS = SIDE * SIDE
CHUNK = 2048


def valid_levels(features: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the valid vectors of an Arrow list array, and their levels (n x 784, uint8)."""
    n = len(features)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros((0, PIXELS), np.uint8)
    offsets = features.offsets.to_numpy()
    values = features.values.to_numpy(zero_copy_only=False)
    ok = features.is_valid().to_numpy(zero_copy_only=False) & (np.diff(offsets) == PIXELS)
    at = np.flatnonzero(ok)
    if at.size == 0:
        return at, np.zeros((0, PIXELS), np.uint8)
    starts = offsets[at]
    if at.size == n and starts[-1] - starts[0] == PIXELS * (n - 1):
        rows = values[starts[0] : starts[0] + PIXELS * n].reshape(n, PIXELS)
    else:
        rows = values[starts[:, None] + np.arange(PIXELS)]
    rows = rows.astype(np.float32)
    finite = np.isfinite(rows.sum(axis=1, dtype=np.float64))
    rows, at = rows[finite], at[finite]
    wide = rows.max(axis=1, initial=0) > 2
    rows[~wide] *= 255
    np.clip(rows, 0, 255, out=rows)
    rows += np.float32(0.5)
    return at, rows.astype(np.uint8)


@lru_cache(maxsize=1)
def cosine_basis(count: int = 64) -> np.ndarray:
    """The ``count`` lowest non-constant functions of the orthonormal 2-D cosine transform, 784 x count."""
    k, x = np.arange(SIDE)[:, None], np.arange(SIDE)[None]
    c = np.sqrt(2 / SIDE) * np.cos(np.pi * (2 * x + 1) * k / (2 * SIDE))
    order = sorted((u * u + v * v, u, v) for u in range(SIDE) for v in range(SIDE) if u + v)[:count]
    return np.stack([np.outer(c[u], c[v]).ravel() / (1 if u and v else np.sqrt(2)) for _, u, v in order], 1).astype(np.float32)


#: Spectrum frequencies with u*u + v*v up to this, one of each conjugate pair, without the constant: 84 of them.
SPECTRUM_RADIUS2 = 52
SPECTRUM_SIZE = 84
#: Steps of the amplitudes, the edge and the length, as uint8. What is above 255 steps is cut off, which brings none
#: further apart. A spectrum has so many bytes: amplitudes, edge, length.
SPECTRUM_STEP, EDGE_STEP, LENGTH_STEP = 4.0, 8.0, 16.0
SPECTRUM_BYTES = SPECTRUM_SIZE + 2


@lru_cache(maxsize=1)
def _spectrum_basis() -> tuple[np.ndarray, np.ndarray]:
    reach = int(SPECTRUM_RADIUS2**0.5)
    waves = sorted((u * u + v * v, u, v) for v in range(reach + 1) for u in range(-reach, reach + 1) if (v or u > 0) and u * u + v * v <= SPECTRUM_RADIUS2)
    y, x = np.mgrid[:SIDE, :SIDE]
    angle = np.stack([2 * np.pi * (u * y + v * x).ravel() / SIDE for _, u, v in waves], 1)
    unit = np.sqrt(2) / SIDE  # orthonormal, a frequency and its conjugate taken together
    return (np.cos(angle) * unit).astype(np.float32), (np.sin(angle) * unit).astype(np.float32)


def edges(levels: np.ndarray) -> np.ndarray:
    """For every image the most that a move by one pixel along each axis pushes out of it, as a length."""
    x = np.square(levels.reshape(-1, SIDE, SIDE).astype(np.float32))
    rows, columns = np.maximum(x[:, 0].sum(1), x[:, -1].sum(1)), np.maximum(x[:, :, 0].sum(1), x[:, :, -1].sum(1))
    return np.sqrt(rows + columns)


def spectrum(levels: np.ndarray) -> np.ndarray:
    """Low-frequency amplitudes of the orthonormal Fourier transform, and the image's edge and length (n x 86, uint8).

    Amplitudes do not change when a drawing moves round, so by Parseval those of an image and of a moved one differ, as
    vectors, by no more than the two images do and what the move pushes out: a lower bound of their distance.
    """
    cos, sin = _spectrum_basis()
    out = np.empty((len(levels), SPECTRUM_BYTES), np.uint8)
    for i in range(0, len(levels), CHUNK):
        x = levels[i : i + CHUNK].astype(np.float32)
        out[i : i + CHUNK, :SPECTRUM_SIZE] = np.minimum(np.hypot(x @ cos, x @ sin) / SPECTRUM_STEP + 0.5, 255)
        out[i : i + CHUNK, SPECTRUM_SIZE] = np.ceil(edges(levels[i : i + CHUNK]) / EDGE_STEP)
        out[i : i + CHUNK, SPECTRUM_SIZE + 1] = np.minimum(np.sqrt(np.square(x).sum(axis=1)) / LENGTH_STEP, 255)
    return out


def faint(sketch: np.ndarray, reach: int) -> np.ndarray:
    """Which spectra are of images so short that they, or what may be near-same to them, differ by a good part of themselves.

    Keys of such images say little, so all of them share a key of their own: every near-same pair of which one image is
    at most twice the near-same distance long shares it.
    """
    edge, length = sketch[:, SPECTRUM_SIZE].astype(np.float32) * EDGE_STEP, sketch[:, SPECTRUM_SIZE + 1].astype(np.float32) * LENGTH_STEP
    return length <= 3 * np.sqrt(np.float32(reach)) + edge


#: The key of faint images.
FAINT = -1


def amplitudes(levels: np.ndarray) -> np.ndarray:
    """All amplitudes of the orthonormal Fourier transform (n x 420), for the same bound over all frequencies."""
    out = np.empty((len(levels), SIDE * 15), np.float32)
    for i in range(0, len(levels), CHUNK):
        a = np.abs(np.fft.rfft2(levels[i : i + CHUNK].reshape(-1, SIDE, SIDE).astype(np.float32))) / SIDE
        a[:, :, 1:14] *= np.sqrt(2)  # the columns whose conjugates the transform leaves out
        out[i : i + CHUNK] = a.reshape(-1, SIDE * 15)
    return out


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """A uint8 matrix as an Arrow binary column, one row each, without copying rows one by one."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The inverse of ``fixed_binary``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if len(column) == 0:
        return np.zeros((0, width), np.uint8)
    if pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), width)


def deliveries(df: DataFrame, id_col: str = "row_id", features_col: str = "features", side: int = 0) -> DataFrame:
    """The columns an image operator needs, whatever else the table holds. Rows with a null id take no part."""
    return df.select(F.col(id_col).cast("long").alias("row_id"), F.col(features_col).cast("array<float>").alias("features"), F.lit(side).cast("tinyint").alias("side")).where(f"row_id is not null and size(features) = {PIXELS}")


#: The cosine sketch: the 64 lowest coefficients in steps of 6, as uint8 around 128.
COSINE_SIZE, COSINE_STEP = 64, 6.0


def cosine_sketch(levels: np.ndarray) -> np.ndarray:
    out = np.empty((len(levels), COSINE_SIZE), np.uint8)
    for i in range(0, len(levels), CHUNK):
        out[i : i + CHUNK] = np.clip(levels[i : i + CHUNK].astype(np.float32) @ cosine_basis(COSINE_SIZE) / COSINE_STEP + 128.5, 0, 255)
    return out


def sketched(images: DataFrame, sketch: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(row_id, side, levels, h1, h2, sketch) of every valid delivery of ``deliveries``; h1, h2: a hash of the content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, levels = valid_levels(batch.column(1))
            if at.size:
                digest = np.frombuffer(b"".join([hashlib.blake2b(row, digest_size=16).digest() for row in levels]), np.int64).reshape(-1, 2)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), fixed_binary(levels), pa.array(np.ascontiguousarray(digest[:, 0])), pa.array(np.ascontiguousarray(digest[:, 1])), fixed_binary(sketch(levels))], ["row_id", "side", "levels", "h1", "h2", "sketch"])

    return images.mapInArrow(run, "row_id long, side tinyint, levels binary, h1 long, h2 long, sketch binary")


def no_sketch(levels: np.ndarray) -> np.ndarray:
    return np.zeros((len(levels), 0), np.uint8)


def fit_sample(table: DataFrame, rows: int) -> np.ndarray:
    """Levels of at most ``rows`` images, those with the smallest hashes of their ids."""
    share = min(1.0, 1.2 * rows / max(1, table.count()))
    drawn = table.where(F.pmod(F.xxhash64("row_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("row_id", "levels").dropDuplicates(["row_id"])
    return matrix(drawn.orderBy(F.xxhash64("row_id")).limit(rows).select("levels").toArrow().column(0), PIXELS)


#: So many ids, of 8 bytes each, may be broadcast; a longer list is joined by shuffling.
BROADCAST_IDS = 1_000_000


def copies(table: DataFrame) -> DataFrame:
    """(rep, side, row_id): every image whose content an image with a smaller id of the same side has, with the smallest."""
    ids = table.select("h1", "h2", "side", "row_id")
    shared = ids.groupBy("h1", "h2", "side").agg(F.min("row_id").alias("rep"), F.max("row_id").alias("last")).where("rep < last").drop("last")
    return ids.join(shared, ["h1", "h2", "side"]).where("row_id <> rep").select("rep", "side", "row_id").distinct()


def representatives(table: DataFrame, same: DataFrame) -> DataFrame:
    """The rows of ``table`` but for those of ``copies``: of images with the same content, the one with the smallest id.

    Repeated deliveries of it stay.
    """
    gone = same.select("row_id")
    return table.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "row_id", "left_anti")
