"""Training rows in files of the shared folder: packed where they are made, read in any order.

A row is packed by itself and without loss, so a run reads its batches in its own order and holds no more than one.
"""

from __future__ import annotations

import mmap
import os
import shutil
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vec
from ..operators.matrices import stack
from ..operators.profile import numbered
from ..session import checkpointed, shared_dir

#: Where a row is: the file of the task attempt that packed it, its first byte and its length; its class, -1 for none.
RECORD = np.dtype([("file", "<i8"), ("start", "<i8"), ("size", "<i4"), ("label", "<i4")])
#: What a byte stands for in each of the two forms that hold 255ths, worked out in single and in double precision.
SHARES = ((np.arange(256, dtype="<f4") / np.float32(255)).astype("<f8"), np.arange(256, dtype="<f8") / 255)
SINGLES, DOUBLES = 2, 3
#: Rows that are packed at once.
BLOCK = 1000


def pack(x: np.ndarray) -> list[bytes]:
    """Every row as its form and its compressed entries: the shortest form that gives the same bits again."""
    with np.errstate(invalid="ignore", over="ignore"):
        codes = np.rint(np.clip(np.nan_to_num(x), 0, 1) * 255).astype(np.uint8)
        singles = x.astype("<f4")
    same = [(value.view(np.int64) == x.view(np.int64)).all(axis=1) for value in (*(s[codes] for s in SHARES), singles.astype(np.float64))]
    forms = np.select(same, range(DOUBLES), DOUBLES)
    entries = {SINGLES: singles, DOUBLES: x}
    return [bytes([form]) + zlib.compress(entries.get(form, codes)[i].tobytes(), 1) for i, form in enumerate(forms.tolist())]


def unpack(rows: list[bytes], width: int) -> np.ndarray:
    x, forms = np.empty((len(rows), width)), np.array([r[0] for r in rows])
    for form in np.unique(forms).tolist():
        at = np.flatnonzero(forms == form)
        data = b"".join([zlib.decompress(memoryview(rows[i])[1:]) for i in at.tolist()])
        if form < SINGLES:
            x[at] = SHARES[form][np.frombuffer(data, np.uint8)].reshape(-1, width)
        else:
            x[at] = np.frombuffer(data, "<f4" if form == SINGLES else "<f8").reshape(-1, width)
    return x


class StoredRows:
    """Rows in order of row_id as (features, one-hot labels), for a slice or for positions in any order."""

    def __init__(self, folder: str, width: int, classes: int):
        self.folder, self.width, self.classes, self.files = folder, width, classes, {}
        self.index = np.memmap(f"{folder}/index", RECORD, "r").view(np.ndarray)

    def __len__(self) -> int:
        return len(self.index)

    def __getitem__(self, at: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        records = self.index[at]
        x = unpack([self._file(f)[start : start + size] for f, start, size, _ in records.tolist()], self.width)
        return x, (records["label"][:, None] == np.arange(self.classes)).astype(np.float64)

    def _file(self, number: int) -> mmap.mmap:
        if number not in self.files:
            with open(f"{self.folder}/{number}", "rb") as f:
                self.files[number] = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        return self.files[number]


def store(df: DataFrame, folder: str, width: int, classes: int, features: str = "features", label: str = "label") -> None:
    """Write df's rows and their index to the folder.

    Every attempt at a task packs into a file of its own, and only attempts that ended are in the index, so a task that
    is run again leaves no row twice. Vectors that are null or of another width raise, as no rows do.
    """
    data = df.select("row_id", vec.double(features).alias("features"), vec.one_hot(label, classes).alias("y"))
    os.makedirs(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().taskAttemptId()
        with open(f"{folder}/{number}", "wb") as f:
            for b in batches:
                for part in (b.slice(i, BLOCK) for i in range(0, b.num_rows, BLOCK)):
                    x, y = stack(part), stack(part, "y")
                    if x.shape[1] != width:
                        raise ValueError(f"a feature vector has {x.shape[1]} entries; {width} were expected")
                    packed, start = pack(x), f.tell()
                    f.write(b"".join(packed))
                    sizes = np.array([len(p) for p in packed])
                    where = [np.full(len(x), number), start + np.cumsum(sizes) - sizes, sizes.astype(np.int32), np.where(y.any(axis=1), y.argmax(axis=1), -1).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, where)], ["row_id", *RECORD.names])

    kinds = zip(RECORD.names, (T.LongType(), T.LongType(), T.IntegerType(), T.IntegerType()))
    packed = checkpointed(data.mapInArrow(run, T.StructType([data.schema["row_id"], *(T.StructField(k, t) for k, t in kinds)])))
    rows, n = numbered(packed, ["row_id"])
    if not n:
        raise ValueError("at least one row is needed")
    index = f"{folder}/index"
    with open(index, "wb") as f:
        f.truncate(n * RECORD.itemsize)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(index, "r+b") as f:
            for b in batches:
                at, records = b.column(0).to_numpy(), np.empty(b.num_rows, RECORD)
                for i, name in enumerate(RECORD.names, 1):
                    records[name] = b.column(i).to_numpy()
                edges = np.flatnonzero(np.diff(at) != 1) + 1
                for places, block in zip(np.split(at, edges), np.split(records, edges)):
                    if len(places):
                        f.seek(int(places[0]) * RECORD.itemsize)
                        f.write(block.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([0])], ["done"])

    rows.select("pos", *RECORD.names).sortWithinPartitions("pos").mapInArrow(place, "done long").count()


def new_folder(spark: SparkSession) -> str:
    """A folder below ``spark.checkpoint.dir``, which tasks open themselves: it must be on a mount that all share."""
    shared_dir(spark)
    path = spark.sparkContext.getCheckpointDir()
    if not path.startswith("file:"):
        raise RuntimeError("training rows need a spark.checkpoint.dir on a shared mount (file:)")
    return f"/{path[5:].lstrip('/')}/rows-{uuid.uuid4().hex}"


def remove(folder: str) -> None:
    shutil.rmtree(folder, ignore_errors=True)
