"""Problem 8: cutting oversized texts at natural boundaries, by agglomerative merging."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2048, 128
#: Strength of a boundary: between words, after a sentence, after a line, after an empty line. Weak ones merge first.
WORD, SENTENCE, LINE, BLANK = 1, 2, 3, 4
_SEGMENT = re.compile(rb"[^ \n]*(?:[ \n]+|$)")


def _segments(text: bytes, limit: int, room: int) -> list[tuple[int, int, int, bool]]:
    """Atomic segments (start, end, strength of the boundary at the end, forced): words with the space behind them.

    Only a stretch without space or line end above ``limit`` is cut by force, at character ends into pieces of ``room``,
    which leaves them space for an overlap. Space that does not fit behind its word is a segment of its own.
    """
    out = []
    for m in _SEGMENT.finditer(text):
        s, e = m.span()
        if s == e:
            continue
        gap = text[s:e]
        word = gap.rstrip(b" \n")
        ends = gap[len(word) :]
        strength = BLANK if ends.count(b"\n") > 1 else LINE if b"\n" in ends else SENTENCE if word[-1:] in (b".", b"!", b"?") else WORD
        if len(word) > limit:
            while s + len(word) > s + room:
                cut = s + room
                while cut > s + 1 and (text[cut] & 0xC0) == 0x80:
                    cut -= 1
                out.append((s, cut, 0, True))
                word, s = word[cut - s :], cut
        if e - s > limit:
            at = s + len(word) if word else s + room
            while e - s > limit:
                out.append((s, at, WORD, False))
                s, at = at, at + room
        out.append((s, e, strength, False))
    return out


def _overlap_start(text: bytes, end: int, floor: int, overlap: int) -> int:
    """Where a piece that repeats what is before ``end`` begins: at the natural boundary nearest below ``overlap`` back.

    Without one within the overlap, the overlap is cut at a character end.
    """
    low = max(floor, end - overlap)
    for at in range(low, end):
        if at == floor or text[at - 1 : at] in (b" ", b"\n"):
            return at
    while low < end and (text[low] & 0xC0) == 0x80:
        low += 1
    return low


def split_text(text: bytes, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, bool]]:
    """Pieces (start, core, end, forced) in order: text[start:end] has at most ``limit`` bytes, text[start:core] repeats.

    Begin with atomic segments and hold adjacent pairs in a heap by the strength of the boundary between them, weakest
    first, then by combined size, then by place. A pair merges while its combined size plus the overlap fits the
    limit; the first piece repeats nothing, so it may use the whole limit. A single segment between that and the limit
    stays whole, and what its piece repeats is shortened to what still fits. ``forced`` marks pieces that begin within
    a stretch without any space or line end.
    """
    if len(text) <= limit:
        return [(0, 0, len(text), False)] if text else []
    room = limit - overlap
    seg = _segments(text, limit, room)
    n = len(seg)
    start, end = [s[0] for s in seg], [s[1] for s in seg]
    left, right, strength = list(range(-1, n - 1)), [*range(1, n), -1], [s[2] for s in seg]
    version, alive = [0] * n, [True] * n
    fits = lambda i, j: end[j] - start[i] <= (limit if start[i] == 0 else room)
    heap = [(strength[i], end[i + 1] - start[i], i, 0, 0) for i in range(n - 1) if fits(i, i + 1)]
    heapq.heapify(heap)
    while heap:
        _, _, i, vi, vj = heapq.heappop(heap)
        j = right[i] if alive[i] else -1
        if j < 0 or version[i] != vi or version[j] != vj or not fits(i, j):
            continue
        end[i], strength[i], right[i], alive[j] = end[j], strength[j], right[j], False
        if right[j] >= 0:
            left[right[j]] = i
        version[i] += 1
        k = right[i]
        if k >= 0 and fits(i, k):
            heapq.heappush(heap, (strength[i], end[k] - start[i], i, version[i], version[k]))
        k = left[i]
        if k >= 0 and fits(k, i):
            heapq.heappush(heap, (strength[k], end[i] - start[k], k, version[k], version[i]))
    cut = {s[1] for s in seg if s[3]}
    out: list[tuple[int, int, int, bool]] = []
    i = 0
    while i >= 0:
        at = start[i]
        out.append((at if not out else _overlap_start(text, at, out[-1][0], min(overlap, limit - (end[i] - at))), at, end[i], at in cut))
        i = right[i]
    return out


def _splitter(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at, rows = [], []
            for i in range(batch.num_rows):
                text = texts[i].as_py().encode("utf-8", "surrogatepass")
                pieces = split_text(text, limit, overlap)
                cut = "forced" if any(p[3] for p in pieces) else "natural"
                for k, (s, core, e, _) in enumerate(pieces):
                    at.append(i)
                    rows.append((k, s, core - s, e - s, cut, text[s:e].decode("utf-8", "surrogatepass")))
                if len(rows) >= 2000:
                    yield _batch(ids, at, rows)
                    at, rows = [], []
            if rows:
                yield _batch(ids, at, rows)

    return run


def _batch(ids: pa.Array, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "piece", "start", "repeated", "tokens", "cut", "text"])


def split_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, piece, start, repeated, tokens, cut, text): the pieces of every text above ``limit`` tokens, in order.

    ``start`` and ``tokens`` count UTF-8 bytes; the first ``repeated`` tokens of a piece are the last of the one before.
    ``cut`` is forced if a piece of the text begins within a stretch without space or line end, which only stretches
    above the limit make necessary, else natural. Texts are cut independently, so this is one pass without a shuffle.
    Null, empty and short texts give no rows.
    """
    long = df.where(F.octet_length(text_col) > limit).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(long.dtypes)["doc_id"]
    return long.mapInArrow(_splitter(limit, overlap), f"doc_id {kind}, piece int, start long, repeated long, tokens long, cut string, text string")


def split_report(pieces: DataFrame) -> DataFrame:
    """(cut, texts, pieces, tokens, repeated, longest): the pieces of all texts against their texts, by kind of cut.

    ``tokens`` are those of the texts, that is without what pieces repeat.
    """
    core = F.col("tokens") - F.col("repeated")
    return pieces.groupBy("cut").agg(F.sum((F.col("piece") == 0).cast("long")).alias("texts"), F.count(F.lit(1)).alias("pieces"), F.sum(core).alias("tokens"), F.sum("repeated").alias("repeated"), F.max("tokens").alias("longest"))
