"""Problem 7: evaluation passages leaking into documents, by CGK embedding, bit-sampling LSH and edit verification."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import keep, release

#: Letters that a reader of printed lines confuses, folded to one sign or to a pair of signs.
FOLD = {
    "a": "e", "c": "e", "e": "e", "o": "e", "0": "e", "q": "e",
    "i": "i", "j": "i", "l": "i", "1": "i", "!": "i", "|": "i", "t": "i", "f": "i",
    "n": "n", "u": "n", "v": "n", "r": "n", "m": "nn", "w": "nn", "d": "ei",
    "b": "b", "h": "b", "k": "k", "s": "s", "5": "s", "g": "g", "9": "g", "p": "p", "x": "x", "y": "y", "z": "z",
    "2": "2", "3": "3", "4": "4", "6": "6", "7": "7", "8": "8",
}
SIGNS = "einbksgpxyz234678"
#: Signs are bytes: those of SIGNS first, all other letters of all scripts hashed to the rest.
CODES = 256
#: Walk steps (half as many signs on average) and sampled steps a table: a window is about half the shortest stretch.
STEPS, SAMPLED, SEED = 48, 36, 17
#: A candidate shares windows that begin at so many places of the passage, in so many places of the document.
SEEDS = 4
#: A smallest case has about so many windows in its stretches; this share of their steps agrees where 3 % of the letters
#: are misread; the share of such cases that is to become candidates.
PLACES, AGREEING, RECALL = 8, 0.97, 0.995


def tables_for(recall: float = RECALL, agreeing: float = AGREEING, places: int = PLACES, seeds: int = SEEDS) -> int:
    """Tables of sampled steps for a target recall: the fewest with which at least ``seeds`` of ``places`` windows meet.

    A window meets in a table if all SAMPLED steps agree, and tables are taken as independent.
    """
    from math import comb

    for tables in range(1, 65):
        p = 1 - (1 - agreeing**SAMPLED) ** tables
        if sum(comb(places, n) * p**n * (1 - p) ** (places - n) for n in range(seeds, places + 1)) >= recall:
            return tables
    return 64


TABLES = tables_for()
#: Fixed size of the key filter that documents' keys pass before they travel: 2**24 bits, 2 MB.
FILTER_BITS = 24
#: Items are looked up within the tasks that read the documents up to so many keys (16 bytes each) and bytes of passages.
INDEX_KEYS, INDEX_BYTES = 2_000_000, 1 << 26
#: A key of more documents than this is spread over several tasks.
SPREAD = 50_000
#: A stretch is a run of item words; it counts from so many words.
STRETCH, LEAST_WORDS, LEAST_SHARE = 8, 14, 0.4
#: So many signs of other columns, adverts and headlines may stand between two lines of a stretch: some ten lines.
BETWEEN = 600
GRAM = 6
#: Signs of the passage that may be unreadable between two pieces of a stretch, within a line and where other matter parts them.
UNREAD, UNREAD_APART = 14, 10
_GAP, _LETTER, _MARK, _WORD = 0, 1, 2, 3


class _Signs:
    """For every code point its kind and its first and second sign (0: none), worked out when it is first met."""

    def __init__(self):
        self.kind, self.first, self.second = (np.zeros(0x110000, np.uint8) for _ in range(3))
        self.known = np.zeros(0x110000, bool)
        self.code = {c: i + 1 for i, c in enumerate(SIGNS)}
        for c in range(0x250):
            self.put(c)

    def put(self, point: int) -> None:
        """Letters and digits of any script count, after compatibility decomposition and without case and accents.

        Signs of scripts that are written without spaces between words are words of their own.
        """
        self.known[point] = True
        char = chr(point)
        if unicodedata.category(char)[0] == "M":
            self.kind[point] = _MARK
            return
        signs = []
        for c in unicodedata.normalize("NFKD", char.casefold()).casefold():
            if c in FOLD:
                signs += [self.code[x] for x in FOLD[c]]
            elif unicodedata.category(c)[0] in "LN":
                signs.append(len(SIGNS) + 1 + ord(c) % (CODES - len(SIGNS) - 1))
        if signs:
            spaceless = 0x0E00 <= point < 0x0F00 or 0x1000 <= point < 0x10A0 or 0x1780 <= point < 0x1800 or 0x3040 <= point < 0xA000 or 0xF900 <= point < 0xFB00 or point >= 0x20000
            self.kind[point] = _WORD if spaceless else _LETTER
            self.first[point], self.second[point] = signs[0], signs[1] if len(signs) > 1 else 0

    def learn(self, points: np.ndarray) -> None:
        for c in np.unique(points[~self.known[points]]).tolist():
            self.put(c)


@lru_cache(maxsize=1)
def _signs() -> _Signs:
    return _Signs()


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fold(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points as folded signs, each with its position, and whether it begins a word.

    Spaces, line ends, hyphens and other punctuation vanish, so broken words, words run together and lines do not
    matter; case, accents and common misreadings are folded; letters of other scripts stay what they are.
    """
    table = _signs()
    table.learn(text)
    kind = table.kind[text]
    place = None
    if (kind == _MARK).any():
        place = np.flatnonzero(kind != _MARK)
        text, kind = text[place], kind[place]
    letter = kind != _GAP
    bar = (text == ord("|")) | (text == ord("!"))
    if bar.any():  # only between letters
        prev, nxt = np.r_[False, letter[:-1] & ~bar[:-1]], np.r_[letter[1:] & ~bar[1:], False]
        letter &= ~bar | (prev & nxt)
    at = np.flatnonzero(letter)
    begins = np.ones(len(at), bool)
    if len(at):
        begins[1:] = (np.diff(at) > 1) | (kind[at[1:]] == _WORD)
    one, two = table.first[text[at]], table.second[text[at]]
    twice = two > 0
    count = 1 + twice
    end = np.cumsum(count) - 1
    signs = np.repeat(one, count)
    signs[end[twice]] = two[twice]
    starts = np.zeros(len(signs), bool)
    starts[(end - count + 1)[begins]] = True
    return signs, np.repeat(at if place is None else place[at], count), starts


@lru_cache(maxsize=1)
def _walks() -> tuple[np.ndarray, np.ndarray]:
    """(steps x signs: whether the walk goes on; steps x tables: odd factors of the sampled steps, 0 for the others)."""
    rng = np.random.default_rng(SEED)
    advance = rng.integers(0, 2, (STEPS, CODES)).astype(np.int64)
    mix = np.zeros((STEPS, TABLES), np.int64)
    for k in range(TABLES):
        # The first table samples the walk's beginning: errors behind it do not matter.
        pick = np.arange(SAMPLED) if k == 0 else rng.permutation(STEPS)[:SAMPLED]
        mix[pick, k] = rng.integers(1, 2**62, SAMPLED) | 1
    return advance, mix


def window_keys(signs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, keys n x TABLES). Windows begin at every word start.

    CGK embedding: a pointer walks over the signs; step t writes the sign under it and advances by a random bit of
    (t, sign), the same for all texts. Two texts fall into step again after an edit, so a small edit distance becomes a
    small Hamming distance; each table hashes the signs written at its sampled steps.
    """
    advance, mix = _walks()
    pad = np.concatenate([signs, np.zeros(STEPS, np.uint8)])
    at = np.flatnonzero(starts)
    at = at[at < len(signs) - STEPS // 3]
    keys = np.zeros((TABLES, len(at)), np.int64)
    ptr = at.copy()
    with np.errstate(over="ignore"):
        for t in range(STEPS):
            c = pad[ptr]
            wide = c.astype(np.int64)
            for k in np.flatnonzero(mix[t]).tolist():
                keys[k] += wide * mix[t, k]
            ptr += advance[t][c]
        for k in range(TABLES):
            keys[k] ^= keys[k] >> 31
            keys[k] *= np.int64(-7046029254386353131)
            keys[k] ^= (keys[k] >> 29) + k
    return at, keys.T


_SEPARATOR = re.compile(r" {3,}[|]? *| *[|] +")


def readings(text: str) -> str:
    """A text followed by another reading of its lines, in case columns were read across.

    If lines hold column separators (three blanks or a bar), the left and then the right parts; else every other line
    and then those between. A text of one or two lines has one reading.
    """
    lines = text.split("\n")
    if len(lines) < 3:
        return text
    if "   " in text or "| " in text:
        parts = [_SEPARATOR.split(x.strip(" |"), maxsplit=1) for x in lines]
        if sum(len(p) > 1 for p in parts) > 1:
            return "\n".join([text, *(p[0] for p in parts), *(p[1] for p in parts if len(p) > 1)])
    return "\n".join([text, *lines[::2], *lines[1::2]])


def _windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, keys) of all windows of some texts, and all signs with where those of each text begin."""
    signs, pos, starts = fold(points(" ".join(texts) + " "))
    begin = np.searchsorted(pos, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
    where, keys = window_keys(signs, starts)
    return np.searchsorted(begin, where, "right") - 1, where, keys, signs, begin


def _keyed(bits: np.ndarray | None):
    """For mapInArrow over (id, text): (id, key, at) of all windows; of documents, those whose keys pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = batch.column(1).to_pylist()
                own, where, keys, *_ = _windows(texts if bits is None else [readings(t) for t in texts])
                for k in range(TABLES):
                    key, o, w = keys[:, k], own, where
                    if bits is not None and len(key):
                        slot = (key & ((1 << FILTER_BITS) - 1)).astype(np.int64)
                        hit = (bits[slot >> 3] >> (slot & 7) & 1).astype(bool)
                        key, o, w = key[hit], o[hit], w[hit]
                    if len(key):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(o)), pa.array(key), pa.array(w)], ["id", "key", "at"])

    return run


def edit_distance(a: bytes, b: bytes) -> int:
    """Levenshtein distance, bit-parallel: one machine-word-like step of whole integers for every sign of b."""
    if not a or not b:
        return len(a) + len(b)
    eq: dict[int, int] = {}
    for i, c in enumerate(a):
        eq[c] = eq.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, score = full, 0, len(a)
    for c in b:
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += bool(ph & last) - bool(mh & last)
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
    return score


def _codes(signs: np.ndarray) -> np.ndarray:
    code = np.zeros(max(0, len(signs) - GRAM + 1), np.int64)
    for i in range(GRAM):
        code = code * CODES + signs[i : i + len(code)]
    return code


class Document:
    """A document's signs with its grams in sorted order, made once for all its candidate items."""

    def __init__(self, text: str | np.ndarray):
        """text, or what it folds to."""
        signs = fold(points(text))[0] if isinstance(text, str) else text
        code = _codes(signs)
        self.text = signs.tobytes()
        self.order = np.argsort(code, kind="stable")
        self.code = code[self.order]


class Passage:
    """An item made ready for verification."""

    def __init__(self, text: str):
        self.signs, _, starts = fold(points(text))
        self.begin = np.flatnonzero(starts)
        self.words = len(self.begin)
        self.code = _codes(self.signs)
        self.word_of = np.cumsum(starts) - 1
        self.size = np.bincount(self.word_of, minlength=self.words)

    def needed(self) -> float:
        return max(LEAST_WORDS, LEAST_SHARE * self.words)

    def held(self, doc: Document) -> int:
        """Words of the passage that the document has in stretches of STRETCH or more.

        Grams in common are chained along diagonals; a chain bridges misread signs; a chain counts where its two texts
        are within a quarter of their length in edit distance. A chain goes on where the passage goes on, after at most
        BETWEEN signs of the document, so other columns, headlines and adverts do not interrupt a stretch.
        """
        lo, hi = np.searchsorted(doc.code, self.code, "left"), np.searchsorted(doc.code, self.code, "right")
        n = hi - lo
        j = np.repeat(np.arange(len(n)), n)
        # A chain of grams covers GRAM signs and one more for each further gram: too few grams cannot be enough.
        if len(j) < 2 * self.needed():
            return 0
        i = doc.order[np.repeat(lo, n) + np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n)]
        d = j - i
        order = np.lexsort((i, d))
        i, j, d = i[order], j[order], d[order]
        turn = np.flatnonzero((d[1:] != d[:-1]) | (i[1:] - i[:-1] > GRAM + 10))
        head, tail = np.concatenate([[0], turn + 1]), np.concatenate([turn, [len(i) - 1]])
        long = i[tail] - i[head] + GRAM >= 8
        head, tail = head[long], tail[long]
        reach = np.zeros(len(self.signs) + 1, np.int32)
        np.add.at(reach, j[head], 1)
        np.add.at(reach, j[tail] + GRAM, -1)
        if (np.cumsum(reach[:-1]) > 0).sum() < 0.4 * self.needed() * len(self.signs) / max(1, self.words):
            return 0
        runs = sorted(zip(i[head].tolist(), (i[tail] + GRAM).tolist(), j[head].tolist(), (j[tail] + GRAM).tolist()))
        chains: list[list[int]] = []
        open_: list[list[int]] = []
        for a, b, s, e in runs:  # an edit that adds or drops signs moves to a near diagonal
            open_ = [c for c in open_ if a - c[1] <= 14]
            for c in open_:
                if -4 <= a - c[1] and 0 <= s - c[2] and -4 <= s - c[3] <= 14 and abs((s - a) - (c[3] - c[1])) <= 4:
                    c[1], c[3] = max(b, c[1]), max(e, c[3])
                    break
            else:
                c = [a, b, s, e]
                chains.append(c)
                open_.append(c)
        chains = [c for c in chains if c[3] - c[2] >= 14]
        # Chains that are too few even if all of them count need no edit distance.
        if self._held_by(chains).sum() < self.needed():
            return 0
        text, own = doc.text, self.signs.tobytes()
        good = [c for c in chains if edit_distance(text[c[0] : c[1]], own[c[2] : c[3]]) <= 0.25 * max(c[1] - c[0], c[3] - c[2])]
        group = list(range(len(good)))
        for b, (start, _, s, _) in enumerate(good):  # chains are in document order
            for a in range(b):
                apart = start - good[a][1]
                if -4 <= apart <= BETWEEN and -4 <= s - good[a][3] <= (UNREAD if apart <= UNREAD else UNREAD_APART):
                    old, new = group[b], group[a]
                    group = [new if g == old else g for g in group]
        held = np.zeros(self.words, bool)
        for g in set(group):
            held |= self._held_by([c for k, c in enumerate(good) if group[k] == g])
        return int(held.sum())

    def _held_by(self, chains: list[list[int]]) -> np.ndarray:
        """Which words of the passage some chains hold in stretches of STRETCH or more.

        A word is held if half of it is covered: its first signs may be broken off at a line end.
        """
        edge = np.zeros(len(self.signs) + 1, np.int32)
        for c in chains:
            edge[c[2]] += 1
            edge[c[3]] -= 1
        have = np.bincount(self.word_of, weights=edge[:-1].cumsum() > 0, minlength=self.words)
        run = np.zeros(self.words + 2, np.int8)
        run[1:-1] = have * 2 >= self.size
        turn = np.flatnonzero(run[1:] != run[:-1])
        held = np.zeros(self.words, bool)
        for a, b in zip(turn[::2].tolist(), turn[1::2].tolist()):
            if b - a >= STRETCH:
                held[a:b] = True
        return held


class Index:
    """Items ready for look-up: window keys in order, with the passage and the place each belongs to, and the passages."""

    def __init__(self, item_ids: list[int], passages: list[str]):
        self.passages = sorted(set(passages))
        number = {p: i for i, p in enumerate(self.passages)}
        self.items: list[list[int]] = [[] for _ in self.passages]
        for item, p in zip(item_ids, passages):
            self.items[number[p]].append(item)
        own, where, keys, *_ = _windows(self.passages)
        flat = keys.T.ravel()
        order = np.argsort(flat, kind="stable")
        self.bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        slot = flat & ((1 << FILTER_BITS) - 1)
        np.bitwise_or.at(self.bits, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
        self.keys, self.own, self.at = flat[order], np.tile(own, TABLES)[order].astype(np.int32), np.tile(where, TABLES)[order].astype(np.int32)

    def candidates(self, texts: list[str], seeds: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(text, passage) that share windows at ``seeds`` places or more of both; and the signs of every text."""
        both = [readings(t) for t in texts]
        doc, where, keys, signs, begin = _windows(both)
        # Another reading repeats the signs of the first behind it, so as many as the text has are the text's own.
        signs = [signs[a : a + (b - a if len(t) == len(r) else (b - a) // 2)] for t, r, a, b in zip(texts, both, begin[:-1].tolist(), begin[1:].tolist())]
        pair, there, here = [], [], []
        for k in range(TABLES if len(self.keys) else 0):
            slot = keys[:, k] & ((1 << FILTER_BITS) - 1)
            hit = np.flatnonzero(self.bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            low = np.searchsorted(self.keys, keys[hit, k], "left")
            n = np.searchsorted(self.keys, keys[hit, k], "right") - low
            slot = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pair.append(np.repeat(doc[hit], n) * len(self.passages) + self.own[slot])
            there.append(np.repeat(where[hit], n))
            here.append(self.at[slot])
        if not pair:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), signs
        pair, there, here = (np.concatenate(x) for x in (pair, there, here))
        both = [_distinct(pair, x) for x in (there, here)]
        pairs = both[0][0][np.minimum(both[0][1], both[1][1]) >= seeds]
        return pairs // max(1, len(self.passages)), pairs % max(1, len(self.passages)), signs


def _distinct(pair: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in order, with how many different places each has."""
    order = np.lexsort((place, pair))
    pair, place = pair[order], place[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (place[1:] != place[:-1])
    return np.unique(pair[new], return_counts=True)


LEAKS = "doc_id long, item_id long, held int, words int"


def _leaks(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "held", "words"])


def _search(shared, seeds: int):
    """For mapInArrow over (doc_id, text): candidates are looked up and verified where the document is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = shared.value, {}
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                rows, last, doc = [], -1, None
                found, passages, signs = index.candidates(texts, seeds)
                for i, p in zip(found.tolist(), passages.tolist()):
                    if i != last:
                        last, doc = i, Document(signs[i])
                    if p not in known:
                        known[p] = Passage(index.passages[p])
                    held = known[p].held(doc)
                    if held >= known[p].needed():
                        rows += [(ids[i], item, held, known[p].words) for item in index.items[p]]
                if rows:
                    yield _leaks(rows)

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (doc_id, text, item_id, passage) in the order of documents."""
    known: dict[str, Passage] = {}
    last, doc = None, None
    for batch in batches:
        ids, texts, items, passages = (batch.column(i) for i in range(4))
        rows = []
        for i in range(batch.num_rows):
            key, passage = (ids[i].as_py(), texts[i].as_py()), passages[i].as_py()
            if key != last:
                last, doc = key, Document(key[1])
            if passage not in known:
                if len(known) > 5000:
                    known.clear()
                known[passage] = Passage(passage)
            held = known[passage].held(doc)
            if held >= known[passage].needed():
                rows.append((key[0], items[i].as_py(), held, known[passage].words))
        if rows:
            yield _leaks(rows)


def leaked_items(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", seeds: int = SEEDS, index_keys: int = INDEX_KEYS, spread: int = SPREAD) -> DataFrame:
    """(doc_id, item_id, held, words): items of which a document holds enough words in stretches of 8 or more.

    Documents and passages are folded to signs without spaces, whatever their script. Windows at word starts are
    embedded by a CGK walk and hashed by bit sampling in as many tables as ``tables_for`` the target recall; pairs that
    share windows at ``seeds`` places or more of both are verified exactly (``Passage.held``).

    Up to ``index_keys`` keys of items, the items' keys are sent to the tasks that read the documents, which look up
    and verify in one pass without a shuffle. Beyond that, documents' keys pass a filter of fixed size and are joined
    with the items' keys; keys of more than ``spread`` document windows are spread over several tasks. Both ways give
    the same rows.

    Every document and passage is processed whole. Null and blank texts hold nothing; null ids take no part; items
    with the same passage are reported each; a repeated row counts once; empty tables give an empty result. Ids must be
    integers.
    """
    passages = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(passage_col).alias("passage")).where("item_id is not null and passage is not null").distinct()
    texts = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    # No passage has more windows than characters, so this bounds the keys before any is made.
    size = passages.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0)).alias("windows"), F.coalesce(F.sum(F.octet_length("passage")), F.lit(0)).alias("bytes")).first()
    if size["windows"] * TABLES <= index_keys and size["bytes"] <= INDEX_BYTES:
        own = passages.orderBy("item_id").toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(Index(own.column(0).to_pylist(), own.column(1).to_pylist()))
        return texts.mapInArrow(_search(shared, seeds), LEAKS).dropDuplicates(["doc_id", "item_id"])
    item_keys = keep(passages.mapInArrow(_keyed(None), "id long, key long, at long").select(F.col("id").alias("item_id"), "key", F.col("at").alias("item_at")).dropDuplicates(["item_id", "key"]), "items")
    bits = _filter(item_keys)
    hits = keep(texts.mapInArrow(_keyed(bits), "id long, key long, at long").select(F.col("id").alias("doc_id"), "key", "at"), "hits")
    # Both sides of a hot key are spread: a document's windows go to one of its parts, an item's to all of them.
    heavy = hits.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > spread).select("key", F.ceil(F.col("n") / spread).cast("int").alias("parts"))
    one = F.coalesce("parts", F.lit(1))
    there = hits.join(heavy, "key", "left").withColumn("part", F.pmod(F.xxhash64("doc_id"), one).cast("int")).drop("parts")
    here = item_keys.join(heavy, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), one - 1))).drop("parts")
    seed = there.join(here, ["key", "part"]).groupBy("doc_id", "item_id").agg(F.count_distinct("at").alias("there"), F.count_distinct("item_at").alias("here"))
    found = keep(seed.where(F.least("there", "here") >= seeds).select("doc_id", "item_id"), "candidates")
    release(hits, item_keys)
    wanted = found.join(passages, "item_id").join(texts, "doc_id").select("doc_id", "text", "item_id", "passage").sortWithinPartitions("doc_id")
    leaks = keep(wanted.mapInArrow(_verify, LEAKS).dropDuplicates(["doc_id", "item_id"]), "leaks")
    release(found)
    return leaks


def _filter(item_keys: DataFrame) -> np.ndarray:
    """The items' keys as a bit set of fixed size, or-ed over tasks: one 2 MB set for each of at most 8 of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for b in batches:
            slot = b.column(0).to_numpy() & ((1 << FILTER_BITS) - 1)
            np.bitwise_or.at(bits, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    sets = item_keys.select("key").coalesce(8).mapInArrow(run, "bits binary").collect()
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for s in sets:
        out |= np.frombuffer(s["bits"], np.uint8)
    return out


def leak_report(found: DataFrame, items: DataFrame, item_col: str = "item_id", suite_col: str = "suite") -> DataFrame:
    """(suite, items, leaked, documents): how many of a suite's items leaked, and into how many document pairs."""
    hits = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    all_ = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(suite_col).alias("suite")).distinct()
    return all_.join(hits, "item_id", "left").groupBy("suite").agg(F.count(F.lit(1)).alias("items"), F.count("documents").alias("leaked"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"))
