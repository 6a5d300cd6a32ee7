"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

For each benchmark item of L words, the windows of L words of a document (a shorter document is one window) have a
128-bit SimHash of their 5-word shingles, read off running sums. The nth occurrence of a shingle in a window is an element of its own
there, so that fingerprints follow the similarity of multisets and no repeated shingle outweighs the rest. Fingerprints of items are indexed
by length in BLOCK_COUNT blocks of 64 bits; a lookup takes the items that are within BLOCK_RADIUS bits in some block: by the pigeonhole principle
these are all within RADIUS = 2 * (20 + 1) - 1 = 41 bits, and of unlike items only about 0.4 %. Blocks are compared as words of all
items of the length at once. Items within RADIUS are verified exactly: the shingles' multiset similarity (sum of least counts over sum of
greatest) must be 75 % or more. Such windows have a mean distance under 23 bits (deviation 4.4) from their item, so one is lost with a chance of
about 1 in 50,000, and an exact copy never.

Windows that share no shingle with any item have similarity 0 and aren't fingerprinted. Sums run over at most CHUNK starts at once,
whatever the lengths of texts and items. The benchmark is handled in blocks of bounded size, each sent to all executors, where a worker makes
its index once; documents are read once a block, in map tasks only, without any shuffle of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillspan.llm import kernel as K

SHINGLE, PERCENT = 5, 75
BLOCK_COUNT, BLOCK_RADIUS = 2, 20
RADIUS = BLOCK_COUNT * (BLOCK_RADIUS + 1) - 1
#: Words of benchmark items sent to the executors at once.
WORDS_AT_ONCE = 1_000_000
#: Window starts, and shingles, whose signs are summed at once.
CHUNK = 4096


def _signs(elements: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 128 bits of the elements: (elements, 128)."""
    both = np.stack([elements, K.mix(elements ^ K.U(0xD1B54A32D192ED03))], axis=1)
    return (np.unpackbits(both.view(np.uint8), axis=1).astype(np.int8) << 1) - 1


def _total(elements: np.ndarray) -> np.ndarray:
    out = np.zeros(64 * BLOCK_COUNT, np.int64)
    for i in range(0, len(elements), CHUNK):
        out += _signs(elements[i : i + CHUNK]).sum(axis=0, dtype=np.int64)
    return out


def _places(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by value and place, the place of each shingle in this order, and the first place there of its value."""
    order = np.argsort(shingles, kind="stable")
    each = np.arange(len(order))
    fresh = np.ones(len(order), bool)
    fresh[1:] = shingles[order[1:]] != shingles[order[:-1]]
    at, first = np.empty_like(each), np.empty_like(each)
    at[order] = each
    first[order] = np.maximum.accumulate(np.where(fresh, each, 0))
    return order, at, first


def _nth(shingles: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The element that the nth occurrence (from 0) of each shingle is; the first one is the shingle."""
    return np.where(nth == 0, shingles, K.mix(shingles + nth.astype(np.uint64) * K.U(0x9E3779B97F4A7C15)))


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The 128 bits as two words."""
    _, at, first = _places(shingles)
    return _pack(_total(_nth(shingles, at - first))[None])[0]


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64)


def _repeats(shingles: np.ndarray, windows: int, n: int) -> tuple[np.ndarray, np.ndarray] | None:
    """What later occurrences of a shingle change in the sums of n windows that count each as a first one.

    The change for the first window, and those from each window to the next (n - 1 x 128); None if no shingle comes twice.
    """
    order, at, first = _places(shingles)
    size = len(shingles)
    twice = np.flatnonzero(np.bincount(first, minlength=size)[first] > 1)
    if not len(twice):
        return None
    key = first[order] * (size + 1) + order
    base = first[twice] * (size + 1)
    entry = np.maximum(twice - windows + 1, 0)  # the first window that holds it
    came = at[twice] - np.searchsorted(key, base + entry)  # as its nth occurrence
    went = np.searchsorted(key, base + np.minimum(twice + windows, size)) - at[twice] - 1  # leaving, it takes the last one along
    begin, nth, sign = np.concatenate([entry, twice + 1]), np.concatenate([came, went]), np.repeat(np.array([1, -1], np.int8), len(twice))
    x = np.concatenate([shingles[twice], shingles[twice]])
    some = np.flatnonzero((nth > 0) & (begin < n))
    begin, nth, sign, x = begin[some], nth[some], sign[some], x[some]
    start, steps = np.zeros(64 * BLOCK_COUNT, np.int64), np.zeros((n - 1, 64 * BLOCK_COUNT), np.int32)
    for i in range(0, len(x), CHUNK):
        part = slice(i, i + CHUNK)
        change = (_signs(_nth(x[part], nth[part])) - _signs(x[part])) * sign[part, None]
        now = begin[part] == 0
        start += change[now].sum(axis=0, dtype=np.int64)
        np.add.at(steps, begin[part][~now] - 1, change[~now])
    return start, steps


def window_marks(shingles: np.ndarray, windows: int, starts: np.ndarray) -> np.ndarray:
    """Fingerprints of the windows of so many shingles that begin at starts (in order): (starts, 2)."""
    low, n = int(starts[0]), int(starts[-1] - starts[0]) + 1
    part = shingles[low : low + n - 1 + windows]
    sums = np.empty((n, 64 * BLOCK_COUNT), np.int64)
    sums[0] = _total(part[:windows])
    steps = _signs(part[windows:]).astype(np.int32) - _signs(part[: n - 1])
    more = _repeats(part, windows, n)
    if more is not None:
        sums[0] += more[0]
        steps += more[1]
    np.cumsum(steps, axis=0, out=sums[1:])
    sums[1:] += sums[0]
    return _pack(sums[starts - low])


def _runs(starts: np.ndarray, windows: int) -> Iterator[np.ndarray]:
    """Starts in runs of CHUNK places at most, cut where a gap is wider than a window."""
    cut = np.flatnonzero(np.diff(starts) > windows) + 1
    for run in np.split(starts, cut):
        i = 0
        while i < len(run):
            j = int(np.searchsorted(run, run[i] + CHUNK))
            yield run[i:j]
            i = j


class Index:
    """Items by length, with their shingle counts and their fingerprints in blocks of words."""

    def __init__(self, ids: list, texts: list[str | None], shingle: int):
        self.ids, self.shingle = [], shingle
        self.size: list[int] = []
        self.bags: list[tuple[np.ndarray, np.ndarray]] = []
        prints, every = [], []
        for i, j, data, offsets in K.blocks(pa.array(texts, pa.string())):
            hashes, at, _, _ = K.words(data, offsets, lower=True)
            found, begin, _ = K.shingles(hashes, at, shingle)
            for r in range(j - i):
                own = found[begin[r] : begin[r + 1]]
                if not len(own):
                    continue
                self.ids.append(ids[i + r])
                self.size.append(int(at[r + 1] - at[r]))
                self.bags.append(np.unique(own, return_counts=True))
                prints.append(fingerprint(own))
                every.append(own)
        size = np.array(self.size, np.int64)
        self.lengths = np.unique(size).tolist()
        self.of_length = {n: np.flatnonzero(size == n) for n in self.lengths}
        self.blocks = {n: [np.array([prints[k][b] for k in at], np.uint64) for b in range(BLOCK_COUNT)] for n, at in self.of_length.items()}
        self.known = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        self.seen = np.zeros(1 << 22, bool)  # a first look: the top bits of known shingles
        self.seen[(self.known >> K.U(42)).astype(np.int64)] = True

    def has(self, shingles: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.seen[(shingles >> K.U(42)).astype(np.int64)])
        values = shingles[maybe]
        at = np.minimum(np.searchsorted(self.known, values), max(0, len(self.known) - 1))
        return maybe[self.known[at] == values] if len(self.known) else maybe[:0]

    def near(self, size: int, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Windows and items of this size within RADIUS of each other, and how many pairs the blocks let through before."""
        items, blocks = self.of_length[size], self.blocks[size]
        windows, found, looked = [], [], 0
        step = max(1, (1 << 20) // len(items))
        for i in range(0, len(marks), step):
            some = marks[i : i + step]
            close = np.zeros((len(some), len(items)), bool)
            for b in range(BLOCK_COUNT):
                close |= np.bitwise_count(some[:, b, None] ^ blocks[b]) <= BLOCK_RADIUS
            w, k = np.nonzero(close)
            looked += len(w)
            off = sum(np.bitwise_count(some[w, b] ^ blocks[b][k]).astype(np.int64) for b in range(BLOCK_COUNT))
            windows.append(w[off <= RADIUS] + i)
            found.append(items[k[off <= RADIUS]])
        return np.concatenate(windows), np.concatenate(found), looked

    def matches(self, hashes: np.ndarray, percent: int) -> dict[int, tuple[float, int]]:
        """Items that some window of one document reaches: the best similarity and its first window's first word."""
        best: dict[int, tuple[float, int]] = {}
        full, _, _ = K.shingles(hashes, np.array([0, len(hashes)]), self.shingle, short=False)
        full_hits = self.has(full)
        for size in self.lengths:
            held = min(size, len(hashes))  # a document shorter than the item is one window
            if held < min(size, self.shingle):
                break
            if size < self.shingle:  # an item shorter than a shingle is its whole sequence
                found, windows = _short(hashes, size), 1
                hits = self.has(found)
            else:
                found, windows, hits = full, held - self.shingle + 1, full_hits
                if 100 * windows < percent * (size - self.shingle + 1):
                    break
            if not len(hits):
                continue
            last = len(found) - windows
            wanted = np.zeros(last + 2, np.int32)
            np.add.at(wanted, np.minimum(np.maximum(hits - windows + 1, 0), last + 1), 1)
            np.add.at(wanted, np.minimum(hits, last) + 1, -1)
            for at in _runs(np.flatnonzero(np.cumsum(wanted[:-1]) > 0), windows):
                w, items, _ = self.near(size, window_marks(found, windows, at))
                for x, item in zip(at[w].tolist(), items.tolist(), strict=True):
                    value = self._similarity(found[x : x + windows], item)
                    if 100 * value >= percent and value > best.get(item, (0.0, 0))[0]:
                        best[item] = (value, x)
        return best

    def _similarity(self, window: np.ndarray, item: int) -> float:
        values, counts = self.bags[item]
        own, times = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(values, own), len(values) - 1)
        least = int(np.where(values[at] == own, np.minimum(counts[at], times), 0).sum())
        return least / (len(window) + int(counts.sum()) - least)


def _short(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows of size words, as kernel.shingles gives them for whole short texts."""
    n = len(hashes) - size + 1
    x = np.full(n, int(K._PLACE[7]) * size % (1 << 64), np.uint64)
    for j in range(size):
        x += hashes[j : n + j] * K._PLACE[j]
    return K.mix(x)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id_col, item_id, similarity, start_word, n_words): the best window of each document for each item that it holds.

    Words are lower-cased for A-Z. Of equally similar windows the first counts; start_word counts from 0, n_words is the window's length. Items with the
    same text are separate items. Null, empty and wordless texts and items hold and match nothing; an item shorter than a shingle matches where its whole sequence stands.
    Repeated rows of docs give repeated rows. Only the named columns are read. Blocks of items stay with the driver and the executors
    until the result has been read.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, item_id {item_kind}, similarity double, start_word long, n_words long"
    out = None
    for ids, texts in _item_blocks(benchmark, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts))
        part = source.mapInArrow(_searcher(shared, shingle, percent, to_arrow_type(benchmark.schema[item_col].dataType)), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_col)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose text holds no item, as find_leaks finds them, with all columns of docs.

    Each row is judged by its own text, so ids don't matter: they may be null or shared, and columns may have any names.
    """
    rows = docs
    for ids, texts in _item_blocks(benchmark, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts))
        source = rows.select(F.col(text_col).alias("text"), F.struct(*(F.col(c) for c in docs.columns)).alias("row"))
        schema = T.StructType([source.schema["row"]])
        rows = source.mapInArrow(_filter(shared, shingle, percent), schema).select("row.*")
    return rows


def _item_blocks(benchmark: DataFrame, item_col: str, item_text: str) -> Iterator[tuple[list, list]]:
    """Items in blocks of about WORDS_AT_ONCE words."""
    ids: list = []
    texts: list = []
    words = 0
    for r in benchmark.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")).toLocalIterator():
        if r.t is None:
            continue
        ids.append(r.i)
        texts.append(r.t)
        words += r.t.count(" ") + 1
        if words >= WORDS_AT_ONCE:
            yield ids, texts
            ids, texts, words = [], [], 0
    if ids:
        yield ids, texts


def _index(shared, shingle: int) -> Index:
    """The index of a block of items, made once by each worker."""
    made = getattr(shared, "_made", None)
    if made is None or made[0] != shingle:
        made = shared._made = (shingle, Index(*shared.value, shingle))
    return made[1]


def _leaks(index: Index, column: pa.Array, percent: int) -> Iterator[tuple[int, int, dict[int, tuple[float, int]]]]:
    """Rows of a text column that hold items, their words, and the items as Index.matches gives them."""
    short = index.lengths and index.lengths[0] < index.shingle
    for i, _, data, offsets in K.blocks(column):
        hashes, at, _, _ = K.words(data, offsets, lower=True)
        found, begin, _ = K.shingles(hashes, at, index.shingle)
        todo = np.flatnonzero(np.diff(at)) if short else np.unique(np.searchsorted(begin, index.has(found), "right") - 1)
        for r in todo.tolist():
            if matches := index.matches(hashes[at[r] : at[r + 1]], percent):
                yield i + r, int(at[r + 1] - at[r]), matches


def _searcher(shared, shingle: int, percent: int, item_type: pa.DataType):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared, shingle)
        for batch in batches:
            found = [(r, index.ids[item], value, s, min(index.size[item], n)) for r, n, matches in _leaks(index, batch.column(1), percent) for item, (value, s) in sorted(matches.items())]
            if found:
                row, item, value, start, size = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(item, item_type), pa.array(value, pa.float64()), pa.array(start, pa.int64()), pa.array(size, pa.int64())], ["id", "item_id", "similarity", "start_word", "n_words"])

    return search


def _filter(shared, shingle: int, percent: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared, shingle)
        for batch in batches:
            stay = np.ones(batch.num_rows, bool)
            stay[[r for r, _, _ in _leaks(index, batch.column(0), percent)]] = False
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(stay))], ["row"])

    return clean
