"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

Tokens are runs of letters, digits and non-ASCII characters (A-Z lower-cased) and runs of one other
character. Uni- and bigrams are hashed to 2**BITS features, counted, and a document's counts are scaled to length 1. Training reads
a bounded, hash-chosen sample of labelled documents on the driver (max_rows of them, and of these as many as have max_features features together);
scoring is a sparse dot product per document, with one float for each feature sent to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm import kernel as K
from quillspan.plans.scratch import Scratch

BITS = 18
MAX_ROWS = 6000
#: Features (8 bytes each) of all sampled documents together that the driver gathers at most.
MAX_FEATURES = 30_000_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.6, 1.0, 0.002, 0.1
THRESHOLD = 0.3

_KIND = np.full(256, 3, np.int16)  # 0 space, 1 word, else a kind for each character
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[33:128] = np.arange(33, 128) + 100
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, their scaled counts, and the rows' offsets into both."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(n + 1, np.int64)
    kind = _KIND[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    change = np.ones(len(data), bool)
    change[1:] = (kind[1:] != kind[:-1]) | first[1 : len(data)]
    edges = np.flatnonzero(change)
    ends = np.append(edges[1:], len(data))
    word = kind[edges] > 0
    starts, ends = edges[word], ends[word]
    hashes = K._hash_runs(data, starts, ends, K._BYTE_LOWER)
    at = np.searchsorted(starts, offsets)
    pairs, begin, _ = K.shingles(hashes, at, 2, short=False)
    row = np.concatenate([K.row_of(at), K.row_of(begin)]).astype(np.int64)
    number = np.concatenate([hashes, pairs]) >> K.U(64 - bits)
    key = np.sort((row << bits) | number.astype(np.int64))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    place = np.flatnonzero(new)
    count = np.diff(np.append(place, len(key))).astype(np.float64)
    key = key[place]
    to = np.searchsorted(key >> bits, np.arange(n + 1))
    norm = np.sqrt(K.sums(count * count, to))
    return key & ((1 << bits) - 1), count / norm[key >> bits], to


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, float]:
    """Weights and bias after epochs passes over (label, features, values) in the order given."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last is the bias
    last = 1 << bits

    def weight(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    def learn(i, w, g):
        z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
        n[i] += g * g

    for _ in range(epochs):
        for y, i, x in rows:
            w, bias = weight(i), weight(last)
            p = 1 / (1 + np.exp(-np.clip(w @ x.astype(np.float64) + bias, -35, 35)))
            learn(i, w, (p - y) * x.astype(np.float64))
            learn(last, bias, p - y)
    w = weight(np.arange(last + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, bits: int = BITS, max_features: int = MAX_FEATURES) -> tuple[np.ndarray, float]:
    """A model from at most max_rows labelled documents, those of the least hash of their id, and max_features features of theirs.

    Each id's label is 1 if at least half of its labels are; null ids and labels teach nothing, nor do labels without a document. Of an id's texts
    the one of the least hash is used. Documents beyond max_features in the order of the hash teach nothing (a document has 2**bits features at most).
    Without any labelled text the model is all zero and scores 0.5.
    """
    each = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    there = docs.select(F.col(id_col).alias("id")).join(each, "id").distinct()
    scratch = Scratch(docs.sparkSession, "training")
    sample = scratch.write(there.orderBy(F.xxhash64("id"), "id").limit(max_rows), "sample")  # labels without a document take no place

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in K.blocks(batch.column(3)):
                number, value, at = features(data, offsets, bits)
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v)) for v in (number.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(3)), *lists], ["id", "y", "h", "f", "v"])

    # max_rows bounds what is broadcast here; sizes come first, so that the driver gathers no more than max_features
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("id", "y", F.xxhash64("text").alias("h"), "text")
    kind = docs.schema[id_col].dataType.simpleString()
    made = scratch.write(chosen.mapInArrow(count, f"id {kind}, y int, h long, f array<int>, v array<float>"), "features")
    least: dict = {}  # of each id the hash and size of the text that teaches
    for r in made.groupBy("id", "h").agg(F.max(F.size("f")).alias("n")).toLocalIterator():
        if r.id not in least or r.h < least[r.id][0]:
            least[r.id] = (r.h, r.n)
    fit_in, total = [], 0
    for (i,) in sample.orderBy(F.xxhash64("id"), "id").select("id").collect():
        total += least[i][1]
        if total > max_features:
            break
        fit_in.append((i, least[i][0]))
    rows: dict = {}  # views into the gathered columns, which are never copied
    if fit_in:
        picked = docs.sparkSession.createDataFrame(fit_in, f"id {kind}, h long")
        for batch in made.join(F.broadcast(picked), ["id", "h"]).select("id", "y", "f", "v").toArrow().to_batches():
            f, v, at = np.asarray(batch.column(2).values), np.asarray(batch.column(3).values), np.asarray(batch.column(2).offsets)
            for k, (i, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                rows[i] = (y, f[at[k] : at[k + 1]], v[at[k] : at[k + 1]])  # equal texts have equal features
    scratch.close()
    order = np.random.Generator(np.random.PCG64(7)).permutation(len(rows))
    ids = sorted(rows)
    return train([rows[ids[k]] for k in order], bits)


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """id_col, any columns in keep, score and predicted (1 if score >= threshold) for each row of docs.

    Null and wordless texts have the score of the bias alone. Repeated rows give repeated rows.
    """
    weights, bias = model
    bits = int(np.log2(len(weights)))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    keep = keep or []

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for i, j, data, offsets in K.blocks(batch.column(0)):
                number, value, at = features(data, offsets, bits)
                p = 1 / (1 + np.exp(-np.clip(K.sums(w[number] * value, at) + bias, -35, 35)))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[1:]), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    names = [id_col, *keep]
    source = docs.select(F.col(text_col).alias("_text"), *(F.col(c) for c in names))
    schema = T.StructType([*source.schema.fields[1:], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return source.mapInArrow(judge, schema)


def held_out(id_col: str):
    """True for ids that never teach: crc32 of the id as text is a multiple of 5. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per row of docs: id_col, held_out, score (0 to 1, higher: label 1 likelier), predicted. See fit and score."""
    model = fit(docs, labels.where(~held_out(id_col)), id_col, text_col, label_col, max_rows)
    return score(docs, model, id_col, text_col, threshold=threshold).select(id_col, held_out(id_col).alias("held_out"), "score", "predicted")
