"""Language identification by the nearest centroid of TF-IDF vectors of letter n-grams.

A text is lower-cased; runs of other characters than letters become one boundary, and there is one at each end. Its n-grams are those of 1 to N characters
that hold a letter and have no boundary inside. They are hashed to 2**BITS features; a feature found t times weighs (1 + ln t) * idf, and a text's weights have
length 1. idf comes from all texts that may teach. Of these a bounded sample of distinct texts (about per_lang a language, of least hash, and max_rows in all) is
clustered, each language in a task of its own, into CLUSTERS centroids at most by spherical k-means. A text has the language of the centroid of greatest cosine; it is
rejected where it lies farther from that centroid than the language's radius: SLACK times the distance within which RADIUS_SHARE of its sampled texts lie from
their own centroids, or LEAST_RADIUS if that is more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm import kernel as K
from quillspan.plans.scratch import Scratch

N, BITS = 3, 13
PER_LANG, MAX_ROWS = 600, 6000
CLUSTERS, ROUNDS = 4, 10
RADIUS_SHARE, SLACK, LEAST_RADIUS = 0.98, 1.25, 0.3
UNKNOWN = "und"
#: Characters of a text whose n-grams are counted at once, and rows whose counts are held at once.
CHUNK, ROWS = 1 << 18, 64
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


@dataclass(frozen=True)
class Model:
    """idf of each feature; centroids as columns, with the language and its radius of each. Without a language every text is unknown."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list
    radius: np.ndarray


def _stream(data: bytes) -> np.ndarray:
    """The characters of a text, each run of others than letters being one 0, as are both ends."""
    code = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    code = np.concatenate([[0], np.where(_is_letter()[code], code, 0), [0]]).astype(np.uint32)
    stay = np.ones(len(code), bool)
    stay[1:] = (code[1:] > 0) | (code[:-1] > 0)
    return code[stay]


def _grams(stream: np.ndarray, row: np.ndarray, begins: int, n: int, bits: int) -> np.ndarray:
    """row * 2**bits + feature of each 1- to n-gram that begins among the first characters of a stream. Texts begin and end with 0, so none leaves its own."""
    code, letter, out = stream.astype(np.uint64) + K.U(1), stream > 0, []
    for k in range(1, min(n, len(stream)) + 1):
        m = min(begins, len(stream) - k + 1)
        fits = letter[:m] | letter[k - 1 : m + k - 1] if k < 3 else np.logical_and.reduce([letter[j : m + j] for j in range(1, k - 1)])
        at = np.flatnonzero(fits)
        h = np.full(len(at), k, np.uint64)
        for j in range(k):
            h += code[at + j] * _PRIMES[j]
        out.append((row[at] << bits) | (K.mix(h) >> K.U(64 - bits)).astype(np.int64))
    return np.concatenate(out)


def counted(data: np.ndarray, offsets: np.ndarray, n: int = N, bits: int = BITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows of lower-cased texts: first row, row after the last, the features in them, their counts, and the rows' offsets into both."""
    rows = len(offsets) - 1
    for i in range(0, rows, ROWS):
        j = min(rows, i + ROWS)
        total = np.zeros((j - i) << bits, np.int64)
        streams = [_stream(data[offsets[r] : offsets[r + 1]].tobytes()) for r in range(i, j)]
        row = np.repeat(np.arange(j - i), [len(s) for s in streams])
        code = np.concatenate(streams)
        for a in range(0, len(code), CHUNK):
            b = a + CHUNK + n - 1  # n-grams that begin in a chunk may end in the next
            total += np.bincount(_grams(code[a:b], row[a:b], CHUNK, n, bits), minlength=len(total))
        at = np.flatnonzero(total)
        yield i, j, at & ((1 << bits) - 1), total[at], np.searchsorted(at >> bits, np.arange(j - i + 1))


def weighted(feature: np.ndarray, count: np.ndarray, at: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of the features of each row, of length 1; a row's don't depend on others."""
    value, row = (1 + np.log(count)) * idf[feature], K.row_of(at)
    return value / np.sqrt(np.bincount(row, value * value, len(at) - 1))[row]


def _frequencies(texts: DataFrame, n: int, bits: int) -> tuple[int, np.ndarray]:
    """How many texts hold a letter, and how many hold each feature."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for _, _, data, offsets in K.blocks(batch.column(0)):
                for _, _, feature, _, at in counted(data, offsets, n, bits):
                    df += np.bincount(feature, minlength=1 << bits)
                    rows += int((np.diff(at) > 0).sum())
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1).astype(np.int32)), pa.array(np.append(df[found], rows))], ["feature", "n"])

    out, rows = np.zeros(1 << bits, np.int64), 0
    for r in texts.mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toLocalIterator():  # 2**bits rows at most
        if r.feature < 0:
            rows = r.n
        else:
            out[r.feature] = r.n
    return rows, out


def clusters(vectors: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """At most k unit centroids of unit rows by spherical k-means, and the cluster of each row; begun by squared distance, the same in every run."""
    rng = np.random.Generator(np.random.PCG64(seed))
    centre = vectors.mean(axis=0)
    centres = [centre / np.linalg.norm(centre)]
    while len(centres) < min(k, len(vectors)):
        far = np.maximum(1 - (vectors @ np.array(centres).T).max(axis=1), 0) ** 2
        if far.sum() <= 1e-18:
            break
        centres.append(vectors[int(np.searchsorted(np.cumsum(far), rng.random() * far.sum()).clip(0, len(far) - 1))])
    centres = np.array(centres)
    own = np.full(len(vectors), -1)
    for _ in range(rounds):
        now = (vectors @ centres.T).argmax(axis=1)
        if (now == own).all():
            break
        own = now
        total = np.zeros_like(centres)
        np.add.at(total, own, vectors)
        size = np.linalg.norm(total, axis=1)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1e-300)[:, None], centres)
    own = (vectors @ centres.T).argmax(axis=1)
    used = np.unique(own)
    return centres[used], np.searchsorted(used, own)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, max_rows: int = MAX_ROWS, n_clusters: int = CLUSTERS, n: int = N, bits: int = BITS) -> Model:
    """A model of all rows of docs with a language and a text that holds a letter; see the module.

    Equal texts of one language teach once. The model holds at most n_clusters centroids a language and max_rows in all, of 2**bits numbers.
    """
    scratch = Scratch(docs.sparkSession, "language")
    texts = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.lower(text_col).alias("text")).where(F.col("text").rlike(r"\p{L}"))
    rows, df = _frequencies(texts.select("text"), n, bits)
    idf = np.log((1 + rows) / (1 + df)) + 1

    hashed = texts.select("lang", F.xxhash64("text").alias("h"))
    share = F.shiftrightunsigned("h", 11) / float(1 << 53)
    sizes = scratch.write(hashed.groupBy("lang").agg(F.count("*").alias("rows")), "sizes")  # written, so that the planner knows how few they are
    keys = hashed.join(sizes, "lang").where(share * F.col("rows") < per_lang).select("lang", "h").distinct()
    keys = scratch.write(keys.orderBy(F.shiftrightunsigned("h", 11), "h", "lang").limit(max_rows), "sample")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, offsets in K.blocks(batch.column(2)):
                for a, b, feature, count, at in counted(data, offsets, n, bits):
                    value = weighted(feature, count, at, idf)
                    lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v)) for v in (feature.astype(np.int32), value)]
                    yield pa.RecordBatch.from_arrays([*(c.slice(i + a, b - a) for c in batch.columns[:2]), *lists], ["lang", "h", "f", "v"])

    def cluster(table: pa.Table) -> pa.Table:
        table = table.sort_by("h").combine_chunks()
        x = np.zeros((table.num_rows, 1 << bits))
        seen: dict = {}
        for r, (h, f, v) in enumerate(zip(table["h"].to_pylist(), table["f"], table["v"], strict=True)):
            if h not in seen:
                seen[h] = r
                x[r, np.asarray(f.values)] = np.asarray(v.values)
        x = x[sorted(seen.values())]
        centres, own = clusters(x, n_clusters)
        radius = max(LEAST_RADIUS, SLACK * float(np.quantile(1 - (x * centres[own]).sum(axis=1), RADIUS_SHARE)))
        out = []
        for c, centre in enumerate(centres):
            found = np.flatnonzero(centre)
            out.append((table["lang"][0].as_py(), c, found.astype(np.int32), centre[found], radius))
        kinds = [table.schema.field("lang").type, pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.float64()]
        return pa.table([pa.array(list(col), kind) for col, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=["lang", "c", "f", "v", "radius"])

    # max_rows bounds the keys, and about per_lang texts meet in a task
    chosen = texts.select("lang", F.xxhash64("text").alias("h"), "text").join(F.broadcast(keys), ["lang", "h"])
    made = scratch.write(chosen.mapInArrow(weigh, "lang string, h long, f array<int>, v array<double>").dropDuplicates(["lang", "h"]), "weights")
    rows_ = sorted(made.groupBy("lang").applyInArrow(cluster, "lang string, c int, f array<int>, v array<double>, radius double").collect(), key=lambda r: (r.lang.encode(), r.c))
    scratch.close()
    centroids = np.zeros((1 << bits, len(rows_)))
    for c, r in enumerate(rows_):
        centroids[r.f, c] = r.v
    return Model(idf, centroids, [r.lang for r in rows_], np.array([r.radius for r in rows_]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, reject: bool = False, n: int = N) -> DataFrame:
    """id_col, any columns in keep, lang_pred, score (the cosine, 0 to 1) and rejected for each row of docs.

    rejected: the text lies outside its language's radius around the nearest centroid; with reject its lang_pred is then UNKNOWN. A text that is null or has no letter is
    UNKNOWN, with score 0, and rejected. Of centroids equally near, that of the least language by code point counts. Repeated rows give repeated rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [id_col, *(keep or [])]
    bits = int(np.log2(len(model.idf)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        langs = pa.array([*m.langs, UNKNOWN], pa.string())
        for batch in batches:
            for i, _, data, offsets in K.blocks(batch.column(0)):
                for a, b, feature, count, at in counted(data, offsets, n, bits):
                    x = np.zeros((b - a, 1 << bits))
                    x[K.row_of(at), feature] = weighted(feature, count, at, m.idf)
                    near, score = np.full(b - a, len(m.langs)), np.zeros(b - a)
                    wordy = np.diff(at) > 0
                    if m.langs and wordy.any():
                        cosine = np.round(x @ m.centroids, 9).clip(0, 1)
                        near[wordy] = cosine.argmax(axis=1)[wordy]
                        score[wordy] = cosine.max(axis=1)[wordy]
                    rejected = 1 - score > np.append(m.radius, -1.0)[near]
                    lang = np.where(rejected & reject, len(m.langs), near)
                    yield pa.RecordBatch.from_arrays([*(c.slice(i + a, b - a) for c in batch.columns[1:]), langs.take(pa.array(lang)), pa.array(score), pa.array(rejected)], [*names, "lang_pred", "score", "rejected"])

    source = docs.select(F.lower(text_col).alias("_text"), *(F.col(c) for c in names))
    schema = T.StructType([*source.schema.fields[1:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return source.mapInArrow(judge, schema)


def held_out(id_col: str) -> Column:
    """True for ids that never teach: crc32 of the id as text leaves 1 by 3. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per row of docs: id_col, held_out, lang_pred, score, rejected; see fit and identify. lang_pred is the nearest language, rejected or not."""
    model = fit(docs.where(~held_out(id_col)), text_col, lang_col, per_lang, max_rows)
    return identify(docs, model, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "rejected")
