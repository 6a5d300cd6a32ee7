"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find groups.

Per document, one pass over the whole text makes the shingle set's size, a 128-bit fingerprint of the set
and the signature's bands (see ``superminhash``). Equal sets collapse into one class, so exact copies are
never paired. Classes that share a band are candidates. They are verified on full sets, first each against
the class that it shares most bands with, then all pairs whose classes no verified link connects yet:
a pair inside a group can't change the group. Of those, exact bounds on the intersection (set sizes, and shingles that only
one candidate has) leave out pairs that can't reach the similarity, and so do signatures that agree in fewer than
``least_agreeing`` of 256 values: a pair of similarity 0.75 does so with a chance of 3e-6. No bucket, group or partner list is capped.

With 32 bands of 4 values a pair of similarity 0.75 is missed with a probability of 5e-6. ``every_candidate`` leaves the signatures' estimate out,
so that only banding can miss a pair. Equal sets are told by 128-bit fingerprints: two unlike sets meet with a chance of 2**-128 a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm import kernel as K
from quillspan.llm.graph import components
from quillspan.llm.ranked import is_integral, numbered
from quillspan.plans.scratch import Scratch

#: Values of a signature; the first BANDS * BAND_ROWS make the bands, all serve to estimate similarity.
VALUES = 256
BANDS, BAND_ROWS = 32, 4
SHINGLE, PERCENT = 5, 75
#: Shingles ranked at once.
PART = 1 << 17


def superminhash(hashes: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (rows x m) of the rows' elements.

    Each element ranks the m components by a random permutation (Fisher-Yates on hashed draws); at rank j
    it offers component p[j] the value j + r, and components keep the least. The ranks go in lockstep over all
    rows; a row stops as soon as every component's value lies below the next rank. Values are (j << 32) + r.
    """
    rows = len(at) - 1
    out = np.full(rows * m, np.iinfo(np.uint64).max, np.uint64)
    live, row = hashes, K.row_of(at)
    places = None
    for j in range(m):
        draw = K.mix(live + K.U((j + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64)))
        pick = (j + (((draw & K.U(0xFFFFFFFF)) * K.U(m - j)) >> K.U(32)).astype(np.int64)).astype(np.int64)
        if j == 0:
            slot = pick
        else:
            each = np.arange(len(live))
            slot = places[each, pick].astype(np.int64)
            places[each, pick] = places[:, j]
        np.minimum.at(out, row * m + slot, (K.U(j) << K.U(32)) + (draw >> K.U(32)))
        worst = (out.reshape(rows, m).max(axis=1) >> K.U(32)) > K.U(j)
        keep = worst[row]
        if not keep.any():
            break
        if j == 0:
            live, row, pick = live[keep], row[keep], pick[keep]
            places = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(live), 1))
            places[np.arange(len(live)), pick] = 0
        elif keep.sum() < 0.7 * len(keep):
            live, row, places = live[keep], row[keep], places[keep]
    return out.reshape(rows, m)


def _sets(column: pa.Array, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, _, data, offsets in K.blocks(column):
        hashes, at, _, _ = K.words(data, offsets, lower=True)
        found, begin, _ = K.shingles(hashes, at, shingle)
        yield K.distinct(found, begin)


def _sketcher(shingle: int, bands: int, band_rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = max(VALUES, bands * band_rows)
        for batch in batches:
            done = 0
            for values, begin in _sets(batch.column(1), shingle):
                n = len(begin) - 1
                keys, packed = np.empty((n, bands), np.uint64), np.empty((n, m // 16), np.uint64)
                i = 0
                while i < n:
                    j = max(i + 1, int(np.searchsorted(begin, begin[i] + PART, "right")) - 1)
                    sig = superminhash(values[begin[i] : begin[j]], begin[i : j + 1] - begin[i], m)
                    part = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None], j - i, axis=0)
                    for k in range(band_rows):
                        part = K.mix(part * K.U(0x9E3779B97F4A7C15) + sig[:, k : bands * band_rows : band_rows])
                    keys[i:j] = part
                    nibbles = (K.mix(sig) >> K.U(60)).reshape(j - i, m // 16, 16)
                    packed[i:j] = (nibbles << (np.arange(16, dtype=np.uint64) * K.U(4))).sum(axis=2, dtype=np.uint64)
                    i = j
                size = np.diff(begin)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32), pa.array(keys[size > 0].ravel().view(np.int64)))
                short = pa.ListArray.from_arrays(np.arange(0, n * (m // 16) + 1, m // 16, dtype=np.int32), pa.array(packed.ravel().view(np.int64)))
                print_a, print_b = K.sums(K.mix(values), begin), K.sums(K.mix(values ^ K.U(0x5851F42D4C957F2D)), begin)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, n), pa.array(size.astype(np.int64)), pa.array(print_a.view(np.int64)), pa.array(print_b.view(np.int64)), lists, short], ["id", "n", "fa", "fb", "bands", "sig"])
                done += n

    return sketch


def _set_maker(shingle: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for values, begin in _sets(batch.column(1), shingle):
                n = len(begin) - 1
                print_a, print_b = K.sums(K.mix(values), begin), K.sums(K.mix(values ^ K.U(0x5851F42D4C957F2D)), begin)
                lists = pa.ListArray.from_arrays(begin.astype(np.int32), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, n), pa.array(print_a.view(np.int64)), pa.array(print_b.view(np.int64)), lists], ["id", "fa", "fb", "items"])
                done += n

    return make


def least_agreeing(percent: int, m: int) -> int:
    """Fewest agreeing 4-bit signature values that a pair of the least similarity has, but for a chance of 3e-6 (4.5 deviations)."""
    p = percent / 100 + (1 - percent / 100) / 16
    return math.floor(m * p - 4.5 * math.sqrt(m * p * (1 - p)))


def _agreeing(marks: list[str]) -> Column:
    """Agreeing values of two signatures, 16 of 4 bits in each long."""
    out = F.lit(16 * len(marks))
    for c in marks:
        x = F.col(f"x{c}").bitwiseXOR(F.col(f"y{c}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(0x1111111111111111)
        out = out - F.bit_count(x)
    return out


def near_dup_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, band_rows: int = BAND_ROWS, every_candidate: bool = False) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (least id of its group), kept (id = component_id).

    docs may have any other columns; the result has only these four, the first under the name id_col. Ids are whole numbers, or anything that sorts
    (strings by code point). Words are lower-cased for A-Z; a text with fewer words than a shingle is one shingle. Null and wordless
    texts have an empty set and stay alone. Rows with words that share an id are one node: it links to whatever
    one of them links to, and all are kept or dropped together. A row without an id stays alone: component_id null, kept.
    An empty table gives an empty result. Ties need no rule: groups and their least ids are unique. every_candidate verifies every pair that shares a
    band and can reach the similarity, without the estimate. Signatures have bands * band_rows values, VALUES at least and 65,536 at most.
    """
    m = max(VALUES, bands * band_rows)
    if bands < 1 or band_rows < 1 or m > 1 << 16 or m % 16:
        raise ValueError("bands * band_rows must be at most 65536, and a multiple of 16 where it is over 256")
    scratch = Scratch(docs.sparkSession, "near-dup")
    sketch_schema = "n long, fa long, fb long, bands array<long>, sig array<long>"
    slim, numbers = docs.select(F.col(id_col).cast("long").alias("id") if is_integral(docs, id_col) else F.col(id_col).alias("id"), F.col(text_col).alias("text")), None
    kind = slim.schema["id"].dataType.simpleString()
    sketch = scratch.write(slim.mapInArrow(_sketcher(shingle, bands, band_rows), f"id {kind}, {sketch_schema}"), "sketch")
    if kind != "bigint":  # nodes are longs from here on
        numbers = numbered(sketch.select("id"), scratch)
        sketch = scratch.write(_renamed(sketch, numbers), "numbered")

    # a class: one set of shingles, under its least id
    sets = scratch.write(sketch.where("n > 0 and id is not null").groupBy("n", "fa", "fb").agg(F.min("id").alias("rep"), F.min_by(F.struct("bands", "sig"), "id").alias("s")).select("n", "fa", "fb", "rep", "s.*"), "classes")
    rows = scratch.write(sets.select("rep", "n", F.posexplode("bands").alias("band", "bucket")), "buckets")
    shared = scratch.write(rows.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot < last").select("bucket", "pivot"), "shared")
    member = scratch.write(rows.join(shared, "bucket"), "members")
    scratch.drop(rows)

    # texts of the classes that have a candidate, read again for their full sets
    wanted = scratch.write(member.select(F.col("rep").alias("id")).distinct(), "wanted")
    if numbers is None:
        full = slim.join(wanted, "id", "left_semi").mapInArrow(_set_maker(shingle), "id long, fa long, fb long, items array<long>")
    else:
        texts = slim.join(wanted.join(numbers, F.col("id") == F.col("number")).select(F.col("key").alias("id")), "id", "left_semi")
        full = _renamed(texts.mapInArrow(_set_maker(shingle), f"id {kind}, fa long, fb long, items array<long>"), numbers)
    full = scratch.write(full, "sets")
    several = None
    if not full.groupBy("id").count().where("count > 1").isEmpty():
        # an id with several rows: each of its classes once
        keys = sets.select(F.col("rep").alias("id"), "fa", "fb")
        full = scratch.write(full.join(keys, ["id", "fa", "fb"]).groupBy("id", "fa", "fb").agg(F.first("items").alias("items")), "sets")
        several = scratch.write(full.groupBy("id").count().where("count > 1").select(F.col("id").alias("rep")), "several")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        with_a = pairs.join(full.select(F.col("id").alias("a"), F.col("items").alias("xs")), "a")
        with_b = with_a.join(full.select(F.col("id").alias("b"), F.col("items").alias("ys")), "b")
        shared = F.size(F.array_intersect("xs", "ys"))
        return scratch.write(with_b.where((100 + percent) * shared >= percent * (F.size("xs") + F.size("ys"))).select("a", "b"), name)

    of_row = sketch.select("id", "n", "fa", "fb").join(sets.select("n", "fa", "fb", "rep"), ["n", "fa", "fb"], "left")
    of_row = scratch.write(of_row.select("id", "n", F.when(F.col("id").isNotNull(), F.col("rep")).alias("rep")), "rows")

    # first each class against the one that it shares most bands with as their least member
    first = member.where("rep <> pivot").groupBy("rep", "pivot").agg(F.count("*").alias("times"))
    first = first.groupBy("rep").agg(F.max_by("pivot", F.struct("times", (-F.col("pivot")).alias("low"))).alias("pivot"))
    links = verified(scratch.write(first.select(F.col("pivot").alias("a"), F.col("rep").alias("b")), "first"), "links")
    label = components(links, scratch)

    # then every pair in a bucket whose members aren't connected yet
    now = scratch.write(member.select("bucket", "band", "rep", "n").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "band", "rep", "n", F.coalesce("label", "rep").alias("label")), "labelled")
    count = now.groupBy("bucket", "label").agg(F.count("*").alias("members"))
    main = count.groupBy("bucket").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("members", "label")).alias("main")).where("labels > 1")
    main = scratch.write(main.select("bucket", "main"), "open")
    still = scratch.write(now.join(main, "bucket"), "still")
    # shingles of these classes that no other of them has can't be shared; what is left must be enough for a link
    reps = scratch.write(still.select("rep").distinct(), "still-reps")
    item = full.join(reps.withColumnRenamed("rep", "id"), "id").select("id", F.explode("items").alias("item"))
    lone = item.groupBy("item").agg(F.count("*").alias("times"), F.min("id").alias("rep")).where("times = 1").groupBy("rep").agg(F.count("*").alias("lone"))
    if several is not None:  # a representative of several classes: the count would be that of all its texts, so none is taken off
        lone = lone.join(several, "rep", "left_anti")
    still = still.join(scratch.write(lone, "lone"), "rep", "left").withColumn("common", F.col("n") - F.coalesce("lone", F.lit(0)))
    marks = [f"s{i}" for i in range(m // 16)]
    able = still.where(100 * F.col("common") >= percent * F.col("n")).drop("lone")
    still = scratch.write(able.join(sets.select("rep", "bands", *(F.col("sig")[i].alias(c) for i, c in enumerate(marks))), "rep"), "still-able")
    # a pair comes up in the first of its shared buckets only
    earlier = F.exists(F.zip_with(F.slice("xbands", 1, F.col("band")), F.slice("ybands", 1, F.col("band")), lambda x, y: x == y), lambda same: same)
    apart = still.where("label <> main").select("bucket", "band", F.col("bands").alias("xbands"), F.col("rep").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), F.col("common").alias("ca"), *(F.col(c).alias(f"x{c}") for c in marks))
    other = still.select("bucket", F.col("bands").alias("ybands"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"), F.col("common").alias("cb"), "main", *(F.col(c).alias(f"y{c}") for c in marks))
    fits = (F.col("la") != F.col("lb")) & ((F.col("lb") == F.col("main")) | (F.col("a") < F.col("b")))
    fits = fits & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & ((100 + percent) * F.least("ca", "cb") >= percent * (F.col("na") + F.col("nb")))
    fits = fits & ~earlier if every_candidate else fits & (_agreeing(marks) >= least_agreeing(percent, m)) & ~earlier
    rest = apart.join(other, "bucket").where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = verified(scratch.write(rest, "rest"), "more-links")

    # an id with several texts ties their classes
    tied = of_row.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last").select("id", "a")
    tied = of_row.join(scratch.write(tied, "tied"), "id").select("a", F.col("rep").alias("b"))
    known = label.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    final = components(known.unionByName(more).unionByName(tied), scratch)

    out = of_row.join(final.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.select("id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep", "id").alias("component_id"))
    if numbers is not None:
        out = _named(_named(out, numbers, "id"), numbers, "component_id")
    out = scratch.write(out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")), "groups")
    scratch.keep(out)
    return out


def _renamed(df: DataFrame, numbers: DataFrame) -> DataFrame:
    """The numbers of ids instead of the ids."""
    return df.join(numbers, F.col("id") == F.col("key"), "left").select(F.col("number").alias("id"), *df.columns[1:])


def _named(df: DataFrame, numbers: DataFrame, column: str) -> DataFrame:
    """The ids of the numbers in a column."""
    return df.join(numbers, F.col(column) == F.col("number"), "left").select(*(F.col("key").alias(c) if c == column else F.col(c) for c in df.columns))
