"""Line deduplication on overlapping three-line windows, in DataFrame operations only.

Line hashes are made per document; every window of three consecutive lines gets a 128-bit hash. Windows
seen twice or more are found by a grouped minimum (partial sums shrink a hot window before the exchange), written, and
joined back (AQE can split a hot window there). No table here has a bound on its size, so none is broadcast. The places of later occurrences return to their document as sorted starts,
which are merged into runs of covered lines and cut out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.arrays import runs
from quillspan.llm.ranked import row_ids
from quillspan.plans.scratch import Scratch

WINDOW = 3


def _has_word(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\x0b\x0c\r", "    ")) != ""


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, short: bool = False) -> DataFrame:
    """One row per row of docs: id_col, n_lines, n_removed (long) and text without later copies of repeated windows.

    Lines are split at \\n and compared whole, case and spaces included. Lines without a word are skipped when
    windows are formed, so blank lines neither make nor break one; those inside a removed run go with it. The first occurrence by
    (id, row, line) stays, ids that are null first; rows of one id go in input order. A document of fewer than three lines with words
    has no window and stays as it is; with short its whole sequence of these lines is one window, equal only to that of another such document. Every removed line has an equal line before it that is kept. A null text has 0 lines and stays null.
    Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    base = scratch.write(row_ids(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))), "docs")
    lines = F.split(F.col("text"), "\n", -1)
    filled = F.transform(F.filter(lines, _has_word), lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g")))
    hashed = base.select("id", "rid", filled.alias("s")).where(F.size("s") >= (1 if short else window))
    both = F.transform(runs(F.col("s"), window), lambda x, i: F.struct(i.alias("pos"), *(F.xxhash64(*(x[f"t{k}"][c] for k in range(window))).alias(c) for c in ("h", "g"))))
    if short:  # get() beyond the end gives nulls, which a hash skips
        whole = F.struct(F.lit(0).alias("pos"), *(F.xxhash64(*(F.get("s", F.lit(k))[c] for k in range(window))).alias(c) for c in ("h", "g")))
        both = F.when(F.size("s") < window, F.array(whole)).otherwise(both)
    windows = scratch.write(hashed.select("id", "rid", F.inline(both)), "windows")

    place = F.struct(F.col("id"), F.col("rid"), F.col("pos"))
    repeated = windows.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    repeated = scratch.write(repeated.select("h", "g", F.col("first.rid").alias("first_rid"), F.col("first.pos").alias("first_pos")), "repeated")
    later = windows.join(repeated.hint("merge"), ["h", "g"]).where("rid <> first_rid or pos <> first_pos")
    starts = scratch.write(later.groupBy("rid").agg(F.sort_array(F.collect_set("pos")).alias("starts")), "starts")

    last = F.size("starts") - 1
    begin = F.filter("starts", lambda x, i: (i == 0) | (x > F.get("starts", F.greatest(i - 1, F.lit(0))) + window))
    end = F.transform(F.filter("starts", lambda x, i: (i == last) | (F.get("starts", F.least(i + 1, last)) > x + window)), lambda x: x + (window - 1))
    joined = base.join(starts.select("rid", begin.alias("begin"), end.alias("end")).hint("merge"), "rid", "left").withColumn("lines", lines)
    # runs count lines with a word; full has the places of these among all lines
    full = F.filter(F.transform("lines", lambda x, i: F.when(_has_word(x), i)), lambda i: i.isNotNull())
    cut = F.col("begin").isNotNull()
    joined = joined.withColumn("full", F.when(cut, full))
    if short:
        joined = joined.withColumn("end", F.transform("end", lambda x: F.least(x, F.size("full") - 1)))

    def between(k: Column) -> Column:
        since = F.when(k == 0, 0).otherwise(F.get("full", F.get("end", k - 1)) + 1)
        until = F.when(k == F.size("begin"), F.size("lines")).otherwise(F.get("full", F.get("begin", k)))
        return F.slice("lines", since + 1, until - since)

    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("begin")), between))
    removed = F.aggregate(F.zip_with("begin", "end", lambda b, e: e - b + 1), F.lit(0).cast("long"), lambda n, x: n + x)
    return joined.select(
        F.col("id").alias(id_col),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(cut, removed).otherwise(0).cast("long").alias("n_removed"),
        F.when(cut, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text"),
    )
