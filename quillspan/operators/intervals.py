"""Joins over ranges of ordered keys: overlap, strongest relation, as-of, containing range, expansion.

Ranges have an equality key (book), lo and hi. containing, expand and overlap_join(bin_size=...) join on cells besides the book, so that a book may hold
any share of all ranges: a range's own level is the least whose cells (of 2**level) are longer than it, so it touches one or two cells of that level, its
home; it is a guest in one or two cells of each higher level that occurs. Of two ranges that meet, the one of the higher level is at home where they do and
the other is at home or a guest there, and never are two guests compared. Reversed ranges (hi < lo) meet nothing. With bins the cells of level 0 are these
bins. Rows are multiplied by their cells just before a join, where Spark only knows the size they had before; so these joins are sorted, never broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STEP = 2_000_000
OPEN_END = 1_000_000


def bound(chapter: Column, verse: Column, end: bool) -> Column:
    """One orderable long of chapter and verse; a missing verse is the chapter's start or end."""
    return chapter.cast("long") * STEP + F.coalesce(verse.cast("long"), F.lit(OPEN_END if end else 0))


def relation(alo: Column, ahi: Column, blo: Column, bhi: Column) -> Column:
    return F.when((alo == blo) & (ahi == bhi), "exact").when((blo <= alo) & (bhi >= ahi), "contains").when((alo <= blo) & (ahi >= bhi), "within").otherwise("overlaps")


STRENGTH = {"exact": 0, "contains": 1, "within": 2, "overlaps": 3}


def strength(rel: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, n in STRENGTH.items():
        out = F.when(rel == name, n).otherwise(out)
    return out


def confidence(rel: Column, see_also: Column, inferred: Column, chapter_level: Column) -> Column:
    return F.when(see_also | inferred, "low").when(rel == "exact", "high").when(chapter_level, "medium").when(rel.isin("contains", "within"), "high").otherwise("medium")


def _level(lo: str, hi: str) -> Column:
    """The own level of a range: 0 for one place, else the number of bits of hi - lo."""
    return F.when(F.col(hi) <= F.col(lo), 0).otherwise(F.length(F.bin(F.coalesce(F.try_subtract(hi, lo), F.lit((1 << 63) - 1)))))


def _levels(df: DataFrame, lo: str, hi: str) -> Column:
    """The own levels that occur, 64 at most, as an array."""
    return F.array(*(F.lit(r[0]) for r in df.where(F.col(lo) <= F.col(hi)).select(_level(lo, hi)).distinct().collect())).cast("array<int>")


def _housed(df: DataFrame, lo: str, hi: str, levels: Column | None = None, own: bool = True, ends: bool = True) -> DataFrame:
    """df with _level and _cell: a row for each cell of a range's own level, or of each of levels that is higher (or its own, if own is set). ends: both
    ends' cells, else that of lo."""
    level = _level(lo, hi)
    df = df.where(F.col(lo) <= F.col(hi))
    df = df.withColumn("_level", level if levels is None else F.explode(F.filter(levels, lambda x: (x >= level) if own else (x > level))))
    cells = F.array_distinct(F.array(F.expr(f"shiftright({lo}, _level)"), F.expr(f"shiftright({hi}, _level)"))) if ends else F.array(F.expr(f"shiftright({lo}, _level)"))
    return df.withColumn("_cell", F.explode(cells))


def _meeting(left: DataFrame, right: DataFrame, bin_size: int | None = None) -> DataFrame:
    """Pairs of a row of left (book, alo, ahi, ...) and one of right (book, blo, bhi, ...) whose ranges meet, once each: in the cell where the later one begins.

    With bin_size the least cells are bins of that size, and a reversed range meets what holds both of its ends.
    """
    key, begin, ends = ["book", "_level", "_cell"], "greatest(alo, blo)", [("alo", "ahi"), ("blo", "bhi")]
    if bin_size is not None:
        place = lambda c: F.floor(c / bin_size)
        left, right = (df.where(F.col(lo).isNotNull() & F.col(hi).isNotNull()).withColumns({f"_{lo}": place(F.least(lo, hi)), f"_{hi}": place(F.greatest(lo, hi))}) for df, (lo, hi) in ((left, ends[0]), (right, ends[1])))
        ends = [("_alo", "_ahi"), ("_blo", "_bhi")]
        begin = f"floor(greatest(alo, blo) / {bin_size})"
    la, lb = _levels(left, *ends[0]), _levels(right, *ends[1])
    first = _housed(left, *ends[0]).join(_housed(right, *ends[1], la).hint("merge"), key)
    second = _housed(left, *ends[0], lb, own=False).join(_housed(right, *ends[1]).hint("merge"), key)
    both = first.unionByName(second)
    both = both.where((F.col("alo") <= F.col("bhi")) & (F.col("blo") <= F.col("ahi")) & (F.col("_cell") == F.expr(f"shiftright({begin}, _level)")))
    return both.drop("_level", "_cell", "_alo", "_ahi", "_blo", "_bhi")


def overlap_join(a: DataFrame, b: DataFrame, bin_size: int | str | None = None) -> DataFrame:
    """All overlapping pairs of (book, lo, hi) ranges as (book, a_id, a_seq, b_id, b_seq, relation).

    a and b have id, seq (order within id), book, lo, hi. Null bounds or books overlap nothing. With a bin_size ranges meet in bins of
    that size, longer ones in bins of twice, four times and so on; "auto" takes cells of the ranges' own sizes.
    """
    left = a.select("book", F.col("id").alias("a_id"), F.col("seq").alias("a_seq"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    right = b.select("book", F.col("id").alias("b_id"), F.col("seq").alias("b_seq"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    touch = (F.col("alo") <= F.col("bhi")) & (F.col("blo") <= F.col("ahi"))
    if bin_size == "auto":
        both = _meeting(left, right)
    elif bin_size is None:
        both = left.join(right, "book").where(touch)
    else:
        both = _meeting(left, right, bin_size)
    return both.withColumn("relation", relation(F.col("alo"), F.col("ahi"), F.col("blo"), F.col("bhi")))


def strongest(pairs: DataFrame) -> DataFrame:
    """One row per (a_id, b_id): the strongest relation, the first seen (a_seq, b_seq) of equals."""
    best = F.min_by(F.struct("relation", "a_seq", "b_seq"), F.struct(strength(F.col("relation")).alias("s"), "a_seq", "b_seq")).alias("x")
    return pairs.groupBy("a_id", "b_id").agg(best).select("a_id", "b_id", "x.*")


def as_of(events: DataFrame, marks: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """events with value of the latest mark at or before them (null if none), by a union and a running last.

    Marks at the same place count before events; of marks at one place the greatest value counts.
    """
    rows = events.withColumn("_value", F.lit(None).cast(marks.schema[value].dataType)).withColumn("_kind", F.lit(1))
    seen = marks.select(*by, at, F.col(value).alias("_value")).withColumn("_kind", F.lit(0))
    both = rows.unionByName(seen, allowMissingColumns=True)
    w = W.partitionBy(*by).orderBy(at, "_kind", "_value").rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(w)).where("_kind = 1").drop("_value", "_kind")


def containing(targets: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, span_id): the smallest span of the target's book that encloses it, the first by seq of equals; null if none."""
    t = targets.select("id", "book", F.col("lo").alias("tlo"), F.col("hi").alias("thi"))
    s = spans.groupBy("book", "lo", "hi").agg(F.min(F.struct("seq", "id")).alias("s")).select("book", F.col("s.id").alias("span_id"), F.col("s.seq").alias("span_seq"), "lo", "hi")
    # a span is as long as what it encloses or longer, and at home in the cell where that begins
    asked = _housed(t, "tlo", "thi", _levels(s, "lo", "hi"), ends=False)
    inside = asked.join(_housed(s, "lo", "hi").hint("merge"), ["book", "_level", "_cell"]).where((F.col("lo") <= F.col("tlo")) & (F.col("hi") >= F.col("thi")))
    best = inside.groupBy("id").agg(F.min_by("span_id", F.struct((F.col("hi").cast("decimal(20,0)") - F.col("lo")).alias("size"), "span_seq")).alias("span_id"))
    return targets.select("id").join(best, "id", "left")


def first_exact(targets: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """targets with text of the first row of texts (by seq) of the same key; null if none."""
    first = texts.groupBy(key).agg(F.min_by("text", "seq").alias("text"))
    return targets.join(first, key, "left")


def resolve(targets: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, source_id, how): the first text of exactly the target's range, else of the smallest containing one."""
    exact = texts.groupBy("book", "lo", "hi").agg(F.min_by("id", "seq").alias("exact_id"))
    both = targets.join(exact, ["book", "lo", "hi"], "left").join(containing(targets, texts), "id", "left")
    how = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("span_id").isNotNull(), "containing_range")
    return both.select("id", F.coalesce("exact_id", "span_id").alias("source_id"), how.alias("how"))


def expand(ranges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, seq, blocks): the blocks that each range touches, in order, as an array of (lo, hi, text)."""
    r = ranges.select("id", "seq", "book", F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    hit = _meeting(r, blocks.select("book", F.col("lo").alias("blo"), F.col("hi").alias("bhi"), "text"))
    each = F.struct(F.col("blo").alias("lo"), F.col("bhi").alias("hi"), "text")
    return hit.groupBy("id", "seq").agg(F.sort_array(F.collect_list(each)).alias("blocks"))


def changed(a: DataFrame, b: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Keys of a with kind: missing in b, spacing (equal without white space) or different; equal texts are left out."""
    both = a.join(b.select(*keys, F.col(text).alias("_other")), keys, "left")
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    kind = F.when(F.col("_other").isNull(), "missing").when(bare(F.col(text)) == bare(F.col("_other")), "spacing").otherwise("different")
    return both.where(F.col("_other").isNull() | (F.col(text) != F.col("_other"))).select(*keys, kind.alias("kind"))
