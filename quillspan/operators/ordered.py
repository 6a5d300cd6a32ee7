"""Operators over ordered rows: forward fill, islands, spans, numbering, neighbours, windows of lists.

Every order must be total within its partition. Partitions are documents (or conversations), so windows scale with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, value): every line with its number from 1."""
    each = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("_i", "value"))
    return each.select("doc_id", (F.col("_i") + 1).alias("line"), "value")


def _running(by: list[str], order: str):
    return W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)


def forward_fill(df: DataFrame, by: list[str], order: str, levels: list[tuple[str, Column]]) -> DataFrame:
    """Section state: each level is the latest non-null value so far, and a new value of a level clears those after it."""
    scope = list(by)
    for name, value in levels:
        df = df.withColumn(f"_{name}", value)
        df = df.withColumn(name, F.last(f"_{name}", ignorenulls=True).over(_running(scope, order)))
        df = df.withColumn(f"_{name}_no", F.count(f"_{name}").over(_running(scope, order)))
        scope = [*scope, f"_{name}_no"]
    return df.drop(*(f"_{n}" for n, _ in levels), *(f"_{n}_no" for n, _ in levels))


def islands(df: DataFrame, by: list[str], order: str, starts: Column, name: str = "island") -> DataFrame:
    """The running count of starting rows: 0 before the first."""
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(_running(by, order)))


def segments(lines: DataFrame, starts: Column) -> DataFrame:
    """(doc_id, island, head, body): lines from one heading to the next; island 0 has no heading."""
    numbered = islands(lines, ["doc_id"], "line", starts).withColumn("_head", starts)
    parts = numbered.groupBy("doc_id", "island").agg(F.max(F.when(F.col("_head"), F.col("value"))).alias("head"), F.sort_array(F.collect_list(F.when(~F.col("_head"), F.struct("line", "value")))).alias("b"))
    return parts.select("doc_id", "island", "head", F.transform("b", lambda x: x.value).alias("body"))


def inside_spans(df: DataFrame, by: list[str], order: str, opens: Column, closes: Column, name: str = "inside") -> DataFrame:
    """True from a row that opens a span to the row that closes it (both included); spans don't nest."""
    state = F.when(closes, F.lit(0)).when(opens, F.lit(1))
    before = F.last(state, ignorenulls=True).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn(name, opens | closes & (F.coalesce(before, F.lit(0)) == 1) | (F.coalesce(before, F.lit(0)) == 1))


def numbered_ids(df: DataFrame, prefix: str, by: list[str], order: list[str], width: int = 4, name: str = "id") -> DataFrame:
    """prefix.0001 and so on in order; wider numbers are not cut."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("string")
    return df.withColumn(name, F.concat(F.lit(f"{prefix}."), F.when(F.length(n) < width, F.lpad(n, width, "0")).otherwise(n)))


def slug_suffixes(df: DataFrame, slug: str, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The first of equal slugs stays; the n-th gets -(n - 1)."""
    n = F.row_number().over(W.partitionBy(*by, slug).orderBy(order)) - 1
    return df.withColumn(slug, F.when(n > 0, F.concat(F.col(slug), F.lit("-"), n)).otherwise(F.col(slug)))


def discontinuities(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value isn't one more than that of the row before."""
    before = F.lag(value).over(W.partitionBy(*by).orderBy(order))
    return df.withColumn("before", before).where(F.col("before").isNotNull() & (F.col(value) != F.col("before") + 1))


def first_occurrences(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def neighbours(df: DataFrame, by: list[str], order: str, key: str) -> DataFrame:
    """Reading order: previous and next key, position from 1, total."""
    w = W.partitionBy(*by).orderBy(order)
    return df.select(*df.columns, F.lag(key).over(w).alias("previous"), F.lead(key).over(w).alias("next"), F.row_number().over(w).alias("position"), F.count("*").over(W.partitionBy(*by)).alias("total"))


def excerpt(items: Column, anchor: Column, span: int = 8, limit: int = 20) -> Column:
    """span items around place anchor (from 0), inside the list; lists of up to limit items stay whole."""
    low = F.greatest(F.lit(0), F.least(anchor - span // 2, F.size(items) - span))
    return F.when(F.size(items) > limit, F.slice(items, low + 1, span)).otherwise(items)


def offset_to_item(lengths: Column, offset: Column) -> Column:
    """The place (from 0) of the item that holds a character offset of the items joined by one space."""
    zero = F.lit(0).cast("long")

    def step(s: Column, x: Column) -> Column:
        end = s.end + x.cast("long") + 1
        return F.struct(end.alias("end"), (s.n + F.when(end <= offset, 1).otherwise(0)).cast("long").alias("n"))

    return F.least(F.aggregate(lengths, F.struct(zero.alias("end"), zero.alias("n")), step).n, F.size(lengths).cast("long") - 1)
