"""Gapless positions inside groups, without a window that puts a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from quillspan.plans.scratch import Scratch

PLACE_BITS = 33  # monotonically_increasing_id keeps the place in the partition in these low bits


def row_ids(df: DataFrame, name: str = "rid") -> DataFrame:
    """A unique long for each row. Write the result before use: a later evaluation may number rows anew."""
    return df.withColumn(name, F.monotonically_increasing_id())


def free_name(name: str, taken: list[str]) -> str:
    """name, or the first of name_1, name_2 and so on that isn't taken in any case."""
    used = {c.lower() for c in taken}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(used) + 2))) if n.lower() not in used)


def is_integral(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.IntegralType)


def numbered(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, number): the distinct values of the one column of keys in their order (strings by code point) as longs from 0; null has none."""
    each = keys.toDF("key").where("key is not null").distinct().withColumn("_all", F.lit(0))
    return scratch.write(ranked(each, ["_all"], [F.col("key")], scratch, "number").select("key", "number"), "numbers")


def ranked(df: DataFrame, groups: list[str], order: list[Column], scratch: Scratch, name: str = "slot") -> DataFrame:
    """df with the row's place (from 0) in its group under order, which must be total within a group.

    One range exchange sorts all rows; a row's place in its partition plus the group's rows in earlier partitions
    is its position. Groups may be of any size; null is a group.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in groups]
    dealt = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    dealt = scratch.write(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    dealt = dealt.withColumn("_part", F.shiftright("_at", PLACE_BITS)).withColumn("_at", F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1))
    runs = dealt.groupBy(*groups, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    runs = scratch.write(runs.withColumn("_before", F.coalesce(before, F.lit(0))), "runs").drop("_rows")
    renamed = runs.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)), F.col("_part").alias("_p"), "_first", "_before")
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(groups):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    out = dealt.join(renamed, same).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before"))
    return out.select(*(F.col(c) for c in df.columns), name)
