"""Roll-ups: label counts, inversion, trees, quality figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_counts(records: DataFrame, labels: str, vocabulary: DataFrame, key: str = "label") -> DataFrame:
    """(label, n) for every label of the vocabulary, 0 if unused."""
    used = records.select(F.explode(labels).alias(key)).groupBy(key).agg(F.count("*").alias("n"))
    return vocabulary.select(key).join(used, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def role_counts(roles: dict[str, DataFrame], key: str = "agent") -> DataFrame:
    """(agent, n_<role>...) over the union of names; each DataFrame has the column agent."""
    parts = [df.select(key, F.lit(role).alias("role")) for role, df in roles.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(key).agg(*(F.count_if(F.col("role") == r).alias(f"n_{r}") for r in roles))


def first_seen(df: DataFrame, by: list[str], seq: str, columns: list[str]) -> DataFrame:
    """Counts by key with the columns of its first row."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(F.min_by(c, seq).alias(c) for c in columns))


def invert(citations: DataFrame, key: str, seq: str, id_col: str, path: Column, facet: Column, text: Column | None = None) -> DataFrame:
    """Citations by key: n (pairs), ids in order, sorted distinct paths and facets, and the first text that isn't null."""
    aggs = [F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct(seq, id_col))), lambda x: x[id_col]).alias("ids"), F.array_sort(F.collect_set(path)).alias("paths"), F.array_sort(F.collect_set(facet)).alias("facets")]
    if text is not None:
        aggs.append(F.min_by(text, F.when(text.isNotNull(), F.col(seq))).alias("text"))
    return citations.groupBy(key).agg(*aggs)


def tree(items: DataFrame, canon: str, book: str, item: str, order: str, every_book: DataFrame | None = None) -> DataFrame:
    """(canon, books: array of (first, book, items)) in order; every_book adds books without items, last."""
    books = items.groupBy(canon, book).agg(F.min(order).alias("first"), F.sort_array(F.collect_list(F.struct(order, item))).alias("items"))
    books = books.withColumn("items", F.transform("items", lambda x: x[item]))
    if every_book is not None:
        none = every_book.select(canon, book).distinct().join(books, [canon, book], "left_anti")
        books = books.unionByName(none.select(canon, book, F.lit(None).cast(items.schema[order].dataType).alias("first"), F.array().cast(books.schema["items"].dataType).alias("items")))
    place = F.struct(F.col("first").isNull().alias("empty"), F.col("first"), F.col(book), F.col("items"))
    return books.groupBy(canon).agg(F.sort_array(F.collect_list(place)).alias("books"))


def coverage(df: DataFrame, by: list[str], owner: str) -> DataFrame:
    """Accounting of rows: how many have an owner, and how many don't."""
    return df.groupBy(*by).agg(F.count(owner).alias("owned"), F.count_if(F.col(owner).isNull()).alias("unowned"))


def rates(df: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """Shares of rows for which each flag is true; null without rows."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(F.try_divide(F.count_if(c), F.count("*")).alias(k) for k, c in flags.items()))


def most_common(df: DataFrame, key: str, seq: str, n: int) -> DataFrame:
    """The n most frequent keys, the first seen of equals."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(seq).alias("_first")).orderBy(F.desc("n"), F.asc("_first")).limit(n).drop("_first")
