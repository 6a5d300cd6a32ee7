"""Browsing: faceted filters, token search with snippets over several sources, paging, redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import holds_all, query_tokens, snippet


def faceted(items: DataFrame, **facets: object) -> DataFrame:
    """AND of optional facets: equality for scalars, membership for arrays; a None, or one without a column, is ignored."""
    for name, value in facets.items():
        if value is None or name not in items.columns:
            continue
        array = items.schema[name].dataType.typeName() == "array"
        items = items.where(F.array_contains(name, value) if array else F.col(name) == F.lit(value))
    return items


def contains_fold(column: str, piece: str | None) -> Column:
    return F.lit(True) if piece is None else F.contains(F.lower(column), F.lit(piece.casefold()))


def non_empty(column: str, wanted: bool | None) -> Column:
    return F.lit(True) if wanted is None else (F.coalesce(F.size(column), F.lit(0)) > 0) == F.lit(wanted)


def reason(tokens: list[str], fields: list[tuple[str, Column]], default: str) -> Column:
    """The label of the first field that holds any token."""
    out = F.lit(default)
    for label, col in reversed(fields):
        out = F.when(F.coalesce(reduce(lambda x, y: x | y, (F.contains(F.lower(col), F.lit(t)) for t in tokens), F.lit(False)), F.lit(False)), label).otherwise(out)
    return out


def search(sources: list[tuple[str, DataFrame, str, str]], query: str, limit: int | None = 20) -> DataFrame:
    """(source, item_id, title, snippet, total) over (name, items, title column, blob column): all tokens must occur; no ranking.

    Order is that of sources, then seq. items have item_id and seq. A query of white space only matches everything.
    """
    tokens = query_tokens(query)
    parts = []
    for i, (name, items, title, blob) in enumerate(sources):
        hit = items.where(holds_all(F.col(blob), tokens))
        parts.append(hit.select(F.lit(i).alias("_s"), F.col("seq").alias("_q"), F.lit(name).alias("source"), F.col("item_id"), F.col(title).alias("title"), snippet(F.col(blob), tokens).alias("snippet")))
    both = reduce(DataFrame.unionByName, parts)
    total = both.agg(F.count("*").alias("total"))
    page = both.orderBy("_s", "_q")
    page = page.limit(limit) if limit is not None else page
    return page.drop("_s", "_q").crossJoin(F.broadcast(total))  # one row


def page(items: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    return items.orderBy(*order).offset(offset).limit(limit)


def redacted(items: DataFrame, columns: list[str], allowed: bool) -> DataFrame:
    """The columns as null unless allowed."""
    return items if allowed else items.withColumns({c: F.lit(None).cast(items.schema[c].dataType) for c in columns})
