"""Chapters, sections and a corpus as a whole: nested documents with their order, and roll-ups that keep what has nothing in it.

Each level of a nested document is one exchange: the rows of the level and what the level below made of itself meet in one union, so no level is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chapter_documents(chapters: DataFrame, topics: DataFrame, citations: DataFrame) -> DataFrame:
    """(chapter, title, n_citations, topics) of each chapter, all children in order; citations and subtopics in full.

    chapters: chapter, title. topics: chapter, topic, subtopic (null for the topic itself), seq, id; several rows of one label count by the first. citations:
    chapter, topic, subtopic, seq and whatever else is to be shown. topics is an array of (id, label, citations, subtopics), subtopics one of (id, label,
    citations). What hangs on an unknown chapter, topic or subtopic is left out; a chapter without topics has none. One row a chapter: for reading, not for
    chapters beyond what a row can hold. For one chapter, filter all three tables first.
    """
    place = ["chapter", "topic", "subtopic"]
    item = F.struct("seq", *(F.col(c) for c in citations.columns if c not in (*place, "seq")))
    shown = [f for f in citations.schema.fields if f.name not in place]
    head = T.StructType([T.StructField("seq", topics.schema["seq"].dataType), T.StructField("id", topics.schema["id"].dataType)])
    rows = topics.select(*place, F.struct("seq", "id").cast(head).alias("head"), F.lit(None).cast(T.StructType([citations.schema["seq"], *(f for f in shown if f.name != "seq")])).alias("item"))
    rows = rows.unionByName(citations.select(*place, F.lit(None).cast(head).alias("head"), item.alias("item")))
    node = rows.groupBy(*place).agg(F.min("head").alias("head"), F.sort_array(F.collect_list("item")).alias("citations")).where("head is not null")
    own, sub = F.col("subtopic").isNull(), F.struct(F.col("head.seq").alias("seq"), F.col("head.id").alias("id"), F.col("subtopic").alias("label"), "citations")
    topic = node.groupBy("chapter", "topic").agg(
        F.min(F.when(own, F.col("head"))).alias("head"), F.flatten(F.collect_list(F.when(own, F.col("citations")))).alias("citations"),
        F.sort_array(F.collect_list(F.when(~own, sub))).alias("subtopics"),
    ).where("head is not null")
    full = F.struct(F.col("head.seq").alias("seq"), F.col("head.id").alias("id"), F.col("topic").alias("label"), "citations", "subtopics")
    parts = topic.select("chapter", full.alias("topic"), F.lit(None).cast(T.StructType([chapters.schema["title"]])).alias("title"))
    parts = parts.unionByName(chapters.select("chapter", F.struct("title").alias("title"), F.lit(None).cast(parts.schema["topic"].dataType).alias("topic")))
    out = parts.groupBy("chapter").agg(F.first("title", ignorenulls=True).alias("title"), F.sort_array(F.collect_list("topic")).alias("topics")).where("title is not null")
    n = F.aggregate("topics", F.lit(0).cast("long"), lambda s, t: s + F.size(t.citations) + F.aggregate(t.subtopics, F.lit(0).cast("long"), lambda r, u: r + F.size(u.citations)))
    return out.select("chapter", F.col("title.title").alias("title"), n.alias("n_citations"), "topics")


def chapter_rollup(chapters: DataFrame, topics: DataFrame, citations: DataFrame) -> DataFrame:
    """chapters with n_topics (rows of topics, of both levels) and n_citations, 0 where there are none; null chapters count nothing."""
    each = topics.select("chapter", F.lit(1).alias("t"), F.lit(0).alias("c")).unionByName(citations.select("chapter", F.lit(0).alias("t"), F.lit(1).alias("c")))
    sums = each.groupBy("chapter").agg(F.sum("t").alias("n_topics"), F.sum("c").alias("n_citations"))
    zero = F.lit(0).cast("long")
    return chapters.join(sums, "chapter", "left").withColumns({c: F.coalesce(c, zero) for c in ("n_topics", "n_citations")})


def section_rollup(sections: DataFrame, entries: DataFrame, source_id: str) -> DataFrame:
    """sections (section, book) with id, n_entries (all entries of the section, headings included) and has_entries; sorted by id they are the list of a book's introductions."""
    sums = entries.groupBy("section").agg(F.count("*").alias("n_entries"))
    n = F.coalesce("n_entries", F.lit(0).cast("long"))
    named = sections.withColumn("id", F.concat(F.lit(f"{source_id}.book."), F.coalesce(F.when(F.length("book") > 0, F.col("book")), F.col("section"))))
    return named.join(sums, "section", "left").withColumns({"has_entries": n > 0, "n_entries": n})


def corpus_stats(records: DataFrame, passages: DataFrame) -> DataFrame:
    """One row: records, passages (with a text), retrievable (not excluded, and a passage with a text), excluded_by_policy, explain_only.

    records: id (unique), policy (null: compose). passages: id (unique), available.
    """
    have = F.coalesce("available", F.lit(False))
    policy = F.coalesce("policy", F.lit("compose"))
    each = records.select("id", policy.alias("policy"), F.lit(True).alias("record")).join(passages.select("id", have.alias("available")), "id", "full")
    record, available = F.coalesce("record", F.lit(False)), F.coalesce("available", F.lit(False))
    return each.agg(
        F.count_if(record).alias("records"), F.count_if(available).alias("passages"), F.count_if(record & available & (F.col("policy") != "exclude")).alias("retrievable"),
        F.count_if(record & (F.col("policy") == "exclude")).alias("excluded_by_policy"), F.count_if(record & (F.col("policy") == "explain_only")).alias("explain_only"),
    )


def canonical_place(canon: Column, book: Column, canons: list[str], books: list[str]) -> Column:
    """A struct to order by: the place of the canon, then of the book, unknown ones last, then the names themselves."""
    place = lambda c, names: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), c), F.lit(0).cast("long")), F.lit(len(names) + 1).cast("long"))
    return F.struct(place(canon, canons).alias("canon_place"), place(book, books).alias("book_place"), canon.alias("canon"), book.alias("book"))
