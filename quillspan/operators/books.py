"""Two kinds of books in Markdown: one of entries under book headings, one of citations under chapters and topics.

All state that a reader would carry (section, chapter, topic, page) is a forward fill over the lines of a document; bodies and references
have a grammar of their own and are read by the parsers of documents.py.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions.refs import Books
from quillspan.functions.text import application_sentences, slug
from quillspan.operators import documents as D
from quillspan.operators import ordered as O

#: Printed forms of a title with its reference, a chapter, a citation, a topic inside one, a page mark and notes that point elsewhere.
TITLE = r"^(.+?)\s*\(([^()]+)\)\s*$"
CHAPTER = r"^##\s+Chapter\s+([IVX]+)[.\s—-]+(.+?)\s*$"
CITATION = r"^\*\*([^*]+)\*\*\s*(.*)$"
LEAD = r"^([A-Z][^—]*?)\s+—\s+(.+)$"
PAGE = r"^<!--\s*page\s+(\d+)"
SEE_INSIDE = r"(?i)[;,]?\s*[A-Za-z]*\s*\(see[^)]*\)"
TARGET = r"(?i)\b(?:under|see)\s+([^;,)]+?)\s*(?:,\s*above|[;,)]|$)"

ROLE = T.ArrayType(T.StructType([*D.REF.fields[:5], T.StructField("role", T.StringType()), T.StructField("raw", T.StringType())]))
TITLED = T.StructType([T.StructField("refs", ROLE), T.StructField("problems", T.ArrayType(T.StringType()))])


def roman(n: int) -> str:
    """Up to 39."""
    return "X" * (n // 10) + ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"][n % 10]


def sections(docs: DataFrame, books: Books, canons: dict[str, str], skip: tuple[str, ...] = ()) -> DataFrame:
    """Entries (####) and introductions of book sections (###), one row each, in documents of the first kind.

    kind is entry or section; a section without paragraphs isn't a row. canon is that of the last # or ## heading that canons knows; nothing before it or under a
    section of skip counts. Columns: doc_id, kind, line, canon, book_section, title, slug (entries), ref_raw, refs, body, application_sentences, problems.
    """
    lines = O.lines_of(docs)
    level = F.length(F.regexp_extract("value", r"^(#{1,4}) ", 1))
    lines = lines.withColumn("level", F.coalesce(level, F.lit(0))).withColumn("label", F.when(F.col("level") > 0, F.trim(F.regexp_replace("value", r"^#+", ""))))
    names = F.create_map(*(F.lit(x) for kv in canons.items() for x in kv))
    high = F.col("level").isin(1, 2)
    lines = O.forward_fill(lines, ["doc_id"], "line", [("canon", F.when(high, names[F.col("label")]))])
    lines = O.forward_fill(lines, ["doc_id"], "line", [("book_section", F.when(F.col("level") == 3, F.col("label")))])
    hidden = F.when(high, False).when(F.col("level") == 3, F.col("label").isin(*skip) if skip else F.lit(False))
    lines = O.forward_fill(lines, ["doc_id"], "line", [("hidden", hidden)])
    lines = O.islands(lines, ["doc_id"], "line", F.col("level") > 0)
    at = F.col("level") > 0
    facts = F.max(F.when(at, F.struct("line", "level", "label", "canon", "book_section", F.coalesce("hidden", F.lit(False)).alias("hidden")))).alias("h")
    parts = lines.groupBy("doc_id", "island").agg(facts, F.sort_array(F.collect_list(F.when(~at, F.struct("line", "value")))).alias("b"))
    parts = parts.select("doc_id", "h.*", F.transform("b", lambda x: x.value).alias("lines")).where(F.col("level").isin(3, 4) & F.col("canon").isNotNull() & ~F.col("hidden"))

    @F.pandas_udf("string")
    def book_of(section: pd.Series) -> pd.Series:
        return section.map(lambda x: books.split(x)[0] if isinstance(x, str) else None)

    @F.pandas_udf(TITLED)
    def read(raw: pd.Series, book: pd.Series) -> pd.DataFrame:
        rows = [D.with_roles(r, books, b if isinstance(b, str) else None) if isinstance(r, str) else ([], []) for r, b in zip(raw, book, strict=True)]
        return pd.DataFrame(rows, columns=TITLED.names)

    entry = F.col("level") == 4
    ref = F.regexp_extract("label", TITLE, 2)
    out = parts.withColumn("book", book_of("book_section")).withColumn("ref_raw", F.when(entry & (ref != ""), ref))
    out = out.withColumn("_t", read("ref_raw", "book")).withColumn("body", D.body_parser(books)("lines", "book"))
    out = out.where(entry | (F.size("body.paragraphs") > 0))
    out = out.select(
        "doc_id", F.when(entry, "entry").otherwise("section").alias("kind"), "line", "canon", "book_section", "book",
        F.when(entry & (ref != ""), F.regexp_extract("label", TITLE, 1)).otherwise(F.col("label")).alias("title"), "ref_raw", F.col("_t.refs").alias("refs"), "body",
        F.flatten(F.transform("body.paragraphs", lambda x: application_sentences(x))).alias("application_sentences"), F.concat("_t.problems", "body.problems").alias("problems"),
    )
    return O.slug_suffixes(out.withColumn("slug", slug(F.col("title"))), "slug", "line", by=("doc_id", "kind"))


def citation_lines(docs: DataFrame) -> DataFrame:
    """Every line of documents of the second kind with its state and bucket: doc_id, line, value, chapter_n, chapter, topic, subtopic, page, bucket.

    Buckets: blank, comment, chapter, topic, structure, citation, prose, and null for lines outside any chapter. A new topic clears the subtopic, a chapter both;
    a bold reference "Topic — Reference" is a topic too. page is that of the latest page mark.
    """
    lines = O.lines_of(docs).withColumn("value", F.trim("value"))
    lines = O.inside_spans(lines, ["doc_id"], "line", F.col("value").startswith("<!--"), F.contains(F.col("value"), F.lit("-->")), "_comment")
    text = F.when(~F.col("_comment"), F.col("value"))
    number = F.create_map(*(F.lit(x) for n in range(1, 31) for x in (roman(n), n)))
    chapter = F.when(text.rlike(CHAPTER), F.struct(number[F.regexp_extract("value", CHAPTER, 1)].alias("n"), F.regexp_extract("value", CHAPTER, 2).alias("title")))
    lines = lines.withColumn("_cite", F.when(text.rlike(CITATION), F.trim(F.regexp_extract("value", CITATION, 1))))
    lead = F.when(F.col("_cite").rlike(LEAD) & ~F.col("_cite").rlike("^[0-9IVX]"), F.regexp_extract("_cite", LEAD, 1))
    lines = lines.withColumn("lead", lead)
    label = F.trim(F.regexp_replace("value", "^#+ ", ""))
    levels = [("_ch", chapter), ("topic", F.coalesce(F.when(text.startswith("### "), label), F.col("lead"))), ("subtopic", F.when(text.startswith("#### "), label))]
    lines = O.forward_fill(lines, ["doc_id"], "line", levels)
    lines = O.forward_fill(lines, ["doc_id"], "line", [("page", F.when(F.col("value").rlike(PAGE), F.regexp_extract("value", PAGE, 1).cast("int")))])
    bucket = (
        F.when(F.col("value") == "", "blank").when(F.col("_comment"), "comment").when(F.col("value").rlike(CHAPTER), "chapter").when(F.col("value").rlike("^#{3,4} "), "topic")
        .when(F.col("value").startswith("#"), "structure").when(F.col("_cite").isNotNull() & F.col("_ch").isNotNull(), "citation").when(F.col("_ch").isNotNull(), "prose")
    )
    return lines.select("doc_id", "line", "value", F.col("_ch.n").alias("chapter_n"), F.col("_ch.title").alias("chapter"), "topic", "subtopic", "page", "lead", "_cite", bucket.alias("bucket"))


def citations(lines: DataFrame, source: str) -> DataFrame:
    """Citations of citation_lines in order: id, doc_id, line, chapter_n, chapter, topic, subtopic, page, ref_raw, text_source, text, back_reference_kind, target, see_also."""
    rows = lines.where("bucket = 'citation'")
    ref = F.when(F.col("lead").isNotNull(), F.regexp_extract("_cite", LEAD, 2)).otherwise(F.col("_cite"))
    tail = F.trim(F.regexp_extract("value", CITATION, 2))
    rows = rows.withColumns({"_ref": ref, "_tail": tail, "text_source": D.citation_source(tail)})
    inner = F.when(F.col("text_source") == "back_reference", F.trim(F.regexp_extract("_tail", r"^\*\((.+)\)\*$", 1)))
    found = F.regexp_extract(inner, TARGET, 1)
    see = F.regexp_extract("_ref", r"(?i)\(see\s+([^)]+?)(?:,\s*above)?(?:,[^)]*)?\)", 1)
    none_if_empty = lambda c: F.when(c != "", c)
    rows = rows.select(
        "doc_id", "line", "chapter_n", "chapter", "topic", "subtopic", "page", F.regexp_replace(F.trim(F.regexp_replace("_ref", SEE_INSIDE, "")), "[;,]+$", "").alias("ref_raw"), "text_source",
        _text(F.col("text_source"), F.col("_tail")).alias("text"), F.when(inner.isNotNull(), D.back_reference_kind(inner)).alias("back_reference_kind"),
        none_if_empty(found).alias("target"), none_if_empty(see).alias("see_also"),
    )
    return O.numbered_ids(rows, source, ["doc_id"], ["line"])


def _text(kind: Column, tail: Column) -> Column:
    return F.when(kind == "inline", F.trim(F.regexp_replace(tail, "^—+", ""))).when(kind == "other", tail)
