"""A book put together from its parts: contents made of the parts' headings, and the lines of the whole in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.text import slug
from quillspan.plans.places import placed
from quillspan.plans.scratch import Scratch

_HEADING = r"^(#{1,6})\s+(.*?)\s*$"


def part_lines(parts: DataFrame) -> DataFrame:
    """(seq, line, value) of parts (seq, text), without white space at the ends of a text; lines from 0. Blank and null texts have none."""
    bare = F.regexp_replace("text", r"^\s+|\s+$", "")
    return parts.select("seq", bare.alias("text")).where(F.length("text") > 0).select("seq", F.posexplode(F.split("text", "\n")).alias("line", "value"))


def headings(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(seq, line, level, text, anchor) of the headings in lines (seq, line, value) that stand outside fences of code.

    A fence opens or closes with a line that begins with three backticks; a part that leaves one open doesn't reach into the next. text is the heading
    without comments and marks of emphasis. Anchors are slugs; of equal ones, over all parts and levels in order, the n-th gets -(n - 1).
    """
    fence = F.startswith("value", F.lit("```"))
    open_ = F.sum(F.when(fence, 1).otherwise(0)).over(W.partitionBy("seq").orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow))
    found = lines.withColumn("_fences", open_).where(~fence & (F.col("_fences") % 2 == 0) & F.col("value").rlike(_HEADING))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("value", _HEADING, 2), "<!--.*?-->", ""), "[*_`]", ""))
    found = found.select("seq", "line", F.length(F.regexp_extract("value", _HEADING, 1)).alias("level"), plain.alias("text")).withColumn("_slug", slug(F.col("text")))
    each = placed(found, ["_slug"], [F.col("seq"), F.col("line")], scratch, "_nth")
    anchor = F.when(F.col("_nth") > 0, F.concat("_slug", F.lit("-"), F.col("_nth").cast("string"))).otherwise(F.col("_slug"))
    return each.select("seq", "line", "level", "text", anchor.alias("anchor"))


def contents(chapters: DataFrame, scratch: Scratch, depth: int = 3) -> DataFrame:
    """(seq, line, value): the entries of a table of contents, one for each heading of levels 2 to depth, indented by level."""
    entry = F.concat(F.repeat(F.lit("  "), F.col("level") - 2), F.lit("- ["), "text", F.lit("](#"), "anchor", F.lit(")"))
    return headings(part_lines(chapters), scratch).where(F.col("level").between(2, depth)).select("seq", "line", entry.alias("value"))


def assemble(front: DataFrame, chapters: DataFrame, header: str, scratch: Scratch, depth: int = 3, title: str = "Table of Contents") -> DataFrame:
    """(position, value): the lines of a book from 0: header, the front parts, a table of contents, the chapters, with rules between them.

    front, chapters: seq (the place in the manifest, unique) and text; parts without text are left out, with their rule. Sort by position to write it.
    """
    def segment(df: DataFrame, group: int) -> DataFrame:
        return df.select(F.lit(group).alias("_g"), F.col("seq").cast("long").alias("_s"), F.col("line").cast("long").alias("_l"), "value")

    def fixed(group: int, values: list[str], first: int = 0) -> DataFrame:
        rows = [(group, 0, first + i, v) for i, v in enumerate(values)]
        return front.sparkSession.createDataFrame(rows, "_g int, _s long, _l long, value string")

    bodies = segment(part_lines(front), 1).unionByName(segment(part_lines(chapters), 3))
    starts = bodies.where("_l = 0").select("_g", "_s")
    rules = starts.select("_g", "_s", F.posexplode(F.array(F.lit(""), F.lit("---"), F.lit(""))).alias("_l", "value")).withColumn("_l", F.col("_l").cast("long") - 3)
    # the entries follow the heading of the contents in the order of their parts and lines
    entries = segment(contents(chapters, scratch, depth), 2)
    head = fixed(2, ["", "---", "", "---", "", f"## {title}", ""]).withColumn("_s", F.lit(-(1 << 62)).cast("long"))
    every = fixed(0, header.split("\n")).unionByName(bodies).unionByName(rules).unionByName(head).unionByName(entries)
    return placed(every, [], [F.col("_g"), F.col("_s"), F.col("_l")], scratch).select("position", "value")


def page_gaps(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(page, next) of printed page marks (``<!-- p. 12``) in lines (position, value) that the next mark in order doesn't follow by one."""
    pages = lines.select("position", F.posexplode(F.regexp_extract_all("value", F.lit(r"<!--\s*p\.\s*(\d+)"), F.lit(1))).alias("_i", "page"))
    each = placed(pages.withColumn("page", F.col("page").cast("long")), [], [F.col("position"), F.col("_i")], scratch, "_n")
    after = each.select((F.col("_n") - 1).alias("_n"), F.col("page").alias("next"))
    return each.join(after, "_n").where(F.col("next") != F.col("page") + 1).select("page", "next")
