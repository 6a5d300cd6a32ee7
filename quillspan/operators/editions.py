"""Two editions of one text side by side: where verses stand in each, and what kind of difference there is."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions import text as X

# Codes of books in the first edition by their common short names, and the codes that the second edition has instead.
FIRST_CODES = {
    "Gen": "GEN", "Exod": "EXO", "Lev": "LEV", "Num": "NUM", "Deut": "DEU", "Josh": "JOS", "Judg": "JDG", "Ruth": "RUT", "1Sam": "1SA", "2Sam": "2SA",
    "1Kgs": "1KI", "2Kgs": "2KI", "1Chr": "1CH", "2Chr": "2CH", "Ezra": "EZR", "Neh": "NEH", "Esth": "EST", "Job": "JOB", "Ps": "PSA", "Prov": "PRO",
    "Eccl": "ECC", "Song": "SNG", "Isa": "ISA", "Jer": "JER", "Lam": "LAM", "Ezek": "EZK", "Dan": "DAN", "Hos": "HOS", "Joel": "JOL", "Amos": "AMO",
    "Obad": "OBA", "Jonah": "JON", "Mic": "MIC", "Nah": "NAM", "Hab": "HAB", "Zeph": "ZEP", "Hag": "HAG", "Zech": "ZEC", "Mal": "MAL",
    "Tob": "TOB", "Jdt": "JDT", "Wis": "WIS", "Sir": "SIR", "Bar": "BAR", "PrMan": "MAN", "1Macc": "1MA", "2Macc": "2MA", "3Macc": "3MA", "4Macc": "4MA",
    "Matt": "MAT", "Mark": "MRK", "Luke": "LUK", "John": "JHN", "Acts": "ACT", "Rom": "ROM", "1Cor": "1CO", "2Cor": "2CO", "Gal": "GAL", "Eph": "EPH",
    "Phil": "PHP", "Col": "COL", "1Thess": "1TH", "2Thess": "2TH", "1Tim": "1TI", "2Tim": "2TI", "Titus": "TIT", "Phlm": "PHM", "Heb": "HEB",
    "Jas": "JAS", "1Pet": "1PE", "2Pet": "2PE", "1John": "1JN", "2John": "2JN", "3John": "3JN", "Jude": "JUD", "Rev": "REV",
}
SECOND_CODES = {"SNG": "SOL", "EZK": "EZE", "JOL": "JOE", "NAM": "NAH", "MRK": "MAR", "JHN": "JOH", "PHP": "PHI", "JAS": "JAM", "1JN": "1JO", "2JN": "2JO", "3JN": "3JO", "MAN": "PRM", "DAG": "DNG", "PS2": "PSX", "2ES": "4ES"}
# Books that the editions print inside another one: its code, the chapter there, and what is added to a verse.
INSIDE = {"PrAzar": ("DAG", 3, 23), "Sus": ("DAG", 13, 0), "Bel": ("DAG", 14, 0)}


def _map(of: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in of.items() for x in kv))


def map_place(book: Column, chapter: Column, verse: Column, codes: dict[str, str] = FIRST_CODES, inside: dict[str, tuple[str, int, int]] = INSIDE) -> Column:
    """A struct (book, chapter, verse) of where an edition has a verse; null for a book that it lacks. Moved books count before codes."""
    place = lambda b, c, v: F.struct(b.alias("book"), c.cast("int").alias("chapter"), v.cast("int").alias("verse"))
    known = F.try_element_at(_map(codes), book)
    out = F.when(known.isNotNull(), place(known, chapter, verse))
    for name, (code, at, offset) in inside.items():
        out = F.when(book == name, place(F.lit(code), F.lit(at), verse + offset)).otherwise(out)
    return out


def other_code(code: Column, codes: dict[str, str] = SECOND_CODES) -> Column:
    """The second edition's code of a book: its own where it differs."""
    return F.coalesce(F.try_element_at(_map(codes), code), code)


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t), na_action="ignore")


def comparable(text: Column) -> Column:
    """Composed characters, white space of any kind as single blanks, none at the ends; a null is empty."""
    return X.collapse(_nfc(F.coalesce(text, F.lit(""))))


def difference(got: Column, want: Column) -> Column:
    """Why two unequal texts differ without a word of either being another: spacing; heading, where want is got with words in capitals, and nothing else, put before
    or after it; else null."""
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    words = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    base, more = words(got), words(want)
    n, m = F.size(base), F.size(more)
    heading = lambda t: t.rlike(r"^\p{L}+$") & (F.upper(t) == t) & (F.lower(t) != t)
    # the places where got may begin: with that many words of capitals before it
    starts = F.when(m > n, F.sequence(F.lit(0), m - n)).otherwise(F.expr("cast(array() as array<int>)"))
    fits = lambda s: (F.slice(more, s + 1, n) == base) & F.forall(F.concat(F.slice(more, F.lit(1), s), F.slice(more, s + n + 1, m)), heading)
    return F.when(bare(got) == bare(want), "spacing").when(F.exists(starts, fits), "heading")


def cross_check(first: DataFrame, second: DataFrame, above: DataFrame | None = None, codes: dict[str, str] = SECOND_CODES) -> DataFrame:
    """(book, chapter, verse, kind, got, want) of the verses of first that second prints otherwise: missing, spacing, heading, or unexplained.

    first: book, chapter, start, end, text; verses that are merged there (start <> end) are numbered otherwise and are not compared. second: book (its own
    code), chapter, verse, text; a text without words is missing. above: book, chapter, text: what second prints before the first verse of a chapter.
    Texts are compared as comparable() has them. Null keys match nothing.
    """
    a = first.where(F.col("start") == F.col("end")).select("book", "chapter", F.col("start").alias("verse"), comparable(F.col("text")).alias("got"), other_code(F.col("book"), codes).alias("_b"))
    b = second.select(F.col("book").alias("_b"), "chapter", "verse", comparable(F.col("text")).alias("want"))
    both = a.join(b, ["_b", "chapter", "verse"], "left").withColumn("want", F.coalesce("want", F.lit("")))
    if above is not None:
        heads = above.select("book", "chapter", F.lit(1).alias("verse"), comparable(F.col("text")).alias("_head"))
        both = both.join(heads, ["book", "chapter", "verse"], "left")
        led = F.coalesce((F.length("_head") > 0) & F.startswith("want", "_head"), F.lit(False))
        both = both.withColumn("want", F.when((F.col("want") != "") & led, F.trim(F.substr("want", F.length("_head") + 1))).otherwise(F.col("want")))
        lost = (F.col("want") == "") & ~led
    else:
        lost = F.col("want") == ""
    kind = F.when(lost, "missing").otherwise(F.coalesce(difference(F.col("got"), F.col("want")), F.lit("unexplained")))
    return both.where(lost | (F.col("got") != F.col("want"))).select("book", "chapter", "verse", kind.alias("kind"), "got", "want")


def verse_count_mismatches(records: DataFrame, passages: DataFrame) -> DataFrame:
    """(id, ref, expected, found) of records whose passage has another number of verses than they state.

    records: id, ref, verse_count (null: not stated). passages: id, available, verses (an array). Passages without a text are left out.
    """
    both = records.where("verse_count is not null").join(passages.where("available"), "id")
    found = F.size(F.coalesce("verses", F.expr("array()").cast(passages.schema["verses"].dataType)))
    return both.where(found != F.col("verse_count")).select("id", "ref", F.col("verse_count").alias("expected"), found.alias("found"))
