"""Printed references ("Gen 3:16-18; 4:1, 5") as ranges, by a stateful parser in an Arrow UDF.

The dimension of books is the caller's: names or abbreviations with a code and the number of chapters (None: verses only,
chapter 1 is meant). Segments end at ``;``. A segment without a book takes the one before; if its chapter doesn't fit there, the first book
named, then the only other named book in which it fits. What can't be read stays as an unresolved row with a reason.
Each distinct string of a batch reaches the parser once, and a task remembers those it has parsed. plain_reference() reads strings of one plain reference
("Gen 3:16-18", "Gen 3", "Jude 14") by column functions alone; the parser doesn't use it, as its expressions cost more a row than they save.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

RANGE = T.StructType([T.StructField(n, t) for n, t in (("book", T.StringType()), ("lo_chapter", T.IntegerType()), ("lo_verse", T.IntegerType()), ("hi_chapter", T.IntegerType()), ("hi_verse", T.IntegerType()), ("raw", T.StringType()), ("origin", T.StringType()), ("reason", T.StringType()))])


@dataclass(frozen=True)
class Books:
    """codes: lower-cased name -> code; chapters: code -> number of chapters, or None."""

    codes: dict[str, str]
    chapters: dict[str, int | None]

    @classmethod
    def of(cls, chapters: dict[str, int | None], *names: dict[str, str]) -> Books:
        """Books whose names come from several tables (name -> code) in order of priority: where two give a name, the first counts; codes name themselves last."""
        codes = {c.lower(): c for c in chapters}
        for table in reversed(names):
            codes |= {name.lower(): code for name, code in table.items()}
        return cls(codes, chapters)

    @cached_property
    def names(self) -> re.Pattern:
        """All names as one pattern, longest first, so that none hides a longer one; compiled once."""
        every = "|".join(re.escape(n) for n in sorted(self.codes, key=lambda n: (-len(n), n)))
        return re.compile(rf"({every})(?=\. | |$)" if every else r"(?!)")

    @property
    def plain(self) -> bool:
        """No name has a digit after a letter, so that the first number after letters ends the name."""
        return not any(re.search(r"[^\W\d]\D*\d", n) for n in self.codes)

    def split(self, text: str) -> tuple[str | None, str]:
        """The longest known name that begins the text, before a space or the end; roman I to III count as digits."""
        text = _ROMAN.sub(lambda m: str(len(m[1])), text.strip())
        found = self.names.match(text.lower())
        return (self.codes[found[1]], text[found.end() :].lstrip(". ")) if found else (None, text)


_ROMAN = re.compile(r"^(III|II|I)(?=\s+[A-Z])")
_CROSS = re.compile(r"^(\d+):(\d+)[a-z]?\s*[-–]\s*(\d+):(\d+)[a-z]?$")
_PIECE = re.compile(r"^(?:(\d+):)?(\d+)[a-z]?(?:\s*[-–]\s*(\d+)[a-z]?)?$")


def ranges_of(text: str, chapters: int | None) -> list[tuple[int, int | None, int, int | None]] | None:
    """(chapter, verse, chapter, verse) ranges, verses None for whole chapters; None if the text is no such list."""
    text = text.strip().rstrip(".,;:").strip()
    if m := _CROSS.match(text):
        a, b, c, d = map(int, m.groups())
        out: list = [(a, b, c, d)]
    else:
        out, chapter = [], None
        single = chapters is None or chapters == 1
        for piece in re.split(r"\s*,\s*", text):
            if not (m := _PIECE.match(piece)):
                return None
            if m[1]:
                chapter = int(m[1])
            low, high = int(m[2]), int(m[3] or m[2])
            if chapter is None and not single:
                out.append((low, None, high, None))
            else:
                out.append((chapter or 1, low, chapter or 1, high))
    fits = all(x[:2] <= x[2:] if x[1] is not None else x[0] <= x[2] for x in out) and all(1 <= x[0] and x[2] <= (chapters or 1) for x in out)
    return out if fits else None


def parse_references(raw: str | None, books: Books, default: str | None = None) -> list[tuple]:
    """Rows as in RANGE. origin: stated, carried, anchor_fallback or named_in_citation; reason only where nothing resolved."""
    rows: list[tuple] = []
    current, first, seen = default, None, []
    for segment in (s.strip() for s in (raw or "").split(";")):
        if not segment:
            continue
        stated, rest = books.split(segment)
        if stated:
            current, first = stated, first or stated
            seen.append(stated)
            tries = [(stated, "stated")]
        elif current is None:
            rows.append((None, None, None, None, None, segment, None, "no book in scope"))
            continue
        else:
            tries = [(current, "carried"), *([(first, "anchor_fallback")] if first and first != current else [])]
        found = next(((b, o, r) for b, o in tries if (r := ranges_of(rest, books.chapters.get(b)))), None)
        if found is None and not stated:
            fits = [(b, r) for b in dict.fromkeys(seen) if (r := ranges_of(rest, books.chapters.get(b)))]
            if len(fits) == 1:
                found = (fits[0][0], "named_in_citation", fits[0][1])
        if found is None:
            rows.append((None, None, None, None, None, segment, None, "not a reference"))
            continue
        current = found[0]
        rows += [(found[0], *r, segment, found[1], None) for r in found[2]]
    return rows


def _lookup(of: dict, key: Column, kind: str) -> Column:
    known = F.create_map(*(F.lit(x).cast(t) for kv in of.items() for x, t in zip(kv, ("string", kind), strict=True)))
    return F.try_element_at(known, key)


def plain_reference(raw: Column, books: Books) -> Column:
    """The one range (as RANGE) of a string that is a known name and a chapter, or chapter and verses; null for any other string."""
    if not books.plain or not books.codes:
        return F.lit(None).cast(RANGE)
    form = r"^ *((?:(?:III|II|I|\d+) +(?=\p{L}))?\p{L}(?:[^\d;]*[^\d;. ])?)(?:\. +| +)(?:(\d{1,6}):)?(\d{1,6})[a-z]?(?: *[-–] *(\d{1,6})[a-z]?)? *$"
    part = lambda i: F.regexp_extract(raw, form, i)
    number = lambda i: F.when(part(i) != "", part(i).cast("int"))
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(part(1), r"^III(?= +\p{Lu})", "3"), r"^II(?= +\p{Lu})", "2"), r"^I(?= +\p{Lu})", "1")
    code = _lookup(books.codes, F.lower(name), "string")
    chapters = F.coalesce(_lookup({k: v for k, v in books.chapters.items() if v is not None} or {"": 0}, code, "int"), F.lit(0))
    chapter, low = number(2), number(3)
    high = F.coalesce(number(4), low)
    one = chapters <= 1  # a bare number is then a verse
    whole = chapter.isNull() & ~one
    first, last = F.when(whole, low).otherwise(F.coalesce(chapter, F.lit(1))), F.when(whole, high).otherwise(F.coalesce(chapter, F.lit(1)))
    fits = code.isNotNull() & (low <= high) & (first >= 1) & (last <= F.greatest(chapters, F.lit(1)))
    none = F.lit(None)
    row = F.struct(code.alias("book"), first.alias("lo_chapter"), F.when(~whole, low).alias("lo_verse"), last.alias("hi_chapter"), F.when(~whole, high).alias("hi_verse"), F.trim(raw).alias("raw"), F.lit("stated").alias("origin"), none.cast("string").alias("reason"))
    return F.when(fits, row.cast(RANGE))


#: Strings whose ranges a task of the parser remembers.
REMEMBERED = 1 << 15


def reference_parser(books: Books, default: str | None = None):
    """A function of a column of printed references to an array of RANGE; a null has none.

    A task parses a string again only if it has met REMEMBERED others since; ranges are made once for each distinct string of a batch.
    """
    fields = [f.type for f in to_arrow_type(RANGE)]

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, list[tuple]] = {}
        for batch in batches:
            own = batch.dictionary_encode()
            found = []
            for raw in own.dictionary.to_pylist():
                if raw not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[raw] = parse_references(raw, books, default)
                found.append(known[raw])
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            rows = [x for f in found for x in f]
            columns = [pa.array([x[i] for x in rows], kind) for i, kind in enumerate(fields)]
            ranges = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, RANGE.names))
            yield ranges.take(own.indices)

    read = F.arrow_udf(each, T.ArrayType(RANGE))

    def parse(raw: Column) -> Column:
        raw = F.col(raw) if isinstance(raw, str) else raw
        return F.coalesce(read(raw), F.array().cast(T.ArrayType(RANGE)))

    parse.read = each
    return parse


def osis(book, lo_chapter, lo_verse, hi_chapter, hi_verse):
    """Book.c[.v][-Book.c[.v]] as a column."""
    low = F.concat_ws(".", book, lo_chapter.cast("string"), lo_verse.cast("string"))
    high = F.concat_ws(".", book, hi_chapter.cast("string"), hi_verse.cast("string"))
    return F.when(book.isNull(), None).when(low == high, low).otherwise(F.concat(low, F.lit("-"), high))
