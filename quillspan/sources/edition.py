"""Verses of a marked-up XML edition in zip archives.

A verse runs from its opening marker to its closing one, across the elements of poetry and paragraphs, so the file is read as a stream of
events with one open verse. Apparatus (notes, headings) is left out, and a superscription is a row of its own.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Elements without scripture, elements that begin a printed line, and the elements of the structure.
APPARATUS = frozenset({"f", "x", "ide", "rem", "toc", "h", "id", "cl", "cp", "s", "r", "ms", "fig"})
LINES = frozenset({"q", "p", "b"})
BOOK, CHAPTER, VERSE, VERSE_END, SUPERSCRIPTION = "book", "c", "v", "ve", "d"

COLUMNS = ["book", "chapter", "lo", "hi", "kind", "lines"]


class _Edition:
    """Collects (book, chapter, lo, hi, kind, lines) from the events of one file."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.book, self.chapter = "", 0
        self.verse: tuple[int, int] | None = None
        self.lines: list[str] = []
        self.text: list[str] = []
        self.heading: list[str] | None = None
        self.muted = 0

    def _end_line(self) -> None:
        if line := " ".join("".join(self.text).split()):
            self.lines.append(line)
        self.text = []

    def _end_verse(self) -> None:
        if self.verse is not None:
            self._end_line()
            if self.lines:
                self.rows.append((self.book, self.chapter, *self.verse, "verse", self.lines))
        self.verse, self.lines, self.text = None, [], []

    def opened(self, tag: str, attributes: dict[str, str]) -> None:
        if self.muted or tag in APPARATUS:
            self.muted += 1
        elif tag == BOOK:
            self._end_verse()
            self.book, self.chapter = attributes.get("id", ""), 0
        elif tag == CHAPTER:
            self._end_verse()
            self.chapter = int(attributes.get("id") or 0)
        elif tag == VERSE:
            self._end_verse()
            numbers = [int(n) for n in re.findall(r"\d+", attributes.get("id", ""))] or [0]
            self.verse = (numbers[0], numbers[-1])
        elif tag == VERSE_END:
            self._end_verse()
        elif tag == SUPERSCRIPTION:
            self.heading = []
        elif tag in LINES and self.verse is not None:
            self._end_line()

    def closed(self, tag: str) -> None:
        if self.muted:
            self.muted -= 1
        elif tag == SUPERSCRIPTION and self.heading is not None:
            self.rows.append((self.book, self.chapter, 0, 0, "superscription", [" ".join("".join(self.heading).split())]))
            self.heading = None

    def data(self, text: str) -> None:
        if self.muted:
            return
        if self.heading is not None:
            self.heading.append(text)
        elif self.verse is not None:
            self.text.append(text)


def verses_of(xml: bytes) -> list[tuple]:
    """Rows as in COLUMNS, in the order of the file; the last superscription of a chapter counts."""
    state, parser = _Edition(), expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = state.opened, state.closed, state.data
    parser.Parse(xml, True)
    state._end_verse()
    last = {r[:2]: i for i, r in enumerate(state.rows) if r[4] == "superscription"}
    return [r for i, r in enumerate(state.rows) if r[4] == "verse" or last[r[:2]] == i]


def read_edition_archive(spark: SparkSession, path: str, suffix: str = "_usfx.xml") -> DataFrame:
    """(book, chapter, lo, hi, kind, lines, seq, archive): the first file of each archive whose name ends in suffix; others give no rows.

    kind is verse (numbers lo to hi, its printed lines) or superscription (one line).
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    member = next((n for n in z.namelist() if n.endswith(suffix)), None)
                    rows = verses_of(z.read(member)) if member else []
                out = pd.DataFrame(rows, columns=COLUMNS)
                yield out.assign(seq=range(len(out)), archive=name)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "book string, chapter int, lo int, hi int, kind string, lines array<string>, seq int, archive string")
