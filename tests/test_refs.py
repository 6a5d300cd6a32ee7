import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspan.functions import refs as R

BOOKS = R.Books.of({"Gen": 50, "Ps": 150, "1Sam": 31, "2Sam": 24, "Judg": 21, "Jude": 1, "Song": 8, "SongThr": None}, {"apocalypse": "Ps"}, {"Genesis": "Gen", "Psalms": "Ps", "1 Samuel": "1Sam", "2 Samuel": "2Sam", "Judges": "Judg", "Song of Songs": "Song", "The Song of the Three": "SongThr"}, {"Ge": "Gen", "Psalm": "Ps", "Genesis": "Jude", "1 Sa": "1Sam", "Jud": "Jude"})
NAMES = ["Genesis", "Ge", "GEN", "Ge.", "Psalm", "Psalms", "1 Samuel", "I Samuel", "II Samuel", "III Samuel", "1 Sa", "1 Sa.", "Judges", "Jude", "Jud", "Judg", "Song of Songs", "Song", "The Song of the Three", "Apocalypse", "Isaiah", "Genesis of it", "I", "II", ""]
TAILS = ["3:16", "3:16-18", "3:16–18a", "3", "3-5", "14", "14, 15", "9:9-1", "0:4", "51:2", "3:16;", " 3:16 ", "3:4, 5", "3:4, 6:1", "9:5-10:4", "1:1; 2:2", "3 : 4", "3:16.", "x", "", "1:2:3", "7b", "3:4b - 6c", "999999:1", "3;4", "٣:١"]


def rows(value):
    return [tuple(x) for x in value]


def test_column_form_equals_parser(spark):
    raws = sorted({f"{n} {t}" for n in NAMES for t in TAILS} | {n + t for n in NAMES for t in TAILS})
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)] + [(-1, None)], "i int, raw string").repartition(3)
    got = {r.i: rows(r.p) for r in df.select("i", R.reference_parser(BOOKS)(F.col("raw")).alias("p")).collect()}
    for i, raw in enumerate(raws):
        assert got[i] == R.parse_references(raw, BOOKS), raw
    assert got[-1] == []
    plain = {r.i for r in df.where(R.plain_reference(F.col("raw"), BOOKS).isNotNull()).collect()}
    assert len(plain) > 100 and {raws.index(x) for x in ("Genesis 3:16-18", "I Samuel 3:16", "Jude 14", "Psalms 3-5", "Ge. 3")} <= plain


def test_priority_of_tables_and_longest_names():
    assert BOOKS.codes["genesis"] == "Gen"  # the second table counts before the third
    assert BOOKS.split("Judges 3:1") == ("Judg", "3:1") and BOOKS.split("Jud 3") == ("Jude", "3") and BOOKS.split("Song of Songs 2:1")[0] == "Song" and BOOKS.split("Isaiah 1") == (None, "Isaiah 1")
    assert BOOKS.split("III Samuel 1:1") == (None, "3 Samuel 1:1") and BOOKS.split("I Samuel") == ("1Sam", "")


def test_names_with_numbers_go_by_the_parser(spark):
    books = R.Books.of({"A": 9, "B": 9}, {"part 2": "B", "part": "A"})
    assert not books.plain
    df = spark.createDataFrame([("Part 2 3:1",), ("Part 2:1",)], "raw string")
    assert [r.p[0].book for r in df.select(R.reference_parser(books)(F.col("raw")).alias("p")).collect()] == ["B", "A"]


@pytest.mark.parametrize("default", [None, "Gen"])
def test_random_citations(spark, default):
    rng = random.Random(3)
    raws = ["; ".join(f"{rng.choice(NAMES[:20] + [''] * 12)} {rng.choice(TAILS)}".strip() for _ in range(rng.randrange(1, 5))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    got = {r.i: rows(r.p) for r in df.select("i", R.reference_parser(BOOKS, default)(F.col("raw")).alias("p")).collect()}
    assert got == {i: R.parse_references(r, BOOKS, default) for i, r in enumerate(raws)}


def test_a_task_parses_a_string_once(spark, monkeypatch):
    """5,000 rows in batches of 500 hold 20 strings: the parser runs 20 times, not in each batch; what is forgotten is parsed again."""
    raws = pa.array([None if i % 50 == 0 else f"Gen {i % 20 + 1}:1; {i % 20 + 2}:3" for i in range(5000)])
    batches = lambda: (raws.slice(i, 500) for i in range(0, 5000, 500))
    each, ran, parse = R.reference_parser(BOOKS, None).read, [], R.parse_references
    monkeypatch.setattr(R, "parse_references", lambda raw, *a: ran.append(raw) or parse(raw, *a))
    want = [None if raw is None else parse(raw, BOOKS) for raw in raws.to_pylist()]
    got = lambda: [r if r is None else [tuple(x.values()) for x in r] for b in each(batches()) for r in b.to_pylist()]
    assert got() == want and sorted(ran) == sorted(set(raws.drop_null().to_pylist()))
    monkeypatch.setattr(R, "REMEMBERED", 3)
    assert got() == want


def test_batches_without_references(spark):
    each = R.reference_parser(BOOKS).read
    assert [b.to_pylist() for b in each(iter([pa.array([], pa.string()), pa.array([None], pa.string()), pa.array([""])]))] == [[], [None], [[]]]
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Gen 3:16\n")], "i int, raw string")
    got = {r.i: rows(r.p) for r in df.select("i", R.reference_parser(BOOKS)("raw").alias("p")).collect()}
    assert got == {1: [], 2: [], 3: R.parse_references("Gen 3:16\n", BOOKS)}
