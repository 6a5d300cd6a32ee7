import pytest
from pyspark.sql import functions as F

from quillspan.operators import chapters as K
from quillspan.operators import editions as E

CHAPTERS = [(1, "One"), (2, "Two"), (3, "Empty")]
TOPICS = [(1, "faith", None, 2, "t2"), (1, "hope", None, 1, "t1"), (1, "faith", "in trial", 4, "t4"), (1, "faith", "at first", 3, "t3"), (1, "orphan", "child", 5, "t5"), (2, "faith", None, 6, "t6"), (9, "lost", None, 7, "t7")]
CITED = [(1, "faith", None, 3, "c3", "C"), (1, "faith", None, 1, "c1", "A"), (1, "faith", "in trial", 2, "c2", "B"), (1, "unknown", None, 4, "c4", "D"), (9, "lost", None, 5, "c5", "E"), (1, "faith", "nowhere", 6, "c6", "F"), (2, "faith", None, 7, None, None)]


@pytest.fixture(scope="module")
def book(spark):
    return (
        spark.createDataFrame(CHAPTERS, "chapter int, title string"), spark.createDataFrame(TOPICS, "chapter int, topic string, subtopic string, seq int, id string"),
        spark.createDataFrame(CITED, "chapter int, topic string, subtopic string, seq int, id string, text string").repartition(4),
    )


def test_chapter_documents_in_order_and_in_full(book):
    docs = {r.chapter: r for r in K.chapter_documents(*book).collect()}
    assert set(docs) == {1, 2, 3} and docs[3].topics == [] and docs[3].n_citations == 0
    one = docs[1]
    assert (one.title, one.n_citations) == ("One", 3) and [(t.id, t.label) for t in one.topics] == [("t1", "hope"), ("t2", "faith")]
    faith = one.topics[1]
    assert [(c.id, c.text) for c in faith.citations] == [("c1", "A"), ("c3", "C")]
    assert [(s.id, s.label, [c.id for c in s.citations]) for s in faith.subtopics] == [("t3", "at first", []), ("t4", "in trial", ["c2"])]
    assert docs[2].n_citations == 1 and docs[2].topics[0].citations[0].text is None
    only = [df.where("chapter = 2") for df in book]
    assert [r.chapter for r in K.chapter_documents(*only).collect()] == [2]


def test_chapter_documents_of_nothing(book):
    chapters, topics, citations = book
    assert K.chapter_documents(chapters, topics.limit(0), citations.limit(0)).where("size(topics) = 0").count() == 3
    assert K.chapter_documents(chapters.limit(0), topics, citations).count() == 0


def test_rollups(spark, book):
    got = {r.chapter: (r.n_topics, r.n_citations) for r in K.chapter_rollup(*book).collect()}
    assert got == {1: (5, 5), 2: (1, 1), 3: (0, 0)}
    sections = spark.createDataFrame([("Genesis", "Gen"), ("Front", None), ("Ruth", "")], "section string, book string")
    entries = spark.createDataFrame([("Genesis", "heading"), ("Genesis", "prayer"), ("Front", "x"), ("Gone", "y")], "section string, kind string")
    got = {r.id: (r.n_entries, r.has_entries) for r in K.section_rollup(sections, entries, "s1").collect()}
    assert got == {"s1.book.Gen": (2, True), "s1.book.Front": (1, True), "s1.book.Ruth": (0, False)}


def test_corpus_stats(spark):
    records = spark.createDataFrame([(1, None), (2, "exclude"), (3, "explain_only"), (4, "compose")], "id int, policy string")
    passages = spark.createDataFrame([(1, True), (2, True), (3, None), (4, False), (5, True)], "id int, available boolean")
    assert K.corpus_stats(records, passages).first().asDict() == {"records": 4, "passages": 3, "retrievable": 1, "excluded_by_policy": 1, "explain_only": 1}
    assert K.corpus_stats(records.limit(0), passages.limit(0)).first().records == 0


def test_canonical_order(spark):
    df = spark.createDataFrame([("NT", "Mark"), ("OT", "Exod"), ("OT", "Gen"), ("XX", "Gen"), ("OT", "Odd"), ("NT", "Matt"), (None, None)], "c string, b string")
    place = K.canonical_place(F.col("c"), F.col("b"), ["OT", "NT"], ["Gen", "Exod", "Matt", "Mark"])
    assert [tuple(r) for r in df.orderBy(place).collect()] == [("OT", "Gen"), ("OT", "Exod"), ("OT", "Odd"), ("NT", "Matt"), ("NT", "Mark"), ("XX", "Gen"), (None, None)]


@pytest.mark.parametrize(
    ("got", "want", "kind"),
    [
        ("a b c", "a bc", "spacing"), ("ab", "a b", "spacing"), ("the law", "ALEPH the law", "heading"), ("the law", "the law SIN AND SHIN", "heading"), ("the law", "BETH the law GIMEL", "heading"),
        ("the law", "Beth the law", None), ("the law", "the old law", None), ("the law", "A1 the law", None), ("the law", "the", None), ("", "ALEPH", "heading"), ("O LORD", "O LORD LORD", "heading"), ("x", "y", None), ("", "", "spacing"), ("loi", "É loi", "heading"),
    ],
)
def test_kinds_of_difference(spark, got, want, kind):
    assert spark.createDataFrame([(got, want)], "g string, w string").select(E.difference(F.col("g"), F.col("w"))).first()[0] == kind


def test_places_in_an_edition(spark):
    rows = [("Gen", 1, 2), ("PrAzar", 1, 1), ("Sus", 1, 5), ("Bel", 1, 3), ("Nope", 1, 1), (None, 1, 1), ("Dan", 3, 1)]
    df = spark.createDataFrame(rows, "b string, c int, v int").select(E.map_place(F.col("b"), F.col("c"), F.col("v")).alias("p"), E.other_code(F.col("b"), {"Gen": "G"}).alias("o"))
    assert [tuple(r.p) if r.p else None for r in df.collect()] == [("GEN", 1, 2), ("DAG", 3, 24), ("DAG", 13, 5), ("DAG", 14, 3), None, None, ("DAN", 3, 1)]
    assert [r.o for r in df.collect()][:2] == ["G", "PrAzar"]


def test_cross_check_by_hand(spark):
    first = [("PSA", 3, 1, 1, "Lord, how many"), ("PSA", 3, 2, 2, "they  are"), ("PSA", 3, 3, 4, "merged"), ("EZK", 1, 1, 1, "café here"), ("EZK", 1, 2, 2, "gone"), ("EZK", 1, 3, 3, "blank"), ("EZK", 1, 4, 4, "word"), ("EZK", 1, 5, 5, "word two"), (None, 1, 1, 1, "null book")]
    second = [("PSA", 3, 1, "A Psalm of David. Lord, how many"), ("PSA", 3, 2, "BETH they are"), ("PSA", 3, 3, "other"), ("EZE", 1, 1, "café here"), ("EZE", 1, 3, " "), ("EZE", 1, 4, "ward"), ("EZE", 1, 5, "wordtwo"), ("EZK", 1, 2, "wrong code")]
    above = spark.createDataFrame([("PSA", 3, "A Psalm of  David.")], "book string, chapter int, text string")
    a = spark.createDataFrame(first, "book string, chapter int, start int, end int, text string")
    b = spark.createDataFrame(second, "book string, chapter int, verse int, text string")
    rows = {(r.book, r.chapter, r.verse): r.kind for r in E.cross_check(a, b, above).collect()}
    assert rows == {("PSA", 3, 2): "heading", ("EZK", 1, 2): "missing", ("EZK", 1, 3): "missing", ("EZK", 1, 4): "unexplained", ("EZK", 1, 5): "spacing", (None, 1, 1): "missing"}
    assert E.cross_check(a, b).where("chapter = 3 and verse = 1").first().kind == "unexplained" and E.cross_check(a.limit(0), b, above).count() == 0


def test_verse_counts(spark):
    records = spark.createDataFrame([(1, "Gen 1:1-3", 3), (2, "Gen 2:1-2", 2), (3, "x", None), (4, "y", 5), (5, "z", 1)], "id int, ref string, verse_count int")
    passages = spark.createDataFrame([(1, True, ["a", "b"]), (2, True, ["a", "b"]), (3, True, []), (4, False, []), (5, True, None)], "id int, available boolean, verses array<string>")
    assert {tuple(r) for r in E.verse_count_mismatches(records, passages).collect()} == {(1, "Gen 1:1-3", 3, 2), (5, "z", 1, 0)}


def test_every_kind_of_difference_is_met(spark):
    from quillspan import catalog

    kinds = {r.kind: r["count"] for r in catalog.queries()["q62_edition_check"](spark, "/root/testdata/sf0.001").groupBy("kind").count().collect()}
    assert set(kinds) == {"missing", "spacing", "heading", "unexplained"} and min(kinds.values()) > 50
