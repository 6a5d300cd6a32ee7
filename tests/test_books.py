"""Books of entries and books of citations, with malformed and misplaced lines."""

from quillspan.functions import refs as R
from quillspan.operators import books as B

BOOKS = R.Books({"genesis": "Gen", "ruth": "Ruth", "psalm": "Ps"}, {"Gen": 50, "Ruth": 4, "Ps": 150})

ENTRIES = """#### Too Early (1:1)
# Old Testament
### Genesis
An introduction. Let us learn from it that we should ask for what we need each day.
#### Prayer of One (4:26)
A paragraph.
> Then began men
> — Genesis 4:26
#### Prayer of One
No reference.
#### Bad (Genesis 99)
### Advert
#### Hidden (1:1)
## Other Heading
### Ruth
#### Another (see 2:3; 3)"""

CITES = """Front matter
**Genesis 1:1** — too early
<!-- page 5 -->
## Chapter IV. On Giving
### Alms
**Psalm 1:1** — Blessed is the man.
#### In Secret
**Psalm 2:1; (see Alms, above)** *(as previously quoted under Alms, above)*
<!-- page 6
still a comment
-->
Prose here.
**Any Good — Psalm 34:10** odd tail
### Last
**Psalm 3**
"""


def test_sections(spark):
    docs = spark.createDataFrame([(1, ENTRIES), (2, None), (3, "")], "doc_id long, text string")
    rows = B.sections(docs, BOOKS, {"Old Testament": "OT"}, skip=("Advert",)).orderBy("line").collect()
    assert [(r.kind, r.title, r.slug, r.ref_raw) for r in rows] == [
        ("section", "Genesis", "genesis", None),
        ("entry", "Prayer of One", "prayer-of-one", "4:26"),
        ("entry", "Prayer of One", "prayer-of-one-1", None),
        ("entry", "Bad", "bad", "Genesis 99"),
        ("entry", "Another", "another", "see 2:3; 3"),
    ]
    assert len(rows[0].application_sentences) == 1 and rows[1].body.quotes[0].refs == ["Gen.4.26"] and [x.book for x in rows[1].refs] == ["Gen"]
    assert len(rows[3].problems) == 1 and [(x.book, x.lo_chapter, x.role) for x in rows[4].refs] == [("Ruth", 2, "see_also"), ("Ruth", 3, "see_also")]
    assert {r.canon for r in rows} == {"OT"}


def test_citations(spark):
    docs = spark.createDataFrame([(1, CITES), (2, None)], "doc_id long, text string")
    lines = B.citation_lines(docs).cache()
    rows = B.citations(lines, "src").orderBy("line").collect()
    assert [(r.id, r.topic, r.subtopic, r.page, r.ref_raw, r.text_source) for r in rows] == [
        ("src.0001", "Alms", None, 5, "Psalm 1:1", "inline"),
        ("src.0002", "Alms", "In Secret", 5, "Psalm 2:1", "back_reference"),
        ("src.0003", "Any Good", None, 6, "Psalm 34:10", "other"),
        ("src.0004", "Last", None, 6, "Psalm 3", "none"),
    ]
    assert rows[0].text == "Blessed is the man." and rows[0].chapter_n == 4 and rows[0].chapter == "On Giving"
    assert (rows[1].back_reference_kind, rows[1].target, rows[1].see_also) == ("previously_quoted", "Alms", "Alms")
    counts = {r.bucket: r["count"] for r in lines.where("doc_id = 1").groupBy("bucket").count().collect()}
    assert counts == {None: 2, "comment": 4, "chapter": 1, "topic": 3, "citation": 4, "prose": 1, "blank": 1}
