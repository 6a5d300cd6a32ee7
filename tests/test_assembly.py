import random
import re

import pytest

from quillspan.operators import assembly as Y
from quillspan.plans.scratch import Scratch


def brute(front, chapters, header, depth=3):
    seen, toc = {}, []
    for part in (t.strip() for _, t in sorted(chapters) if t):
        code = False
        for line in part.split("\n"):
            if line.startswith("```"):
                code = not code
                continue
            m = re.match(r"^(#{1,6})\s+(.*?)\s*$", line)
            if code or not m:
                continue
            plain = re.sub(r"[*_`]", "", re.sub(r"<!--.*?-->", "", m[2])).strip()
            s = re.sub(r"\s+", "-", re.sub(r"[^\w\s-]", "", plain.strip().lower()))
            n = seen[s] = seen.get(s, -1) + 1
            if 2 <= len(m[1]) <= depth:
                toc.append("  " * (len(m[1]) - 2) + f"- [{plain}](#{s + (f'-{n}' if n else '')})")
    parts = [header, *(t.strip() for _, t in sorted(front) if t), "---\n\n## Table of Contents\n\n" + "\n".join(toc), *(t.strip() for _, t in sorted(chapters) if t)]
    return "\n\n---\n\n".join(p for p in parts if p).split("\n")


CHAPTERS = [(3, "## One\ntext <!-- p. 5 -->\n```\n# not a heading\n```\n### *Sub* part\n\n#### Deep\n"), (1, "\n\n# Top\n## One\n<!-- p. 3 --> and <!-- p.4 -->\n"), (2, "   "), (4, "## Élan & vie <!-- x -->\n```py\n## open fence\n"), (5, "## After an open fence\n##\n##No space\n## One\n<!-- p. 8 -->"), (6, None)]
FRONT = [(1, "Title page\n"), (2, ""), (0, "# Half title\nmore")]


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "assembly-test")


def frames(spark, *tables):
    return [spark.createDataFrame(t, "seq int, text string").repartition(3) for t in tables]


def test_assembled_book(spark, scratch):
    front, chapters = frames(spark, FRONT, CHAPTERS)
    rows = Y.assemble(front, chapters, "<!--\n note\n-->\n\n# Book", scratch).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(len(rows)))
    assert [r.value for r in rows] == brute(FRONT, CHAPTERS, "<!--\n note\n-->\n\n# Book")
    lines = Y.assemble(front, chapters, "# Book", scratch)
    assert [(r.page, r.next) for r in Y.page_gaps(lines, scratch).collect()] == [(5, 8)]


def test_random_books(spark, scratch):
    rng = random.Random(6)
    pieces = ["## A", "### B *x*", "# A", "```", "word", "", "## A", "#### A", "## b_c", "##  Spaced   out ", "text # no", "### `A`"]
    chapters = [(i, "\n".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25)))) for i in range(60)]
    front, parts = frames(spark, FRONT, chapters)
    assert [r.value for r in Y.assemble(front, parts, "h", scratch, depth=4).orderBy("position").collect()] == brute(FRONT, chapters, "h", 4)


def test_book_without_parts(spark, scratch):
    front, chapters = frames(spark, [], [])
    rows = Y.assemble(front, chapters, "# Book", scratch).orderBy("position").collect()
    assert [r.value for r in rows] == ["# Book", "", "---", "", "---", "", "## Table of Contents", ""] and Y.headings(Y.part_lines(chapters), scratch).count() == 0
