import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspan.operators import benchmark as N

LABELS, CONTEXTS = {"petition": "Asking God for something.", "praise": "Honouring God"}, {"public": "Said before others.", "odd": ""}
RECORDS = [
    ("p.1", "Moses Prays for Israel.", "Moses", ["Moses"], ["petition", "unknown"], "public"), ("p.2", "God Praises God for God", "God", ["God"], ["praise", "petition"], None), ("p.3", "Hannah Laments and Asks", "Hannah", None, None, "odd"),
    ("p.4", "The People Pray", "The People", ["The People", "People"], [], "public"), ("p.5", "Makes an Oath", None, [], None, None), ("p.6", None, "X", ["X"], ["praise"], "public"), *((f"q.{i}", f"Ruth {v} Naomi", "Ruth", ["Naomi", ""], ["praise"], "public") for i, v in enumerate(["Prays to", "Complains About", "Repents for", "Intercede for", "Blesses"])),
]


def brute(record):
    i, title, speaker, agents, labels, context = record
    title = title or ""
    for pattern, other in N.VERBS:
        title = re.sub(pattern, other, title)
    if hashlib.sha256(i.encode()).digest()[0] % 2 == 0 and speaker and speaker.lower() != "god":
        title = title.replace(speaker, "someone")
        for a in agents or []:
            title = title.replace(a, "someone") if a else title
    parts = [title.lower().rstrip("."), "; ".join(d.lower().rstrip(".") for d in (LABELS.get(x, "") for x in labels or []) if d), CONTEXTS.get(context, "").lower().rstrip(".")]
    return ". ".join(p for p in parts if p) + "."


def test_requests_made_of_records(spark):
    df = spark.createDataFrame(RECORDS, "id string, title string, speaker string, agents array<string>, labels array<string>, context string")
    asked, qrels = N.known_items(df, LABELS, CONTEXTS)
    got = {r.gold: (r.query_id, r.text) for r in asked.collect()}
    assert got == {r[0]: ("t1." + r[0].split(".")[-1], brute(r)) for r in RECORDS}
    assert any("someone" in t for _, t in got.values()) and {(r.doc_id, r.grade) for r in qrels.collect()} == {(r[0], 2) for r in RECORDS}


def test_grid_by_hand(spark):
    cols = "query_id string, doc_id string, rank int"
    a = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("p", "z", 1), ("p", "x", 26)], cols)
    b = spark.createDataFrame([("q", "b", 1), ("p", "x", 6), ("p", "y", 1)], cols)
    qrels = spark.createDataFrame([("q", "b", 2), ("p", "x", 2), ("o", "w", 1)], "query_id string, doc_id string, grade int")
    labels = spark.createDataFrame([("a", ["petition"]), ("b", ["petition"]), ("c", ["praise"]), ("x", ["praise"]), ("y", ["praise", "petition"]), ("z", None)], "doc_id string, labels array<string>")
    gold = qrels.select("query_id", "doc_id")
    got = {r.run: r for r in N.grid({"a": a, "b": b, "none": a.limit(0)}, qrels, labels, gold, labels.where("doc_id = 'a'")).collect()}
    assert [(r.n, r.recall_1, r.recall_5, r.recall_10, r.mrr) for r in (got["a"], got["b"], got["none"])] == [(3, 0, pytest.approx(1 / 3), pytest.approx(1 / 3), pytest.approx(0.5 / 3)), (3, pytest.approx(1 / 3), pytest.approx(1 / 3), pytest.approx(2 / 3), pytest.approx((1 + 1 / 6) / 3)), (3, 0, 0, 0, 0)]
    assert got["a"].ndcg_10 == pytest.approx(1 / math.log2(3) / 3) and got["b"].ndcg_10 == pytest.approx((1 + 1 / math.log2(7)) / 3)
    assert got["a"].label_precision_5 == pytest.approx((2 / 3) / 3) and got["b"].label_precision_5 == pytest.approx((1 + 1) / 3) and got["a"].flagged_5 == pytest.approx((1 / 3) / 3)


def brute_grade(text):
    words = re.findall(r"'*[a-z][a-z']*", text.lower())
    sentences = sum(bool(re.search("[a-z]", s)) for s in re.split(r"[.!?]+", text.lower()))
    if not words:
        return None

    def syllables(w):
        runs = len(re.findall("[aeiouy]+", w))
        return max(1, runs - (1 if re.search("[^aeiouyl]e$", w) and runs > 1 else 0))

    return 0.39 * len(words) / sentences + 11.8 * sum(map(syllables, words)) / len(words) - 15.59


def test_reading_grade(spark):
    rng = random.Random(7)
    texts = ["The cat sat on the mat.", "", "123 ... !", "Table apple make free the rhythm", "Don't stop! 'Tis 'the' end?", "One\n\ntwo.three", "Ünïcode é words here."]
    texts += [" ".join(rng.choice(["make", "strengths", "a", "able,", "idea.", "queue!", "it's", "e", "me?", "...", "the"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "i int, t string")
    got = {r.i: r.g for r in df.select("i", N.reading_grade(F.col("t")).alias("g")).collect()}
    assert got == {**{i: pytest.approx(brute_grade(t)) if brute_grade(t) is not None else None for i, t in enumerate(texts)}, 999: None}
    assert got[0] == pytest.approx(0.39 * 6 + 11.8 - 15.59)


def test_composition_rates(spark):
    part = "struct<address:string,anchor:string,close:string>"
    rows = [
        ("r", 1, ("To all,", "the words", "End."), "B.1.1", "The cat sat on the mat.", 70, False, 1), ("r", 1, ("To all,", "not there", "End."), "B.9.9", "The cat.", 50, True, 2), ("r", 2, ("To all,", "more", ""), "B.1.2", "A dog ran.", 180, False, 0),
        ("r", 3, None, None, None, None, None, None), ("s", 3, None, None, None, None, None, None),
    ]
    made = spark.createDataFrame(rows, f"run string, doc_id int, movements {part}, anchor_osis string, spoken string, word_count int, fallback_used boolean, retry_count int")
    passages = spark.createDataFrame([(1, "these are the words of it", ["B.1.1"]), (2, "more and more", ["B.1.2", "B.1.3"])], "doc_id int, text string, osis array<string>")
    got = {r.run: r for r in N.composition_rates(made, passages).collect()}
    r = got["r"]
    assert (r.explain_only, r.n, r.median_words, r.retries) == (1, 3, 70, 3)
    assert [round(x, 6) for x in (r.verbatim, r.citation, r.complete, r.words_in_range, r.fallback)] == [round(2 / 3, 6)] * 4 + [round(1 / 3, 6)]
    assert r.median_grade == pytest.approx(sorted(map(brute_grade, ("The cat sat on the mat.", "The cat.", "A dog ran.")))[1])
    assert (got["s"].n, got["s"].explain_only, got["s"].verbatim, got["s"].median_words) == (0, 1, None, None)
