"""The whole answer to a request, against the rules of each step."""

import pytest

from quillspan.operators import compose as C
from quillspan.operators import gate as G
from quillspan.operators import retrieval as L
from quillspan.operators import suggest as P
from quillspan.plans.scratch import Scratch

LINE = "Keep us in your way through the long night and bring us home when the morning comes again."
BANK = P.Bank(
    address=("Dear friend,",), naming=("We bring what weighs on us:",), naming_for_others=("We bring someone we love:",), ask=("Hear what is asked here.",), trust=("We have seen help before and wait for it now.",), close=("So be it.",),
    extensions=(LINE, LINE.replace("night", "winter"), LINE.replace("night", "storm"), LINE.replace("night", "drought")), ask_by_label={"lament": ("Hear the tears of this day.",)}, stern_labels=frozenset({"curse"}), stern_ask=("Let justice be done.",), vocatives=("Lord", "God"),
)
TEXTS = {
    1: "He said, “O Lord, the God of hosts, my sorrow is heavy and my tears have been my food by day and by night. You have seen all of it.”",
    2: "The harvest was gathered and the people sang for joy in the fields of the valley.",
    3: "My sorrow is secret and should not be shown to anyone at all in this place.",
    4: "Sorrow came over the city like rain over dry and open land in the seventh month.",
    5: "",
}


@pytest.fixture(scope="module")
def answers(spark):
    cols = "doc_id long, title string, text string, labels array<string>, policy string"
    labels = {1: ["lament"], 2: ["praise"], 3: ["lament"], 4: ["curse"], 5: ["lament"]}
    corpus = spark.createDataFrame([(i, f"t{i}", t, labels[i], {3: "exclude", 4: "explain_only"}.get(i)) for i, t in TEXTS.items()], cols)
    asked = spark.createDataFrame([(1, "My mother has sorrow, tears"), (2, "zzz qqq"), (3, "I want to end it, sorrow harvest"), (4, None)], "query_id long, text string")
    themes = [G.Theme("grief", ["sorrow"], ["lament"], [], ["weeping"])]
    out = P.suggest(asked, corpus, L.build_index(corpus, {"text": 1, "title": 2}, Scratch(spark, "test")), BANK, [G.Category("harm", ["end it"])], themes, ["mother"], {"lament": "tears of grief"}, narrow_to=("lament",), threshold=0.0001)
    return {r.query_id: r for r in out.collect()}


def test_answers(answers):
    assert {i: r.abstained for i, r in answers.items()} == {1: False, 2: True, 3: False, 4: True}
    assert [s.doc_id for s in answers[1].suggestions] == [1, 4] and [s["rank"] for s in answers[1].suggestions] == [1, 2]
    assert answers[3].status == "crisis" and [s.doc_id for s in answers[3].suggestions] == [1]
    assert answers[1].status == "ok" and answers[2].suggestions == []


def test_composition_keeps_the_rules(answers):
    first, second = answers[1].suggestions
    assert first.movements["anchor"] in TEXTS[1] and 60 <= first.word_count <= 180 and first.movements["address"] == "O Lord, the God of hosts,"
    assert first.movements["ask"].startswith("Hear the tears") and first.movements["naming"].startswith("We bring someone we love: ")
    assert first.matched_on[:2] == ["lament", "grief"] and "sorrow" in first.matched_on
    assert second.movements is None and second.word_count is None


def answer(spark, make, text="I have sorrow", **more):
    corpus = spark.createDataFrame([(1, "t", TEXTS[1], ["lament"], None)], "doc_id long, title string, text string, labels array<string>, policy string")
    asked = spark.createDataFrame([(1, text)], "query_id long, text string")
    out = P.suggest(asked, corpus, L.build_index(corpus, {"text": 1}, Scratch(spark, "test")), BANK, [G.Category("harm", ["end it"])], [], threshold=0.0001, make=make, **more)
    return out.first().suggestions[0]


def good(i, text, *_):
    return {"movements": {"address": "Hello,", "anchor": text[9:40], "naming": "word " * 60, "ask": "Help.", "close": "End."}, "start": 9}


def test_fallback_of_a_faulty_composer(spark):
    def raises(*_):
        raise RuntimeError

    def short(i, text, *_):
        return {"movements": {"address": "Hello,", "anchor": text[9:40], "naming": "x", "ask": "Help.", "close": "End."}, "start": 9}

    def made_up(i, text, *_):
        return good(i, text) | {"movements": good(i, text)["movements"] | {"anchor": "It never said this."}}

    for make, error in ((raises, "RuntimeError"), (short, "rules"), (made_up, "rules"), (lambda *_: None, None)):
        got = answer(spark, make)
        assert got.fallback_used and got.composer_error == error and got.movements["anchor"] in TEXTS[1] and got.movements["address"] == "O Lord, the God of hosts,"
    taken = answer(spark, good)
    assert not taken.fallback_used and taken.movements["address"] == "Hello," and taken.composer_error is None
    assert answer(spark, good, "I want to end it, sorrow").movements["address"] == "O Lord, the God of hosts,"  # no other composer in a crisis


def test_citations_instructions_and_excerpts(spark):
    verses = [(f"Ps.1.{i}", f"Verse {i} tells of sorrow and of you in my long night.") for i in range(1, 31)]
    rows = [(1, "t", " ".join(t for _, t in verses), ["lament"], None, ["Ps 1:1-30", "Ps 2"], verses, "exile", "the people", True, None), (2, "u", verses[0][1], ["curse"], "explain_only", ["Ps 3"], verses[:1], "other", "David", False, "too  harsh")]
    cols = "doc_id long, title string, text string, labels array<string>, policy string, refs array<string>, verses array<struct<osis:string,text:string>>, context string, speaker string, collective boolean, reason string"
    corpus = spark.createDataFrame(rows, cols)
    guide = P.Guide(gloss_by_context={"exile": "far from home", "other": "at some time"}, how_by_context={"exile": "Slowly.", "other": "Aloud."}, single_verse=" Twice.", long_passage=" In parts.", stern=" With care.", no_themes="Nothing was named.")
    asked = spark.createDataFrame([(1, "I have sorrow")], "query_id long, text string")
    out = P.suggest(asked, corpus, L.build_index(corpus, {"text": 1}, Scratch(spark, "test")), BANK, [], [], threshold=0.0, guide=guide, explain_note="Not to be spoken.")
    one, two = sorted(out.first().suggestions, key=lambda s: s.doc_id)
    text = dict(verses)[one.anchor_osis]
    assert one.movements["anchor"].split(".")[0] in text and one.reference == "Ps 1:1-30" and one.parallels == ["Ps 2"]
    assert len(one.excerpt.split(". ")) == 8 and text in one.excerpt and two.excerpt is None
    assert one.instructions.why == "the people spoke it together (far from home). It holds lament. Nothing was named." and one.instructions.how == "Slowly. In parts."
    assert two.instructions.how == "Aloud. Twice. With care." and two.note == "Not to be spoken. too harsh" and two.spoken is None

    def wrong(i, t, *_):
        return good(i, t) | {"osis": "Ps.9.9"}

    assert answer(spark, wrong).composer_error is None  # without verses there is nothing to cite


@pytest.mark.parametrize("n", [1, 5, 30, 90, 400])
def test_word_budget(spark, n):
    text = "Lord, " + " ".join(f"word{i}" for i in range(n)) + "."
    rows = spark.createDataFrame([(1, text, [], [], [], False, "x " * n), (2, " ", [], [], [], False, "")], "doc_id long, text string, labels array<string>, tokens array<string>, q_labels array<string>, for_others boolean, subject string")
    made, empty = (r.own for r in P.compose(rows, BANK).orderBy("doc_id").collect())
    words = sum(len(v.split()) for v in made["movements"].values())
    assert C.LOW <= words <= C.HIGH and made["movements"]["anchor"] in text and text[made["start"] :].startswith(made["movements"]["anchor"])
    assert empty.movements is None


def test_own_addresses():
    cases = {
        "He said, “O Lord, the God of hosts, hear": ("O Lord, the God of hosts", 35),
        "Lord! Hear": ("Lord", 5),
        "Lordly things, they": None,
        "“ Lord of all things here. God, hear": ("Lord of all things here, God", 31),
        "God; hear": None,
        "Lord": None,
        "O Lord, who is there, say": ("O Lord", 7),
        "Lord " + "x" * 70 + ", hear": None,
        "": None,
    }
    assert {t: P.own_address(t, ("Lord", "God")) for t in cases} == cases


def test_reasons(spark):
    cols = "a array<string>, b array<string>, n int"
    df = spark.createDataFrame([(["x", "y"], ["semantic similarity", "x"], 2), ([], ["semantic similarity"], 1), (["p", "q", "r", "s", "t"], None, 2)], cols)
    assert [r[0] for r in df.select(P.fused_reasons(df.a, df.b, df.n)).collect()] == [["x", "y", "both retrievers agree"], ["semantic similarity"], ["p", "q", "r", "s", "both retrievers agree"]]


def test_query_terms(spark):
    df = spark.createDataFrame([(1, ["sorrow", "sorrow"], ["lament"], ["home"], ["weeping"])], "query_id long, tokens array<string>, labels array<string>, contexts array<string>, expansions array<string>")
    got = {r.term: r.weight for r in P.query_terms(df, {"lament": "tears of sorrow", "praise": "joy"}).collect()}
    assert got == pytest.approx({"sorrow": 2.5, "lament": 1.5, "home": 1.0, "weeping": 0.7, "tears": 0.5})
