from dataclasses import replace

import pytest

from quillspan.operators import gate as G
from quillspan.operators import retrieval as L
from quillspan.operators import suggest as P
from quillspan.plans.scratch import Scratch
from quillspan.sources import policies as S
from tests.test_suggest import BANK, TEXTS

GATE = """
sign_off: pending
categories:
  - name: harm
    terms: [end it, "no more"]
  - name: other
    patterns: ['gonna \\w+ it']
allowed_contents: [lament]
notice: >-
  Please talk to
  someone now.
"""
LEXICON = """
themes:
  - name: grief
    terms: [sorrow, tears]
    contents: [lament]
    expansions: [weeping]
  - name: joy
    terms: [glad]
intercessory_markers: [My Mother, them]
stopwords: [the, "no"]
"""
PHRASES = """
address: {fallback: ["Dear friend,"]}
naming:
  first_person: ["We bring what weighs on us:"]
  intercessory: ["We bring someone we love:"]
ask:
  by_content:
    lament: ["Hear the tears of this day."]
  imprecatory: ["Let justice be done."]
  default: ["Hear what is asked here."]
  extensions: ["Keep us in your way through the long night and bring us home when the morning comes again.", "Keep us in your way through the long winter and bring us home when the morning comes again.", "Keep us in your way through the long storm and bring us home when the morning comes again."]
trust: {default: ["We have seen help before and wait for it now."]}
close: {default: ["So be it."]}
instructions:
  why_it_fits:
    template: "{speaker_clause} {contents_clause}{themes_clause}"
    speaker_by_collective: {false: "{speaker} said it {context_gloss}.", true: "{speaker} said it together."}
    contents_clause: "It holds {contents}."
    themes_clause: " It was about {themes}."
  context_gloss: {solitary: "alone", other: "somewhere"}
  how_to_pray:
    by_context: {solitary: "Say it alone.", other: "Say it."}
    single_verse_note: " It is short."
  posture: {solitary: "Alone.", other: "Any."}
explain_only_note: >-
  Not for you
  to say.
"""


@pytest.fixture
def folder(tmp_path):
    for name, text in (("gate", GATE), ("lexicon", LEXICON), ("phrases", PHRASES)):
        (tmp_path / f"{name}.yaml").write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_whole_answer_from_files(spark, folder):
    gate, lexicon = S.load_gate(f"{folder}/gate.yaml"), S.load_lexicon(f"{folder}/lexicon.yaml")
    bank, guide, note = S.load_phrases(f"{folder}/phrases.yaml", frozenset({"curse"}), ("Lord", "God"))
    assert (gate.notice, gate.narrow_to, gate.approved) == ("Please talk to someone now.", ("lament",), False) and note == "Not for you to say."
    assert [t.name for t in lexicon.themes] == ["grief", "joy"] and lexicon.markers == ["my mother", "them"] and lexicon.stopwords == ("the", "no")
    assert bank.ask_by_label == {"lament": ("Hear the tears of this day.",)} and bank.stern_ask == ("Let justice be done.",) and len(bank.extensions) == 3
    corpus = spark.createDataFrame([(i, f"t{i}", t, ["lament"] if i != 2 else ["praise"], None, "solitary", "Moses") for i, t in TEXTS.items()], "doc_id long, title string, text string, labels array<string>, policy string, context string, speaker string")
    asked = spark.createDataFrame([(1, "I have sorrow"), (2, "zzz qqq"), (3, "I'm gonna END it, sorrow")], "query_id long, text string")
    index = L.build_index(corpus, {"text": 1}, Scratch(spark, "policies-test"))
    out = {r.query_id: r for r in P.suggest(asked, corpus, index, bank, gate.categories, lexicon.themes, lexicon.markers, stopwords=lexicon.stopwords, narrow_to=gate.narrow_to, threshold=0.0001, guide=guide, explain_note=note, notice=gate.notice, message="Nothing is close enough.").collect()}
    assert (out[1].notice, out[1].message, out[1].abstained) == (None, None, False)
    assert (out[2].notice, out[2].message, out[2].abstained, out[2].suggestions) == (None, "Nothing is close enough.", True, [])
    assert (out[3].status, out[3].notice, out[3].hits) == ("crisis", gate.notice, ["harm", "other"]) and all("lament" in s.labels for s in out[3].suggestions)
    first = out[1].suggestions[0]
    assert first.instructions.why == "Moses said it alone. It holds lament. It was about grief." and first.instructions.posture == "Alone." and first.movements["address"]


def test_missing_files_and_wrong_values(spark, tmp_path, folder):
    assert S.load_gate(f"{folder}/none.yaml") == S.Gate() and S.load_lexicon(f"{folder}/none.yaml") == S.Lexicon() and S.load_overlay(spark, f"{folder}/none.yaml").count() == 0
    with pytest.raises(FileNotFoundError):
        S.load_phrases(f"{folder}/none.yaml")
    (tmp_path / "bad.yaml").write_text("themes:\n  - {name: x, terms: [no]}\n")
    with pytest.raises(ValueError, match="no|False"):
        S.load_lexicon(str(tmp_path / "bad.yaml"))
    (tmp_path / "bad.yaml").write_text("categories:\n  - {name: x, terms: [7]}\n")
    with pytest.raises(ValueError, match="x.terms"):
        S.load_gate(str(tmp_path / "bad.yaml"))


def test_overlay(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("prayers:\n  a: exclude\n  b: {policy: explain_only, reason: 'said in anger'}\n  c: {reason: 'none given'}\n  unknown: exclude\n")
    records = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    got = {r.id: (r.policy, r.reason) for r in G.with_policy(records, S.load_overlay(spark, str(tmp_path / "p.yaml"))).collect()}
    assert got == {"a": ("exclude", None), "b": ("explain_only", "said in anger"), "c": ("compose", "none given"), "d": ("compose", None)}


def test_settings(tmp_path):
    (tmp_path / "s.yaml").write_text("defaults: {k: 5, retriever: hybrid}\nretrieval: {psalm_penalty: 0.2}\nunknown: 1\ninclude_copyrighted_text: true\n")
    s = S.load_settings(str(tmp_path / "s.yaml"), "APP_", {"APP_K": "7", "APP_INCLUDE_COPYRIGHTED_TEXT": "off", "K": "9"})
    assert (s.k, s.retriever, s.psalm_penalty, s.include_copyrighted_text, s.candidate_pool) == (7, "hybrid", 0.2, False, 25)
    assert S.load_settings(None, "APP_", {}) == S.Settings() == S.load_settings(str(tmp_path / "none.yaml"), "APP_", {})
    with pytest.raises(ValueError, match="k: 'x' is no int"):
        S.load_settings(None, "APP_", {"APP_K": "x"})


def test_rest_of_the_candidates_is_composed_when_the_first_fail(spark):
    """What is composed from the ten records that rank highest breaks a rule; the eleventh is still suggested."""
    rows = [(i, "t", TEXTS[1].replace("by day", "sorrow sorrow sorrow by day"), ["curse"], None) for i in range(1, 11)] + [(11, "t", TEXTS[1], ["lament"], None)]
    corpus = spark.createDataFrame(rows, "doc_id long, title string, text string, labels array<string>, policy string")
    bank, index = replace(BANK, stern_ask=("Smite them all.",)), L.build_index(corpus, {"text": 1}, Scratch(spark, "policies-test"))
    ask = lambda **more: [s.doc_id for s in P.suggest(spark.createDataFrame([(1, "sorrow")], "query_id long, text string"), corpus, index, bank, [], [], threshold=0.0001, **more).first().suggestions]
    assert ask() == [1, 2, 3] and ask(forbidden="smite") == [11]
