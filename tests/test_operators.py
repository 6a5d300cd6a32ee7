import zipfile

import pytest
from pyspark.sql import functions as F

from quillspan.functions import refs as R
from quillspan.functions import text as X
from quillspan.operators import aggregates as A
from quillspan.operators import compose as C
from quillspan.operators import gate as G
from quillspan.operators import intervals as I
from quillspan.operators import metrics as M
from quillspan.operators import ordered as O
from quillspan.operators import retrieval as L
from quillspan.plans.scratch import Scratch
from quillspan.plans import registry
from quillspan.sources import files
from quillspan.streaming.gate_stream import gated

BOOKS = R.Books({"gen": "Gen", "genesis": "Gen", "mark": "Mk", "mk": "Mk", "1 kings": "1Kgs", "jude": "Jude"}, {"Gen": 50, "Mk": 16, "1Kgs": 22, "Jude": None})


def column(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Gen 3:16-18", [("Gen", 3, 16, 3, 18)]),
        ("Genesis 3:16a; 4:1, 5", [("Gen", 3, 16, 3, 16), ("Gen", 4, 1, 4, 1), ("Gen", 4, 5, 4, 5)]),
        ("Mk 1:40-2:3", [("Mk", 1, 40, 2, 3)]),
        ("Gen 3–5", [("Gen", 3, None, 5, None)]),
        ("Jude 3, 5-7", [("Jude", 1, 3, 1, 3), ("Jude", 1, 5, 1, 7)]),
        ("I Kings 8:22", [("1Kgs", 8, 22, 8, 22)]),
        ("Gen 1:1; Mk 2:1; 40:3", [("Gen", 1, 1, 1, 1), ("Mk", 2, 1, 2, 1), ("Gen", 40, 3, 40, 3)]),
        ("3:4", [(None,) * 5]),
        ("Gen 9:9-1", [(None,) * 5]),
        ("", []),
        (None, []),
    ],
)
def test_references(raw, want):
    assert [r[:5] for r in R.parse_references(raw, BOOKS)] == want


def test_reference_origins():
    rows = R.parse_references("Gen 1:1; Mk 2:1; 40:3; x", BOOKS)
    assert [r[6] for r in rows] == ["stated", "stated", "anchor_fallback", None] and rows[3][7] == "not a reference"


def test_relations_and_ties(spark):
    cols = "id string, seq int, book string, lo long, hi long"
    a = spark.createDataFrame([("a", 0, "G", 10, 20), ("a", 1, "G", 100, 100), ("x", 0, None, 1, 2)], cols)
    b = spark.createDataFrame([("same", 0, "G", 10, 20), ("around", 0, "G", 5, 30), ("in", 0, "G", 12, 13), ("part", 0, "G", 18, 25), ("touch", 0, "G", 20, 21), ("far", 0, "G", 30, 40), ("two", 0, "G", 19, 30), ("two", 1, "G", 1, 500)], cols)
    want = {("same", "exact"), ("around", "contains"), ("in", "within"), ("part", "overlaps"), ("touch", "overlaps"), ("two", "contains")}
    assert {(r.b_id, r.relation) for r in I.strongest(I.overlap_join(a, b)).collect()} == want
    plain = I.overlap_join(a, b).collect()
    assert sorted(map(str, plain)) == sorted(map(str, I.overlap_join(a, b, bin_size=7).select(*plain[0].asDict()).collect()))
    found = I.containing(a.where("seq = 0"), b.where("seq = 0").withColumn("seq", F.monotonically_increasing_id())).collect()
    assert {r.id: r.span_id for r in found} == {"a": "same", "x": None}


def test_resolution_prefers_exact(spark):
    cols = "id string, seq int, book string, lo long, hi long"
    t = spark.createDataFrame([("t", 0, "G", 5, 6), ("u", 0, "G", 7, 7), ("v", 0, "H", 1, 1)], cols)
    s = spark.createDataFrame([("wide", 0, "G", 1, 9), ("late", 2, "G", 5, 6), ("early", 1, "G", 5, 6)], cols)
    assert {r.id: (r.source_id, r.how) for r in I.resolve(t, s).collect()} == {"t": ("early", "exact"), "u": ("wide", "containing_range"), "v": (None, None)}


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("p", "z", 1)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "b", 2), ("p", "y", 1), ("o", "x", 0)], "query_id string, doc_id string, grade int")
    got = {r.query_id: (r.recall, r.rr) for r in M.per_query(ranked, qrels, 2).collect()}
    assert got == {"q": (1.0, 0.5), "p": (0.0, 0.0), "o": (0.0, 0.0)}
    best = M.per_query(spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], ranked.schema), spark.createDataFrame([("q", "a", 2), ("q", "b", 1)], qrels.schema), 10).first()
    assert best.ndcg == 1.0
    p = M.nearest_rank(spark.createDataFrame([("x", i) for i in range(20)], "k string, v int"), "v", 0.95, ["k"]).first()
    assert p.percentile == 19


def test_filters_and_ties(spark):
    docs = spark.createDataFrame([(1, "compose", "OT", ["a"]), (2, "exclude", "OT", ["a"]), (3, None, "NT", None), (4, None, "OT", [])], "doc_id long, policy string, canon string, labels array<string>")
    ids = lambda f: [r.doc_id for r in docs.where(f.column(docs)).orderBy("doc_id").collect()]
    assert ids(L.Filters()) == [1, 3, 4] and ids(L.Filters(canon=("OT",), exclude_ids=(4,))) == [1] and ids(L.Filters(allowed=("a", "b"))) == [1]
    same = spark.createDataFrame([(1, "love peace"), (2, "love peace"), (3, "war")], "doc_id long, text string")
    out = L.bm25(L.weighted_terms(spark.createDataFrame([(9, "peace peace and")], "query_id long, text string")), L.build_index(same, {"text": 2}, Scratch(spark, "test")), 5).collect()
    assert [r.doc_id for r in out] == [1, 2] and out[0].score == out[1].score
    terms = L.matched_terms(L.weighted_terms(spark.createDataFrame([(9, "love peace")], "query_id long, text string")), L.build_index(same, {"text": 1}, Scratch(spark, "test"))).where("doc_id = 1").first()
    assert terms.terms == ["peace", "love"]


def test_fusion_and_abstention(spark):
    cols = "query_id long, doc_id long, score double, rank int"
    a, b = spark.createDataFrame([(1, 10, 5.0, 1), (1, 11, 4.0, 2)], cols), spark.createDataFrame([(1, 11, 0.9, 1)], cols)
    out = L.fuse([a, b]).collect()
    assert [(r.doc_id, r.n_lists) for r in out] == [(11, 2), (10, 1)] and out[0].score == round((1 / 61 + 1 / 62) / (2 / 61), 6)
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    assert {r.query_id: r.abstained for r in L.abstains(L.fuse([a, b]), q, 0.08).collect()} == {1: False, 2: True}


def test_ordered(spark):
    rows = [("d", i, v) for i, v in enumerate(["# A", "x", "## a", "y", "# B", "z"], 1)]
    lines = spark.createDataFrame(rows, "doc_id string, line int, value string")
    levels = [("top", F.when(F.col("value").rlike("^# "), F.col("value"))), ("sub", F.when(F.col("value").rlike("^## "), F.col("value")))]
    got = [(r.top, r.sub) for r in O.forward_fill(lines, ["doc_id"], "line", levels).orderBy("line").collect()]
    assert got == [("# A", None), ("# A", None), ("# A", "## a"), ("# A", "## a"), ("# B", None), ("# B", None)]
    parts = {r.island: (r["head"], r.body) for r in O.segments(lines, F.col("value").rlike("^# ")).collect()}
    assert parts == {1: ("# A", ["x", "## a", "y"]), 2: ("# B", ["z"])}
    inside = O.inside_spans(lines, ["doc_id"], "line", F.col("value") == "x", F.col("value") == "y").orderBy("line").collect()
    assert [r.inside for r in inside] == [False, True, True, True, False, False]
    assert column(spark, O.excerpt(F.col("a"), F.lit(0)), a=list(range(30))) == list(range(8)) and column(spark, O.excerpt(F.col("a"), F.lit(29)), a=list(range(30))) == list(range(22, 30))
    assert [column(spark, O.offset_to_item(F.col("a"), F.lit(k)), a=[3, 4]) for k in (0, 3, 4, 7)] == [0, 0, 1, 1]


def test_text(spark):
    t = F.col("t")
    assert column(spark, X.terms(t, ("the",)), t="The Café can't BE the, one!") == ["caf", "can't", "one"]
    assert column(spark, X.ngrams(X.words(t), 3), t="a b c d") == ["a b c", "b c d"] and column(spark, X.ngrams(X.words(t), 3), t="a b") == []
    assert column(spark, X.english_list(t), t=["a_b", "c", "d"]) == "a b, c and d"
    assert column(spark, X.snippet(t, ["zzz", "needle"]), t="x" * 100 + " needle " + "y" * 300).startswith("…")
    assert column(spark, X.rotate(t, F.lit(4)), t=[1, 2, 3]) == [2, 3, 1]
    assert column(spark, X.split_names(t), t="Moses, Aaron, and Hur") == ["Moses", "Aaron", "Hur"]
    assert column(spark, X.path_slug(t, F.lit("B_c!")), t="A x") == "a-x-b-c" and column(spark, X.holds_all(t, []), t="x") is True
    assert [column(spark, X.read_seconds(t), t=n) for n in (1, 150)] == [1, 60]


def test_gate_and_analysis(spark):
    df = spark.createDataFrame([("I’m ill and My daughter won't eat.",), ("The skill is mine",), (None,)], "text string")
    out = gated(df, "text", [G.Category("body", ["ill"]), G.Category("food", [], ["won't eat"])], [G.Theme("health", ["ill"], ["petition"], [], ["heal"])])
    assert [r.hits for r in out.collect()] == [["body", "food"], [], []]
    assert out.first().labels == ["petition"] and out.first().expansions == ["heal"]
    assert df.select(G.subject(F.col("text"), F.lit(True))).first()[0] == "they are ill and Their daughter will not eat."
    said = "It's my job, and I can't sleep; Don't say he's  wrong. I'd go" + " on" * 40
    mine = spark.createDataFrame([(said,), ("  ",), ("I’ve seen X'mas and rock'n'roll!",)], "text string").select(G.subject(F.col("text"), F.lit(False))).collect()
    assert mine[0][0].startswith("It is my job, and I cannot sleep; Do not say he is wrong. I would go on on") and mine[0][0].endswith(" on...") and len(mine[0][0].split()) == 40
    assert [r[0] for r in mine[1:]] == ["", "I have seen X'mas and rock'n'roll!"]


def test_anchor_is_verbatim():
    text = "He came and said: “O Lord my God, hear the prayer which your servant prays before you today; keep your word.” Then he went."
    a, b = C.choose_anchor(text, {"prayer"})
    assert "“" not in text[a:b] and text[a:b] in text and 8 <= len(text[a:b].split()) <= 45
    assert C.choose_anchor("   ", set()) is None and C.choose_anchor("word " * 100, set()) == (0, 45 * 5 - 1)


def test_violations(spark):
    passage = "one two three four five six seven eight"
    m = {"address": "O,", "anchor": "two three", "naming": "one two three four five six", "ask": "smite them", "close": "Amen."}
    got = column(spark, C.violations(F.col("m"), F.lit(passage), forbidden="smite"), m=m)
    assert got == ["quotes_passage", "words", "harm"]
    assert "anchor_not_verbatim" in column(spark, C.violations(F.col("m"), F.lit("other"), forbidden=None), m=m)
    assert "harm" not in column(spark, C.violations(F.col("m"), F.lit(passage), forbidden="smite", stern=F.lit(False)), m=m)
    told = {"address": "one two three four five six,", "anchor": "two three", "naming": "w " * 60, "ask": "Help.", "close": "Amen."}
    rules = lambda **k: column(spark, C.violations(F.col("m"), F.lit(passage), **k), m=told)
    assert rules() == [] and rules(address_declared=F.lit(True)) == [] and rules(address_declared=F.lit(False)) == ["quotes_passage"]
    cited = F.array(F.lit("A.1.1"), F.lit("A.1.2"))
    assert rules(osis=F.lit("A.1.2"), verses=cited) == [] and rules(osis=F.lit("A.1.3"), verses=cited) == ["citation"] and rules(osis=F.lit(None).cast("string"), verses=cited) == ["citation"]


def test_policy_last_wins_and_counts(spark):
    policy = spark.createDataFrame([("a", "exclude", "x", 1), ("a", None, "y", 2), ("zz", "exclude", "", 1)], "id string, policy string, reason string, seq int")
    got = {r.id: (r.policy, r.reason) for r in G.with_policy(spark.createDataFrame([("a",), ("b",)], "id string"), policy).collect()}
    assert got == {"a": ("compose", "y"), "b": ("compose", None)}
    labels = A.label_counts(spark.createDataFrame([(["p", "q"],), (["p"],)], "labels array<string>"), "labels", spark.createDataFrame([("p",), ("r",)], "label string"))
    assert {r.label: r.n for r in labels.collect()} == {"p": 2, "r": 0}


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "x": 1, "more": 2}\n\n{"id": "2"}\n')
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string, x int").count() == 2
    assert files.read_definitions(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "t.txt").write_text("a\n\nb")
    assert [(r.line, r.value) for r in files.read_lines(spark, str(tmp_path / "t.txt")).orderBy("line").collect()] == [(1, "a"), (2, ""), (3, "b")]
    with zipfile.ZipFile(tmp_path / "v.zip", "w") as z:
        z.writestr("v.txt", "GEN 1:1 In the beginning\nnonsense\nGEN 1:2 And")
    assert files.read_verse_archive(spark, str(tmp_path / "v.zip")).count() == 2
    (tmp_path / "p.yaml").write_text("terms: [no, yes]")
    with pytest.raises(ValueError, match="quote"):
        files.read_policy(str(tmp_path / "p.yaml"))
    df = spark.createDataFrame([(["a", "b"], None)], "x array<string>, y int")
    assert files.flat_for_csv(df).first() == ("a|b", "")
    assert not files.write_if_clean({"t": df}, df, str(tmp_path / "out")) and files.write_if_clean({"t": df}, df.limit(0), str(tmp_path / "out"))
    ok, status = files.load_each({"good": lambda: df, "bad": lambda: spark.read.parquet(str(tmp_path / "nothing"))})
    assert list(ok) == ["good"] and status["bad"].startswith("unavailable")


def test_registry():
    registry.register("test", "one")(len)
    with pytest.raises(ValueError, match="already"):
        registry.register("test", "one")(len)
    assert registry.names("test") == ["one"] and registry.component("test", "one").run is len
    with pytest.raises(KeyError, match="there are: one"):
        registry.component("test", "two")


def test_gate_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("so ill",), ("well",)], "text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    q = gated(stream, "text", [G.Category("body", ["ill"])], []).writeStream.format("memory").queryName("gated").start()
    q.processAllAvailable()
    q.stop()
    assert {r.text: r.status for r in spark.table("gated").collect()} == {"so ill": "crisis", "well": "ok"}


def test_terms_are_matched_only_where_a_text_holds_one(spark):
    from quillspan.operators import gate

    texts = ["a Don’t b", "don't", "undon't", "DON'T!", "", None, "c++ now", "c+", "x_clown", "clown", "I am x", "’"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    hit = df.select("i", gate.any_term(F.col("t"), ["Don't", "c++", "clown"], ["i am"]).alias("x"))
    assert {r.i for r in hit.collect() if r.x} == {0, 1, 3, 6, 9, 10} and [r.i for r in hit.collect() if r.x is None] == [5]
    assert "Contains(" in df.where(gate.any_term(F.col("t"), ["clown"]))._jdf.queryExecution().optimizedPlan().toString()
