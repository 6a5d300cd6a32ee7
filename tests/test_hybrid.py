import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import hybrid as H
from quillspan.operators import retrieval as L
from quillspan.operators import suggest as P
from quillspan.operators import vector_index as V
from quillspan.plans.scratch import Scratch
from tests.test_suggest import BANK, TEXTS

RECORDS = [
    (1, "Psalm of mercy", "have mercy on me for my grief is great and my eyes fail", [1.0, 0.0, 0.0], ["lament"], "compose", "OT"),
    (2, "Thanks", "give thanks with joy and sing for the harvest was great", [0.0, 1.0, 0.0], ["praise"], "compose", "OT"),
    (3, "Grief", "my soul is cast down and finds no rest at night", [0.9, 0.1, 0.0], ["lament"], "compose", "NT"),
    (4, "Hidden", "grief grief grief mercy", [1.0, 0.0, 0.0], ["lament"], "exclude", "OT"),
    (5, "Silent", "nothing in common with it", None, ["praise"], "compose", "OT"),
    (6, "Psalm of grief", "grief and mercy, grief and mercy come to me", [0.2, 0.2, 0.9], ["petition"], "compose", "OT"),
]
SCHEMA = "doc_id long, title string, text string, vector array<double>, labels array<string>, policy string, canon string"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(RECORDS, SCHEMA).withColumn("has_text", F.lit(True))


@pytest.fixture(scope="module")
def index(spark, corpus):
    return L.build_index(corpus, {"title": 2, "text": 1}, Scratch(spark, "hybrid-test"))


def asked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, text string, vector array<double>, labels array<string>, themes array<string>")


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r)
    return out


def test_fused_lists_reasons_and_filters(spark, corpus, index):
    queries = asked(spark, [(10, "mercy in my grief", [1.0, 0.05, 0.0], ["lament"], ["sorrow"]), (11, "mercy", None, [], []), (12, "zzz", [0.0, 1.0, 0.0], [], []), (13, "zzz", None, [], []), (14, None, None, None, None)])
    got = ranked(H.retrieve(queries, corpus, index, 3, L.Filters(canon=("OT", "NT"))))
    assert set(got) == {10, 11, 12}
    assert 4 not in {r.doc_id for rows in got.values() for r in rows}
    top = got[10][0]
    assert (top.doc_id, top.sources, top.matched_on[-1]) == (1, ["bm25", "dense"], "both retrievers agree") and top.matched_on[:2] == ["lament", "sorrow"] and len(top.matched_on) <= 5
    only_dense = next(r for r in got[10] if r.doc_id == 3)
    assert only_dense.sources == ["bm25", "dense"] or "bm25" not in only_dense.sources
    assert all(r.sources == ["bm25"] for r in got[11]) and got[12][0].doc_id == 2 and got[12][0].matched_on == ["semantic similarity"] and got[12][0].sources == ["dense"]
    assert all(0 < r.score <= 1 and [x.rank for x in rows] == list(range(1, len(rows) + 1)) for rows in got.values() for r in rows)
    ot = ranked(H.retrieve(queries, corpus, index, 3, L.Filters(canon=("NT",))))
    assert {r.doc_id for r in ot[10]} == {3}


def test_fused_order_follows_unrounded_sums(spark):
    rows = [(1, i, i) for i in range(1, 400)]
    a = spark.createDataFrame(rows, "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 1000 + i, i) for i in range(1, 400)], "query_id long, doc_id long, rank int")
    got = [(r.doc_id, r.score) for r in L.fuse([a, b], 700, 2).orderBy("rank").collect()]
    assert [d for d, _ in got] == [d for i in range(1, 351) for d in (i, 1000 + i)]
    assert len({s for _, s in got}) < 350  # rounded scores repeat


def test_penalty_acts_before_lexical_ranking(spark, corpus, index):
    queries = asked(spark, [(10, "grief mercy", None, [], [])])
    scratch = Scratch(spark, "hybrid-test")
    plain = [r.doc_id for r in H.lexical(queries, corpus, index, scratch, 2).orderBy("rank").collect()]
    held = [r.doc_id for r in H.lexical(queries, corpus, index, scratch, 2, penalty=0.9, penalised=F.col("title").startswith("Psalm of grief")).orderBy("rank").collect()]
    assert plain[0] == 6 and held[0] == 1
    dense = H.dense(asked(spark, [(10, "", [1.0, 0.0, 0.0], [], [])]), corpus, scratch, 5, penalty=0.5, penalised=F.col("doc_id") == 1).orderBy("rank").collect()
    assert [r.doc_id for r in dense] == [1, 3] and dense[0].score < dense[1].score  # ranks stay


def test_whole_answer_from_hybrid_candidates(spark):
    rows = [(i, f"t{i}", t, v, ["lament"], None) for (i, t), v in zip(TEXTS.items(), ([1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.1, 0.9], None), strict=True)]
    records = spark.createDataFrame(rows, "doc_id long, title string, text string, vector array<double>, labels array<string>, policy string")
    requests = spark.createDataFrame([(10, "sorrow"), (12, "zzz")], "query_id long, text string")
    queries = asked(spark, [(10, "sorrow", [1.0, 0.05], ["lament"], ["grief"]), (12, "zzz", [0.05, 1.0], [], [])])
    index = L.build_index(records, {"text": 1}, Scratch(spark, "hybrid-test"))
    found = H.retrieve(queries, records, index, 3)
    out = {r.query_id: r for r in P.suggest(requests, records, index, BANK, [], [], found=found).collect()}
    assert out[10].suggestions[0].doc_id == 1 and out[10].suggestions[0].matched_on[-1] == "both retrievers agree" and out[10].suggestions[0].movements["anchor"] in TEXTS[1]
    assert all(s.matched_on == ["semantic similarity"] for s in out[12].suggestions)


def test_prose_for_an_encoder(spark):
    df = spark.createDataFrame([("T", "S", "A", "public", ["x", "y"], ["Zion", "Babel"], "Text."), ("T", "S", "A", "odd", [], [], None), (None, None, None, None, None, None, None)], "t string, s string, a string, c string, l array<string>, p array<string>, x string")
    prose = df.select(H.dense_document(*map(F.col, ["t", "s", "a", "c", "l", "p", "x"]), {"public": "before all"}, {"x": "an x"}).alias("d")).collect()
    assert prose[0].d == "T. A prayer by S to A. It is a public prayer: before all. Its content is x, y: an x . The prayer was in Zion, Babel. Text."
    assert prose[1].d == "T. A prayer by S to A. It is a odd prayer: . Its content is : ." and prose[2].d is not None
    q = spark.createDataFrame([("Help me.", ["lament", "petition"]), ("Help me.", []), (None, ["lament"])], "x string, l array<string>")
    assert [r.q for r in q.select(H.dense_query(F.col("x"), F.col("l")).alias("q")).collect()] == ["Help me. This is a prayer of lament, petition.", "Help me.", " This is a prayer of lament."]


def encoder(calls):
    def encode(rows):
        calls.append(rows.count())
        return rows.withColumn("vector", F.array(F.length("text").cast("double"), F.col("doc_id").cast("double")))

    return encode


def test_index_rewrites_only_changed_parts(spark, tmp_path):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    path, calls = f"file://{tmp_path}/index", []
    assert V.load(spark, path).count() == 0
    first = V.build(docs, path, encoder(calls), "v1", parts=8).collect()
    assert calls == [200] and all(r.state == "rewritten" and r.encoded == r.n_rows for r in first) and sum(r.n_rows for r in first) == 200
    again = V.build(docs.repartition(7).orderBy(F.desc("doc_id")), path, encoder(calls), "v1", parts=8).collect()
    assert calls == [200] and {r.state for r in again} == {"skipped"} and {r.fingerprint for r in again} == {r.fingerprint for r in first}
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 17, "other").otherwise(F.col("text")))
    report = V.build(changed, path, encoder(calls), "v1", parts=8).collect()
    assert calls == [200, 1] and [r.state for r in report].count("rewritten") == 1 and sum(r.encoded for r in report) == 1 and sum(r.removed for r in report) == 1
    held = {r.doc_id: list(r.vector) for r in V.load(spark, path).collect()}
    assert held == {i: [5.0 if i == 17 else float(len(f"text {i}")), float(i)] for i in range(200)}
    V.build(changed.where("doc_id < 3"), path, encoder(calls), "v1", parts=8)
    assert sorted(r.doc_id for r in V.load(spark, path).collect()) == [0, 1, 2] and calls[-1:] != [3]
    everything = V.build(changed.where("doc_id < 3"), path, encoder(calls), "v2", parts=8).collect()
    assert calls[-1] == 3 and {r.state for r in everything if r.n_rows} == {"rewritten"}
    assert V.vacuum(spark, path, keep=1) > 0 and V.load(spark, path).count() == 3


def test_a_build_lost_midway_leaves_the_index(spark, tmp_path):
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    path = f"file://{tmp_path}/index"
    V.build(docs, path, encoder([]), "v1", parts=4)

    def broken(rows):
        return rows.withColumn("vector", F.array(F.raise_error(F.lit("lost")).cast("double")))

    with pytest.raises(Exception, match="lost"):
        V.build(docs.withColumn("text", F.lit("y")), path, broken, "v1", parts=4).collect()
    assert {list(r.vector)[0] for r in V.load(spark, path).collect()} == {1.0}
    report = V.build(docs.withColumn("text", F.lit("yy")), path, encoder([]), "v1", parts=4).collect()
    assert sum(r.encoded for r in report) == 20 and {list(r.vector)[0] for r in V.load(spark, path).collect()} == {2.0}


def test_index_of_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(None, None), (1, None), (1, ""), (1, "a"), (1, "a"), (2, "a")], "doc_id long, text string")
    path, calls = f"file://{tmp_path}/index", []
    encode = lambda rows: rows.withColumn("vector", F.array(F.lit(1.0)))
    assert sum(r.encoded for r in V.build(docs, path, encode, "v1", parts=3).collect()) == 6
    assert V.load(spark, path).count() == 6
    more = V.build(docs.union(docs.limit(1)), path, encode, "v1", parts=3).collect()
    assert sum(r.n_rows for r in more) == 7 and sum(r.encoded for r in more) == 0  # equal rows share the vector
    assert V.build(docs.limit(0), path, encode, "v1", parts=3).where("state = 'removed'").count() > 0 and V.load(spark, path).count() == 0


def test_stored_vectors_serve_searches(spark, tmp_path):
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, str(i), [float(x) for x in rng.normal(size=4)]) for i in range(50)], "doc_id long, text string, vector array<double>")
    source = docs.withColumnRenamed("vector", "raw")
    path = f"file://{tmp_path}/index"
    V.build(source, path, lambda rows: rows.withColumn("vector", F.col("raw")), "v1", parts=4)
    stored = V.load(spark, path).select("doc_id", "vector")
    queries = docs.where("doc_id < 5").select(F.col("doc_id").alias("query_id"), "vector")
    assert sorted(map(tuple, L.nearest(queries, stored, 3).collect())) == sorted(map(tuple, L.nearest(queries, docs.select("doc_id", "vector"), 3).collect()))


def test_hashes_made_before_a_join_serve_for_texts(spark, tmp_path, small, monkeypatch):
    docs = spark.createDataFrame([(i, f"t{i}" if i else None) for i in range(20)], "doc_id long, text string")
    encode = lambda rows: rows.withColumn("vector", F.array(F.col("doc_id").cast("double")))
    hashed = docs.select("doc_id", V.row_hash("v1", F.col("doc_id"), F.col("text")).alias("h"))
    whole, narrow = (sorted(map(tuple, V.build(x, str(tmp_path / n), encode, "v1", parts=3, **more).collect())) for x, n, more in ((docs, "a", {}), (hashed, "b", {"hash_col": "h"})))
    assert whole == narrow and sum(r[1] for r in whole) == 20
    from quillspan import catalog

    seen, build = [], V.build
    monkeypatch.setattr(V, "build", lambda docs, *a, **k: seen.append(docs.columns) or build(docs, *a, **k))
    assert catalog.queries()["q54_vector_index"](spark, small).count() > 0
    assert seen and not any("text" in c for c in seen)  # else each build exchanges and writes the texts
