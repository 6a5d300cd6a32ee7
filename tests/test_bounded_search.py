"""What a task of a search holds doesn't grow with its documents, and ties go by id."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.operators import metrics as M
from quillspan.operators import retrieval as L


@pytest.mark.parametrize("case", range(24))
def test_best_rows_by_brute_force(case, monkeypatch):
    monkeypatch.setattr(L, "FOUND", 50)
    rng = np.random.default_rng(case)
    n, k, m = int(rng.integers(1, 9)), int(rng.integers(1, 12)), int(rng.integers(1, 400))
    scores = np.round(rng.random((n, m)), case % 4) * (rng.random((n, m)) < 0.8) + rng.random((n, m)) * 1e-5
    ids = list(range(m)) if case % 3 else rng.permutation(m).tolist()
    docs = pa.array(ids if case % 2 else [f"d{i}" for i in ids])
    best, at = L._Best(n, k, 3, np.nextafter(0, 1)), 0
    while at < m:
        part = docs.slice(at, int(rng.integers(1, 60)))
        follows = best.follows(part)
        for q in range(0, n, 3):
            best.add(scores[q : q + 3, at : at + len(part)], part, follows, q)
        at += len(part)
    got = [tuple(r.values()) for b in best.batches(pa.array(range(n))) for r in b.to_pylist()]
    rounded = np.round(scores, 3)
    want = [(q, d, -s) for q in range(n) for s, d in sorted((-rounded[q, j], docs[j].as_py()) for j in range(m) if rounded[q, j] > 0)[:k]]
    assert got == want


def test_tied_documents_are_not_all_held():
    """Of 100,000 documents of equal words 10 are kept for each of 500 queries; all would be 1 GB."""
    ids = list(range(500))
    block = L.TermBlock.of(ids, [False] * 500, ["common", "rare"] * 500, [i for i in ids for _ in "ab"], [1.0, 2.0] * 500)
    batch = lambda at: pa.RecordBatch.from_arrays([pa.array(range(at, at + 10_000)), pa.array([["common"]] * 10_000), pa.array([[1]] * 10_000, pa.list_(pa.int32())), pa.array([1.0] * 10_000), pa.array([True] * 10_000), pa.array([1.0] * 10_000)], ["doc_id", "terms", "tfs", "length", "fit", "factor"])
    order = list(range(0, 100_000, 10_000))
    random.Random(1).shuffle(order)
    score = L._scorer(SimpleNamespace(value=block), 10, 1.0, 6, T.LongType())
    tracemalloc.start()
    rows = [r for b in score(map(batch, order)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(r[:2] for r in rows) == [(q, d) for q in ids for d in range(10)] and {r[2] for r in rows} == {1.0}
    assert peak < 200 << 20


def test_terms_of_long_documents_are_not_all_held():
    """1,000 documents of 3,000 of the queries' terms each: arrays of all 3 million would be 200 MB."""
    names = [f"t{i}" for i in range(3000)]
    block = L.TermBlock.of([0, 1], [False] * 2, names * 2, [0] * 3000 + [1] * 3000, [1.0] * 3000 + [0.5] * 3000)
    lists = pa.DictionaryArray.from_arrays(pa.array(np.tile(np.arange(3000, dtype=np.int32), 1000)), pa.array(names)).cast(pa.string())
    at = pa.array(np.arange(1001, dtype=np.int32) * 3000)
    columns = [pa.array(range(1000)), pa.ListArray.from_arrays(at, lists), pa.ListArray.from_arrays(at, pa.array(np.ones(3_000_000, np.int32))), pa.array([1.0] * 1000), pa.array([True] * 1000), pa.array([1.0] * 1000)]
    batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "terms", "tfs", "length", "fit", "factor"])
    tracemalloc.start()
    rows = [r for b in L._scorer(SimpleNamespace(value=block), 5, 1.0, 6, T.LongType())(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(rows) == [(q, d, w) for q, w in ((0, 3000.0), (1, 1500.0)) for d in range(5)]
    assert peak < 64 << 20


def test_blocks_of_vectors_are_bounded_by_the_rows_that_tasks_keep(spark, monkeypatch):
    """The rows that a task keeps for a block, k a query, don't grow with the queries."""
    monkeypatch.setattr(L, "KEPT", 70, raising=False)
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(len(value[0])) or send(self, value))
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 4)).round(3)
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, vector array<float>").repartition(3)
    got = {(r.query_id, r["rank"]): r.doc_id for r in L.nearest(docs.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "query_id"), docs, 7).collect()}
    assert sorted(sent) == [10, 10, 10]
    unit = L._unit(v.astype(np.float32).astype(np.float64))
    for q in range(0, 60, 2):
        scores = np.round(unit @ unit[q], 6)
        assert [got[q, r] for r in range(1, 8)] == [d for _, d in sorted((-s, i) for i, s in enumerate(scores) if i != q)[:7]]


@pytest.mark.parametrize("k", [1, 3, 10])
def test_metrics_in_classes_equal_those_of_pairs(spark, k):
    rng = random.Random(k)
    classes = {i: rng.choice(["a", "a", "b", "c", None]) for i in range(80)} | {80: "alone", 90: "pair", 91: "pair"}
    members = spark.createDataFrame([(i, c, 1 + i % 2 if i % 7 else 0) for i, c in classes.items()], "doc_id long, class string, grade long")
    queries = members.where("doc_id % 10 = 0 or doc_id = 7").select(F.col("doc_id").alias("query_id"), "class")
    ranked = spark.createDataFrame([(q, d, r + 1) for q in (0, 7, 10, 20, 40, 80, 90) for r, d in enumerate(rng.sample(sorted(set(classes) - {q}), 12))], "query_id long, doc_id long, rank int")
    pairs = queries.join(members, "class").where("query_id <> doc_id").select("query_id", "doc_id", "grade")
    rounded = lambda df: sorted((r[0], *(round(x, 9) for x in r[1:])) for r in df.collect())
    got = rounded(M.per_query_in_classes(ranked, queries, members, k))
    assert got == rounded(M.per_query(ranked, pairs, k)) and {90} <= {r[0] for r in got} and 80 not in {r[0] for r in got}


def test_judgements_of_a_large_class_are_not_pairs(spark):
    """100,000 queries with 100,000 members would be 10 billion pairs."""
    members = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("class"), (1 + F.col("id") % 2).alias("grade"))
    queries = members.select(F.col("doc_id").alias("query_id"), "class")
    ranked = queries.select("query_id", ((F.col("query_id") + 1) % 100_000).alias("doc_id"), F.lit(1).alias("rank"))
    row = M.summary(M.per_query_in_classes(ranked, queries, members)).first()
    assert row.n == 100_000 and row.recall == round(1 / 99_999, 6) and row.rr == 1.0
