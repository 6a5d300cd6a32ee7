import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import whitening
from quillspan.llm.queries import op12_embedding_whitening
from quillspan.session import table


def brute(vectors, k=16):
    """n, sums, eigenvalues over their trace, eigenvectors and exact deviations of whole-number vectors."""
    fit = sorted(set(vectors))
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, total, strict=True)] for x in fit])
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    rows = {x: sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True)) for x in fit}
    white = {x: np.array([(n * a - s) / n for a, s in zip(x, total, strict=True)]) @ q / np.sqrt(e) for x in fit}
    return n, rows, white, e / np.trace(v)


def whole(vector):
    return tuple(math.floor(64 * float(c)) + 1_000_000 for c in vector)


def check(rows, out, k=16):
    """rows: (id, vector) that should remain, ids unique."""
    vectors = {i: whole(v) for i, v in rows}
    n, deviation, white, explained = brute(list(vectors.values()), k)
    k = len(explained)
    got = {}
    for r in out.collect():
        assert (r.vec_id, r.component) not in got
        got[r.vec_id, r.component] = r
    assert set(got) == {(i, c) for i in vectors for c in range(1, k + 1)}
    sign = np.ones(k)
    for c in range(k):
        i = max(vectors, key=lambda i: abs(white[vectors[i]][c]))
        sign[c] = np.sign(white[vectors[i]][c] * got[i, c + 1].whitened)
    for (i, c), r in got.items():
        assert (r.n, r.deviation) == (n, deviation[vectors[i]])
        assert r.whitened == pytest.approx(sign[c - 1] * white[vectors[i]][c - 1], abs=1e-9)
        assert r.explained == pytest.approx(explained[c - 1], rel=1e-9)
        assert r.identity_error < 1e-10 and r.residual < 1e-10


def test_query_equals_dense_solution(spark, small):
    rows = [(r.vec_id, r.embedding) for r in table(spark, small, "embeddings").collect()]
    check(rows, op12_embedding_whitening(spark, small))


SCHEMA = "vec_id long, embedding array<float>"


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(c) for c in rng.normal(size=5) * [9, 5, 3, 2, 1]]) for i in range(60)]
    good += [(100 + i, good[0][1]) for i in range(50)]  # copies of one vector
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0, 4.0]), (203, [math.nan] * 5), (204, [math.inf, 0.0, 0.0, 0.0, 0.0]), (205, [1.0, 2.0]), (206, [0.5] * 9)]
    df = spark.createDataFrame(good + bad, SCHEMA).select("*", F.lit(1).alias("component"), F.lit("x").alias("y"), F.lit(2).alias("task"), F.lit(0).alias("id"), F.lit(1).alias("n")).repartition(7)
    check(good, whitening.whiten(df))
    check(good, whitening.whiten(df, components=2), 2)


def test_repeated_and_null_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(None if i % 3 == 0 else 7, [float(c) for c in rng.normal(size=3)]) for i in range(30)]
    out = whitening.whiten(spark.createDataFrame(rows + rows, SCHEMA).coalesce(2))
    assert out.count() == 60 * 3 and {r.n for r in out.collect()} == {30}
    assert out.where("vec_id is null").count() == 20 * 3


def test_empty_and_single_vectors(spark):
    empty = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns[:6] == ["vec_id", "component", "n", "deviation", "whitened", "explained"]
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).count() == 0


def test_components_end_at_the_rank(spark):
    rng = np.random.default_rng(8)
    flat = [(i, [float(a), float(2 * a), float(b), 0.0]) for i, (a, b) in enumerate(rng.integers(-50, 50, (40, 2)))]
    out = whitening.whiten(spark.createDataFrame(flat, "vec_id int, embedding array<double>"))
    assert {r.component for r in out.collect()} == {1, 2} and out.first().identity_error < 1e-10


def test_long_and_large_vectors(spark):
    rng = np.random.default_rng(9)
    wide = [(i, [float(c) for c in rng.normal(size=300) * np.linspace(4, 0.2, 300)]) for i in range(500)]
    check(wide, whitening.whiten(spark.createDataFrame(wide, "vec_id long, embedding array<double>")))
    large = [(i, [float(c) for c in rng.normal(size=3) * 1e16]) for i in range(20)]  # deviations beyond a long
    out = whitening.whiten(spark.createDataFrame(large, "vec_id long, embedding array<double>"))
    assert out.count() == 60 and out.where("deviation is null").count() > 0 and out.first().identity_error < 1e-8
    huge = [(i, [float(c) for c in rng.normal(size=2) * 1e300]) for i in range(9)]
    assert whitening.whiten(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).count() >= 0


def test_lobpcg_certifies_or_fails():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(200, 200)))
    e = 1 / np.arange(1, 201) ** 1.5
    values, vectors, residuals = whitening.lobpcg(lambda b: (q * e) @ (q.T @ b), 200, 10)
    assert values == pytest.approx(e[:10], rel=1e-12) and (residuals < 1e-12).all()
    assert np.abs(np.abs((q[:, :10] * vectors).sum(axis=0)) - 1).max() < 1e-12
    with pytest.raises(RuntimeError):
        whitening.lobpcg(lambda b: (q * e) @ (q.T @ b), 200, 10, max_steps=2)
