"""Column functions of ranking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
RRF_K = 60


def idf(n_docs: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.01), F.log1p((n_docs - df + 0.5) / (df + 0.5)))


def bm25_part(weight: Column, idf_: Column, tf: Column, length: Column, mean: Column, k1: float = K1, b: float = B) -> Column:
    norm = 1 - b + b * length / F.when(mean == 0, 1.0).otherwise(mean)
    return weight * idf_ * tf * (k1 + 1) / (tf + k1 * norm)


def saturate(score: Column, pivot: float) -> Column:
    return F.when(score <= 0, 0.0).otherwise(score / (score + pivot))


def dense_score(cosine: Column, floor: float = 0.45, pivot: float = 0.22) -> Column:
    return saturate(F.greatest(F.lit(0.0), cosine - floor), pivot)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    size = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / size)


def rrf_part(rank: Column, k: int = RRF_K) -> Column:
    return 1 / (k + rank)


def rrf_scaled(total: Column, lists: int = 2, k: int = RRF_K) -> Column:
    return F.least(F.lit(1.0), total / (lists / (k + 1)))


def penalised(score: Column, flag: Column, penalty: float) -> Column:
    return F.when(flag, score * (1 - penalty)).otherwise(score)


def gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1


def discount(rank: Column) -> Column:
    return F.log2(rank + 1)
