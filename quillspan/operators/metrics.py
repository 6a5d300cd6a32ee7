"""Ranking metrics over (query_id, doc_id, rank) and judgements (query_id, doc_id, grade); all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions import scoring as S


def per_query(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall, rr, ndcg) for every query of qrels; 0 where nothing relevant exists or is found."""
    judged = qrels.where("grade > 0")
    ideal_rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("grade"), F.asc("doc_id")))
    ideal = judged.withColumn("r", ideal_rank).groupBy("query_id").agg(F.count("*").alias("n_rel"), F.sum(F.when(F.col("r") <= k, S.gain(F.col("grade")) / S.discount(F.col("r")))).alias("ideal"))
    every = qrels.select("query_id").distinct().join(ideal, "query_id", "left")
    return _rates(every, ranked.join(judged, ["query_id", "doc_id"]), k)


def per_query_in_classes(ranked: DataFrame, queries: DataFrame, members: DataFrame, k: int = 10) -> DataFrame:
    """per_query() where the judgements of a query (query_id, class) are all members (doc_id, class, grade) of its class but itself; ids are unique.

    The judgements are not made as pairs, which grow with the square of a class: a class is one row, with its size and the k + 1 best of its members.
    """
    queries, members = queries.where("class is not null"), members.where("class is not null and doc_id is not null")
    judged = members.where("grade > 0")
    place = F.row_number().over(W.partitionBy("class").orderBy(F.desc("grade"), F.asc("doc_id")))
    best = judged.withColumn("_r", place).where(F.col("_r") <= k + 1).groupBy("class").agg(F.sort_array(F.collect_list(F.struct("_r", "doc_id", "grade"))).alias("_best"))
    sizes = members.groupBy("class").agg(F.count("*").alias("_all"), F.count_if(F.col("grade") > 0).alias("_judged")).join(best, "class", "left")
    itself = members.select(F.col("doc_id").alias("query_id"), "class", (F.col("grade") > 0).alias("_own"))
    every = queries.join(itself, ["query_id", "class"], "left").join(sizes, "class").where(F.col("_all") > F.col("_own").isNotNull().cast("int"))
    others = F.slice(F.filter("_best", lambda x: x["doc_id"] != F.col("query_id")), 1, k)
    gains = F.transform(others, lambda x, i: S.gain(x["grade"]) / S.discount(i + 1))
    ideal = every.select("query_id", (F.col("_judged") - F.coalesce("_own", F.lit(False)).cast("int")).alias("n_rel"), F.aggregate(gains, F.lit(0.0), lambda a, x: a + x).alias("ideal"))
    hit = ranked.where("query_id <> doc_id").join(queries, "query_id").join(judged, ["doc_id", "class"])
    return _rates(ideal, hit, k)


def _rates(every: DataFrame, hit: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, rr, ndcg) of every (query_id, n_rel, ideal), from what is relevant of the ranked rows."""
    got = hit.groupBy("query_id").agg(F.count_if(F.col("rank") <= k).alias("found"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, S.gain(F.col("grade")) / S.discount(F.col("rank")))).alias("dcg"))
    return every.join(got, "query_id", "left").select(
        "query_id",
        F.coalesce(F.try_divide(F.col("found"), F.col("n_rel")), F.lit(0.0)).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.coalesce(F.try_divide(F.col("dcg"), F.col("ideal")), F.lit(0.0)).alias("ndcg"),
    )


def share_at(ranked: DataFrame, flag: Column, k: int) -> DataFrame:
    """(query_id, share) of the first k that have the flag; the denominator is what was ranked."""
    return ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.avg(flag.cast("double")).alias("share"))


def nearest_rank(df: DataFrame, value: str, p: float, by: list[str]) -> DataFrame:
    """(by..., percentile): the value at place min(n - 1, int(n * p)) of the order from 0; no interpolation."""
    w = W.partitionBy(*by).orderBy(value)
    numbered = df.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(W.partitionBy(*by)))
    return numbered.where(F.col("_i") == F.least(F.col("_n") - 1, F.floor(F.col("_n") * p))).select(*by, F.col(value).alias("percentile"))


def summary(each: DataFrame) -> DataFrame:
    return each.agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in ("recall", "rr", "ndcg")))
