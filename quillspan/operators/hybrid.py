"""Retrieval by words and by vectors at once: two independently ranked lists with their reasons, fused by reciprocal rank.

A batch of queries has query_id, text, vector (null: found by words only), labels and themes; records have doc_id, text, vector (null: not found by
vector), labels, and where they apply policy, canon, has_text and the columns of a penalty. Both lists obey the same filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import scoring as S
from quillspan.operators import retrieval as L
from quillspan.operators import suggest as P
from quillspan.plans.scratch import Scratch

VAGUE = "semantic similarity"


def dense_document(title: Column, speaker: Column, addressee: Column, context: Column, labels: Column, places: Column, text: Column, context_defs: dict[str, str] | None = None, label_defs: dict[str, str] | None = None) -> Column:
    """A record as prose for an encoder: what comes first weighs most, so title and people lead and the text ends it."""

    def defined(name: Column, of: dict[str, str] | None) -> Column:
        known = F.create_map(*(F.lit(x) for kv in (of or {"": ""}).items() for x in kv))
        return F.coalesce(F.try_element_at(known, F.coalesce(name, F.lit(""))), F.lit(""))

    none = F.expr("cast(array() as array<string>)")
    labels = F.coalesce(labels, none)
    about = F.array_join(F.transform(labels, lambda x: defined(x, label_defs)), " ")
    place = F.when(F.size(F.coalesce(places, none)) > 0, F.concat(F.lit(" The prayer was in "), F.array_join(places, ", "), F.lit("."))).otherwise("")
    # fixed values: the words of the sentences
    parts = [title, F.lit(". A prayer by "), speaker, F.lit(" to "), addressee, F.lit(". It is a "), context, F.lit(" prayer: "), defined(context, context_defs), F.lit(". Its content is "), F.array_join(labels, ", "), F.lit(": "), about, F.lit("."), place, F.lit(" "), text]
    return F.trim(F.concat(*(F.coalesce(p, F.lit("")) for p in parts)))


def dense_query(text: Column, labels: Column) -> Column:
    """A request in its own words, and what was read in it as a sentence after them."""
    said = F.when(F.size(labels) > 0, F.concat(F.lit("This is a prayer of "), F.array_join(labels, ", "), F.lit(".")))
    return F.concat_ws(" ", F.coalesce(text, F.lit("")), said)


def dense_reasons(record_labels: Column, query_labels: Column, themes: Column, n: int = 6, vague: str = VAGUE) -> Column:
    """Labels of the record that the request shares, then its themes; the vague reason only if there is no other."""
    none = F.expr("cast(array() as array<string>)")
    shared = P.reasons(record_labels, query_labels, themes, none, n)
    return F.when(F.size(shared) > 0, shared).otherwise(F.array(F.lit(vague)))


def _others(ranked: DataFrame, k: int) -> DataFrame:
    """The list without the query itself."""
    left = ranked.where(~F.col("query_id").eqNullSafe(F.col("doc_id"))).withColumn("_r", F.col("rank")).drop("rank")
    return L.top_k(left, k, [F.asc("_r")]).drop("_r")


def lexical(queries: DataFrame, records: DataFrame, index: L.Index, scratch: Scratch, k: int, filters: L.Filters = L.Filters(), pivot: float = P.PIVOT, penalty: float = 0.0, penalised: Column | None = None, own: bool = True, terms: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score, rank, matched_on): BM25, the scores of penalised records less by the share penalty before they are ranked, then
    saturated; reasons are shared labels, themes and the terms that add most. own: a query may find the record of its own id."""
    terms = scratch.write(L.weighted_terms(queries) if terms is None else terms, "terms")
    factor = S.penalised(F.lit(1.0), F.coalesce(penalised, F.lit(False)), penalty) if penalised is not None else F.lit(1.0)
    keep = records.where(filters.column(records)).select("doc_id", F.lit(True).alias("fit"), factor.alias("factor"))
    found = L.bm25(terms, index, k if own else k + 1, keep=keep, digits=digits)
    found = scratch.write(found if own else _others(found, k), "lexical")
    why = L.matched_terms(terms, index, pairs=found)
    both = found.join(why, ["query_id", "doc_id"], "left").join(queries.select("query_id", F.col("labels").alias("_q"), F.col("themes").alias("_t")), "query_id").join(records.select("doc_id", F.col("labels").alias("_d")), "doc_id")
    reasons = P.reasons(F.col("_d"), F.col("_q"), F.col("_t"), F.col("terms"))
    return both.select("query_id", "doc_id", F.round(S.saturate(F.col("score"), pivot), 4).alias("score"), "rank", reasons.alias("matched_on"))


def dense(queries: DataFrame, records: DataFrame, scratch: Scratch, k: int, filters: L.Filters = L.Filters(), floor: float = 0.45, pivot: float = 0.22, penalty: float = 0.0, penalised: Column | None = None, own: bool = True) -> DataFrame:
    """(query_id, doc_id, score, rank, matched_on): the nearest vectors in order of their cosine, as far as it is over floor. A penalty lowers scores, not ranks."""
    keep = records.where(filters.column(records) & F.col("vector").isNotNull())
    found = L.nearest(queries.select("query_id", "vector"), keep.select("doc_id", "vector"), k, own=own).where(F.col("score") > floor)
    found = scratch.write(found, "dense")
    flag = F.coalesce(penalised, F.lit(False)) if penalised is not None else F.lit(False)
    both = found.join(queries.select("query_id", F.col("labels").alias("_q"), F.col("themes").alias("_t")), "query_id").join(records.select("doc_id", F.col("labels").alias("_d"), flag.alias("_f")), "doc_id")
    score = F.round(S.penalised(S.dense_score(F.col("score"), floor, pivot), F.col("_f"), penalty), 4)
    return both.where(S.dense_score(F.col("score"), floor, pivot) > 0).select("query_id", "doc_id", score.alias("score"), "rank", dense_reasons(F.col("_d"), F.col("_q"), F.col("_t")).alias("matched_on"))


def retrieve(queries: DataFrame, records: DataFrame, index: L.Index, k: int = 10, filters: L.Filters = L.Filters(), pool: int = P.POOL, floor: float = 0.45, pivot: float = 0.22, penalty: float = 0.0, penalised: Column | None = None, own: bool = True, terms: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank, matched_on, sources): both lists at pool_depth, fused; sources names the lists that hold the record, in order."""
    scratch, depth = Scratch(records.sparkSession, "hybrid"), L.pool_depth(k, pool)
    queries = scratch.write(queries.select("query_id", "text", "vector", "labels", "themes"), "queries")
    by_words = scratch.write(lexical(queries, records, index, scratch, depth, filters, penalty=penalty, penalised=penalised, own=own, terms=terms), "by_words")
    by_vector = scratch.write(dense(queries, records, scratch, depth, filters, floor, pivot, penalty, penalised, own), "by_vector")
    return P.hybrid(by_words, by_vector, k)
