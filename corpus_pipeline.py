"""A corpus pipeline: five stages over documents, each written and read again as the next one's input.

Every stage but the last returns the columns of documents; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.decontaminate import drop_leaks
from quillspan.llm.mixing import mix_documents
from quillspan.llm.near_dup import near_dup_groups
from quillspan.llm.quality_classifier import fit, held_out, score
from quillspan.llm.ranked import row_ids
from quillspan.llm.sharding import shard_documents
from quillspan.plans.scratch import Scratch, scratch_scope
from quillspan.session import table

#: SQL has no union-find, SuperMinHash, FTRL training or Newton steps; the stages are tested against brute force instead.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    whole = docs.select("doc_id", "text", F.struct("*").alias("row"))  # no name of a column can meet one of the score's
    return score(whole, model, keep=["row"]).where("predicted = 1").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near-duplicates: one row of each id and text. Rows without an id all stay."""
    scratch = Scratch(spark, "dropped")
    groups = near_dup_groups(docs).select("doc_id", "component_id").where("doc_id <> component_id").distinct()
    groups = scratch.write(groups.select("doc_id"), "ids")
    kept = docs.join(groups, "doc_id", "left_anti").select(*docs.columns)
    repeated = scratch.write(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    rows = kept.join(repeated, "doc_id", "left_semi").select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    rows = scratch.write(row_ids(rows, "_place"), "rows")
    first = rows.groupBy("doc_id", "text").agg(F.min_by("row", "_place").alias("row")).select("row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(first)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; each row is judged by its own text, whatever its id."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the mixture takes."""
    return mix_documents(docs, carry=True)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their place in it."""
    return shard_documents(docs, carry=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("source mixing", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch_scope():  # what a stage wrote for itself goes when its rows are written
            made = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            scratch.drop(before)
        docs = before = made
    return docs
