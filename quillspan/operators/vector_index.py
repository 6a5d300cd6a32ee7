"""A stored index of vectors that a build brings up to date: parts whose fingerprint is unchanged are skipped, and in the others only new rows are encoded.

A row's part follows from its id. A part's fingerprint is a hash over the number of its rows and the sums of their hashes, so it needs one aggregation and no
order. A build writes the changed parts into a folder of its own and then, as its last step, a manifest that names the folder of each part: readers go by the
newest complete manifest, so a build that is lost midway leaves the index as it was.

    <path>/builds/<build>/part=<k>/...       (doc_id, row_hash, vector)
    <path>/manifests/<number>/...            (part, n_rows, fingerprint, build, stamp)
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.plans.scratch import Scratch

MANIFEST = "part int, n_rows long, fingerprint string, build string, stamp string"


def part_of(doc_id: Column, parts: int) -> Column:
    """The part of an id, the same in every build: the first 32 bits of its hash modulo parts."""
    return (F.conv(F.substring(F.sha2(F.coalesce(doc_id.cast("string"), F.lit("")), 256), 1, 8), 16, 10).cast("long") % parts).cast("int")


def row_hash(stamp: str, doc_id: Column, text: Column) -> Column:
    """What a stored vector depends on: the encoder's stamp, the id and the text."""
    return F.sha2(F.concat_ws("|", F.lit(stamp), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))), 256)


def fingerprints(rows: DataFrame) -> DataFrame:
    """(part, n_rows, fingerprint) of rows (part, row_hash), in whatever order they come."""
    number = lambda at: F.sum(F.conv(F.substring("row_hash", at, 15), 16, 10).cast("decimal(38,0)"))
    each = rows.groupBy("part").agg(F.count("*").alias("n_rows"), number(1).alias("_a"), number(16).alias("_b"))
    return each.select("part", "n_rows", F.sha2(F.concat_ws("|", F.col("part").cast("string"), F.col("n_rows").cast("string"), F.col("_a").cast("string"), F.col("_b").cast("string")), 256).alias("fingerprint"))


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete manifests."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{n}/_SUCCESS"))
    return sorted(int(n) for n in names if n.isdigit() and done(n))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete manifest; without rows where there is no index."""
    found = _numbers(spark, path)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifests/{found[-1]:08d}") if found else spark.createDataFrame([], MANIFEST)


def _stored(spark: SparkSession, path: str, parts: list, kind: str) -> DataFrame:
    schema = f"doc_id {kind}, row_hash string, vector array<double>"
    folders = [f"{path}/builds/{r.build}/part={r.part}" for r in parts]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def load(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """(doc_id, row_hash, vector) of the index; without rows where there is none. kind: the type of the ids."""
    return _stored(spark, path, manifest(spark, path).where("build is not null").select("part", "build").collect(), kind)


def build(docs: DataFrame, path: str, encode: Callable[[DataFrame], DataFrame], stamp: str, text_col: str = "text", parts: int = 64, force: bool = False, hash_col: str | None = None) -> DataFrame:
    """Bring the index at path up to date with docs (doc_id, the text and whatever encode reads); the report: a row a part.

    encode adds the column vector (array of double) to rows of docs that the index lacks; stamp names the encoder and its version: another one, or force,
    rebuilds all. Every row is indexed: filters belong to the search. The report has part, n_rows, kept (vectors reused), encoded, removed (stored rows that
    are gone or changed), state (skipped, rewritten or removed) and fingerprint. Rows of equal id and text share a vector. Null texts are empty.
    hash_col: a column that holds row_hash already; no text is then read. Where docs come of a join, hash the texts before it, so that they aren't exchanged.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    scratch = Scratch(spark, "vector-index")
    rows = docs.withColumns({"part": part_of(F.col("doc_id"), parts), "row_hash": F.col(hash_col) if hash_col else row_hash(stamp, F.col("doc_id"), F.col(text_col))})
    now = fingerprints(rows.select("part", "row_hash")).withColumn("stamp", F.lit(stamp))
    old = manifest(spark, path).select("part", F.col("n_rows").alias("_n"), F.col("fingerprint").alias("_f"), F.col("build").alias("_b"), F.col("stamp").alias("_s"))
    same = F.col("fingerprint").eqNullSafe(F.col("_f")) & F.col("stamp").eqNullSafe(F.col("_s")) & F.lit(not force)
    state = F.when(F.col("n_rows").isNull(), "removed").when(same, "skipped").otherwise("rewritten")
    # a row a part, and the parts are a number that the caller chose
    plan = scratch.write(now.join(old, "part", "full").withColumn("state", state), "plan")
    todo = [r.part for r in plan.where("state = 'rewritten'").select("part").collect()]
    figures = "part int, kept long, encoded long"
    if todo:
        fresh = scratch.write(rows.where(F.col("part").isin(todo)).drop("vector"), "fresh")
        held = plan.where(F.col("part").isin(todo) & F.col("_b").isNotNull()).select("part", F.col("_b").alias("build")).collect()
        stored = _stored(spark, path, [] if force else held, kind).select("row_hash", F.col("vector").alias("_stored")).dropDuplicates(["row_hash"])
        known = fresh.select("doc_id", "part", "row_hash").join(stored, "row_hash").select("doc_id", "part", "row_hash", F.col("_stored").alias("vector"), F.lit(False).alias("new"))
        missing = fresh.join(stored.select("row_hash"), "row_hash", "left_anti")
        made = encode(missing).select("doc_id", "part", "row_hash", F.col("vector").cast("array<double>").alias("vector"), F.lit(True).alias("new"))
        name = f"{len(_numbers(spark, path)) + 1:08d}-{uuid.uuid4().hex}"
        every = scratch.write(known.unionByName(made), "rows")
        every.drop("new").repartition("part").write.partitionBy("part").parquet(f"{path}/builds/{name}")
        counts = every.groupBy("part").agg(F.count_if(~F.col("new")).alias("kept"), F.count_if("new").alias("encoded"))
    else:
        name, counts = None, spark.createDataFrame([], figures)
    if todo or plan.where("state = 'removed'").count():
        rewritten = F.col("state") == "rewritten"
        entries = plan.where("state <> 'removed'").select("part", "n_rows", "fingerprint", F.when(rewritten, F.lit(name)).otherwise(F.col("_b")).alias("build"), "stamp")
        entries.coalesce(1).write.parquet(f"{path}/manifests/{(_numbers(spark, path) or [0])[-1] + 1:08d}")
    report = plan.join(counts, "part", "left")
    kept = F.when(F.col("state") == "skipped", F.col("n_rows")).otherwise(F.coalesce("kept", F.lit(0)))
    out = report.select("part", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), kept.alias("kept"), F.coalesce("encoded", F.lit(0)).alias("encoded"), (F.coalesce("_n", F.lit(0)) - kept).alias("removed"), "state", "fingerprint")
    out = scratch.write(out, "report")
    scratch.keep(out)
    return out


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete manifests but the newest keep, and builds that none of those names; how many builds went. Not for use while a build runs."""
    numbers = _numbers(spark, path)
    stay = numbers[-keep:]
    named = {r.build for n in stay for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifests/{n:08d}").select("build").distinct().collect()}
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for n in numbers[:-keep]:
        fs.delete(Path(f"{path}/manifests/{n:08d}"), True)
    gone = [s.getPath() for s in fs.listStatus(Path(f"{path}/builds")) if s.getPath().getName() not in named] if numbers else []
    for p in gone:
        fs.delete(p, True)
    return len(gone)
