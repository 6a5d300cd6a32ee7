"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Rates r(d) in [0, cap] minimise the entropy against equal rates under the constraint that each source's words come to
its target. The optimum tilts a document's rate exponentially in its size, r / (cap - r) = exp(t * x) / (cap - 1), where x
is size over the source's mean size; the dual is convex in t, one t a source. Newton steps, kept inside a bracket, run for all
sources at once over exact (source, size) counts. Rates become whole copies: the floor, plus one where a hashed draw falls under a
cut. Cuts are set from the largest size class (powers of 2) down, each class making up for the error of those above.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.llm.ranked import ranked, row_ids
from quillspan.plans.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
BINS = 256
#: A source is settled within TOLERANCE of its size, or once its tilt is known to BRACKET; each step at least halves a bracket that a Newton step leaves.
TOLERANCE, BRACKET, STEPS = 1e-7, 1e-8, 400


def source_targets(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights repeat over sources by code point, null last.

    A target is weight * level, or cap * source_size where that is less; the level makes all targets share * whole size. That is
    where resharing what exceeds the caps by weight ends: the level starts as if no source were capped and rises as those below it are, each
    time to what the others must share, by one sum over sources. No step sorts or holds all sources in one task.
    """
    placed = ranked(sizes.withColumn("_all", F.lit(0)), ["_all"], [F.col("source").asc_nulls_last()], scratch, "place")
    turn = F.array(*map(F.lit, weights))
    each = scratch.write(placed.select("source", "source_size", F.get(turn, (F.col("place") % len(weights)).cast("int")).alias("weight")), "weights")
    full = F.col("source_size") * F.lit(cap)
    whole = (each.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        now = full <= F.col("weight") * F.lit(level)
        n, held, rest = each.agg(F.count_if(now), F.sum(F.when(now, full)), F.sum(F.when(~now, F.col("weight")))).first()
        if n == capped or not rest:
            break
        level, capped = (whole - (held or 0)) / rest, n
    if capped >= 0 and not rest:  # all are at their caps
        level = float("inf")
    return each.select("source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(full.cast("double"), F.col("weight") * F.lit(level))).alias("target"))


def _tilts(stats: DataFrame, targets: DataFrame, cap: int, scratch: Scratch) -> DataFrame:
    """(source, source_size, target, mean, t) with t null where the cap binds for the whole source."""
    mean = stats.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    first = targets.join(mean.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    part = F.least(F.col("target") / F.col("source_size") / cap, F.lit(1 - 1e-9))
    free = (F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * cap)
    first = first.withColumn("t", F.when(free, F.ln(part * (cap - 1) / (1 - part)))).withColumn("lo", F.lit(-1e6)).withColumn("hi", F.lit(1e6)).withColumn("gap", F.lit(None).cast("double"))
    now = scratch.write(first, "tilts")
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean")
        rate = cap / (1 + (cap - 1) * F.exp(-F.greatest(F.least(F.col("t") * x, F.lit(500.0)), F.lit(-500.0))))
        words = F.col("size") * F.col("n")
        params = now.select(F.col("source").alias("_s"), "t", "mean").where("t is not null")
        sums = stats.join(params, F.col("source").eqNullSafe(F.col("_s"))).groupBy("source").agg(F.sum(words * rate).alias("got"), F.sum(words * x * rate * (1 - rate / cap)).alias("slope"))
        both = now.join(sums.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        gap = F.col("got") - F.col("target")
        both = both.withColumn("gap", gap).withColumn("lo", F.when(gap < 0, F.col("t")).otherwise(F.col("lo"))).withColumn("hi", F.when(gap > 0, F.col("t")).otherwise(F.col("hi")))
        newton = F.col("t") - F.try_divide(F.col("gap"), F.col("slope"))
        inside = (newton > F.col("lo")) & (newton < F.col("hi"))
        half = F.when(F.col("lo") <= -1e6, F.least(F.col("t") * 2, F.lit(-1.0))).when(F.col("hi") >= 1e6, F.greatest(F.col("t") * 2, F.lit(1.0))).otherwise((F.col("lo") + F.col("hi")) / 2)
        settled = (F.abs("gap") <= TOLERANCE * F.col("source_size")) | (F.col("hi") - F.col("lo") <= BRACKET)
        both = both.withColumn("t", F.when(settled, F.col("t")).when(inside, newton).otherwise(half))
        now = scratch.write(both.drop("got", "slope"), "tilts")
        if now.where(F.col("t").isNotNull() & ~settled).isEmpty():
            break
    else:
        raise RuntimeError(f"the tilts of some sources aren't settled after {STEPS} steps")
    # sums of doubles differ in their last digits from run to run; the tilts that are used don't
    return scratch.write(now.select("source", "source_size", "target", "mean", F.round("t", 6).alias("t")), "tilts-done")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, share: float = 1.0, carry: bool = False) -> DataFrame:
    """Whole copies of each document so that each source's words come near its target.

    Returns one row per row of docs: id_col, size (words, null 0), source_size, target (of its source), rate, copies, taken =
    copies * size. carry: the columns of docs instead, each row as often as it has
    copies. Other columns clash with nothing. Targets: see
    source_targets. Wordless texts have rate 1. A null source is a source; an empty table gives an empty result. Draws come from
    id and text, so the result doesn't depend on how rows are dealt; only rows equal in both get theirs by input order.
    """
    scratch = Scratch(docs.sparkSession, "mix")

    def sized(rows: DataFrame, *more: str) -> DataFrame:
        """id, source, size and h of rows (_id, _source, _text), and more of their columns."""
        size = F.coalesce(F.regexp_count("_text", F.lit(WORD)), F.lit(0)).cast("long")
        return rows.select(F.col("_id").alias("id"), F.col("_source").alias("source"), size.alias("size"), F.xxhash64("_id", F.xxhash64("_text")).alias("h"), *more)

    parts = [F.col(c).alias(name) for c, name in ((id_col, "_id"), (source_col, "_source"), (text_col, "_text"))]
    slim = scratch.write(sized(row_ids(docs.select(*parts)), "rid"), "sizes")
    stats = scratch.write(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "stats")
    totals = stats.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    params = _tilts(stats, scratch.write(source_targets(totals, scratch, weights, cap, share), "targets"), cap, scratch)

    whole, again = None, scratch.write(slim.groupBy("h").count().where("count > 1").select("h"), "again")
    if not again.isEmpty():  # rows that equal others are told apart by a number, with which they are written if they are to be carried
        if carry:
            whole = scratch.write(row_ids(docs.select(F.struct("*").alias("row"))), "docs")
            slim = scratch.write(sized(whole.select("rid", *(F.col("row")[c].alias(name) for c, name in ((id_col, "_id"), (source_col, "_source"), (text_col, "_text")))), "rid"), "sizes")
        twice = slim.join(again.withColumn("_twice", F.lit(True)), "h", "left")
        slim = twice.withColumn("h", F.when(F.col("_twice"), F.xxhash64("h", "rid")).otherwise(F.col("h"))).drop("_twice")

    def rated_(rows: DataFrame) -> DataFrame:
        """rows with source_size, target, rate, base, flip and class; the parameters are a row a source."""
        x = F.col("size") / F.col("mean")
        tilt = F.greatest(F.least(F.col("t") * x, F.lit(500.0)), F.lit(-500.0))
        rate = F.when((F.col("size") == 0), 1.0).when(F.col("t").isNull(), F.lit(float(cap))).otherwise(F.lit(float(cap)) / (1 + (cap - 1) * F.exp(-tilt)))
        out = rows.join(params.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).withColumn("rate", F.round(rate, 9))
        base = F.least(F.floor("rate"), F.lit(cap)).cast("int")
        unit = (F.shiftrightunsigned("h", 11)).cast("double") / float(1 << 53)
        out = out.withColumn("base", base).withColumn("flip", F.floor((unit - (F.col("rate") - F.col("base")) + 1) * (BINS / 2)).cast("int"))
        return out.withColumn("class", F.floor(F.log2(F.greatest("size", F.lit(1)).cast("double") + 0.5)).cast("int")).drop("_s", "mean", "t", "h")

    rated = scratch.write(rated_(slim), "rated")

    open_ = F.col("base") < cap
    bins = rated.where("size > 0").groupBy("source", "class", "flip").agg(F.sum(F.when(open_, F.col("size")).otherwise(0)).alias("w"), F.sum(F.round(F.col("size") * (F.col("rate") - F.col("base")) * 1e6).cast("decimal(38,0)")).alias("due"))
    upto = W.partitionBy("source", "class").orderBy("flip").rowsBetween(W.unboundedPreceding, W.currentRow)
    cumulated = bins.withColumn("cum", F.sum("w").over(upto))
    classes = cumulated.groupBy("source", "class").agg((F.sum("due").cast("double") / 1e6).alias("due"), F.sort_array(F.collect_list(F.struct("flip", "cum"))).alias("cums"))
    listed = classes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("class", "due", "cums")), asc=False).alias("each"))

    def step(acc, c):
        need = acc["carry"] + c["due"]
        none = F.array(F.struct(F.abs(need).alias("off"), F.lit(-1).alias("flip"), F.lit(0).cast("long").alias("cum")))
        best = F.array_min(F.concat(none, F.transform(c["cums"], lambda b: F.struct(F.abs(b["cum"] - need).alias("off"), b["flip"].alias("flip"), b["cum"].alias("cum")))))
        return F.struct((need - best["cum"]).alias("carry"), F.concat(acc["cuts"], F.array(F.struct(c["class"].alias("class"), best["flip"].alias("cut")))).alias("cuts"))

    start = F.struct(F.lit(0.0).alias("carry"), F.expr("cast(array() as array<struct<class:int,cut:int>>)").alias("cuts"))
    cuts = scratch.write(listed.select(F.col("source").alias("_s"), F.inline(F.aggregate("each", start, step)["cuts"])).withColumnRenamed("class", "_c"), "cuts")

    def copied(rows: DataFrame) -> DataFrame:
        done = rows.join(cuts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("class") == F.col("_c")), "left")
        return done.withColumn("copies", F.col("base") + ((F.col("size") > 0) & (F.col("base") < cap) & (F.col("flip") <= F.coalesce("cut", F.lit(-1)))).cast("int"))

    if not carry:
        done = copied(rated)
        out = scratch.write(done.select(F.col("id").alias(id_col), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken")), "mixed")
        scratch.keep(out)
        return out
    if whole is None:  # a row's copies follow from itself, the parameters and the cuts, so no text is written or exchanged
        scratch.keep(params, cuts)
        # whole rows as one column, so that no name of theirs meets one of ours
        each = copied(rated_(sized(docs.select(F.struct("*").alias("row"), *parts), "row")))
    else:
        counts = scratch.write(copied(rated).select("rid", "copies").where("copies > 0"), "copies")
        scratch.keep(whole, counts)
        each = whole.join(counts, "rid")
    return each.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
