import random
import time

from pyspark.sql import functions as F

from quillspan.operators import intervals as I

COLS = "id long, seq int, book string, lo long, hi long"


def made_up(rng, n, first):
    rows = []
    for i in range(n):
        lo = rng.choice([rng.randrange(-40, 40), rng.randrange(-(1 << 40), 1 << 40)])
        hi = lo + rng.choice([0, 0, 1, 3, 8, 100, 1 << 20, 1 << 45, -1])
        rows.append((first + i, rng.randrange(3), rng.choice(["G", "G", "G", "H", None]), rng.choice([lo, lo, lo, lo, lo, lo, None]), hi))
    return rows + [(first + n, 0, "G", -(1 << 63), (1 << 63) - 1), (first + n + 1, 0, "G", 5, 5), (first + n + 2, 0, "G", (1 << 63) - 1, (1 << 63) - 1)]


def meets(a, b):
    return a[2] is not None and a[2] == b[2] and None not in (a[3], b[3]) and a[3] <= a[4] and b[3] <= b[4] and a[3] <= b[4] and b[3] <= a[4]


def test_cells_find_what_all_pairs_find(spark):
    rng = random.Random(17)
    a, b = made_up(rng, 120, 0), made_up(rng, 120, 1000)
    left, right = spark.createDataFrame(a, COLS).repartition(3), spark.createDataFrame(b, COLS).repartition(3)
    got = sorted((r.a_id, r.b_id) for r in I.overlap_join(left, right, bin_size="auto").collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if meets(x, y)) and len(got) > 500
    blocks = right.select("book", "lo", "hi", F.col("id").cast("string").alias("text"))
    got = {r.id: [(x.lo, x.hi, x.text) for x in r.blocks] for r in I.expand(left, blocks).collect()}
    want = {x[0]: sorted((y[3], y[4], str(y[0])) for y in b if meets(x, y)) for x in a}
    assert got == {i: v for i, v in want.items() if v}
    found = {r.id: r.span_id for r in I.containing(left, right).collect()}
    assert set(found) == {x[0] for x in a}
    for x in a:
        inside = [y for y in b if meets(x, y) and y[3] <= x[3] and y[4] >= x[4]]
        if not inside:
            assert found[x[0]] is None
        else:
            least = min((y[4] - y[3], y[1]) for y in inside)
            assert found[x[0]] in {y[0] for y in inside if (y[4] - y[3], y[1]) == least}


def test_one_book_of_very_many_ranges(spark):
    """All pairs would be 40 billion: a range a place in one book, and targets inside each."""
    n = 200_000
    spans = spark.range(n).select(F.col("id"), F.lit(0).alias("seq"), F.lit("G").alias("book"), (F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 6).alias("hi"))
    wide = spark.range(n // 1000).select((F.col("id") + n).alias("id"), F.lit(0).alias("seq"), F.lit("G").alias("book"), (F.col("id") * 10_000).alias("lo"), (F.col("id") * 10_000 + 9999).alias("hi"))
    targets = spark.range(n).select(F.col("id"), F.lit(0).alias("seq"), F.lit("G").alias("book"), (F.col("id") * 10 + F.col("id") % 8).alias("lo"), (F.col("id") * 10 + F.col("id") % 8).alias("hi"))
    began = time.time()
    found = I.containing(targets, spans.union(wide))
    wrong = found.where(F.col("span_id") != F.when(F.col("id") % 8 < 7, F.col("id")).otherwise(n + F.floor(F.col("id") / 1000)))
    assert wrong.count() == 0 and found.count() == n
    shown = I.expand(targets.where("id % 8 < 7"), spans.select("book", "lo", "hi", F.lit("x").alias("text")))
    assert shown.where("size(blocks) <> 1").count() == 0
    assert time.time() - began < 120


def test_no_ranges(spark):
    empty = spark.createDataFrame([], COLS)
    one = spark.createDataFrame([(1, 0, "G", 1, 2)], COLS)
    assert I.overlap_join(empty, one, bin_size="auto").count() == 0 and I.containing(one, empty).first().span_id is None and I.expand(one, empty.withColumn("text", F.lit(""))).count() == 0


def test_bins_smaller_than_ranges(spark):
    """A range touches a few cells however many bins it spans, and the pairs are those without bins, reversed ranges too."""
    rng = random.Random(3)
    left, right = (spark.createDataFrame([r for r in made_up(rng, 100, first) if abs(r[4]) < 1 << 50], COLS) for first in (0, 1000))
    pairs = lambda size: sorted((r.a_id, r.b_id) for r in I.overlap_join(left, right, size).collect())
    assert len(pairs(None)) > 300 and pairs(None) == pairs(1) == pairs(4096) == pairs(1 << 21)
    long = spark.range(2000).select("id", F.lit(0).alias("seq"), F.lit("G").alias("book"), (F.col("id") * (1 << 20)).alias("lo"), (F.col("id") * (1 << 20) + (1 << 33)).alias("hi"))
    began = time.time()
    assert I.overlap_join(long, long.where("id % 100 = 0"), 16).count() == sum(abs(a - b) <= 1 << 13 for a in range(2000) for b in range(0, 2000, 100))
    assert time.time() - began < 60


def test_cells_are_not_broadcast(spark):
    """Where rows are multiplied before a join, Spark knows their size only from before."""
    one = spark.createDataFrame([(1, 0, "G", 1, 2)], COLS)
    for size in (16, "auto"):
        plan = I.overlap_join(one, one, size)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
