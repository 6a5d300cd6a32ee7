import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import outline as T
from quillspan.plans.places import placed
from quillspan.plans.scratch import Scratch

SCHEMA = "node string, parent string, label string, item boolean"


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "outline-test")


def brute(rows, q):
    """Kept nodes with matched and the items kept at or under them."""
    kids, parent = {}, {n: p for n, p, _, _ in rows}
    for n, p, _, _ in rows:
        kids.setdefault(p if p in parent else None, []).append(n)
    info = {n: (label, item) for n, _, label, item in rows}
    out = {}

    def walk(n, whole):
        label, item = info[n]
        hit = q in (label or "").lower()
        count, any_kept = 0, False
        for k in kids.get(n, []):
            c, kept = walk(k, whole or hit)
            count, any_kept = count + c, any_kept or kept
        if whole or hit or any_kept:
            count += bool(item)
            out[n] = (hit, count)
            return count, True
        return 0, False

    for root in kids[None]:
        walk(root, False)
    return out


def test_random_trees(spark, scratch):
    rng = random.Random(4)
    rows = [(f"x{i}", None if i < 3 else f"x{max(0, i - rng.choice([1, 1, 1, 2, 9]))}", rng.choice(["Rain", "sun", "wind", None, "SNOW", "fog and rain"]) if rng.random() < 0.2 else "calm", rng.random() < 0.5) for i in range(300)]
    rows += [("lost", "nobody", "rain", True), ("lone", None, "calm", True)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for q in ("RAIN", "snow ", "nothing"):
        got = {r.node: (r.matched, r.n_items) for r in T.prune(df, q, ["label"], F.col("item"), scratch).collect()}
        assert got == brute(rows, q.strip().lower())
    every = T.prune(df, "  ", ["label"], F.col("item"), scratch).collect()
    assert len(every) == len(rows) and not any(r.matched for r in every)
    parent = {n: p for n, p, _, _ in rows}
    chain = lambda n: [*(chain(parent[n]) if parent[n] in parent else []), n]
    got = {r.node: (r.depth, r.path) for r in T.paths(df, F.col("node"), scratch).collect()}
    assert got == {n: (len(chain(n)) - 1, chain(n)) for n in parent}


def test_circles_empty_trees_and_null_nodes(spark, scratch):
    ring = spark.createDataFrame([("a", "c", "x", True), ("b", "a", "x", True), ("c", "b", "x", True), ("d", None, "x", True)], SCHEMA)
    with pytest.raises(ValueError, match="circle"):
        T.jumps(ring, scratch)
    empty = spark.createDataFrame([], SCHEMA)
    assert T.prune(empty, "x", ["label"], F.col("item"), scratch).count() == 0 and T.paths(empty, F.col("node"), scratch).count() == 0
    odd = spark.createDataFrame([(None, None, "x", True), ("a", None, None, None), ("b", "a", "x", None)], SCHEMA)
    assert {(r.node, r.matched, r.n_items) for r in T.prune(odd, "x", ["label"], F.col("item"), scratch).collect()} == {("a", False, 0), ("b", True, 0)}


def test_a_deep_chain_takes_few_steps(spark, scratch):
    chain = spark.range(3000).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.when(F.col("id") == 2999, "end").otherwise("").alias("label"), F.lit(True).alias("item"))
    assert len(T.jumps(chain, scratch)) == 12
    got = T.prune(chain, "end", ["label"], F.col("item"), scratch)
    assert got.count() == 3000 and got.where("node = 0").first().n_items == 3000


def test_reading_order_introduces_once(spark, scratch):
    sections = spark.createDataFrame([("s1", 1, "Gen", "Genesis"), ("s2", 2, "Mal", "Malachi"), ("s3", 3, None, "Loose"), ("s4", 4, "Mal", "Malachi again")], "section string, seq int, intro string, label string")
    entries = spark.createDataFrame([("s4", 1, "e4", "d"), ("s1", 2, "e2", "b"), ("s1", 1, "e1", "a"), ("s3", 1, "e3", "c"), ("s9", 1, "e9", "no section")], "section string, seq int, id string, label string")
    rows = T.reading_order(sections, entries, scratch).orderBy("position").collect()
    assert [(r.position, r.kind, r.id) for r in rows] == [(0, "intro", "Gen"), (1, "entry", "e1"), (2, "entry", "e2"), (3, "intro", "Mal"), (4, "entry", "e3"), (5, "entry", "e4")]


def test_places_in_groups_of_any_size(spark, scratch):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "cold").alias("g"))
    rows = placed(df, ["g"], [F.desc("v")], scratch).collect()
    for g in ("hot", "cold", None):
        mine = sorted((r for r in rows if r.g == g), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(len(mine))) and [r.v for r in mine] == sorted((r.v for r in mine), reverse=True)
    assert placed(df.limit(0), [], [F.col("v")], scratch).count() == 0


def test_finished_paths_are_not_written_again(spark, scratch):
    rows = [(f"r{i}", None) for i in range(1000)] + [(f"c{i}", f"c{i - 1}" if i else "r0") for i in range(9)]
    got = {r.node: r.path for r in T.paths(spark.createDataFrame(rows, "node string, parent string"), F.col("node"), scratch).collect()}
    assert len(got) == 1009 and got["c8"] == ["r0", *(f"c{i}" for i in range(9))] and got["r7"] == ["r7"]
    steps = [p for p in scratch._paths if p.endswith("-paths")]
    assert 3 <= len(steps) <= 5 and all(spark.read.parquet(p).count() <= 9 for p in steps)
