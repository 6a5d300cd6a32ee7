"""Connected components: union-find inside partitions, contraction to roots between them.

A round gives every node a pointer to its least neighbour, follows the pointers to their roots by doubling, and links the
roots. Nodes are compared by id in the first round, which ends most stars and groups at once, and by a hash that changes with the round
later: then at most half of the nodes of any component are expected to be less than all their neighbours, so the rounds grow with the
logarithm of the nodes and the doublings with that of the longest path, whatever the order of ids. Once AT_ONCE links or fewer are left, one task ends them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.plans.scratch import Scratch

#: Links that one task may take, and nodes that a task holds before it passes on what it has.
AT_ONCE, HELD = 500_000, 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's links: each node that isn't its set's least one, with that one."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def out() -> Iterator[pa.RecordBatch]:
        nodes = list(parent)
        for i in range(0, len(nodes), 100_000):
            part = nodes[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > HELD:
            yield from out()
            parent.clear()
    yield from out()


def _roots(links: DataFrame, turn: int, scratch: Scratch) -> DataFrame:
    """(a, to) of every node: the root that its pointer leads to; a node less than all its neighbours is its own."""

    def key(c: str) -> Column:
        return F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("x")) if turn else F.struct(F.col(c).alias("x"))

    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    to = both.groupBy("a").agg(F.least(F.min(key("b")), key("a")).alias("k")).select("a", F.col("k.x").alias("to"))
    to = scratch.write(to, "pointers")
    while True:
        ahead = to.select(F.col("a").alias("to"), F.col("to").alias("far"))
        far = scratch.write(to.join(ahead, "to").select("a", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")), "doubled")
        scratch.drop(to)
        to = far
        if to.where("moved").isEmpty():
            return to.select("a", "to")


def components(links: DataFrame, scratch: Scratch, at_once: int = AT_ONCE) -> DataFrame:
    """(node, label) of every node in a link, where label is the least node of its component.

    links: two long columns; loops, repeats and any direction are fine; rows with a null are no links.
    Each partition first shrinks its links to a forest, so a hub's links meet no single task.
    """
    a, b = links.columns
    now = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    now = scratch.write(now.mapInArrow(_forest, "a long, b long"), "forest")
    labels, turn = None, 0
    while n := now.count():
        if n <= at_once:
            to = scratch.write(now.coalesce(1).mapInArrow(_forest, "a long, b long").withColumnRenamed("b", "to"), "last")
            to = to.unionByName(to.select(F.col("to").alias("a"), "to").distinct())
            rest = None
        else:
            to = _roots(now, turn, scratch)
            left, right = to.select("a", F.col("to").alias("x")), to.select(F.col("a").alias("b"), F.col("to").alias("y"))
            rest = now.join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
            rest = scratch.write(rest.mapInArrow(_forest, "a long, b long"), "forest")
            turn += 1
        if labels is None:
            labels = to.select(F.col("a").alias("node"), F.col("to").alias("label"))
        else:
            moved = to.select(F.col("a").alias("label"), "to")
            labels = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = scratch.write(labels, "labels")
        if rest is None:
            break
        now = rest
    if labels is None:
        return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    if turn > 1:  # roots of later rounds aren't the least nodes
        least = labels.groupBy("label").agg(F.min("node").alias("least"))
        labels = scratch.write(labels.join(least, "label").select("node", F.col("least").alias("label")), "labels")
    return labels
