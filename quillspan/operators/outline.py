"""Trees of any depth as rows (node, parent): filtering, counts below a node, order of reading, nested documents.

Nothing walks a tree a level at a time: each step doubles the distance that nodes look up, so a tree of depth d takes log2(d) + 1 steps, and a step handles
only nodes that have an ancestor that far up. A parent that is null or isn't a node makes its node a root. Nodes must be unique; null nodes are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.plans.places import placed
from quillspan.plans.scratch import Scratch


def jumps(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Tables (node, up) of the ancestors 1, 2, 4 and so on above, of the nodes that have one. A cycle is an error."""
    each = nodes.where("node is not null").select("node", F.col("parent").alias("up"))
    up = each.join(each.select(F.col("node").alias("up")), "up", "left_semi").select("node", "up")
    out, total, far = [], each.count(), 1
    while True:
        up = scratch.write(up, "jump")
        if up.isEmpty():
            return out
        if far > total:
            raise ValueError("the parents of some nodes run in a circle")
        out.append(up)
        further = up.select(F.col("node").alias("up"), F.col("up").alias("_next"))
        up, far = up.join(further, "up").select("node", F.col("_next").alias("up")), 2 * far


def below(marked: DataFrame, steps: list[DataFrame], scratch: Scratch) -> DataFrame:
    """The nodes of marked (node) and all under them."""
    for up in steps:
        hit = up.join(marked.select(F.col("node").alias("up")), "up", "left_semi").select("node")
        marked = scratch.write(marked.unionByName(hit).distinct(), "below")
    return marked


def above(marked: DataFrame, steps: list[DataFrame], scratch: Scratch) -> DataFrame:
    """The nodes of marked (node) and all over them."""
    for up in steps:
        hit = up.join(marked, "node", "left_semi").select(F.col("up").alias("node"))
        marked = scratch.write(marked.unionByName(hit).distinct(), "above")
    return marked


def totals(counted: DataFrame, steps: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(node, n): the sum of n over a node and all nodes under it, for the (node, n) given; nodes without any are left out."""
    total = counted.groupBy("node").agg(F.sum("n").alias("n"))
    for up in steps:  # what lies under a node up to so far, plus what lies under the nodes exactly so far below it
        more = up.join(total, "node").select(F.col("up").alias("node"), "n")
        total = scratch.write(total.unionByName(more).groupBy("node").agg(F.sum("n").alias("n")), "totals")
    return total


def prune(nodes: DataFrame, query: str, texts: list[str], item: Column, scratch: Scratch, searched: Column | None = None) -> DataFrame:
    """The nodes that stay under a filter, with matched and n_items (the items that stay at or under the node).

    A node matches if one of its texts holds the query, in any case; searched is false for nodes that are only ever kept for others. A match keeps
    all that is under it, and all that is over it. Of the rest nothing stays. A blank query matches nothing and keeps everything.
    """
    q = query.strip().lower()
    hit = F.lit(False)
    for t in texts if q else []:
        hit = hit | F.coalesce(F.contains(F.lower(t), F.lit(q)), F.lit(False))
    nodes = scratch.write(nodes.where("node is not null").withColumns({"matched": hit if searched is None else hit & F.coalesce(searched, F.lit(False)), "_item": F.coalesce(item, F.lit(False))}), "nodes")
    steps = jumps(nodes, scratch)
    matched = nodes.where("matched").select("node")
    stay = nodes.select("node") if not q else below(matched, steps, scratch).unionByName(above(matched, steps, scratch)).distinct()
    stay = scratch.write(stay, "stay")
    n = totals(nodes.where("_item").join(stay, "node", "left_semi").select("node", F.lit(1).cast("long").alias("n")), steps, scratch)
    out = nodes.drop("_item").join(stay, "node", "left_semi").join(n.withColumnRenamed("n", "n_items"), "node", "left")
    return out.withColumn("n_items", F.coalesce("n_items", F.lit(0).cast("long")))


def paths(nodes: DataFrame, key: Column, scratch: Scratch) -> DataFrame:
    """(node, depth, path): how many ancestors a node has, and the keys of these from the root down to its own; rows sorted by path are in depth-first order."""
    each = scratch.write(nodes.where("node is not null").select("node", F.col("parent").alias("up"), F.array(key).alias("path")), "nodes")
    over = each.select(F.col("node").alias("_known"))
    known = scratch.write(each.join(over, F.col("up") == F.col("_known"), "left").select("node", F.col("_known").alias("up"), "path"), "known")
    done, rest, far, total = known.where("up is null"), known.where("up is not null"), 1, each.count()
    # an unfinished row has the keys from below up to its node, and up moves twice as far each step; finished rows don't move any more
    while not rest.isEmpty():
        if far > total:
            raise ValueError("the parents of some nodes run in a circle")
        over = done.unionByName(rest).select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_over"))
        known = scratch.write(rest.join(over, "up").select("node", F.col("_up").alias("up"), F.concat("_over", "path").alias("path")), "paths")
        done, rest, far = done.unionByName(known.where("up is null")), known.where("up is not null"), 2 * far
    return done.select("node", (F.size("path") - 1).alias("depth"), "path")


def reading_order(sections: DataFrame, entries: DataFrame, scratch: Scratch) -> DataFrame:
    """(position, kind, id, label): before the entries of a section its introduction, if it has one that no earlier section had; positions from 0.

    sections: section, seq, intro (null: none), label. entries: section, seq, id, label. Orders must be total; an entry of an unknown section is left out.
    """
    first = sections.where("intro is not null").groupBy("intro").agg(F.min(F.struct("seq", "section", "label")).alias("s"))
    heads = first.select(F.col("s.seq").alias("_s"), F.lit(0).alias("_k"), F.lit(None).cast(entries.schema["seq"].dataType).alias("_e"), F.lit("intro").alias("kind"), F.col("intro").cast("string").alias("id"), F.col("s.label").alias("label"))
    items = entries.join(sections.select("section", F.col("seq").alias("_s")), "section")
    items = items.select("_s", F.lit(1).alias("_k"), F.col("seq").alias("_e"), F.lit("entry").alias("kind"), F.col("id").cast("string").alias("id"), "label")
    return placed(heads.unionByName(items), [], [F.col("_s"), F.col("_k"), F.col("_e")], scratch).select("position", "kind", "id", "label")
