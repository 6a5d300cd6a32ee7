"""Sharding by histogram sort: exact byte counts below candidate key boundaries, refined until the splitters stand.

The key is a list of long columns compared in turn; the last makes it unique, so a key that holds a third of
all rows is split like any other. A pass counts the bytes of at most PROBES equal cells of each open interval
of the key space, and of about CELLS in all (partial sums in every task; the driver sees a bounded table of cells), then narrows each
splitter to one cell. Rows find their interval by binary search. Passes read only the narrow key table. Shards are cut on into even parts in the same passes, whose
splitters need only be near, so that no task sorts a whole shard. The splitters then are the partitioner of the one exchange of rows; a row's
slot is its place in its sorted part plus the rows counted in the shard's earlier parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.ranked import PLACE_BITS, free_name, is_integral, numbered, row_ids
from quillspan.plans.scratch import Scratch

PROBES, CELLS = 1024, 1 << 16
#: From so many bounds on they are searched as an array, as a tree of comparisons would outgrow compiled code.
TREE = 64
#: How far the splitters inside a shard may be off, in sizes of a part.
LOOSE = 0.5
_LEAST = -(1 << 63)


@dataclass
class _Search:
    """The place of one splitter: in keys that begin with prefix and go on with lo <= value < hi; below: bytes before these."""

    prefix: tuple[int, ...]
    lo: int
    hi: int
    below: int
    found: tuple[int, ...] | None = None


def splitters(keys: DataFrame, levels: list[str], weight: str, shards: int, tolerance: float = 0.0, parts: int = 1) -> list[tuple[int, ...]]:
    """shards * parts - 1 least keys, in order: part i takes the keys from splitter i - 1 on and below splitter i.

    The splitters between shards stand at the row boundary nearest to their share of the whole weight (the lower of two), or at the
    first boundary met within tolerance * weight / shards of it; those inside a shard stand within LOOSE of a part's size. A key may be cut short;
    missing levels count as least.
    """
    whole = keys.agg(F.sum(weight), F.min(levels[0]), F.max(levels[0])).first()
    total = whole[0] or 0
    inner, shards = parts, shards * parts
    if not total:
        return [(_LEAST,)] * (shards - 1)
    goals = [_Search((), whole[1], whole[2] + 1, 0) for _ in range(shards - 1)]
    while True:
        open_ = list(dict.fromkeys((g.prefix, g.lo, g.hi) for g in goals if g.found is None))
        if not open_:
            return [g.found for g in goals]
        probes = max(16, min(PROBES, CELLS // len(open_)))
        cells = _count(keys, levels, weight, open_, probes)
        for i, g in enumerate(goals, 1):
            if g.found is not None:
                continue
            slack = (LOOSE if i % inner else tolerance * inner) * total  # in weights times shards
            width = -((g.lo - g.hi) // probes)
            below, aim = g.below, total * i  # weights are compared times shards
            for cell, w, rows, first, last in cells[g.prefix, g.lo, g.hi]:
                if (below + w) * shards <= aim:
                    below += w
                    continue
                start = g.lo + cell * width
                level = len(g.prefix)
                if rows == 1 or (width == 1 and level + 1 == len(levels)) or min(aim - below * shards, (below + w) * shards - aim) <= slack:
                    after = aim - below * shards > (below + w) * shards - aim
                    if rows == 1 and width > 1:
                        start, width = first, 1
                    g.found = (*g.prefix, start + width if after else start)
                elif width == 1:
                    g.prefix, g.lo, g.hi, g.below = (*g.prefix, start), first, last + 1, below
                else:
                    g.lo, g.hi, g.below = start, min(start + width, g.hi), below
                break
            else:
                g.found = (*g.prefix, g.hi)


def _longs(values: list[int]) -> Column:
    """An array of constants, as one short expression."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _count(keys: DataFrame, levels: list[str], weight: str, open_: list[tuple], probes: int) -> dict[tuple, list[tuple]]:
    """For each open interval (they don't overlap) its non-empty cells in order: cell, weight, rows, and the least and greatest value that matters next."""
    open_ = sorted(open_, key=lambda x: (*x[0], x[1]))
    width = [-((lo - hi) // probes) for _, lo, hi in open_]
    which = shard_of(levels, [(*prefix, lo) for prefix, lo, _ in open_]) - 1
    rows = keys.select(*levels, F.col(weight).alias("_b"), which.alias("_w")).where("_w >= 0")
    pick = lambda values: F.get(_longs(values), F.col("_w"))
    at = [F.col(c) for c in levels]
    depth = F.get(F.array(*(F.lit(n) for n in range(len(levels)))), pick([len(x[0]) for x in open_]).cast("int"))
    value = F.get(F.array(*at), depth)
    inside = value <= pick([x[2] - 1 for x in open_])
    for n in range(len(levels) - 1):
        inside = inside & ((depth <= n) | (at[n] == pick([x[0][n] if len(x[0]) > n else 0 for x in open_])))
    rows = rows.withColumns({"_v": value, "_d": depth, "_in": inside, "_lo": pick([x[1] for x in open_]), "_width": pick(width)}).where("_in")
    if all(hi - lo < 1 << 62 and lo > _LEAST for _, lo, hi in open_):
        cell = F.expr("case when _in then (_v - _lo) div _width end")
    else:  # a difference may leave the range of a long
        cell = F.expr("cast(floor((cast(_v as decimal(38,0)) - cast(_lo as decimal(38,0))) / cast(_width as decimal(38,0))) as long)")
    # one row in a wide cell: its own value ends the search; a cell of one value: the next level goes on
    seen = F.when((F.col("_width") > 1) | (F.col("_d") + 1 == len(levels)), F.col("_v")).otherwise(F.get(F.array(*at), F.col("_d") + 1))
    found = rows.select("_w", cell.alias("_c"), seen.alias("_s"), "_b")
    out: dict[tuple, list[tuple]] = {x: [] for x in open_}
    for r in found.groupBy("_w", "_c").agg(F.sum("_b"), F.count("*"), F.min("_s"), F.max("_s")).collect():
        out[open_[r[0]]].append(tuple(r)[1:])
    return {x: sorted(cells) for x, cells in out.items()}


def shard_of(levels: list[str], bounds: list[tuple[int, ...]]) -> Column:
    """The number of bounds that are not above the key: few by a balanced tree of comparisons, many by halving an array of them."""
    key = F.struct(*(F.col(c) for c in levels))
    full = [[*b, *[_LEAST] * (len(levels) - len(b))] for b in bounds]

    def below(i: int, j: int) -> Column:
        if i == j:
            return F.lit(i)
        m = (i + j) // 2
        return F.when(key < F.struct(*(F.lit(v).cast("long").alias(c) for c, v in zip(levels, full[m], strict=True))), below(i, m)).otherwise(below(m + 1, j))

    if len(bounds) <= TREE:
        return below(0, len(bounds))
    columns = [_longs([b[n] for b in full]) for n in range(len(levels))]
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))

    def further(place: Column, step: Column) -> Column:
        bound = F.struct(*(F.get(x, place + step - 1).alias(c) for x, c in zip(columns, levels, strict=True)))
        return F.when((place + step <= len(bounds)) & (bound <= key), place + step).otherwise(place)

    return F.aggregate(steps, F.lit(0), further)


def shard_documents(docs: DataFrame, shards: int = 16, key_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.0, carry: bool = False) -> DataFrame:
    """Documents in key order, cut into shards of near-equal bytes.

    Returns one row per row of docs: key_col, size (UTF-8 bytes of the text, none for null, plus 1), text_crc32 (null for a
    null text), law ('bytes'), shard (from 0), slot (from 0 in each shard, in key order, without gaps) and grown_shard
    (null: this law moves rows when shards are added). carry: all columns of docs, then shard and slot, which are called shard_1 and so on where
    docs has such a column; the text then moves in the one exchange. Keys are whole numbers, or anything that sorts (strings by code point).
    Rows without a key come first. Equal keys and whole repeated rows stay
    separate rows in input order and may be split between shards. More shards than rows leave shards empty. Other columns are not read without carry.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    levels = ["_has", "_key", "_rid"]
    key = [F.col(key_col).isNotNull().cast("long").alias("_has"), F.col(key_col).alias("_key"), size.alias("size")]
    if carry:  # whole rows as one column, so that no name of theirs meets one of ours
        base = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), *key)
    else:
        base = docs.select(F.col(key_col).alias("_id"), *key, F.crc32(F.col(text_col).cast("binary")).alias("text_crc32"))
    base = scratch.write(row_ids(base, "_rid"), "keys")
    if is_integral(docs, key_col):
        base = base.withColumn("_key", F.coalesce(F.col("_key").cast("long"), F.lit(0)))
    else:
        named = base.join(numbered(base.select("_key"), scratch).withColumnRenamed("key", "_key"), "_key", "left")
        base = scratch.write(named.withColumn("_key", F.coalesce("number", F.lit(0))).drop("number"), "numbered")

    parts = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)
    bounds = splitters(base, levels, "size", shards, tolerance, parts)
    placed = base.withColumn("_part", shard_of(levels, bounds))
    rows = {r[0]: r[1] for r in placed.groupBy("_part").count().collect()}  # one row a part
    before = [sum(rows.get(j, 0) for j in range(i - i % parts, i)) for i in range(shards * parts)]
    dealt = placed.repartitionById(shards * parts, "_part").sortWithinPartitions(*levels)
    at = F.monotonically_increasing_id().bitwiseAND((1 << PLACE_BITS) - 1)
    slot = (at + F.get(F.array(*(F.lit(n).cast("long") for n in before)), F.col("_part"))).alias("slot")
    out = dealt.select("*", slot).withColumn("shard", F.floor(F.col("_part") / parts).cast("int"))
    if carry:
        return out.select("row.*", F.col("shard").alias(free_name("shard", docs.columns)), F.col("slot").alias(free_name("slot", docs.columns)))
    return out.select(F.col("_id").alias(key_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
