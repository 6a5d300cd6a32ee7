"""Quotation linking: quoted passages joined by hash to the messages they come from, in DataFrame operations only.

A line that begins with quote marks (``>``, any number, spaces between allowed) has that many levels. Runs of
lines of one level are passages. Passages of level 0 are a message's own words; the others quote. Normalised
passages are compared by 128-bit hashes. The original of a passage is the earliest message of the scope that holds it as its own,
found by a grouped minimum, so a passage that thousands quote or repeat is never paired out. Parts of longer messages are found by
the first ANCHOR words of the quotes: each place where these stand gives one window for each length of such quotes. Messages that answer each
other make a thread; the first message of each is found by doubling the links, and threads set the order of replies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.arrays import runs
from quillspan.llm.ranked import ranked, row_ids
from quillspan.plans.scratch import Scratch

MARKS = r"^[ \t]*((?:>[ \t]*)+)"
#: A quote of so many words is found anywhere in a message, a shorter one as whole lines only.
ANCHOR = 5


def _normal(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g")]


def _line_pieces(parts: DataFrame) -> DataFrame:
    """(scope, at, p): each passage, its lines, and its runs of lines with fewer than ANCHOR words together; normalised."""
    # lines are a column of their own, so that a run doesn't split the passage again
    lined = parts.select("scope", "at", _normal(F.col("passage")).alias("whole"), F.filter(F.transform(F.split("passage", "\n", -1), _normal), lambda x: x != "").alias("l"))

    def short(r: int) -> Column:
        every = F.transform(runs(F.col("l"), r), lambda x: F.concat_ws(" ", *(x[f"t{k}"] for k in range(r))))
        return F.filter(every, lambda x: F.size(F.split(x, " ")) < ANCHOR)

    return lined.select("scope", "at", F.explode(F.array_distinct(F.concat(F.array("whole"), "l", *map(short, range(2, ANCHOR))))).alias("p"))


def passages(messages: DataFrame, text: str) -> DataFrame:
    """messages with (level, part, passage): one row a run of lines of one level with a word in it."""
    parsed = F.transform(F.split(text, "\n", -1), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), r"[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("line")))
    levels = F.transform("_lines", lambda x: x.level)
    fresh = F.zip_with(levels, F.concat(F.array(F.lit(-1)), levels), lambda x, before: x.isNotNull() & (x != before))  # the second is one longer
    starts = F.filter(F.transform(fresh, lambda new, i: F.when(new, i)), lambda i: i.isNotNull())
    bounded = messages.withColumn("_lines", parsed).withColumn("_starts", starts)
    until = F.get("_starts", F.col("part") + 1)
    out = bounded.select("*", F.posexplode("_starts").alias("part", "_from"))
    run = F.slice("_lines", F.col("_from") + 1, F.coalesce(until, F.size("_lines")) - F.col("_from"))
    out = out.withColumn("level", F.get("_lines", F.col("_from")).level).withColumn("passage", F.array_join(F.transform(run, lambda x: x.line), "\n"))
    return out.where(_normal(F.col("passage")) != "").drop("_lines", "_starts", "_from")


def own_words(text: str) -> Column:
    """The text without quoted lines, trimmed at both ends; null for null."""
    kept = F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(MARKS))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def link_quotations(messages: DataFrame, scope: str = "conv_id", order: str = "turn", text_col: str = "text", role_col: str = "role") -> DataFrame:
    """Reply-ordered conversations without quotes, one row per message.

    Returns scope, order, role_col, n_quotes (quoted passages of the message), parent (the order value of the message it
    answers, null if none), depth (levels of the deepest quote), thread (the order value of the first message of its thread, its own if it answers none),
    position (long, from 0 in the scope: threads in the order of their first messages, a thread's messages by order, so that each follows the one it
    answers and branches of other threads don't interleave) and text (own words). The message answered is the latest original among those of its quotes of the least level that
    are linked; an original comes strictly before, by order. A passage of level n is matched, whatever its line ends, with a whole
    passage of a message's own words, with one or more whole lines of it, or, if it has ANCHOR words or more, with any run of words in it. Null scopes are one scope; messages without order come first and
    are no originals; messages of one order are none for each other and keep input order, and the first of them stands for all where threads are
    followed. Null or empty texts quote nothing. Other columns are not read.
    """
    scratch = Scratch(messages.sparkSession, "quotes")
    base = scratch.write(row_ids(messages.select(F.col(scope).alias("scope"), F.col(order).cast("long").alias("at"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))), "messages")
    found = passages(base, "text")
    normal = _normal(F.col("passage"))
    words = F.split(normal, " ")
    start = F.xxhash64(F.array_join(F.slice(words, 1, ANCHOR), " "))
    quotes = found.where("level > 0").select("scope", "at", "rid", "level", F.size(words).alias("n"), start.alias("start"), *_hashes(normal))
    quotes = scratch.write(quotes, "passages")
    scopes = scratch.write(quotes.select("scope").distinct(), "quoting")
    parts = found.where("level = 0 and at is not null").join(scopes.withColumnRenamed("scope", "_s"), F.col("scope").eqNullSafe(F.col("_s")), "left_semi")
    pieces = _line_pieces(parts)
    # quotes of ANCHOR words or more: places of their first words, then windows of their lengths
    anchors = quotes.where(F.col("n") >= ANCHOR).groupBy(F.col("scope").alias("_s"), F.col("start").alias("_k")).agg(F.collect_set("n").alias("lengths"))
    anchors = scratch.write(anchors, "anchors")
    split = parts.select("scope", "at", "rid", "part", words.alias("w")).where(F.size("w") >= ANCHOR)
    keys = F.transform(runs(F.col("w"), ANCHOR), lambda x: F.xxhash64(F.concat_ws(" ", *(x[f"t{k}"] for k in range(ANCHOR)))))
    places = split.select("scope", "rid", "part", F.posexplode(keys).alias("pos", "k"))
    hits = places.join(anchors, (F.col("k") == F.col("_k")) & F.col("scope").eqNullSafe(F.col("_s")))
    hits = scratch.write(hits.select("rid", "part", "pos", F.explode("lengths").alias("n")), "places")
    windows = split.join(hits, ["rid", "part"]).where("pos + n <= size(w)")
    pieces = pieces.unionByName(windows.select("scope", "at", F.array_join(F.slice("w", F.col("pos") + 1, F.col("n")), " ").alias("p")))
    firsts = pieces.groupBy("scope", *_hashes(F.col("p"))).agg(F.min("at").alias("first"))
    firsts = scratch.write(firsts.withColumnRenamed("scope", "_s"), "originals")
    linked = quotes.join(firsts, ["h", "g"]).where(F.col("scope").eqNullSafe(F.col("_s")) & (F.col("first") < F.col("at")))
    best = linked.groupBy("rid").agg(F.max(F.struct((-F.col("level")).alias("near"), F.col("first"))).getField("first").alias("parent"))
    count = quotes.groupBy("rid").agg(F.count("*").alias("n_quotes"), F.max("level").alias("depth"))
    facts = scratch.write(count.join(best, "rid", "left"), "facts")
    out = base.join(facts, "rid", "left").withColumn("text", own_words("text"))
    tops = _threads(base, facts, scratch)
    if tops is None:
        out = out.withColumn("thread", F.col("at"))
    else:
        same = (F.col("parent") == F.col("_at")) & F.col("scope").eqNullSafe(F.col("_s"))
        out = out.join(tops, same, "left").withColumn("thread", F.coalesce("top", "parent", "at")).drop("_s", "_at", "top")
    out = ranked(out.na.fill(0, ["n_quotes", "depth"]), ["scope"], [F.col("thread"), F.col("at"), F.col("rid")], scratch, "position")
    return out.select(F.col("scope").alias(scope), F.col("at").alias(order), F.col("role").alias(role_col), F.col("n_quotes").cast("long"), "parent", F.col("depth").cast("long"), "thread", "position", "text")


def _threads(base: DataFrame, facts: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(_s, _at, top): the first message of the thread of every message that answers one; None if none does. Rounds double what they follow."""
    answers = facts.where("parent is not null").select("rid", "parent")
    if answers.isEmpty():
        return None
    linked = base.select("scope", "at", "rid").join(answers, "rid", "left")
    # the first message of an order value stands for it, also where only a later one answers
    up = linked.where("at is not null").groupBy("scope", "at").agg(F.min_by(F.struct("parent"), "rid").alias("p")).where("p.parent is not null")
    up = scratch.write(up.select("scope", "at", F.col("p.parent").alias("top")), "answers")
    while True:
        ahead = up.select(F.col("scope").alias("_s"), F.col("at").alias("_at"), F.col("top").alias("far"))
        both = up.join(ahead, (F.col("top") == F.col("_at")) & F.col("scope").eqNullSafe(F.col("_s")), "left")
        up = scratch.write(both.select("scope", "at", F.coalesce("far", "top").alias("top"), F.col("far").isNotNull().alias("moved")), "followed")
        if up.where("moved").isEmpty():
            return up.select(F.col("scope").alias("_s"), F.col("at").alias("_at"), "top")
