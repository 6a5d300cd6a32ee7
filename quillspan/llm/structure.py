"""Repair of the structure of conversations: the cheapest edits after which roles alternate, found on a trie of signatures.

A conversation's rows stand in order of turn (nulls first), then of role and text. A row's fault is the first that fits: blank (no character
besides white space), duplicate (role and text seen earlier in the conversation), truncated (the last character besides white space isn't one of
``. ! ?``). Edits: K keeps a row (cost 0), R makes its role user or assistant (1), D deletes it (2; blank and duplicate rows must go), I inserts a
user or assistant row without text anywhere (5); a truncated row that stays costs 5 more. What is left must read ``(s?(ua)+)?`` in initials of
roles. Of the cheapest lists of edits the one of the least letters in ASCII is the audit.

A row is one symbol (initial of its role, fault), a conversation a string of symbols, its signature. Equal signatures are solved once; distinct ones
are sorted over tasks, and a task walks the trie that they form: the costs after each prefix (a layer) stay on a stack and are computed once for all
signatures below it. A conversation may be of any length: places come from a range sort, symbols are joined in pieces, texts pass a task as a stream.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.ranked import ranked
from quillspan.plans.scratch import Scratch

SPACE = " \t\n\x0b\x0c\r"
#: Initials of roles by place, and faults by place; any other initial (and an empty role) is a fourth kind.
INITIALS, FAULTS = ("s", "u", "a"), ("fine", "blank", "duplicate", "truncated")
_SYMBOLS = "ABCDEFGHIJKLMNOP"  # 4 * kind of role + fault
#: Symbols of a conversation that are gathered as rows at once.
PIECE = 4096

RENAME, DELETE, INSERT, CUT = 1, 2, 5, 5
_NEVER = 1 << 40
# States of (s?(ua)+)?: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_TURN = {0: "u", 1: "u", 2: "a", 3: "u"}  # what an inserted or renamed row is after each state
_ENDS = (0, 3)


@dataclass(frozen=True)
class Repaired:
    """report: a row a conversation; messages: what is left of them, conversation by conversation, each whole and in order in one task."""

    report: DataFrame
    messages: DataFrame


def _inserted(layer: list[int]) -> list[int]:
    for _ in range(2):  # two rows, user and assistant, lead from any state to any other that rows of those roles reach
        for s, role in _TURN.items():
            t = _NEXT[role][s]
            layer[t] = min(layer[t], layer[s] + INSERT)
    return layer


def _moves(state: int, symbol: int) -> Iterator[tuple[str, int, int]]:
    """Edits of a row in a state, in the order of their letters: (letter, state after it, cost)."""
    kind, fault = divmod(symbol, 4)
    yield "D", state, DELETE
    if fault in (1, 2):
        return
    more = CUT if fault == 3 else 0
    if kind < 3 and state in _NEXT[INITIALS[kind]]:
        yield "K", _NEXT[INITIALS[kind]][state], more
    role = _TURN[state]
    if kind == 3 or role != INITIALS[kind]:
        yield "R", _NEXT[role][state], RENAME + more


_MOVES = [[list(_moves(s, symbol)) for symbol in range(16)] for s in range(4)]
_LEGAL = {(0, 1), (1, 2), (2, 1)}


class _Trie:
    """The path from the root to one node: a layer of costs and the counts of each node on it."""

    def __init__(self) -> None:
        self.path = ""
        self.costs = array("q", _inserted([0, _NEVER, _NEVER, _NEVER]))
        self.counts = array("q", [0, 0, 0, 0])  # blank, duplicate, truncated, illegal

    def enter(self, signature: str) -> None:
        """Go to the node of a signature; layers of the prefix that it shares with the last one stay."""
        shared = 0
        for x, y in zip(self.path, signature):  # noqa: B905
            if x != y:
                break
            shared += 1
        del self.costs[4 * shared + 4 :], self.counts[4 * shared + 4 :]
        for i in range(shared, len(signature)):
            symbol = ord(signature[i]) - 65
            layer = [_NEVER] * 4
            for s in range(4):
                cost = self.costs[4 * i + s]
                if cost < _NEVER:
                    for _, t, c in _MOVES[s][symbol]:
                        layer[t] = min(layer[t], cost + c)
            self.costs.extend(_inserted(layer))
            counts = self.counts[4 * i : 4 * i + 4]
            if symbol % 4:
                counts[symbol % 4 - 1] += 1
            if i and ((ord(signature[i - 1]) - 65) // 4, symbol // 4) not in _LEGAL:
                counts[3] += 1
            self.counts.extend(counts)
        self.path = signature

    def answer(self) -> tuple[list[int], int, str]:
        """Counts, least cost and audit of the node."""
        signature, costs = self.path, self.costs
        n = len(signature)
        best = min(costs[4 * n + s] for s in _ENDS)
        # states that a cheapest list of edits passes, from the end
        on = bytearray(4 * n + 4)
        for s in _ENDS:
            on[4 * n + s] = costs[4 * n + s] == best
        for i in range(n, -1, -1):
            for _ in range(2):
                for s, role in _TURN.items():
                    t = _NEXT[role][s]
                    if on[4 * i + t] and costs[4 * i + s] + INSERT == costs[4 * i + t]:
                        on[4 * i + s] = 1
            if i:
                symbol = ord(signature[i - 1]) - 65
                for s in range(4):
                    cost = costs[4 * i - 4 + s]
                    on[4 * i - 4 + s] = any(on[4 * i + t] and cost + c == costs[4 * i + t] for _, t, c in _MOVES[s][symbol])
        letters, i, s = [], 0, 0
        while i < n or s not in _ENDS or costs[4 * i + s] != best:
            cost = costs[4 * i + s]
            moves = [(x, i + 1, t, c) for x, t, c in _MOVES[s][ord(signature[i]) - 65]] if i < n else []
            moves.append(("I", i, _NEXT[_TURN[s]][s], INSERT))
            x, i, s = min((x, j, t) for x, j, t, c in moves if on[4 * j + t] and cost + c == costs[4 * j + t])
            letters.append(x)
        return list(self.counts[4 * n : 4 * n + 4]), best, "".join(letters)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = _Trie()
    for batch in batches:
        rows = []
        for signature in batch.column(0).to_pylist():
            trie.enter(signature)
            counts, cost, audit = trie.answer()
            rows.append((signature, *counts, cost, audit))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if 0 < k < 6 else pa.string()) for k, x in enumerate(zip(*rows, strict=True))], ["signature", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def solve_signatures(signatures: DataFrame) -> DataFrame:
    """(signature, blank, duplicate, truncated, illegal, cost, audit) of each distinct value of the one column of signatures."""
    each = signatures.toDF("signature").distinct()
    parts = int(each.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = each.repartitionByRange(parts, "signature").sortWithinPartitions("signature")
    return dealt.mapInArrow(_solve, "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _joined(parts: Column, field: str) -> Column:
    return F.array_join(F.transform(F.sort_array(parts), lambda p: p[field]), "")


def _marked(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (c, t, r, x) with their place in the conversation, and (c, t, slot, symbol) of each."""
    bare = F.rtrim("x", F.lit(SPACE))
    kind = F.lit(3)
    for k, initial in enumerate(INITIALS):
        kind = F.when(F.substring("r", 1, 1) == initial, k).otherwise(kind)
    rows = rows.select("*", F.sha2(F.concat(F.length("r").cast("string"), F.lit(":"), "r", "x"), 256).alias("h"), kind.alias("kind"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    placed = ranked(rows, ["c"], [F.asc_nulls_first("t"), F.asc("r"), F.asc("x")], scratch)
    again = placed.where(~F.col("blank")).groupBy("c", "h").agg(F.min("slot").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = again.select(F.col("c").alias("c2"), F.col("h").alias("h2"), "first")
    fault = F.when(F.col("blank"), 1).when(F.coalesce(F.col("slot") > F.col("first"), F.lit(False)), 2).when(F.col("cut"), 3).otherwise(0)
    both = placed.select("c", "t", "slot", "h", "kind", "blank", "cut").join(again, F.col("c").eqNullSafe(F.col("c2")) & (F.col("h") == F.col("h2")), "left")
    marked = both.select("c", "t", "slot", F.substring(F.lit(_SYMBOLS), 4 * F.col("kind") + fault + 1, F.lit(1)).alias("symbol"))
    return placed, scratch.write(marked, "symbols")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", every: DataFrame | None = None) -> Repaired:
    """The report and the repaired messages of conversations.

    report (conv_col, rows, gaps, blank, duplicate, truncated, illegal, cost, audit): one row per conversation; gaps counts the turns missing between the
    least and the greatest (nulls left out), illegal the neighbours whose roles' initials aren't su, ua or au, before any edit. messages (conv_col, position,
    edit, role, text): what is left, edit being K, R or I. A null role or text is one space, so a row without text is blank; a null conversation is
    one of its own; rows of equal turn, role and text are copies. every: the conversations to report, in its conv_col, with or without rows; else those of
    rows. An empty table gives an empty report. Other columns don't matter.
    """
    scratch = Scratch(rows.sparkSession, "structure")
    plain = rows.select(F.col(conv_col).alias("c"), F.col(turn_col).cast("long").alias("t"), *(F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(y) for x, y in ((role_col, "r"), (text_col, "x"))))
    placed, marked = _marked(plain, scratch)
    pieces = marked.groupBy("c", F.floor(F.col("slot") / PIECE).alias("p")).agg(_joined(F.collect_list(F.struct("slot", "symbol")), "symbol").alias("s"))
    turns = marked.groupBy("c", "t").agg(F.count("*").alias("n"))
    parts = pieces.select("c", F.struct("p", "s").alias("piece"), F.lit(None).cast("long").alias("t"), F.lit(0).cast("long").alias("n"))
    parts = parts.unionByName(turns.select("c", F.lit(None).cast(parts.schema["piece"].dataType).alias("piece"), "t", "n"))
    if every is not None:
        parts = parts.unionByName(every.select(F.col(conv_col).alias("c")).distinct(), allowMissingColumns=True)
    wide = [F.col(x).cast("decimal(20,0)") for x in ("high", "low", "seen")]
    gaps = F.least(F.coalesce(wide[0] - wide[1] + 1 - wide[2], F.lit(0)), F.lit((1 << 63) - 1)).cast("long")
    each = parts.groupBy("c").agg(_joined(F.collect_list("piece"), "s").alias("signature"), F.max("t").alias("high"), F.min("t").alias("low"), F.count("t").alias("seen"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    each = scratch.write(each.select("c", "signature", "rows", gaps.alias("gaps")), "conversations")
    solved = scratch.write(solve_signatures(each.select("signature")), "solved")
    report = scratch.write(each.join(solved, "signature").select(F.col("c").alias(conv_col), "rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), "report")
    scratch.drop(marked, each, solved)
    heads = report.where("rows > 0").select(F.col(conv_col).alias("c"), F.lit(-1).cast("long").alias("slot"), F.lit("").alias("r"), F.col("audit").alias("x"))
    stream = heads.unionByName(placed.select("c", "slot", "r", "x")).repartition("c").sortWithinPartitions("c", "slot")
    kind = stream.schema["c"].dataType.simpleString()
    messages = stream.mapInArrow(_edited, f"c {kind}, position long, edit string, role string, text string").withColumnRenamed("c", conv_col)
    return Repaired(report, messages)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits applied to the rows that follow them; the letters left at the end of a conversation are inserted rows."""
    conv, audit, at, state, position = None, "", 0, 0, 0
    names = {"s": "system", "u": "user", "a": "assistant"}
    for batch in batches:
        out: list[tuple] = []

        def put(edit, role, text, initial):
            nonlocal state, position
            out.append((conv, position, edit, role, text))  # noqa: B023
            state, position = _NEXT[initial][state], position + 1

        def insert():
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put("I", names[_TURN[state]], "", _TURN[state])
                at += 1

        for c, slot, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if slot < 0:
                conv, audit, at, state, position = c, text, 0, 0, 0
                insert()
                continue
            letter = audit[at]
            at += 1
            if letter == "K":
                put("K", role, text, role[0])
            elif letter == "R":
                put("R", names[_TURN[state]], text, _TURN[state])
            insert()
        kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
        columns = zip(*out, strict=True) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["c", "position", "edit", "role", "text"])


def digests(repaired: Repaired, conv_col: str = "conv_id") -> DataFrame:
    """The report with repaired_sha256: of the messages' ``role:text``, joined by newlines (of nothing, where none are left)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, last = None, None, None
        for batch in batches:
            last, done = batch, []
            for c, position, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if position == 0:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                state.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            yield _pairs(batch, done)
        if state is not None:
            yield _pairs(last, [(conv, state.hexdigest())])

    messages = repaired.messages.select(F.col(conv_col).alias("c"), "position", "role", "text")
    found = messages.mapInArrow(digest, f"c {messages.schema['c'].dataType.simpleString()}, h string")
    both = repaired.report.join(found, F.col(conv_col).eqNullSafe(F.col("c")), "left")
    return both.select(*repaired.report.columns, F.coalesce("h", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _pairs(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.string())], ["c", "h"])


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Known damage to test a repair with, by crc32 of ``conv:turn`` mod 20 (a null is one space): 0 drops a row, 1 empties its text, 2 takes out its
    ``. ! ?``, 3 repeats it, 4 makes its role user; all other rows stay. Null roles and texts become one space. Columns: those four."""
    space = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in (conv_col, turn_col)))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in (role_col, text_col))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, F.lit("user")).otherwise(role)
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select(conv_col, turn_col, role.alias(role_col), text.alias(text_col), F.explode(F.array_repeat(F.lit(0), times)).alias("_copy")).drop("_copy")


def repair_damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The report of conversations after known damage, with the digest of what the repair makes of them: one row for each conversation of the input."""
    names = (conv_col, turn_col, role_col, text_col)
    every = conversations.select(conv_col)
    return digests(repair(damaged(conversations, *names), *names, every=every), conv_col)
