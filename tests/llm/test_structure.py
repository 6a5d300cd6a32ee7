import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillspan.llm import structure
from quillspan.llm.queries import op11_structure_repair
from quillspan.session import table

SPACE = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(c, t, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(SPACE)
        if not bare:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("truncated" if bare[-1] not in ".!?" else "fine")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, audit, what is left), row by row; of lists that end in the same role the cheaper one, then the lesser, goes on."""

    def fits(made, role):
        return role[:1] in {"": "su", "s": "u", "u": "a", "a": "u"}[made[1][:1] if made else ""]

    def prune(items):
        kept = {}
        for c, a, m in items:
            k = m[1][:1] if m else ""
            if k not in kept or (c, a) < kept[k][:2]:
                kept[k] = (c, a, m)
        return list(kept.values())

    def inserts(items):
        out = list(items)
        for _ in range(2):
            items = [(c + 5, a + "I", (m, r, "")) for c, a, m in items for r in ("user", "assistant") if fits(m, r)]
            out += items
        return prune(out)

    frontier = inserts([(0, "", None)])
    for (_, _, role, text), mark in zip(rows, marks, strict=True):
        after = []
        for c, a, m in frontier:
            after.append((c + 2, a + "D", m))
            if mark in ("blank", "duplicate"):
                continue
            more = 5 if mark == "truncated" else 0
            if role and fits(m, role):
                after.append((c + more, a + "K", (m, role, text)))
            after += [(c + 1 + more, a + "R", (m, r, text)) for r in ("user", "assistant") if fits(m, r)]
        frontier = inserts(prune(after))
    cost, audit, m = min((x for x in frontier if x[2] is None or x[2][1][:1] == "a"), key=lambda x: x[:2])
    left = []
    while m:
        left.append(m[1:])
        m = m[0]
    return cost, audit, left[::-1]


def exhaustive(rows, marks):
    """(cost, audit) of the best of all lists of edits with up to two inserts at a place."""
    best = None
    for letters in itertools.product("DKR", repeat=len(rows)):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            cost, audit, roles = 5 * sum(gaps), "I" * gaps[0], ["?"] * gaps[0]
            for (_, _, role, _), mark, x, g in zip(rows, marks, letters, gaps[1:], strict=True):
                if x != "D":
                    cost += 5 * (mark == "truncated") + (1000 if mark in ("blank", "duplicate") else 0) + (x == "R")
                    roles.append(role[:1] or "-" if x == "K" else "?")
                else:
                    cost += 2
                audit += x + "I" * g
                roles += ["?"] * g
            if best is not None and (cost, audit) >= best:
                continue
            head = ["s"] if roles and roles[0] == "s" else []
            body = roles[len(head) :]
            if len(body) % 2 == 0 and all(r in ("?", "ua"[k % 2]) for k, r in enumerate(body)) and not (head and not body):
                best = (cost, audit)
    return best


def brute(rows):
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], [])
    for r in brute_damage(rows):
        by_conv[r[0]].append(r)
    out = {}
    for c, each in by_conv.items():
        each.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        marks = faults(each)
        turns = [r[1] for r in each if r[1] is not None]
        cost, audit, left = cheapest(each, marks)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(each))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (len(each), gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, digest)
    return out


COLUMNS = ["rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def got(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_brute_force(spark, small):
    rows = [tuple(r) for r in table(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got(op11_structure_repair(spark, small)) == brute(rows)


def made_up(rng, n):
    texts = ["It is so.", "Is it", "", "  \n", "No!", "Yes?  ", "well", "\xa0"]
    rows = []
    for c in range(n):
        for t in range(rng.randrange(0, 12)):
            rows.append((c, t + rng.choice([0, 0, 0, 3]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "User"]), rng.choice(texts)))
    return rows


def test_random_conversations(spark):
    rng = random.Random(11)
    rows = made_up(rng, 300)
    rows += [(None, None, None, None), (None, 3, "user", "Hello."), (None, None, "user", "Hi."), (900, None, "user", None), (901, -(1 << 63), "user", "A."), (901, (1 << 63) - 1, "assistant", "B."), (902, 1, "system", "Alone."), (903, 1, "user", "x" * 300_000 + ".")]
    rows += [(904, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(5000)]  # longer than a piece
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("slot"), F.lit(2).alias("c"), F.lit("x").alias("audit")).repartition(5)
    want = brute(rows)
    want[901] = (want[901][0], min(want[901][1], (1 << 63) - 1), *want[901][2:])
    assert got(structure.repair_damaged(df)) == want


def test_brute_force_is_the_best_of_all_lists():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(1, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["A.", "b", "", "C."])) for t in range(rng.randrange(5))]
        marks = faults(rows)
        assert cheapest(rows, marks)[:2] == exhaustive(rows, marks)


def test_trie_equals_single_signatures():
    rng = random.Random(2)
    signatures = sorted({"".join(rng.choice("ADEHILMP") for _ in range(rng.randrange(10))) for _ in range(500)})
    trie = structure._Trie()
    for s in signatures:
        trie.enter(s)
        alone = structure._Trie()
        alone.enter(s)
        assert trie.answer() == alone.answer()


def test_messages_and_empty_tables(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Why?"), (1, 2, "user", "Why?"), (1, 3, "assistant", "So."), (2, 0, "user", "Go.")]
    out = structure.repair(spark.createDataFrame(rows, SCHEMA))
    left = [(r.conv_id, r.position, r.edit, r.role, r.text) for r in out.messages.orderBy("conv_id", "position").collect()]
    assert left == [(1, 0, "K", "user", "Why?"), (1, 1, "K", "assistant", "So.")]
    assert [(r.conv_id, r.audit, r.cost) for r in out.report.orderBy("conv_id").collect()] == [(1, "DKDK", 4), (2, "D", 2)]
    empty = spark.createDataFrame([], SCHEMA)
    assert structure.repair_damaged(empty).count() == 0 and structure.repair(empty).messages.count() == 0


@pytest.mark.parametrize("size", [9_000])
def test_one_conversation_holds_most_rows(spark, size):
    df = spark.range(size).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("No. "), F.col("id").cast("string"), F.lit(".")).alias("text"))
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"No. {i}.") for i in range(size)]
    assert got(structure.repair_damaged(df)) == brute(rows)
