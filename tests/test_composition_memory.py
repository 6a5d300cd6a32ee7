"""Composition and verification hold one text at a time in Python, and quoted runs are found as by brute force."""

import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspan import catalog
from quillspan.operators import compose as C
from quillspan.operators import suggest as P

N = 300
TEXTS = pa.array([f"{i} " + "quiet words without an end " * 2000 for i in range(N)])  # 16 MB


def peak_of(run):
    tracemalloc.start()
    out = run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_anchors_hold_one_text_at_a_time():
    fixed = lambda x: pa.array([x] * N)
    out, peak = peak_of(lambda: C.anchor_within.func(TEXTS, pa.array([["rest"]] * N), fixed(8), fixed(45), fixed(0)))
    assert all(TEXTS[i].as_py()[a["start"] : a["end"]] == a["text"] for i, a in enumerate(out.to_pylist()))
    assert peak < 8 << 20


def test_composers_hold_one_text_at_a_time():
    make = lambda i, text, *rest: {"movements": {"anchor": text[:9]}, "start": 0} if int(i) % 3 else 1 / 0
    fixed = lambda x: pa.array([x] * N)
    out, peak = peak_of(lambda: P.composer(make).func(pa.array(map(str, range(N))), TEXTS, *(pa.array([["a"]] * N) for _ in "abc"), fixed(False), fixed("s")))
    rows = out.to_pylist()
    assert [r["error"] for r in rows] == [None if i % 3 else "ZeroDivisionError" for i in range(N)]
    assert dict(rows[1]["movements"]) == {"anchor": TEXTS[1].as_py()[:9]} and rows[0]["movements"] is None
    assert peak < 8 << 20


@pytest.mark.parametrize("n", [1, 2, 6])
def test_quoted_runs_by_brute_force(spark, n):
    rng = random.Random(n)
    say = lambda most: rng.choice(["", "...", " "]) + "".join(rng.choice(["a", "B2", "It’s", "c-d", "ÉB", "x", "\n"]) + rng.choice([" ", ", ", "—", "\n"]) for _ in range(rng.randrange(most)))
    rows = [([rng.choice([None, say(12), say(3)]) for _ in range(rng.randrange(4))], rng.choice([None, say(60), say(200), ""])) for _ in range(300)] + [(None, "a b c"), (["a a"], "aa a")]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t array<string>, p string").select("i", C.quotes(F.col("t"), F.col("p"), n)).collect()
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    runs = lambda t: {tuple(w[i : i + n]) for w in [words(t)] for i in range(len(w) - n + 1)}
    assert dict(map(tuple, got)) == {i: any(runs(t) & runs(p) for t in own or ()) for i, (own, p) in enumerate(rows)}


def test_texts_go_to_python_once(spark, small):
    plan = catalog.queries()["q48_compose_verify"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"EvalPython", plan)) == 1, plan
