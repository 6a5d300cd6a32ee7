import math
import random
import re
import zlib
from collections import Counter
from fnmatch import fnmatchcase

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import decontaminate, graph, kernel, near_dup, quality_classifier, quality_rules, sharding, token_counts, url_filter
from quillspan.llm.line_dedup import dedup_lines
from quillspan.llm.mixing import mix_documents, source_targets
from quillspan.llm.queries import VOCABULARY
from quillspan.llm.quotations import link_quotations
from quillspan.plans.scratch import Scratch
from quillspan.session import table
from tests.llm import brute


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# 1 sharding


def test_shards_equal_brute_force(spark, small):
    rows = sorted(pairs(table(spark, small, "documents")))
    got = {r.doc_id: r for r in sharding.shard_documents(table(spark, small, "documents")).collect()}
    total = sum(len(t.encode()) + 1 for _, t in rows)
    below, slots = 0, [0] * 16
    for i, t in rows:
        size = len(t.encode()) + 1
        shard = min(15, (2 * below + size) * 16 // (2 * total))
        r = got[i]
        assert (r["size"], r.text_crc32, r.shard, r.slot, r.law, r.grown_shard) == (size, zlib.crc32(t.encode()), shard, slots[shard], "bytes", None)
        below, slots[shard] = below + size, slots[shard] + 1


def test_shards_of_a_hot_key_and_odd_rows(spark, odd, empty):
    hot = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("abcde").alias("text"))
    sizes = [r[1] for r in sharding.shard_documents(hot).groupBy("shard").agg(F.sum("size")).orderBy("shard").collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 6
    rows = sharding.shard_documents(odd, 3).collect()
    assert len(rows) == odd.count() and all(0 <= r.shard < 3 for r in rows)
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    carried = sharding.shard_documents(odd, 3, carry=True)
    assert carried.columns == [*odd.columns, "shard_1", "slot_1"] and carried.count() == odd.count()
    assert sorted(map(str, carried.drop("shard_1", "slot_1").collect())) == sorted(map(str, odd.collect()))
    assert sharding.shard_documents(empty).count() == 0 and sharding.shard_documents(empty, carry=True).count() == 0


def test_parts_of_shards_are_near_equal_and_tasks_hold_one(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 9000, 5).otherwise(F.col("id") * F.col("id")).alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    out = sharding.shard_documents(rows, 2).withColumn("task", F.spark_partition_id())
    parts = out.groupBy("shard", "task").agg(F.sum("size").alias("size"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.count("*").alias("n")).orderBy("shard", "a").collect()
    assert len(parts) == 4 and all(r.b - r.a + 1 == r.n for r in parts)
    sizes = [r["size"] for r in parts]
    assert abs(sizes[0] + sizes[1] - sizes[2] - sizes[3]) <= 51 and max(sizes) < 2 * min(sizes)


def test_shards_of_string_keys(spark):
    rng = random.Random(3)
    ids = [None, None, "", "é", "z", "zz", "Z", *("".join(rng.choice("abé") for _ in range(rng.randrange(9))) for _ in range(200))]
    docs = spark.createDataFrame([(i, "t" * rng.randrange(9)) for i in ids], "doc_id string, text string").repartition(5)
    rows = sorted(sharding.shard_documents(docs, 3).collect(), key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in rows] == sorted(ids, key=lambda x: (x is not None, (x or "").encode()))
    sizes = [sum(r["size"] for r in rows if r.shard == s) for s in range(3)]
    assert max(sizes) - min(sizes) <= 18


# 2 line dedup


def test_line_dedup_equals_brute_force(spark, small):
    rows = sorted(pairs(table(spark, small, "documents")))
    rng = random.Random(5)
    lines = [f"line number {i} of some." for i in range(6)] + ["", "  "]
    rows += [(10_000 + i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(14)))) for i in range(60)]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == brute.dedup(rows)


def test_line_dedup_odd_rows(odd, empty):
    rows = dedup_lines(odd).collect()
    assert len(rows) == odd.count()
    assert sorted(r.n_removed for r in rows if r.n_removed) == [4, 4, 4]  # four rows have the prose, one keeps it
    assert all(r.text is None for r in rows if r.doc_id == 3) and dedup_lines(empty).count() == 0


def test_line_dedup_of_short_documents(spark):
    texts = ["a b\nc d", "\na b\n \nc d\n", "a b", "a b", "a b\nc d\ne f", "a b\nc d\ne f", "", None, "c d\na b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.text) for r in dedup_lines(docs, short=True).collect()}
    want = {0: (0, texts[0]), 1: (2, "\n"), 2: (0, "a b"), 3: (1, ""), 4: (0, texts[4]), 5: (3, ""), 6: (0, ""), 7: (0, None), 8: (0, texts[8])}
    assert got == want


# 3 decontamination


def test_leaks_equal_brute_force(spark, small):
    docs, items = table(spark, small, "documents"), [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    base = [(i, t) for i, t in pairs(docs) if len(t) < 4000][:60]
    rng = random.Random(3)
    for k in range(60):
        w = items[k % len(items)][1].split()
        if k % 2:
            w[rng.randrange(len(w))] = "changed"
        base.append((50_000 + k, "before it stands this. " + " ".join(w) + " and after it that."))
        base.append((70_000 + k, " ".join(w[k % 7 : len(w) - k % 5])))  # shorter than the item
    items += [(900, "two words"), (901, None), (902, "")]
    base.append((60_000, "here Two  WORDS stand"))
    got = decontaminate.find_leaks(spark.createDataFrame(base, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in got.collect()}
    assert found == {k: (pytest.approx(v), s) for k, (v, s) in brute.leaks(base, [x for x in items if x[1]]).items()}
    assert len(found) > 40 and any(d >= 70_000 for d, _ in found)


def test_multi_index_meets_all_within_radius():
    rng = np.random.default_rng(1)
    index = decontaminate.Index([0], ["a b c d e f g h i j k l m n o p"], 5)
    for _ in range(200):
        bits = rng.choice(128, decontaminate.RADIUS, replace=False)
        mark = np.array([index.blocks[16][b][0] for b in range(2)])
        for b in bits:
            mark[b // 64] ^= np.uint64(1 << int(b % 64))
        assert index.near(16, mark[None])[1].tolist() == [0]


def test_multi_index_lets_few_unlike_items_through():
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(1000)]
    index = decontaminate.Index(list(range(1000)), texts, 5)
    marks = np.stack([index.blocks[40][b] for b in range(2)], axis=1)
    windows, items, looked = index.near(40, marks)
    assert set(range(1000)) == {w for w, k in zip(windows.tolist(), items.tolist(), strict=True) if w == k}
    assert len(items) < 1200 and looked < 0.01 * 1000 * 1000


@pytest.mark.parametrize("words", [30_000, 90_000])
def test_leaks_in_long_texts_take_one_path(words):
    import time

    rng = random.Random(words)
    w = [f"w{rng.randrange(3000)}" for _ in range(words)]
    item = w[words // 2 : words // 2 + 200]
    index = decontaminate.Index([5], [" ".join(item)], 5)
    hashes = decontaminate.K.words(np.frombuffer(" ".join(w).encode(), np.uint8), np.array([0, len(" ".join(w))]), True)[0]
    began = time.time()
    assert index.matches(hashes, 75) == {0: (1.0, words // 2)}
    assert time.time() - began < 2


def test_leaks_of_long_items_run_over_chunks(monkeypatch):
    rng = random.Random(9)
    w = [f"w{rng.randrange(40)}" for _ in range(700)]
    item = [*w[100:400], "changed", *w[401:600]]
    index = decontaminate.Index([5], [" ".join(item)], 5)
    hashes = decontaminate.K.words(np.frombuffer(" ".join(w).encode(), np.uint8), np.array([0, len(" ".join(w))]), True)[0]
    whole = index.matches(hashes, 75)
    monkeypatch.setattr(decontaminate, "CHUNK", 37)
    assert index.matches(hashes, 75) == whole and whole[0][1] == 100


def test_leaks_with_a_run_of_one_shingle(spark):
    rng = random.Random(8)
    items, docs = [], []
    for k in range(12):
        w = [f"w{rng.randrange(10**6)}" for _ in range(730)]
        other = w[:-100] + ["-"] * 100  # similarity over 0.75
        items.append((k, " ".join(other if k % 2 else w)))
        docs.append((k, "before it. " + " ".join(w if k % 2 else other)))
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in got.collect()}
    assert found == {k: (pytest.approx(v), s) for k, (v, s) in brute.leaks(docs, items).items()} and len(found) == 12


def test_window_sums_count_occurrences():
    rng = np.random.default_rng(3)
    for n, kinds, windows in ((60, 4, 9), (60, 1, 20), (50, 1000, 7), (30, 3, 30), (40, 5, 1)):
        x = rng.integers(0, 1 << 63, kinds, dtype=np.uint64)[rng.integers(0, kinds, n)]
        for at in (np.arange(n - windows + 1), np.arange(n - windows + 1)[1::3]):
            if len(at):
                assert decontaminate.window_marks(x, windows, at).tolist() == [decontaminate.fingerprint(x[i : i + windows]).tolist() for i in at]


def test_leaks_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "The first line of it is here. The second line"), (2, None), (3, " ")], "item_id int, text string")
    assert sorted(str(r.doc_id) for r in decontaminate.find_leaks(odd, items).collect()) == ["1", "1", "2", "None"]
    assert decontaminate.find_leaks(empty, items).count() == 0 and decontaminate.find_leaks(odd, items.limit(0)).count() == 0


# 4 quality rules


def test_rules_by_hand(spark):
    text = "This is a good line of prose.\nHome | About | Shop | Help\nThis is a good line of prose.\nno stop here at all\nBad### of$$$ it%%% all###."
    r = quality_rules.clean_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), with_text=True).first()
    n = len(brute.words(text))
    assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (n, sum(map(len, brute.words(text))), 1, 14)
    assert (r.n_symbols, r.lost_lines, r.base_failed, r.kept) == (15, 3, True, False)
    assert r.text == "This is a good line of prose.\nThis is a good line of prose."


def test_boilerplate_phrases_are_a_parameter(spark):
    text = "Une belle phrase du matin.\nTOUS DROITS RÉSERVÉS par nous.\nBitte Hier Klicken jetzt sofort.\nMy own phrase stands here too."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    kept = lambda **k: quality_rules.clean_documents(docs, with_text=True, **k).first().text.split("\n")
    lines = text.split("\n")
    assert kept() == [lines[0], lines[3]] and kept(boilerplate={}) == lines and kept(boilerplate={"x": ("OWN phrase",)}) == lines[:3]


def test_rules_odd_rows(odd, empty):
    rows = quality_rules.clean_documents(odd, with_text=True).collect()
    assert len(rows) == odd.count() and quality_rules.clean_documents(empty).count() == 0
    for r in rows:
        assert r.kept is False or not r.base_failed
        if r.text is None or not r.text.strip():
            assert r.n_words <= 40_001
    assert [r.kept for r in rows if r.doc_id == 2] == [True] and [r.n_words for r in rows if r.doc_id == 8] == [40_001]


# 5 token counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens_equal_brute_force(spark, small, rule):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = table(spark, small, "documents").limit(40)
    got = {}
    for r in token_counts.count_tokens(docs, VOCABULARY, rule=rule).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.begin, r.end, r.n_tokens))
    for i, text in pairs(docs):
        ends, at = [], 0
        for line in text.split("\n"):
            at += len(line.encode()) + 1
            ends.append(at)
        ends[-1] -= 1
        counts, at = [0] * len(ends), 0
        for t in enc.encode_ordinary(text):
            owners = [next(k for k, e in enumerate(ends) if b < e) for b in range(at, at + len(enc.decode_single_token_bytes(t)))]
            at += len(owners)
            counts[owners[0] if rule == "first" else owners[-1] if rule == "last" else max(owners, key=lambda o: (owners.count(o), -o))] += 1
        rows = sorted(got[i])
        assert [r[3] for r in rows] == counts and "".join(text[a:b] for _, a, b, _ in rows) == text


def test_boundary_rules():
    sizes, ends = np.array([2, 3, 1]), np.array([3, 4, 6])
    assert token_counts.attribute(sizes, ends, "first").tolist() == [2, 0, 1]
    assert token_counts.attribute(sizes, ends, "last").tolist() == [1, 0, 2]
    assert token_counts.attribute(sizes, ends, "most").tolist() == [2, 0, 1]


def test_tokens_odd_rows_and_pieces(odd, empty, monkeypatch):
    whole = token_counts.count_tokens(odd, VOCABULARY).groupBy("doc_id").agg(F.sum("n_tokens")).collect()
    assert 3 not in {r[0] for r in whole} and token_counts.count_tokens(empty, VOCABULARY).count() == 0
    text = "ab cd.\nEf gh.\n\n x y\n z.\nlast one here.\n" * 50
    own = np.frombuffer(text.encode(), np.uint8)
    monkeypatch.setattr(token_counts, "PIECE", 64)
    parts = list(token_counts._pieces(own))
    assert "".join(parts) == text and len(parts) > 10


def encoder():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_cut_texts_have_the_tokens_of_whole_ones(spark, small, monkeypatch):
    enc, rng = encoder(), random.Random(2)
    texts = [t for _, t in pairs(table(spark, small, "documents"))][:60]
    texts += ["".join(rng.choice("ab.\n\t \r'sé—1") for _ in range(3000)) for _ in range(40)]
    monkeypatch.setattr(token_counts, "PIECE", 50)
    cut = 0
    for t in texts:
        parts = list(token_counts._pieces(np.frombuffer(t.encode(), np.uint8)))
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t)
        cut += len(parts) - 1
    assert cut > 500


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens_of_fields(spark, rule):
    enc, rng = encoder(), random.Random(7)
    texts = {i: "".join(rng.choice(["the ", "é", "water", " of", "\n", "1", ". "]) for _ in range(80)) for i in range(30)} | {50: "", 51: None, 52: "no spans here"}
    spans = []
    for i in range(30):
        cuts = sorted(rng.sample(range(len(texts[i]) + 20), 6))
        spans += [(i, "title", cuts[0], cuts[1]), (i, "body", cuts[1], cuts[2]), (i, "title", cuts[4], cuts[5])]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("field", F.lit("x")).withColumn("spans", F.lit(1))
    table_ = spark.createDataFrame([*spans, (99, "x", 0, 5), (None, "x", 0, 5), (52, "x", None, 5), (50, "empty", 0, 0)], "doc_id long, field string, begin int, end int")
    got = {}
    for r in token_counts.count_tokens(docs, VOCABULARY, rule=rule, spans=table_).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.field, r.begin, r.end, r.n_tokens)
    for i in range(30):
        text, own = texts[i], [s for s in spans if s[0] == i]
        owner = [len(own)] * len(text)
        for k, (_, _, a, b) in enumerate(own):
            owner[a:b] = [k] * (min(b, len(text)) - min(a, len(text)))
        piece = [0] * len(text)  # runs of one owner: two gaps are two runs
        for c in range(1, len(text)):
            piece[c] = piece[c - 1] + (owner[c] != owner[c - 1])
        of_byte = [(owner[c], piece[c]) for c in range(len(text)) for _ in text[c].encode()]
        want, at = [0] * (len(own) + 1), 0
        for t in enc.encode_ordinary(text):
            part = of_byte[at : at + len(enc.decode_single_token_bytes(t))]
            at += len(part)
            most = max(dict.fromkeys(part), key=lambda o: (part.count(o), -part.index(o)))
            want[(part[0] if rule == "first" else part[-1] if rule == "last" else most)[0]] += 1
        assert [got[i][k][3] for k in range(len(own) + 1)] == want
        assert [got[i][k][:3] for k in range(len(own))] == [(f, min(a, len(text)), min(b, len(text))) for _, f, a, b in own]
    assert got[50] == {0: ("empty", 0, 0, 0)} and 51 not in got and got[52] == {0: (None, None, None, len(enc.encode_ordinary(texts[52])))} and 99 not in got
    for bad in ([(1, "a", 0, 5), (1, "b", 4, 6)], [(1, "a", 5, 4)], [(1, "a", -1, 4)]):
        with pytest.raises(ValueError, match="overlap"):
            token_counts.count_tokens(docs, VOCABULARY, spans=spark.createDataFrame(bad, table_.schema))


# 6 classifier


def test_classifier_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    out = quality_classifier.classify_quality(docs, labels)
    for r in out.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = out.where("held_out").join(labels, "doc_id").collect()
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r.predicted for r in held if r.quality]) > 0.98


def plain_ftrl(rows, bits, epochs, alpha, beta, l1, l2):
    """One coordinate at a time, in dictionaries."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for y, f, v in rows:
            x = [*zip(f, v), ("bias", 1.0)]
            w = {i: weight(i) for i, _ in x}
            p = 1 / (1 + math.exp(-sum(w[i] * xi for i, xi in x)))
            for i, xi in x:
                g = (p - y) * xi
                s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i], n[i] = z.get(i, 0.0) + g - s * w[i], n.get(i, 0.0) + g * g
    return [weight(i) for i in range(1 << bits)], weight("bias")


def plain_features(text, bits):
    """Tokens and neighbours by a regular expression, hashed one by one."""
    kinds = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+|([\x00-\x08\x0e-\x1f])[\x00-\x08\x0e-\x1f]*|([!-/:-@\[-`{-\x7f])\2*")
    tokens = [m[0].encode() for m in kinds.finditer(text)]
    hashes = [int(kernel.words(np.frombuffer(t, np.uint8), np.array([0, len(t)]), True)[0][0]) for t in tokens]
    pairs = [int(kernel.shingles(np.array(p, np.uint64), np.array([0, 2]), 2)[0][0]) for p in zip(hashes, hashes[1:])]
    count = Counter(h >> (64 - bits) for h in hashes + pairs)
    norm = math.sqrt(sum(c * c for c in count.values()))
    return {f: c / norm for f, c in count.items()}


def test_features_and_training_equal_plain_ones(spark, small):
    texts = [t for _, t in pairs(table(spark, small, "documents")) if len(t) < 2500][:40] + ["A--B!! é1 x\ty", "..."]
    rows = []
    for k, t in enumerate(texts):
        data = t.encode()
        f, v, _ = quality_classifier.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 12)
        assert dict(zip(f.tolist(), v.tolist(), strict=True)) == pytest.approx(plain_features(t, 12))
        rows.append((k % 3 // 2, f.astype(np.int32), v.astype(np.float32)))
    w, bias = quality_classifier.train(rows, 12, 3, 0.6, 1.0, 0.002, 0.1)
    want, want_bias = plain_ftrl([(y, f.tolist(), v.tolist()) for y, f, v in rows], 12, 3, 0.6, 1.0, 0.002, 0.1)
    assert w.tolist() == pytest.approx(want, abs=1e-5) and bias == pytest.approx(want_bias) and np.count_nonzero(w) > 100
    t = texts[3].encode()
    docs = spark.createDataFrame([(1, texts[3]), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, (w, bias)).collect()}
    dot = sum(w[f] * v for f, v in plain_features(texts[3], 12).items())
    assert got == {1: pytest.approx(1 / (1 + math.exp(-dot - bias)), abs=1e-5), 2: pytest.approx(1 / (1 + math.exp(-bias)))}


def test_training_sample_is_of_labelled_documents(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "$$$ bad ###") for i in range(0, 400, 10)] + [(10**6, "good words here"), (10**6, "$$$")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, (i // 10) % 2) for i in range(400)] + [(10**6, 1)], "doc_id long, quality int")
    for r in (10, 41):  # labels without a document are nine of ten and don't use up the rows
        w, bias = quality_classifier.fit(docs, labels, max_rows=r, bits=8)
        assert np.any(w)
    few = quality_classifier.fit(docs, labels, bits=8, max_features=20)
    assert np.any(few[0]) and not np.array_equal(few[0], w) and not np.any(quality_classifier.fit(docs, labels, bits=8, max_features=1)[0])
    assert np.array_equal(quality_classifier.fit(docs.repartition(9), labels.repartition(3), bits=8)[0], quality_classifier.fit(docs, labels, bits=8)[0])


def test_classifier_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (9, None)], "doc_id long, quality int")
    rows = quality_classifier.classify_quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality_classifier.classify_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify_quality(empty, labels).count() == 0


# 7 near duplicates


def test_groups_equal_brute_force(spark, small):
    rng = random.Random(11)
    rows = [(i, t) for i, t in pairs(table(spark, small, "documents"))]
    base = [f"word{rng.randrange(5000)}" for _ in range(120)]
    for k in range(150):  # one group whose members differ in a few places, some too much
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((20_000 + k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near_dup.near_dup_groups(docs).collect()
    truth = brute.groups(rows)
    assert {r.doc_id: r.component_id for r in near_dup.near_dup_groups(docs, bands=64, band_rows=5, every_candidate=True).collect()} == truth
    assert {r.doc_id: r.component_id for r in got} == truth
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(set(brute.shingles(t))) for i, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_groups_odd_rows(spark, odd, empty):
    rows = near_dup.near_dup_groups(odd).collect()
    assert len(rows) == odd.count() and near_dup.near_dup_groups(empty).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    assert by[None] == {(None, True)} and by[1] == {(1, True)} and by[2] == {(1, False)} and by[8] == {(7, False)}
    # id 9 has two texts, one of them in a group with 10
    assert by[10] == {(9, False)} and by[9] == {(9, True)} and by[3] == {(3, True)} and by[4] == {(4, True)}


def test_groups_of_string_ids(spark):
    a, b = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))
    rows = [("é", a), ("b", a + " end"), ("c", b), ("ca", b), (None, a), (None, None), ("", "alone here"), ("d", ""), ("b", b)]
    got = near_dup.near_dup_groups(spark.createDataFrame(rows, "doc_id string, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == sorted([("é", "b", False), ("b", "b", True), ("b", "b", True), ("c", "b", False), ("ca", "b", False), ("None", "None", True), ("None", "None", True), ("", "", True), ("d", "d", True)])


def test_signature_sizes(spark):
    with pytest.raises(ValueError, match="multiple of 16"):
        near_dup.near_dup_groups(spark.createDataFrame([], "doc_id long, text string"), bands=51, band_rows=6)
    x = np.random.default_rng(1).integers(0, 1 << 63, 4000, dtype=np.uint64)
    assert (near_dup.superminhash(x, np.array([0, len(x)]), 512) < np.iinfo(np.uint64).max).all()


def test_groups_of_ids_with_unlike_texts(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**7)}"
    rows = []
    for k in range(16):  # 3k is near to 3k + 2 but not enough, 3k + 1 is enough and has another text too
        base = [word() for _ in range(204)]
        less, more = list(base), list(base)
        for i in range(6):
            less[10 + 30 * i] = word()
        for i in range(5):
            more[25 + 30 * i] = word()
        rows += [(3 * k, " ".join(less)), (3 * k + 1, " ".join(more)), (3 * k + 1, " ".join(word() for _ in range(500))), (3 * k + 2, " ".join(base))]
    got = near_dup.near_dup_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute.groups(rows)


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for shared, size in ((0, 40), (75, 100), (400, 500), (3, 4)):
        a, b = values[:size], np.concatenate([values[:shared], values[1000 : 1000 + size - shared]])
        sig = near_dup.superminhash(np.concatenate([a, b]), np.array([0, size, 2 * size]), 256)
        assert abs((sig[0] == sig[1]).mean() - shared / (2 * size - shared)) < 0.12
        assert (near_dup.superminhash(b, np.array([0, size]), 256)[0] == sig[1]).all()


@pytest.fixture
def plain_plans(spark):
    """Without AQE, so that partitions stay as many as they are."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_components_of_long_chains_take_few_rounds(spark, plain_plans, monkeypatch):
    def chain(first, n, mixed=True):
        ids = list(range(first, first + n))
        if mixed:
            random.Random(n).shuffle(ids)
        return list(zip(ids, ids[1:]))

    links = [*chain(0, 1000), *chain(20_000, 10_000), *chain(50_000, 1500, mixed=False), (90_001, 90_000), (5, 5)]
    random.Random(1).shuffle(links)
    links = spark.createDataFrame([*links, (None, 7), (8, None)], "a long, b long").repartition(64)
    want = {i: first for first, n in ((0, 1000), (20_000, 10_000), (50_000, 1500), (90_000, 2)) for i in range(first, first + n)}
    rounds, one_round = [], graph._roots
    monkeypatch.setattr(graph, "_roots", lambda *a: rounds.append(1) or one_round(*a))
    got = {r.node: r.label for r in graph.components(links, Scratch(spark, "test"), at_once=0).collect()}
    assert got == want and 1 < len(rounds) <= 20
    assert {r.node: r.label for r in graph.components(links, Scratch(spark, "test")).collect()} == want
    monkeypatch.setattr(graph, "HELD", 10)
    assert {r.node: r.label for r in graph.components(links.where("a < 2000"), Scratch(spark, "test"), at_once=100).collect()} == {k: v for k, v in want.items() if k < 2000}
    assert graph.components(links.limit(0), Scratch(spark, "test")).count() == 0


# 8 quotations


def test_quotations(spark):
    rows = [
        (1, 0, "user", "How does it  work?\nPlease say."),
        (1, 1, "assistant", "> how does it work?\nIt works well."),
        (1, 2, "user", "> > How does it work?\n> It works well.\nThanks to you."),
        (1, 3, "assistant", ">> unknown words\nStill here."),
        (2, 0, "user", "It works well."),
        (2, 1, "user", None),
        (None, 0, "user", "> It works well."),
        (None, None, "user", ""),
    ]
    out = link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.turn): r for r in out.collect()}
    assert [got[1, t].parent for t in range(4)] == [None, 0, 1, None]
    assert [got[1, t].n_quotes for t in range(4)] == [0, 1, 2, 1] and [got[1, t].depth for t in range(4)] == [0, 1, 2, 2]
    assert [got[1, t].text for t in range(4)] == ["How does it  work?\nPlease say.", "It works well.", "Thanks to you.", "Still here."]
    assert [got[1, t].position for t in range(4)] == [0, 1, 2, 3] and got[2, 1].text is None
    assert got[None, 0].parent is None and got[None, 0].position == 1 and got[None, None].position == 0
    assert link_quotations(out.select("conv_id", "turn", "role", "text").limit(0)).count() == 0


def test_threads_of_replies(spark):
    rows = [(1, 0, "user", "What is the first thing to do?"), (1, 1, "user", "And who is to do the second?"), (1, 2, "assistant", "> What is the first thing to do?\nRead what it says there."), (1, 3, "assistant", "> And who is to do the second?\nYou are the one to.")]
    rows += [(1, 4 + k, "user", f"> {'Read what it says there.' if k % 2 == 0 else 'You are the one to.'}\nRemark {k} goes here.") for k in range(4)]
    rows += [(2, k, "user", (f"> Message {k - 1} says a thing here.\n" if k else "") + f"Message {k} says a thing here.") for k in range(40)]
    rows += [(3, 0, "user", "Both of them are the first."), (3, 1, "user", "> Both of them are the first.\nOne answer of two."), (3, 1, "user", "One more of the same turn."), (3, 2, "user", "> One more of the same turn.\nThis follows the other.")]
    out = link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.conv_id, r.position)):
        got.setdefault(r.conv_id, []).append((r.turn, r.parent, r.thread))
    assert got[1] == [(0, None, 0), (2, 0, 0), (4, 2, 0), (6, 2, 0), (1, None, 1), (3, 1, 1), (5, 3, 1), (7, 3, 1)]
    assert got[2] == [(k, k - 1 if k else None, 0) for k in range(40)]
    assert got[3] == [(0, None, 0), (1, 0, 0), (2, 1, 0), (1, None, 1)]  # the first message of a turn stands for it


def test_quotation_odd_rows(spark):
    long = "\n".join(f"Line {i} of a very long message." for i in range(4000))
    rows = [(1, 0, "user", long), (1, 0, "user", long), (1, 1, "assistant", "> Line 3999 of a very long message.\nYes."), (1, 1, "assistant", "> Line 3999 of a very long message.\nYes."), (1, 2, "user", "> " + long.replace("\n", "\n> ")), (None, None, None, None), (2, None, "user", "> \n>> \n\t\n"), (2, 5, "", ""), (2, 5, "", "")]
    names = "conv_id long, turn long, role string, text string, rid int, scope int, at int, level int, part int, passage int, position int, thread int, parent int, h int, n int, _s int"
    df = spark.createDataFrame([(*r, *([7] * 12)) for r in rows], names).repartition(3)
    out = link_quotations(df).collect()
    got = sorted((str(r.conv_id), str(r.turn), r.n_quotes, str(r.parent), r.depth, str(r.thread)) for r in out)
    want = [("1", "0", 0, "None", 0, "0")] * 2 + [("1", "1", 1, "0", 1, "0")] * 2 + [("1", "2", 1, "0", 1, "0"), ("2", "5", 0, "None", 0, "5"), ("2", "5", 0, "None", 0, "5"), ("2", "None", 0, "None", 0, "None"), ("None", "None", 0, "None", 0, "None")]
    assert got == want
    for c in (1, 2, None):
        assert sorted(r.position for r in out if r.conv_id == c) == list(range(sum(r[0] == c for r in rows)))


def test_partial_and_wrapped_quotations(spark):
    whole = "First of all, hello there.\nHow are you?\n\nThe second paragraph has many\nwords on each of its lines\nand ends here.\n\nyes\nno\nBye for now."
    quotes = [
        "> The second paragraph has many\n> words on each of its lines\n> and ends here.",  # a paragraph
        "> words on each of its lines\n> and ends here.",  # two lines
        "> The second paragraph has many words on\n> each of its lines and ends here.",  # wrapped anew
        "> paragraph has many words on each",  # inside of lines
        "> yes\n> no",  # short lines
        "> How are you?\n>\n> The second paragraph has many",  # over a blank line
        "> The second paragraph has many others",  # not there
        "> are you",  # short and no whole line
        "> and ends here. yes yes",
    ]
    rows = [(1, 0, "user", "Another thing to say here first."), (1, 1, "user", whole), (1, 2, "user", whole + "\nmore")]
    rows += [(1, 3 + k, "assistant", q + "\nFine.") for k, q in enumerate(quotes)]
    rows += [(None, t, r, x) for _, t, r, x in rows] + [(2, 9, "user", quotes[0])]
    out = link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.turn): r.parent for r in out.collect()}
    for c in (1, None):
        assert [got[c, 3 + k] for k in range(len(quotes))] == [1] * 6 + [None] * 3
    assert got[2, 9] is None and len(got) == len(rows)


# 9 mixing


def water_filling(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), sum(sizes.values())
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 3 * sizes[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3 * sizes[s]
            left -= target[s]
        free -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 100, "c": 1000, None: 5}, {"a": 100}, {"x": 1, "y": 10**6, "z": 7, "zz": 0}, {"a": 50, "b": 50, "c": 50, "d": 50}])
def test_targets_equal_resharing(spark, sizes):
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), Scratch(spark, "test")).collect()}
    assert got == pytest.approx(water_filling(sizes))


def test_mix_meets_targets(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = mix_documents(docs).collect()
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r)
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
    for (_, target), group in by.items():
        assert abs(sum(r.taken for r in group) - target) <= 0.005 * target + 3
    again = mix_documents(docs.repartition(7)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in rows}


def test_rates_equal_a_plain_solution(spark, small):
    """Tilts by bisection on the dual's slope, one source after the other, in plain Python."""
    docs = table(spark, small, "documents")
    sizes = {}
    for r in docs.select("source", "text").collect():
        sizes.setdefault(r.source, []).append(len(brute.words(r.text, False)))
    target = water_filling({s: sum(x) for s, x in sizes.items()})
    rate = lambda t, x: 3 / (1 + 2 * math.exp(-max(-500, min(500, t * x))))
    tilt = {}
    for s, x in sizes.items():
        mean, lo, hi = sum(x) / len(x), -600.0, 600.0
        for _ in range(200):
            t = (lo + hi) / 2
            lo, hi = (lo, t) if sum(n * rate(t, n / mean) for n in x) > target[s] else (t, hi)
        tilt[s] = (lo, mean, target[s] >= 3 * sum(x))
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in mix_documents(docs).collect():
        t, mean, full = tilt[source[r.doc_id]]
        want = 1 if not r["size"] else 3 if full else rate(t, r["size"] / mean)
        assert r.rate == pytest.approx(want, abs=2e-5 * (1 + r["size"] / mean))
        assert math.floor(r.rate) <= r.copies <= math.ceil(r.rate)


def test_mix_odd_rows(spark, odd, empty):
    rows = mix_documents(odd).collect()
    assert len(rows) == odd.count() and mix_documents(empty).count() == 0
    carried = mix_documents(odd, carry=True)
    assert carried.columns == odd.columns and carried.count() == sum(r.copies for r in rows)
    hot = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") < 1000, "a").when(F.col("id") < 2000, "b").otherwise("c").alias("source"))
    for r in mix_documents(hot).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) < 0.1 * r.target


# 10 URL filter


def test_automaton_equals_fnmatch(monkeypatch):
    rng = random.Random(4)
    globs = ["*", "a*b", "?", "ab?*c", "*aab", "", "**a", *("".join(rng.choice("ab*?") for _ in range(rng.randrange(1, 12))) for _ in range(60))]
    urls = ["", *("".join(rng.choice("ab") for _ in range(rng.randrange(15))) for _ in range(300))]
    want = [[fnmatchcase(u, g) for g in globs] for u in urls]
    data, offsets = np.frombuffer("".join(urls).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(u) for u in urls])])
    machine = url_filter.Automaton.of([g.encode() for g in globs])
    assert machine.run(data, offsets).tolist() == want
    for bytes_, few in ((1, 8), (500, 0), (5000, 100)):  # one URL a block, all in steps, all alone
        monkeypatch.setattr(url_filter, "STATE_BYTES", bytes_)
        monkeypatch.setattr(url_filter, "FEW", few)
        assert machine.run(data, offsets).tolist() == want


def test_long_url_is_quick(spark):
    import time

    machine = url_filter.Automaton.of([*(b.encode() for b in url_filter.BLOCKED), b"*x?y*\x00*z"])
    text = b"host\x00/" + b"ab" * 500_000 + b"z"
    began = time.time()
    assert machine.run(np.frombuffer(text, np.uint8), np.array([0, len(text)])).tolist() == [[False] * 8]
    assert time.time() - began < 1


def test_url_odd_rows(spark):
    urls = [None, "", "://", "http://", "http://A.com/x", "http://A.com/x", "a://b\x00c.com/\x00.exe", "http://é.NET/es/ü", "x://spam?.zip", "http://h.org/a.zip#b", "http://h.org/a\nb.exe"]
    rows = [(k // 2, u, "s", 1, "n", "whole", True) for k, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string, n int, rule string, whole string, listed boolean").repartition(3)
    got = sorted(tuple(r)[1:] for r in url_filter.filter_urls(df).collect())
    want = [("", "", None, "block")] * 4 + [("a.com", "/x", "com/", "allow")] * 2
    want += [("b\x00c.com", "/\x00.exe", "com/", "allow"), ("é.net", "/es/ü", "net/es/", "block"), ("spam", "", None, "block"), ("h.org", "/a.zip", None, "block"), ("h.org", "/a\nb.exe", None, "block")]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert [r.verdict for r in url_filter.filter_urls(df.where("url = 'http://A.com/x'"), rules=(), blocked=()).collect()] == ["allow"] * 2


def test_url_rules(spark):
    cases = {
        "http://Example.COM/en/1?x#y": ("example.com", "/en/1", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://a.www.example.com/en": ("a.www.example.com", "/en", "com/", "allow"),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://x.net/es/a": ("x.net", "/es/a", "net/es/", "block"),
        "http://x.org/net/es/a": ("x.org", "/net/es/a", None, "allow"),
        "http://spam.org/": ("spam.org", "/", None, "block"),
        "http://a.com": ("a.com", "", None, "allow"),
        "no url": ("", "", None, "block"),
        None: ("", "", None, "block"),
        "http://x.org/" + "a" * 100_000: ("x.org", "/" + "a" * 100_000, None, "allow"),
    }
    df = spark.createDataFrame([(k, u, "h", "x") for k, u in enumerate(cases)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert list(got[k] for k in range(len(cases))) == list(cases.values())
    assert url_filter.filter_urls(df.limit(0)).count() == 0


# kernel


def test_kernel_words_over_segment_bounds(monkeypatch):
    import pyarrow as pa

    text = "ab " * 50 + "c" * 500 + " d\n" + "é " * 30
    whole = [kernel.words(d, o, True)[0].tolist() for _, _, d, o in kernel.blocks(pa.array([text, None, text]))]
    monkeypatch.setattr(kernel, "SEGMENT", 16)
    cut = [kernel.words(d, o, True)[0].tolist() for _, _, d, o in kernel.blocks(pa.array([text, None, text]))]
    assert whole == cut and len(whole[0]) == 2 * len(brute.words(text))


def test_splitters_of_many_parts(spark):
    """Over a thousand parts at once: bounds are searched as an array, and the cells of a pass stay bounded."""
    rows = spark.range(30_000).select(F.xxhash64("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "600")
    try:
        got = sharding.shard_documents(rows, 300).groupBy("shard").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 300 and max(r["size"] for r in got) - min(r["size"] for r in got) <= 102 and all(r.last == r.n - 1 for r in got)


def test_bounds_searched_as_array_and_as_tree_agree(spark, monkeypatch):
    rng = random.Random(8)
    bounds = sorted({(rng.randrange(50),) if rng.random() < 0.3 else (rng.randrange(50), rng.randrange(5)) for _ in range(60)}, key=lambda b: (*b, -(1 << 63)))
    keys = spark.createDataFrame([(rng.randrange(-2, 53), rng.randrange(5)) for _ in range(500)], "a long, b long")
    tree = [r[0] for r in keys.select(sharding.shard_of(["a", "b"], bounds)).collect()]
    monkeypatch.setattr(sharding, "TREE", 0)
    assert tree == [r[0] for r in keys.select(sharding.shard_of(["a", "b"], bounds)).collect()]


def test_unsettled_tilts_are_an_error(spark, small, monkeypatch):
    from quillspan.llm import mixing

    monkeypatch.setattr(mixing, "STEPS", 1)
    monkeypatch.setattr(mixing, "TOLERANCE", 0.0)
    with pytest.raises(RuntimeError, match="settled"):
        mix_documents(table(spark, small, "documents")).count()
