import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import kernel, language
from quillspan.llm.queries import op13_language_id
from quillspan.session import table


def grams(text, n=3):
    """1- to n-grams of a text as strings; a boundary is a blank."""
    out, s = Counter(), " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    for k in range(1, n + 1):
        for i in range(len(s) - k + 1):
            g = s[i : i + k]
            if g.strip() and " " not in g[1:-1]:
                out[g] += 1
    return out


def feature(gram, bits=language.BITS):
    code = [0 if c == " " else ord(c) for c in gram]
    h = len(code) + sum((c + 1) * int(p) for c, p in zip(code, language._PRIMES, strict=False))
    return int(kernel.mix(np.array([h % (1 << 64)], np.uint64))[0]) >> (64 - bits)


TEXTS = ["Hello, World", "", "123 !!", "é", "a", "ab", "Ünïcode wörds — and “quotes”", "x1y", "  the end.\n\nof it ", "日本語 text", "don't"]


@pytest.mark.parametrize("chunk", [1, 2, 5, 1 << 18])
def test_counts_equal_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(language, "CHUNK", chunk)
    monkeypatch.setattr(language, "ROWS", 4)
    data = [t.lower().encode() for t in TEXTS]
    offsets = np.cumsum([0, *map(len, data)])
    got = []
    for _, _, found, count, at in language.counted(np.frombuffer(b"".join(data), np.uint8), offsets):
        got += [dict(zip(found[a:b].tolist(), count[a:b].tolist(), strict=True)) for a, b in zip(at[:-1], at[1:], strict=True)]
    for text, found in zip(TEXTS, got, strict=True):
        want = Counter()
        for g, c in grams(text).items():
            want[feature(g)] += c
        assert found == want


def test_query_scores_equal_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    model = language.fit(table(spark, small, "documents").where(~language.held_out("doc_id")))
    got = {r.doc_id: r for r in op13_language_id(spark, small).collect()}
    assert len(got) == len(docs)
    teach = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 != 1]
    texts = dict(docs)
    df = Counter()
    for i in teach:
        df.update({feature(g) for g in grams(texts[i])})
    for f in range(1 << language.BITS):
        assert model.idf[f] == pytest.approx(math.log((1 + len(teach)) / (1 + df[f])) + 1)
    for i, text in docs:
        counts = Counter()
        for g, c in grams(text).items():
            counts[feature(g)] += c
        weight = {f: (1 + math.log(c)) * model.idf[f] for f, c in counts.items()}
        size = math.sqrt(sum(w * w for w in weight.values()))
        cosine = [sum(w * model.centroids[f, c] for f, w in weight.items()) / size for c in range(len(model.langs))]
        best = max(range(len(cosine)), key=lambda c: (round(cosine[c], 9), -c))
        assert got[i].score == pytest.approx(cosine[best], abs=2e-9)
        assert got[i].lang_pred == model.langs[best] and got[i].held_out == (i not in teach)
        assert got[i].rejected == (1 - cosine[best] > model.radius[best])


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = docs.join(language.identify_languages(docs), "doc_id").where("held_out").collect()
    assert len(rows) > 300 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.99
    assert sum(r.rejected for r in rows) / len(rows) < 0.05


def test_held_out_languages_teach_nothing(spark, small):
    docs = table(spark, small, "documents")
    other = docs.withColumn("lang", F.when(language.held_out("doc_id"), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit(None)).repartition(5)
    assert sorted(map(tuple, language.identify_languages(docs).collect())) == sorted(map(tuple, language.identify_languages(other).collect()))


def test_odd_rows(spark, odd, empty):
    taught = odd.withColumn("lang", F.when(F.col("source").isNotNull(), F.col("source")))
    rows = language.identify_languages(taught).collect()
    assert len(rows) == odd.count()
    unknown = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert {3, 4, 5, 11} <= unknown and all(r.rejected and r.score == 0 for r in rows if r.lang_pred == "und")
    assert {r.lang_pred for r in rows} <= {"s0", "s1", "und"} and all(r.held_out for r in rows if r.doc_id is None)
    untaught = language.identify_languages(odd).collect()
    assert {r.lang_pred for r in untaught} == {"und"} and len(untaught) == odd.count()
    assert language.identify_languages(empty).count() == 0


def test_clusters_and_rejection(spark):
    rows = [(i, "der hund und die katze sind im haus " * 3 + f"nr {i} ist da", "de") for i in range(40)] + [(100 + i, "the dog and the cat are in the house " * 3 + f"no {i} is there", "en") for i in range(40)]
    rows += [(200 + i, "BUY NOW CHEAP OFFERS CLICK WWW " * 4, "en") for i in range(40)]  # equal texts teach once
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.langs == sorted(model.langs) and set(model.langs) == {"de", "en"} and model.langs.count("en") >= 2
    asked = spark.createDataFrame([(1, "die katze und der hund"), (2, "cat and dog in the house"), (3, "cheap offers buy now"), (4, "日本語の文章です"), (5, "zzzzqq xxjj")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in language.identify(asked, model, reject=True).collect()}
    assert got[4] == got[5] == ("und", True)
    assert {i: r.lang_pred for r in language.identify(asked, model).collect() if (i := r.doc_id) < 4} == {1: "de", 2: "en", 3: "en"}


def test_kmeans_finds_groups():
    rng = np.random.default_rng(1)
    centres = np.eye(20)[:3]
    x = np.concatenate([c + 0.05 * rng.random((30, 20)) for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found, own = language.clusters(x, 3)
    assert len(found) == 3 and all(len(set(own[30 * g : 30 * g + 30])) == 1 for g in range(3)) and len(set(own)) == 3
    assert len(language.clusters(np.tile(x[:1], (9, 1)), 4)[0]) == 1
