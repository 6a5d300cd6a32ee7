import pytest

LONG = "x" * 300_000
WORDY = " ".join(f"w{i}" for i in range(40_000))
NAMES = ["doc_id", "text", "lang", "source", "n_chars", "rid", "size", "id", "shard", "slot", "score", "predicted", "label", "row", "copies", "_key", "bands", "n"]


def odd_rows():
    prose = "The first line of it is here.\nThe second line follows it.\nThe third line ends the part.\nA fourth one is alone."
    texts = [(1, prose), (1, prose), (2, prose), (3, None), (4, ""), (5, " \n\t\n "), (6, LONG), (7, WORDY), (8, WORDY + " end"), (None, prose), (None, None), (9, "one two three"), (9, "a b c d e f g h i j k."), (10, "One  TWO\tthree"), (11, "\n\n\n"), (-(1 << 63), "least key."), ((1 << 63) - 1, "greatest key.")]
    return [(i, t, None, None if k % 3 == 0 else f"s{k % 2}", None, *([k] * (len(NAMES) - 5))) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def schema():
    return "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in NAMES[5:])


@pytest.fixture(scope="session")
def odd(spark, schema):
    """Nulls, empty, wordless and very long texts, repeated rows and ids, extra columns with clashing names."""
    return spark.createDataFrame(odd_rows(), schema).repartition(3)


@pytest.fixture(scope="session")
def empty(spark, schema):
    return spark.createDataFrame([], schema)
