import random

import pytest

from quillspan.llm import quality_rules, queries
from quillspan.session import table
from tests.compare import same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    same(spark, small, queries.queries()[name], queries.oracle_sql()[name])


def test_quotation_sql_on_quotes(spark, tmp_path):
    rng = random.Random(12)
    rows = [(1, 0, "user", "How does it work?\nPlease say."), (1, 1, "assistant", "> how does it work?\nIt works well."), (1, 2, "user", "> > How does it  work?\n> It works well.\nThanks."), (2, 0, "user", None)]
    for conv in range(3, 60):  # messages that quote lines, runs of words and whole texts of earlier ones, re-wrapped and nested
        said: list[str] = []
        for turn in range(8):
            own = "\n".join(" ".join(rng.choice(["water", "fire", "the", "of", "stone", "a", "Yes", "no."]) for _ in range(rng.choice([1, 2, 3, 7, 12]))) for _ in range(rng.randrange(1, 5)))
            text = own
            if said and rng.random() < 0.8:
                w = rng.choice(said).split()
                a = rng.randrange(len(w))
                piece = rng.choice([rng.choice(said), " ".join(w[a : a + rng.choice([2, 5, 6, 20])]), "\n".join(rng.choice(said).split("\n")[:2]), "never said by any of them"])
                text = "\n".join(rng.choice(["> ", ">> ", ">"]) + x for x in piece.split("\n")) + rng.choice(["\n", "\n\n"]) + own
            said.append(own)
            rows.append((conv, turn, "user", text))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    df.toPandas().to_parquet(tmp_path / "conversations.parquet")
    got = queries.op8_chat_formatting(spark, str(tmp_path))
    assert got.where("parent is not null").count() > 150 and got.where("thread <> turn").count() > 150
    same(spark, str(tmp_path), queries.op8_chat_formatting, queries.oracle_sql()["op8_chat_formatting"], ["conversations"])


def test_quality_rules_sql_of_phrases_with_signs(spark, tmp_path):
    phrases = {"en": ("don't (ever) track", "c++ [beta]", "50% off"), "fr": ("s'inscrire",)}
    texts = ["It is a line of words that ends well.\nPlease DON'T (ever) track me here.\nOne more line, it ends.", "We write c++ [beta] and so on, to the end of it all.", "ccc beta is no such phrase, and this line of words stays.", "Cliquez pour s'inscrire ici, et encore des mots.\nUne autre ligne de mots qui reste ici.", "Now at 50% off, as we say in these ten words here.", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").toPandas().to_parquet(tmp_path / "documents.parquet")
    got = quality_rules.clean_documents(table(spark, str(tmp_path), "documents"), boilerplate=phrases)
    assert [r.lost_lines for r in got.orderBy("doc_id").collect()] == [1, 1, 0, 1, 1, 0, 0]
    same(spark, str(tmp_path), lambda s, d: quality_rules.clean_documents(table(s, d, "documents"), boilerplate=phrases), queries.quality_rules_sql(phrases), ["documents"])
