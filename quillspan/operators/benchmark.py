"""Known-item benchmarks: requests made of records, a grid of retrievers scored in one plan, and figures of what was composed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import scoring as S

# What a title's verb becomes in a request, tried in this order.
VERBS = (
    (r"\bPrays for\b", "is asking for"), (r"\bPrays Against\b", "is asking God to deal with"), (r"\bPrays to\b", "is speaking to"), (r"\bPrays\b", "is praying"),
    (r"\bPraises God for\b", "is thanking God for"), (r"\bPraises\b", "is praising"), (r"\bBlesses\b", "is blessing"), (r"\bThanks\b", "is thanking"),
    (r"\bConfesses\b", "is admitting"), (r"\bLaments?\b", "is grieving over"), (r"\bRepents? for\b", "is turning away from"), (r"\bAsks?\b", "is asking"),
    (r"\bIntercedes? for\b", "is pleading for"), (r"\bMakes? an Oath\b", "is swearing an oath"), (r"\bComplains? About\b", "is complaining about"),
)
NEVER_DROPPED = ("god",)
#: How deep each retriever ranks for the figures; words that a composition should have.
DEPTH, WORDS = 25, (60, 180)


def _defined(names: Column, of: dict[str, str]) -> Column:
    """The definitions of names in their order, lower-cased, without closing full stops; names without one are left out."""
    known = F.create_map(*(F.lit(x) for kv in (of or {"": ""}).items() for x in kv))
    said = F.transform(F.coalesce(names, F.expr("cast(array() as array<string>)")), lambda n: F.rtrim(F.lower(F.coalesce(F.try_element_at(known, n), F.lit(""))), F.lit(".")))
    return F.filter(said, lambda d: d != "")


def paraphrase(record_id: Column, title: Column, speaker: Column, agents: Column, labels: Column, context: Column, label_defs: dict[str, str], context_defs: dict[str, str], verbs: tuple[tuple[str, str], ...] = VERBS, never: tuple[str, ...] = NEVER_DROPPED) -> Column:
    """A request that a record should answer: its title in other words, without its speaker for about half of the ids, then what its labels and context mean."""
    for pattern, other in verbs:
        title = F.regexp_replace(title, pattern, other)
    even = F.conv(F.substring(F.sha2(record_id.cast("string"), 256), 1, 2), 16, 10).cast("int") % 2 == 0
    dropped = F.coalesce(even & (F.length(speaker) > 0) & ~F.lower(speaker).isin(*never), F.lit(False))
    someone = F.aggregate(F.coalesce(agents, F.expr("cast(array() as array<string>)")), F.replace(title, speaker, F.lit("someone")), lambda t, a: F.when(F.length(a) > 0, F.replace(t, a, F.lit("someone"))).otherwise(t))
    asked = F.rtrim(F.lower(F.when(dropped, someone).otherwise(title)), F.lit("."))
    meant = F.array_join(_defined(labels, label_defs), "; ")
    around = F.array_join(_defined(F.array(context), context_defs), "")
    return F.concat(F.array_join(F.filter(F.array(F.coalesce(asked, F.lit("")), meant, around), lambda p: p != ""), ". "), F.lit("."))


def known_items(records: DataFrame, label_defs: dict[str, str], context_defs: dict[str, str], prefix: str = "t1.", verbs: tuple[tuple[str, str], ...] = VERBS) -> tuple[DataFrame, DataFrame]:
    """Requests (query_id, tier, text, gold) and judgements (query_id, doc_id, grade 2) from records (id, title, speaker, agents, labels, context), one each."""
    number = F.element_at(F.split(F.col("id").cast("string"), r"\."), -1)
    asked = records.select(F.concat(F.lit(prefix), number).alias("query_id"), F.lit(1).alias("tier"), paraphrase(*map(F.col, ("id", "title", "speaker", "agents", "labels", "context")), label_defs, context_defs, verbs).alias("text"), F.col("id").alias("gold"))
    return asked, asked.select("query_id", F.col("gold").alias("doc_id"), F.lit(2).alias("grade"))


def grid(runs: dict[str, DataFrame], qrels: DataFrame, labels: DataFrame, gold: DataFrame, flagged: DataFrame | None = None, at: tuple[int, ...] = (1, 5, 10), depth: int = DEPTH) -> DataFrame:
    """A row a run (run, n, recall_<k>, mrr, ndcg_10, label_precision_5, flagged_5): means over all judged queries, 0 where a run found nothing.

    runs: ranked lists (query_id, doc_id, rank) by name, of which the first depth count: a retriever's own ranking, before anything is composed or dropped.
    qrels: query_id, doc_id, grade. labels: doc_id, labels. gold: query_id, doc_id of the record a query was made of. flagged: doc_ids whose share is reported.
    All runs are scored in one plan.
    """
    every = None
    for name, ranked in runs.items():
        one = ranked.where(F.col("rank") <= depth).select(F.lit(name).alias("run"), "query_id", "doc_id", "rank")
        every = one if every is None else every.unionByName(one)
    judged = qrels.where("grade > 0")
    best = F.sort_array(F.collect_list(F.col("grade").cast("int")), asc=False)
    ideal = judged.groupBy("query_id").agg(F.count("*").alias("n_rel"), best.alias("g")).select("query_id", "n_rel", F.aggregate(F.transform(F.slice("g", 1, 10), lambda g, i: S.gain(g) / S.discount(i + 1)), F.lit(0.0), lambda s, x: s + x).alias("ideal"))
    asked = qrels.select("query_id").distinct().join(ideal, "query_id", "left").withColumn("run", F.explode(F.array(*map(F.lit, runs))))
    found = [F.count_if(F.col("rank") <= k).alias(f"f{k}") for k in at]
    hit = every.join(judged, ["query_id", "doc_id"]).groupBy("run", "query_id").agg(*found, F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= 10, S.gain(F.col("grade")) / S.discount(F.col("rank")))).alias("dcg"))
    of_gold = gold.join(labels, "doc_id").select("query_id", F.col("labels").alias("_g"))
    top = every.where("rank <= 5").join(of_gold, "query_id", "left").join(labels.select("doc_id", F.col("labels").alias("_l")), "doc_id", "left")
    flag = F.lit(None).cast("boolean")
    if flagged is not None:
        top = top.join(flagged.select("doc_id", F.lit(True).alias("_f")).distinct(), "doc_id", "left")
        flag = F.coalesce("_f", F.lit(False))
    top = top.groupBy("run", "query_id").agg(F.avg(F.coalesce(F.arrays_overlap("_g", "_l"), F.lit(False)).cast("double")).alias("label_precision_5"), F.avg(flag.cast("double")).alias("flagged_5"))
    each = asked.join(hit, ["run", "query_id"], "left").join(top, ["run", "query_id"], "left")
    zero = lambda c: F.avg(F.coalesce(c, F.lit(0.0)))
    return each.groupBy("run").agg(
        F.count("*").alias("n"), *(zero(F.try_divide(F.col(f"f{k}"), F.col("n_rel"))).alias(f"recall_{k}") for k in at), zero(1 / F.col("first")).alias("mrr"),
        zero(F.try_divide(F.col("dcg"), F.col("ideal"))).alias("ndcg_10"), zero(F.col("label_precision_5")).alias("label_precision_5"), (zero(F.col("flagged_5")) if flagged is not None else F.lit(None).cast("double")).alias("flagged_5"),
    )


def syllables(word: Column) -> Column:
    """Runs of vowels, less a silent e at the end (not that of -le), and one at least."""
    runs = F.regexp_count(word, F.lit("[aeiouy]+"))
    silent = word.rlike("[^aeiouyl]e$") & (runs > 1)
    return F.greatest(F.lit(1), runs - silent.cast("int"))


def reading_grade(text: Column) -> Column:
    """The Flesch-Kincaid grade, 0.39 words / sentences + 11.8 syllables / words - 15.59, over runs of a-z and apostrophes with a letter; null without words.

    Sentences are runs that end in ``. ! ?`` and hold a word, what follows the last of those included.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(r"'*[a-z][a-z']*"), F.lit(0))
    sentences = F.size(F.filter(F.split(F.lower(text), r"[.!?]+"), lambda s: s.rlike("[a-z]")))
    spoken = F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + syllables(w))
    return F.when(F.size(words) > 0, 0.39 * F.size(words) / sentences + 11.8 * spoken / F.size(words) - 15.59)


def composition_rates(suggestions: DataFrame, passages: DataFrame, by: tuple[str, ...] = ("run",), words: tuple[int, int] = WORDS) -> DataFrame:
    """A row for each by: explain_only, n (composed), and of those the shares verbatim, citation, complete, words_in_range and fallback, the median of words
    and of the reading grade, and the retries in all.

    suggestions: by, doc_id, movements (a struct with anchor; null: instructions only), anchor_osis, spoken, word_count, fallback_used, and retry_count if there is
    one. passages: doc_id (unique), text, osis (an array of the verses' places). Shares of nothing are null.
    """
    made = F.col("movements").isNotNull()
    both = suggestions.join(passages.select("doc_id", F.col("text").alias("_text"), F.col("osis").alias("_osis")), "doc_id", "left")
    anchor = F.col("movements.anchor")
    complete = F.lit(True)
    for name in suggestions.schema["movements"].dataType.names:
        complete = complete & (F.length(F.col(f"movements.{name}")) > 0)
    flags = {
        "verbatim": F.contains("_text", anchor), "citation": F.array_contains("_osis", F.col("anchor_osis")), "complete": complete,
        "words_in_range": F.col("word_count").between(*words), "fallback": F.col("fallback_used"),
    }
    share = lambda c: F.try_divide(F.count_if(made & F.coalesce(c, F.lit(False))), F.count_if(made))
    retries = F.sum(F.when(made, F.col("retry_count"))) if "retry_count" in suggestions.columns else F.lit(0)
    return both.groupBy(*by).agg(
        F.count_if(~made).alias("explain_only"), F.count_if(made).alias("n"), *(share(c).alias(k) for k, c in flags.items()),
        F.median(F.when(made, F.col("word_count"))).alias("median_words"), F.median(F.when(made, reading_grade(F.col("spoken")))).alias("median_grade"), F.coalesce(retries, F.lit(0)).cast("long").alias("retries"),
    )
