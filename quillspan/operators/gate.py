"""Safety gate, situation analysis and policies, from small tables of terms that the caller supplies.

Terms match whole words: no letter, digit or underscore stands next to them. Curly apostrophes count as straight ones.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import collapse, terms


def _plain(text: Column) -> Column:
    """Lower case, with straight apostrophes; only texts that have curly ones are gone through for them."""
    return F.lower(F.when(F.contains(text, F.lit("’")), F.replace(text, F.lit("’"), F.lit("'"))).otherwise(text))


def any_term(text: Column, words: list[str], patterns: list[str] | None = None) -> Column:
    """True where a term or pattern occurs; one alternation for all terms, matched only against texts that hold one of them as a substring."""
    low, out = _plain(text), None
    if words:
        names = [w.lower() for w in words]
        held = F.contains(low, F.lit(names[0]))
        for w in names[1:]:
            held = held | F.contains(low, F.lit(w))
        out = held & low.rlike(rf"(?:^|[^a-z0-9_])(?:{'|'.join(re.sub(r'([^\w\s])', r'\\\1', w) for w in names)})(?:$|[^a-z0-9_])")
    if patterns:
        other = low.rlike("|".join(f"(?:{p})" for p in patterns))
        out = other if out is None else out | other
    return F.lit(False) if out is None else out


@dataclass(frozen=True)
class Category:
    name: str
    words: list[str]
    patterns: list[str] = field(default_factory=list)


def gate(df: DataFrame, text: str, categories: list[Category]) -> DataFrame:
    """df with hits (names of the categories that match, in their order) and status ('crisis' or 'ok')."""
    names = F.array_compact(F.array(*(F.when(any_term(F.col(text), c.words, c.patterns), c.name) for c in categories)))
    return df.withColumn("hits", names).withColumn("status", F.when(F.size("hits") > 0, "crisis").otherwise("ok"))


@dataclass(frozen=True)
class Theme:
    name: str
    words: list[str]
    labels: list[str] = field(default_factory=list)
    contexts: list[str] = field(default_factory=list)
    expansions: list[str] = field(default_factory=list)


def analyse(df: DataFrame, text: str, themes: list[Theme], markers: list[str] | None = None, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """df with tokens, themes in their order, their labels, contexts and expansions (distinct, in order), and for_others."""

    def gathered(what: str) -> Column:
        parts = [F.when(F.array_contains("themes", t.name), F.array(*map(F.lit, getattr(t, what)))) for t in themes if getattr(t, what)]
        return F.array_distinct(F.flatten(F.array_compact(F.array(*parts)))) if parts else F.expr("cast(array() as array<string>)")

    out = df.withColumn("themes", F.array_compact(F.array(*(F.when(any_term(F.col(text), t.words), t.name) for t in themes))))
    out = out.withColumn("tokens", terms(F.col(text), stopwords))
    return out.withColumns({w: gathered(w) for w in ("labels", "contexts", "expansions")} | {"for_others": any_term(F.col(text), markers or [])})


# Short forms and what they stand for.
CONTRACTIONS = {
    "i'm": "I am", "i've": "I have", "i'd": "I would", "i'll": "I will", "can't": "cannot", "won't": "will not", "don't": "do not", "doesn't": "does not", "didn't": "did not",
    "isn't": "is not", "aren't": "are not", "wasn't": "was not", "weren't": "were not", "haven't": "have not", "hasn't": "has not", "hadn't": "had not", "couldn't": "could not",
    "wouldn't": "would not", "shouldn't": "should not", "it's": "it is", "that's": "that is", "there's": "there is", "we've": "we have", "we're": "we are", "they're": "they are",
    "he's": "he is", "she's": "she is", "let's": "let us",
}
# Words of the first person and of the third, in the order of their replacement; case counts.
PERSONS = {"I am": "they are", "I have": "they have", "I was": "they were", "I": "they", "my": "their", "My": "Their", "me": "them", "myself": "themselves", "mine": "theirs"}


def written_out(text: Column) -> Column:
    """Contractions written out; one that begins with a capital gives a capital. Curly apostrophes count as straight ones."""
    pieces = F.regexp_extract_all(F.translate(text, "’", "'"), F.lit(r"[A-Za-z]+'[a-z]+\b|[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    known = F.create_map(*(F.lit(x) for kv in CONTRACTIONS.items() for x in kv))

    def one(piece: Column) -> Column:
        long = F.try_element_at(known, F.lower(piece))
        first = F.substring(piece, 1, 1)
        capital = F.concat(F.upper(F.substring(long, 1, 1)), F.lower(F.substring(long, F.lit(2), F.length(long))))
        return F.when(long.isNull(), piece).when((first == F.lower(first)) | F.startswith(long, F.lit("I")), long).otherwise(capital)

    return F.array_join(F.transform(pieces, one), "")


def third_person(text: Column) -> Column:
    for first, third in PERSONS.items():
        text = F.regexp_replace(text, rf"\b{first}\b", third)
    return text


def subject(text: Column, for_others: Column, words: int = 40) -> Column:
    """The situation as a clause: contractions written out, at most words words, first letter upper, full stop; in the third person if it is for others."""
    out = written_out(collapse(text))
    parts = F.split(out, " ")
    cut = F.when(F.size(parts) > words, F.concat(F.regexp_replace(F.array_join(F.slice(parts, 1, words), " "), "[,;:]+$", ""), F.lit("..."))).otherwise(out)
    ended = F.when(cut.rlike("[.!?…]$") | (cut == ""), cut).otherwise(F.concat(cut, F.lit(".")))
    said = F.concat(F.upper(F.substring(ended, 1, 1)), F.substring(ended, F.lit(2), F.length(ended)))
    return F.when(for_others, third_person(said)).otherwise(said)


def with_policy(records: DataFrame, policy: DataFrame, default: str = "compose") -> DataFrame:
    """records with policy and reason; of several entries of an id the last by seq counts."""
    last = policy.groupBy("id").agg(F.max_by(F.struct(F.coalesce("policy", F.lit(default)).alias("policy"), "reason"), "seq").alias("p"))
    return records.join(last, "id", "left").withColumn("policy", F.coalesce("p.policy", F.lit(default))).withColumn("reason", F.col("p.reason")).drop("p")
