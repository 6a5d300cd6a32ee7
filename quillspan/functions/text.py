"""Column functions over text: tokens, slugs, snippets, sentence splits, quality score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM, WORD = r"[a-z']+", r"[a-z0-9']+"


def terms(text: Column, stopwords: tuple[str, ...] = (), least: int = 3) -> Column:
    """Index terms in order, repeats kept: lower case, letters and apostrophes, at least `least` long, no stopwords."""
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda t: F.length(t) >= least)
    return F.filter(found, lambda t: ~t.isin(*stopwords)) if stopwords else found


def words(text: Column) -> Column:
    """Words of verification: digits count, nothing is left out."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def slug(text: Column) -> Column:
    """Lower case, only letters and numbers of any script, underscores, white space and hyphens; white space becomes one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}_\s-]", ""), r"\s+", "-")


def path_slug(*parts: Column) -> Column:
    """Several labels as one slug; underscores count as spaces and hyphens don't stay at the ends."""
    joined = F.regexp_replace(F.lower(F.concat_ws("-", *parts)), r"[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(joined, r"[\s_]+", "-"), r"^-+|-+$", "")


def split_names(text: Column) -> Column:
    """A printed list of names: commas and 'and' part them."""
    return F.filter(F.transform(F.split(text, r"\s*,\s*and\s+|\s+and\s+|\s*,\s*"), F.trim), lambda x: x != "")


def english_list(items: Column) -> Column:
    """'a', 'a and b', 'a, b and c'; underscores become spaces; nothing for no items is 'prayer'."""
    clean = F.transform(items, lambda x: F.regexp_replace(x, "_", " "))
    n = F.size(clean)
    head = F.array_join(F.slice(clean, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, "prayer").when(n == 1, F.get(clean, 0)).otherwise(F.concat(head, F.lit(" and "), F.get(clean, n - 1)))


def n_words(text: Column) -> Column:
    """Words between white space; none in a null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(0))


def query_tokens(query: str) -> list[str]:
    return query.casefold().split()


def holds_all(blob: Column, tokens: list[str]) -> Column:
    """Every token is a substring of the lower-cased blob; no tokens hold everywhere."""
    out = F.lit(True)
    for t in tokens:
        out = out & F.contains(F.lower(blob), F.lit(t))
    return out


def snippet(text: Column, tokens: list[str], before: int = 46, after: int = 140) -> Column:
    """The surroundings of the first token, in token order, that occurs; the head of the text if none does."""
    at = F.lit(None).cast("int")
    for t in reversed(tokens):
        i = F.locate(t, F.lower(text))
        at = F.when(i > 0, i).otherwise(at)
    start = F.greatest(F.coalesce(at, F.lit(1)) - 1 - before, F.lit(0))
    start = F.when(at.isNull(), 0).otherwise(start)
    end = F.least(F.length(text), F.when(at.isNull(), F.lit(after)).otherwise(at - 1 + after))
    body = F.trim(F.substring(text, start + 1, end - start))
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(end < F.length(text), "…").otherwise(""))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def application_sentences(text: Column, low: int = 40, high: int = 400) -> Column:
    """Sentences of low to high characters that speak of us."""
    return F.filter(sentences(text), lambda s: F.length(s).between(low, high) & F.lower(s).rlike(r"(^|[^a-z])(we|us|our|ourselves)([^a-z]|$)"))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens; none if there are fewer."""
    # shifted slices side by side: the tokens are made once, not once a run
    shifted = F.arrays_zip(*(F.slice(tokens, i + 1, F.greatest(F.size(tokens) - n + 1, F.lit(0))).alias(f"t{i}") for i in range(n)))
    return F.transform(shifted, lambda x: F.concat_ws(" ", *(x[f"t{i}"] for i in range(n))))


def pick(seed: Column, salt: str, n: int, byte: int = 0) -> Column:
    """A stable choice in 0..n-1 from one byte of a SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat(seed, F.lit("|" + salt)), 256), 1 + 2 * byte, 2), 16, 10).cast("int") % n


def choice(options: tuple[str, ...], seed: Column, salt: str) -> Column:
    """One of options, the same for the same seed and salt; empty if there are none."""
    return F.get(F.array(*map(F.lit, options)), pick(seed, salt, len(options))) if options else F.lit("")


def rotate(items: Column, start: Column) -> Column:
    n = F.size(items)
    k = F.when(n > 0, start % F.greatest(n, F.lit(1))).otherwise(0)
    return F.concat(F.slice(items, k + 1, n), F.slice(items, F.lit(1), k))


def count_of(text: Column, piece: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)


def ocr_quality(text: Column, artifacts: tuple[str, ...] = ("|", "~", "^", "\\"), grade: Column | None = None) -> Column:
    """0 to 100: less for a share of short lines (up to 30) and for artifacts (2 each, up to 30), more for a grade; 0 under 10 characters."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    short = F.size(F.filter(lines, lambda x: F.length(F.trim(x)) < 10)) / F.greatest(F.size(lines), F.lit(1))
    bad = sum((count_of(text, a) for a in artifacts), F.lit(0.0))
    bonus = F.least(2 * grade, F.lit(20.0)) if grade is not None else F.lit(0.0)
    score = F.lit(100.0) - 30 * short - F.least(2 * bad, F.lit(30.0)) + bonus
    return F.when(F.length(text) < 10, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def read_seconds(n_words: Column, per_minute: int = 150) -> Column:
    """Reading time, rounded half to even, 1 at least."""
    return F.greatest(F.lit(1), F.bround(n_words / per_minute * 60, 0).cast("int"))
