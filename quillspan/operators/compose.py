"""Composition of a response around a verbatim anchor, and its verification.

The choice of an anchor is iterative, so it runs as an Arrow UDF per record; everything else, the word budget too, is made of columns.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillspan.functions.text import n_words, words

MOVEMENTS = ("address", "anchor", "naming", "ask", "trust", "close")
LOW, HIGH = 60, 180

#: Ends of clauses (a sentence's, then also a phrase's) and words that mark speech to persons, of persons, and narration.
_COARSE, _FINE = re.compile(r"[.!?;:]['’”]?\s+|\n"), re.compile(r"[.!?;:,—]['’”]?\s+|\n")
_YOU = re.compile(r"\b(?:you|your|yours|thee|thy)\b", re.I)
_WE = re.compile(r"\b(?:i|me|my|mine|we|us|our)\b", re.I)
_TOLD = re.compile(r"\b(?:said|says|saying|prayed|vowed|answered|cried out|spoke|replied|stood|knelt|lifted up (?:his|her|their)|these words)\b", re.I)


def window_score(n: int, you: int, we: int, told: bool, overlap: int, aim: int = 24) -> float:
    """Speech to and of persons counts for a window of n words, narration against it, words of the query for it."""
    return 2 * min(3, you) + min(3, we) - 4 * told + 2.5 * min(4, overlap) - 0.06 * abs(n - aim)


def _clauses(text: str, start: int, end: int, cut: re.Pattern) -> list[tuple[int, int]]:
    out, at = [], start
    for m in cut.finditer(text, start, end):
        out.append((at, m.end()))
        at = m.end()
    if text[at:end].strip():
        out.append((at, end))
    return out


def speech(text: str) -> tuple[int, int]:
    a, b = text.find("“"), text.rfind("”")
    return (0, len(text)) if a < 0 else (a + 1, b if b > a else len(text))


def choose_anchor(text: str, wanted: set[str], low: int = 8, high: int = 45, after: int = 0) -> tuple[int, int] | None:
    """Start and end of the best run of clauses of low to high words; the first of equals; a word cut if none fits."""
    start, end = speech(text)
    start = max(start, after)
    if end - start < 12:
        start, end = after, len(text)
    starts = [m.start() for m in re.finditer(r"\S+", text)]

    def n_words(a: int, b: int) -> int:
        i = bisect_left(starts, a)
        within = 0 < a < len(text) and not text[a - 1].isspace() and not text[a].isspace()  # a cuts a word
        return bisect_left(starts, b) - i + within

    order = sorted(wanted)
    for cut in (_COARSE, _FINE):
        spans = _clauses(text, start, end, cut)
        facts = []
        for a, b in spans:
            piece = text[a:b]
            low_piece = piece.lower()
            facts.append((len(_YOU.findall(piece)), len(_WE.findall(piece)), bool(_TOLD.search(piece)), sum(1 << k for k, t in enumerate(order) if t in low_piece)))
        best: tuple[float, int, int] | None = None
        for i in range(len(spans)):
            you = we = held = 0
            told = False
            for j in range(i, len(spans)):
                you, we, told, held = you + facts[j][0], we + facts[j][1], told or facts[j][2], held | facts[j][3]
                n = n_words(spans[i][0], spans[j][1])
                if n > high:
                    break
                if n >= low and (s := window_score(n, you, we, told, held.bit_count())) > (best or (float("-inf"),))[0]:
                    piece = text[spans[i][0] : spans[j][1]]
                    a = spans[i][0] + len(piece) - len(piece.lstrip())
                    best = (s, a, a + len(piece.strip()))
        if best:
            return best[1], best[2]
    body = text[start:end].strip()
    if not body:
        return None
    a = text.index(body, start)
    parts = list(re.finditer(r"\S+", body))
    return a, a + parts[min(high, len(parts)) - 1].end()


ANCHOR = T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


@F.arrow_udf(ANCHOR)
def anchor_within(text: pa.Array, tokens: pa.Array, low: pa.Array, high: pa.Array, after: pa.Array) -> pa.Array:
    """The anchor of low to high words after an offset of each text, for the tokens of a query: always a slice of the text; null if it has none.

    Only one text of a batch is a Python string at a time.
    """
    rows = []
    for t, w, lo, hi, at in map(plain, zip(text, tokens, low, high, after, strict=True)):
        found = choose_anchor(t, set(w or ()), lo, hi, at) if t is not None else None
        rows.append(dict(zip(ANCHOR.names, (t[found[0] : found[1]], *found) if found else (None, None, None), strict=True)))
    return pa.array(rows, to_arrow_type(ANCHOR))


def plain(row: tuple) -> tuple:
    return tuple(x.as_py() for x in row)


def anchor(text: Column, tokens: Column, low: Column | int = 8, high: Column | int = 45, after: Column | int = 0) -> Column:
    return anchor_within(text, tokens, *(F.lit(x).cast("int") if isinstance(x, int) else x.cast("int") for x in (low, high, after)))


def spoken(movements: Column) -> Column:
    """Texts in the fixed order of movements, one a line, blanks left out."""
    each = F.array(*(F.try_element_at(movements, F.lit(m)) for m in MOVEMENTS))
    return F.array_join(F.filter(each, lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), "\n")


def quotes(texts: Column, passage: Column, n: int) -> Column:
    """Whether any run of n words of one of the texts stands in the passage; the few runs of the texts are looked for in its words."""
    held = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(passage, F.lit(""))), "[^a-z0-9]+", " "), F.lit(" "))
    once = lambda x, f: F.get(F.transform(F.array(x), f), 0)  # f of x as a variable, made once and not for every run
    said = F.filter(F.transform(texts, lambda t: words(F.coalesce(t, F.lit("")))), lambda w: F.size(w) >= n)
    run = lambda w, i: F.concat(F.lit(" "), F.array_join(F.slice(w, i, n), " "), F.lit(" "))
    within = lambda w, h: F.exists(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.contains(h, run(w, i)))
    found = once(said, lambda s: F.when(F.size(s) > 0, once(held, lambda h: F.exists(s, lambda w: within(w, h)))))
    return F.coalesce(found, F.lit(False))


def violations(movements: Column, passage: Column, osis: Column | None = None, verses: Column | None = None, n: int = 6, forbidden: str | None = None, stern: Column | None = None, address_declared: Column | None = None) -> Column:
    """Names of the rules broken: missing_<movement>, anchor_not_verbatim, citation, quotes_passage, words, harm.

    osis must be one of verses, where both are given. An address may quote the passage only where it is declared to be its own (all are if
    address_declared isn't given). forbidden is looked for in the ask of stern records (of all if stern isn't given).
    """
    get = lambda m: F.coalesce(F.try_element_at(movements, F.lit(m)), F.lit(""))
    missing = [F.when(F.trim(get(m)) == "", f"missing_{m}") for m in ("address", "anchor", "naming", "ask", "close")]
    address = F.lit("") if address_declared is None else F.when(F.coalesce(address_declared, F.lit(False)), "").otherwise(get("address"))
    quoted = quotes(F.array(address, *(get(m) for m in MOVEMENTS if m not in ("anchor", "address"))), passage, n)
    rules = [*missing, F.when(~F.contains(passage, get("anchor")), "anchor_not_verbatim"), F.when(quoted, "quotes_passage"), F.when(~n_words(spoken(movements)).between(LOW, HIGH), "words")]
    if osis is not None and verses is not None:
        rules.append(F.when(~F.coalesce(F.array_contains(verses, osis), F.lit(False)), "citation"))
    if forbidden:
        harm = F.lower(get("ask")).rlike(forbidden)
        rules.append(F.when(harm if stern is None else harm & F.coalesce(stern, F.lit(False)), "harm"))
    return F.array_compact(F.array(*rules))
