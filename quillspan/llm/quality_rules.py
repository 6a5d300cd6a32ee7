"""Quality rules, line first: failing lines go, then documents that lose too many of their words.

A line with a word fails
- punctuation: its last character isn't one of ``. ! ? : ; " ' ) ]`` or of the marks in END_MARKS, or over 10 % of its
  characters besides white space are of ``# * $ % & | < > ~ ^ = @``, or at least 3 words and 30 % of its words end in ``!!``;
- navigation: it has 3 or more of ``| >``;
- boilerplate: it holds one of the phrases given, in any case; by default those of the four languages in BOILERPLATE.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import kernel as K

#: Phrases of boilerplate lines by language; further languages and phrases are a parameter.
BOILERPLATE = {
    "en": ("all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "javascript", "lorem ipsum", "click here", "read more", "sign up", "log in", "subscribe to"),
    "de": ("alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "impressum und", "cookie-richtlinie", "hier klicken", "klicken sie hier", "weiterlesen", "jetzt anmelden", "newsletter abonnieren"),
    "es": ("todos los derechos reservados", "política de privacidad", "términos de uso", "condiciones de uso", "política de cookies", "haz clic aquí", "haga clic aquí", "leer más", "iniciar sesión", "suscríbete a"),
    "fr": ("tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "mentions légales", "politique de cookies", "cliquez ici", "lire la suite", "se connecter", "s'inscrire", "abonnez-vous à"),
}
# Closing marks besides the ASCII ones.
END_MARKS = "…”’»›。！？"

MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOST_PERCENT, WINDOW = 10, 20, 50, 5

_SYMBOL, _NOISE, _NAV, _END = (np.isin(np.arange(256), list(x)) for x in (b"#*$%&|<>", b"#*$%&|<>~^=@", b"|>", b".!?:;\"')]"))
_ENDS = [m.encode() for m in END_MARKS]


def _per_line(flag: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return total[end] - total[begin]


def _repeats(hashes: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Words of each row that lie in a window found twice or more in it."""
    found, begin, first = K.shingles(hashes, at, window, short=False)
    row = K.row_of(begin)
    key = found ^ K.mix(row.astype(np.uint64) + K.U(1))
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    cover = np.zeros(len(hashes) + 1, np.int32)
    if len(again):
        twice = first[np.isin(key, again)]
        np.add.at(cover, twice, 1)
        np.add.at(cover, np.minimum(twice + window, len(hashes)), -1)
    return K.sums(np.cumsum(cover[:-1]) > 0, at)


def _judge_block(data: np.ndarray, offsets: np.ndarray, suspects: np.ndarray, phrase: re.Pattern, min_words: int, max_repeat: int, max_lost: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Figures of each row, and the lines: begin, end, row, fails."""
    n = len(offsets) - 1
    hashes, at, starts, ends = K.words(data, offsets, lower=False)
    # lines: split at \n and at rows; every row has one line at least
    breaks = np.flatnonzero(data == 10)
    # (a text's last line may be empty and begin where the next text does)
    own = np.concatenate([np.arange(n), np.searchsorted(offsets[1:], breaks, "right")])
    begin = np.concatenate([offsets[:-1], breaks + 1])
    ordered = np.lexsort((begin, own))
    row, begin = own[ordered], begin[ordered]
    last = np.ones(len(begin), bool)
    last[:-1] = row[1:] != row[:-1]
    end = np.where(last, offsets[1:][row], np.append(begin[1:], 0) - 1)

    word_line = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    n_words = word_line[1] - word_line[0]
    full = n_words > 0
    solid = ~K._SPACE[data]
    chars = solid & ((data & 0xC0) != 0x80)
    tail = np.zeros(len(begin), np.int64)
    tail[full] = ends[word_line[1][full] - 1]
    closing = np.zeros(len(begin), bool)
    closing[full] = _END[data[tail[full] - 1]]
    for mark in _ENDS:
        fits = full & (tail - begin >= len(mark))
        for k, c in enumerate(reversed(mark)):
            fits[fits] = data[tail[fits] - 1 - k] == c
        closing |= fits
    bang = np.zeros(len(starts), bool)
    two = ends - starts >= 2
    bang[two] = (data[ends[two] - 1] == 33) & (data[ends[two] - 2] == 33)
    total = np.concatenate([[0], np.cumsum(bang)])
    banged = total[word_line[1]] - total[word_line[0]]
    noisy = 10 * _per_line(_NOISE[data], begin, end) > _per_line(chars, begin, end)
    fails = full & (~closing | noisy | ((banged >= 3) & (10 * banged >= 3 * n_words)) | (_per_line(_NAV[data], begin, end) >= 3))
    for k in np.flatnonzero(full & ~fails & suspects[row]):
        fails[k] = phrase.search(data[begin[k] : end[k]].tobytes().decode()) is not None

    # equal lines of a row
    line_hash = K._hash_runs(data, begin[full], end[full], K._BYTE) ^ K.mix(row[full].astype(np.uint64) + K.U(1))
    line_row = row[full]
    order = np.argsort(line_hash, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = line_hash[order][1:] == line_hash[order][:-1]
    count = np.diff(at)
    repeats = _repeats(hashes, at, WINDOW)
    lost = np.bincount(row[fails], weights=n_words[fails], minlength=n).astype(np.int64)
    failed = (count < min_words) | (100 * repeats > max_repeat * count)
    figures = {
        "n_words": count,
        "word_chars": K.sums(chars, offsets),
        "n_symbols": K.sums(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(line_row[order][same], minlength=n),
        "n_repeat_words": repeats,
        "lost_words": lost,
        "lost_lines": np.bincount(row[fails], minlength=n),
        "base_failed": failed,
        "kept": ~failed & (100 * lost <= max_lost * count),
    }
    return figures, begin, end, row, fails


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, max_lost_percent: int = MAX_LOST_PERCENT, boilerplate: dict[str, tuple[str, ...]] = BOILERPLATE) -> DataFrame:
    """One row per row of docs: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_words, lost_lines, base_failed, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text; lines are split at \\n. base_failed: under min_words words, or over
    max_repeat_percent of the words in 5-word windows found twice or more. kept: not base_failed and at most max_lost_percent
    of the words on failing lines. with_text adds text: the lines that stay (null for a null text). Null, empty and wordless
    texts have no words and are base_failed. boilerplate: phrases by language, all of them looked for in every line. Rows are judged one by one: repeats, ties and other columns don't matter.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words", "lost_lines"]
    phrases = "|".join(re.escape(p) for of_language in boilerplate.values() for p in of_language) or r"[^\s\S]"
    phrase = re.compile(phrases, re.IGNORECASE)
    names = ["id", *longs, "base_failed", "kept", *["text"] * with_text]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            suspects = pc.match_substring_regex(text, phrases, ignore_case=True).fill_null(False).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in K.blocks(text):
                out, begin, end, row, fails = _judge_block(data, offsets, suspects[i:j], phrase, min_words, max_repeat_percent, max_lost_percent)
                columns = [batch.column(0).slice(i, j - i), *(pa.array(np.asarray(out[c], np.int64)) for c in longs), pa.array(out["base_failed"]), pa.array(out["kept"])]
                if with_text:
                    lines: list[list[bytes]] = [[] for _ in range(j - i)]
                    for k in np.flatnonzero(~fails):
                        lines[row[k]].append(data[begin[k] : end[k]].tobytes())
                    null = text.slice(i, j - i).is_null().to_pylist()
                    columns.append(pa.array([None if null[k] else b"\n".join(x).decode() for k, x in enumerate(lines)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in longs) + ", base_failed boolean, kept boolean" + ", text string" * with_text
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).mapInArrow(judge, schema).withColumnRenamed("id", id_col)
