"""Token counts by section or field, from offsets: each document is encoded once, whole.

A token covers the bytes from its offset to the next one's. Sections are the lines, or the spans of a table of fields and what lies between them. Tokens
and sections are both in order and without gaps, so the interval join is a sorted search of the tokens' anchors among the sections' ends. A token that crosses a boundary goes
to one section by rule: 'first' (that of its first byte), 'last' (of its last byte) or 'most' (of most bytes, the first of
equals). Sections therefore add up to the document's tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import kernel as K

# Fixed value: the pre-tokenising pattern that belongs to byte-level BPE vocabularies of this kind.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longest piece of text given to the encoder at once; longer texts are cut at ends of lines.
PIECE = 1 << 20
RULES = ("first", "last", "most")


def attribute(sizes: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. sizes: bytes of the tokens; ends: where sections end, the last at the sum of sizes."""
    until = np.cumsum(sizes)
    since = until - sizes
    first = np.searchsorted(ends, since, "right")
    if rule == "first":
        section = first
    else:
        last = np.searchsorted(ends, until - 1, "right")
        section = last
        if rule == "most":
            section = first.copy()
            for t in np.flatnonzero(last > first):
                cuts = np.concatenate([[since[t]], ends[first[t] : last[t]], [until[t]]])
                section[t] = first[t] + int(np.argmax(np.diff(cuts)))
    return np.bincount(section, minlength=len(ends))


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "first", pattern: str = PATTERN, spans: DataFrame | None = None) -> DataFrame:
    """One row per section of each row of docs: id_col, section (from 0), begin, end (code points), n_tokens (long).

    Sections are the lines of the text; a line's \\n belongs to it. A text has one section more than it has \\n, so an
    empty text has one empty section, and a null text none. Repeated rows give repeated rows; other columns are not read. vocabulary is the path
    of a file of base64 tokens and their ranks; it is read on the driver and sent to the executors (its size is fixed).

    spans: (id_col, field, begin, end) of the texts' fields, in code points, without overlaps (else a ValueError). Then there is a column field, and
    rows are the spans in their order, numbered by section, ends cut at the text's; and a last row with a null field, begin and end for the tokens of what
    no span covers, if there is such text. Texts without spans have this row only; spans with a null or of no text have no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fielded = spans is not None
    if fielded:
        source = source.join(_listed(spans.select(F.col(id_col).alias("id"), F.col("field").cast("string").alias("field"), "begin", "end")), "id", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        length = np.zeros(encoding.n_vocab, np.int64)
        for token, n in shared.value.items():
            length[n] = len(token)
        for batch in batches:
            text = batch.column(1)
            null = text.is_null().to_numpy(zero_copy_only=False)
            for i, j, data, offsets in K.blocks(text):
                parts, rows, fields = [], [], []
                for r in range(j - i):
                    if null[i + r]:
                        continue
                    own = data[offsets[r] : offsets[r + 1]]
                    ids = np.concatenate([np.zeros(0, np.int64), *(np.asarray(encoding.encode_ordinary(p), np.int64) for p in _pieces(own))])
                    points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                    if not fielded:
                        ends = np.append(np.flatnonzero(own == 10) + 1, len(own))
                        part = np.arange(len(ends)), points[np.append(0, ends[:-1])], points[ends], attribute(length[ids], ends, rule)
                    else:
                        names, *part = _by_field(batch.column(2)[i + r].as_py() or [], own, length[ids], int(points[-1]), rule)
                        fields += names
                    parts.append(part)
                    rows.append(np.full(len(part[0]), i + r))
                if rows:
                    columns = [np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)]
                    section, begin, end, n = (pa.array(x, mask=x < 0) for x in columns)
                    named = [pa.array(fields, pa.string())] if fielded else []
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), *named, section.cast(pa.int32()), begin, end, n], [c.split()[0] for c in schema])

    schema = [f"id {kind}", *["field string"] * fielded, "section int", "begin long", "end long", "n_tokens long"]
    return source.mapInArrow(count, ", ".join(schema)).withColumnRenamed("id", id_col)


def _listed(spans: DataFrame) -> DataFrame:
    """(id, spans): the spans of each id in order, as an array of (begin, end, field). A document's spans are one row."""
    good = spans.where("id is not null and begin is not null and end is not null")
    out = good.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"), "field"))).alias("spans"))
    last = F.size("spans") - 1
    crossed = F.exists(F.sequence(F.lit(0), last), lambda i: (F.get("spans", i).begin > F.get("spans", i).end) | ((i < last) & (F.get("spans", i).end > F.get("spans", i + 1).begin)))
    bad = out.where((F.get("spans", F.lit(0)).begin < 0) | crossed).select("id").limit(3).collect()
    if bad:
        raise ValueError(f"spans overlap, run backwards or begin before the text, of ids such as {[r.id for r in bad]}")
    return out


def _by_field(spans: list[dict], own: np.ndarray, sizes: np.ndarray, n_points: int, rule: str) -> tuple:
    """Fields, sections, begins, ends and tokens of the spans of one text, then of the rest if there is any (its numbers are -1, for null)."""
    byte = np.append(np.flatnonzero((own & 0xC0) != 0x80), len(own))  # where code points begin
    begin, end = (np.array([min(s[k], n_points) for s in spans], np.int64) for k in ("begin", "end"))
    bounds = np.empty(2 * len(spans) + 1, np.int64)  # what lies before each span, the span, and what follows the last
    bounds[0:-1:2], bounds[1::2], bounds[-1] = byte[begin], byte[end], len(own)
    tokens = attribute(sizes, bounds, rule)
    names, section = [s["field"] for s in spans], np.arange(len(spans))
    if n_points == int((end - begin).sum()):
        return names, section, begin, end, tokens[1::2]
    return [*names, None], np.append(section, len(spans)), np.append(begin, -1), np.append(end, -1), np.append(tokens[1::2], tokens[::2].sum())


def _pieces(own: np.ndarray) -> Iterator[str]:
    """The text, cut after a \\n between two printable ASCII characters, if there is one past PIECE bytes.

    The pattern makes such a \\n a piece of its own either way, so the tokens are those of the whole text.
    """
    solid = (own > 32) & (own < 127)
    places = np.flatnonzero(own[1:-1] == 10) + 1 if len(own) > PIECE else np.zeros(0, np.int64)
    places = places[solid[places - 1] & solid[places + 1]] + 1
    i = 0
    while i < len(own):
        k = int(np.searchsorted(places, i + PIECE))
        j = int(places[k]) if k < len(places) else len(own)
        yield own[i:j].tobytes().decode()
        i = j
