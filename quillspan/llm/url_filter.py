"""URL filter: a bit-parallel wildcard automaton that runs all glob rules at once over each canonical URL.

A glob has literals, ``?`` (one byte) and ``*`` (any bytes). Each literal is one bit of a word vector; bits of all globs lie one after
another over as many 64-bit words as they take. One step for a byte c is D = (D << 1 & B[c]) | (D & L) over the words, where B[c] has the
bits whose literal accepts c, and L those behind which a ``*`` stands. A glob matches if its last bit is set at the end.
Steps run over a block of URLs at once, as many as keep its states within STATE_BYTES; hosts and paths are cut out by column functions before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm import kernel as K

U = np.uint64
#: Stands between host and path of a canonical URL; no other byte of it is zero.
SEAM = b"\x00"
#: Bytes of the states that step at once, and URLs that are too few to.
STATE_BYTES, FEW = 1 << 23, 8

# The rules of host, path and verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
# Globs over host and path; a URL that no rule fits is blocked if one matches.
BLOCKED = ("*spam*\x00*", "*adult*\x00*", "*casino*\x00*", "*free-bets*\x00*", "*porn*\x00*", "*\x00*.exe", "*\x00*.zip")


@dataclass
class Automaton:
    """Masks of all globs: accept[c] (256 x words), loops, starts (words), and the last bit of each glob."""

    accept: np.ndarray
    loops: np.ndarray
    starts: np.ndarray
    last: np.ndarray
    _masks: tuple[list[int], int] | None = None

    @classmethod
    def of(cls, globs: list[bytes]) -> Automaton:
        bits: list[tuple[int | None, bool]] = []  # the byte that enters a state (None: any, -1: it is a start), and its loop
        starts, last = [], []
        for g in globs:
            starts.append(len(bits))
            bits.append((-1, False))
            for c in g:
                if c == ord("*"):
                    bits[-1] = (bits[-1][0], True)
                else:
                    bits.append((None if c == ord("?") else c, False))
            last.append(len(bits) - 1)
        width = max(1, -(-len(bits) // 64))
        accept, loops, first = np.zeros((256, width), np.uint64), np.zeros(width, np.uint64), np.zeros(width, np.uint64)
        for i, (c, loop) in enumerate(bits):
            word, bit = i // 64, U(1) << U(i % 64)
            if loop:
                loops[word] |= bit
            if c is None:
                accept[:, word] |= bit
            elif c >= 0:
                accept[c, word] |= bit
            else:
                first[word] |= bit
        return cls(accept, loops, first, np.array(last, np.int64))

    def run(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row for each URL (the bytes between two offsets), a column for each glob."""
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        out = np.zeros((len(size), len(self.last)), bool)
        rows = max(1, STATE_BYTES // (8 * len(self.loops) + len(self.last)))  # the states of a block, whatever the width of the automaton
        for i in range(0, len(order), rows):
            part = order[i : i + rows]
            state, left, begin = np.repeat(self.starts[None], len(part), axis=0), size[part], offsets[part]
            at, n = 0, int(np.searchsorted(-left, 0, "left"))
            while n > FEW:  # URLs longer than at come first
                now = state[:n]
                moved = now << U(1)
                moved[:, 1:] |= now[:, :-1] >> U(63)
                state[:n] = (moved & self.accept[data[begin[:n] + at]]) | (now & self.loops)
                at += 1
                n = int(np.searchsorted(-left, -at, "left"))
            for k in range(n):
                state[k] = self._alone(state[k], data[begin[k] + at : begin[k] + left[k]].tobytes())
            out[part] = (state[:, self.last // 64] >> (self.last % 64).astype(np.uint64)) & U(1) != 0
        return out

    def _alone(self, state: np.ndarray, text: bytes) -> np.ndarray:
        """The same steps for one URL, whose words make one whole number: the few that are longer than the rest of their block."""
        if self._masks is None:
            self._masks = [int.from_bytes(a.tobytes(), "little") for a in self.accept], int.from_bytes(self.loops.tobytes(), "little")
        (accept, loops), now = self._masks, int.from_bytes(state.tobytes(), "little")
        for c in text:
            now = ((now << 1) & accept[c]) | (now & loops)
        return np.frombuffer(now.to_bytes(8 * len(state), "little"), np.uint64)


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.locate("://", url) + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict.

    A rule (host, path, verdict) fits its host and all subdomains where the path starts with the rule's; the longest wins,
    of equally long ones the first. rule is its host and path, else null. Where no rule fits, a URL without a host
    is blocked, as is one that a blocked glob matches; others are allowed. Null URLs, and those without ``://``, have an empty host and path. Only id
    and URL are read, so other columns clash with nothing; repeated rows give repeated rows.
    """
    globs = []
    for host, path, _ in rules:
        tail = host.encode() + SEAM + path.encode() + b"*"
        globs += [tail, b"*." + tail]
    machine = Automaton.of([*globs, *(b.encode() for b in blocked)])
    names = [h + p for h, p, _ in rules]
    by_length = np.array(sorted(range(len(rules)), key=lambda i: (-len(names[i]), i)), np.int64)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rules_hit, listed = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for _, _, data, offsets in K.blocks(batch.column(3)):
                hit = machine.run(data, offsets)
                fits = np.zeros((len(hit), len(rules) + 1), bool)
                fits[:, :-1] = hit[:, 0 : 2 * len(rules) : 2][:, by_length] | hit[:, 1 : 2 * len(rules) : 2][:, by_length]
                fits[:, -1] = True  # none of the rules
                rules_hit.append(np.append(by_length, -1)[fits.argmax(axis=1)])
                listed.append(hit[:, 2 * len(rules) :].any(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate(rules_hit)), pa.array(np.concatenate(listed))], ["id", "host", "path", "n", "listed"])

    kind = pages.schema[id_col].dataType.simpleString()
    host, path = parts_of(F.col(url_col).cast("string"))
    split = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    whole = F.concat(F.translate("host", "\x00", "\x01"), F.lit("\x00"), F.translate("path", "\x00", "\x01"))  # the seam is the only zero
    out = split.select("*", whole.alias("whole")).mapInArrow(judge, f"id {kind}, host string, path string, n long, listed boolean")
    of_rule = lambda values: F.get(F.array(*map(F.lit, values)), F.col("n").cast("int")) if values else F.lit(None).cast("string")
    known = F.col("n") >= 0
    verdict = F.when(known, of_rule([v for _, _, v in rules])).when(F.col("listed") | (F.col("host") == ""), "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", F.when(known, of_rule(names)).alias("rule"), verdict.alias("verdict"))
