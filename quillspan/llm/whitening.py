"""Whitening of embeddings along their leading components, found by LOBPCG over distributed covariance products.

Entries c become whole numbers x = floor(64 * c) + OFFSET, so that counts and sums are exact. The fit list holds each distinct vector once. Its
covariance V is never formed: a step sends a block of at most 3 * (components + GUARD) directions to the tasks, each multiplies its centred rows with them
and returns rows' * (rows * block), and sums of tasks are added in the order of tasks, in two stages. The driver holds blocks of (dimensions x directions)
only. Each step is a Rayleigh-Ritz solution on the span of the iterate, its residuals and the previous directions; it ends when the residual of every
component asked for is below the tolerance, and fails loudly if that isn't reached.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.plans.scratch import Scratch

SCALE, OFFSET = 64, 1_000_000
#: Directions of the block beyond the components asked for; they speed up the last of those.
GUARD = 4
MAX_STEPS = 2000
#: Eigenvalues below this share of the largest are taken for zero: such components have no whitened values.
NULL_SHARE = 1e-12
#: Rows that a task holds as doubles at once.
ROWS = 1 << 13
#: Whole numbers less OFFSET stay within this; a longer entry counts as this long.
LARGEST = 1 << 61


@dataclass(frozen=True)
class Whitener:
    """n: vectors of the fit list; total: their sums less n * OFFSET, exact; spread: the greatest |entry - OFFSET|; trace: that of the covariance;
    values, vectors: eigenvalues, falling, and unit eigenvectors as columns; residuals: ||V v - e v|| of each; error: see whiten."""

    n: int
    total: tuple[int, ...]
    spread: int
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    error: float


def whole_numbers(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, y): y = floor(64 * entry), for rows whose vector isn't null and holds finite numbers only."""
    entries = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    return entries.where(F.col("v").isNotNull() & finite).select("id", F.transform("v", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST))))).alias("y"))


def _matrix(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The whole numbers of a list column, ROWS rows at a time."""
    for i in range(0, len(column), ROWS):
        part = column.slice(i, ROWS)
        yield np.asarray(part.flatten()).reshape(len(part), width)


def _numerators(y: np.ndarray, n: int, total: np.ndarray, safe: bool) -> np.ndarray:
    """n * y - total, exact: as 64-bit numbers where these hold it, else as Python's."""
    return y * n - total if safe else y.astype(object) * n - total.astype(object)


def _fits(n: int, spread: int) -> bool:
    return 2 * n * (spread + 1) < 1 << 62


def _summed(table: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over tasks of the doubles that make returns for a task's batches, added in the order of tasks: first some tasks' in each of about
    the square root of their number of groups, then the groups' on the driver, so that it gets few blocks however many tasks there are."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = make(batches)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([found.astype(np.float64).tobytes()], pa.binary())], ["block"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = None, None
        for batch in batches:
            for task, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(block, np.float64)
                total, first = (x.copy(), task) if total is None else (total + x, first)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["task", "block"])

    blocks = table.mapInArrow(part, "block binary").select(F.spark_partition_id().alias("task"), "block")
    groups = max(1, math.isqrt(table.rdd.getNumPartitions()))
    rows = blocks.repartition(groups, "task").sortWithinPartitions("task").mapInArrow(add, "task int, block binary").collect()
    out = np.zeros(int(np.prod(shape)))
    for r in sorted(rows, key=lambda r: r.task):
        out += np.frombuffer(r.block, np.float64)
    return out.reshape(shape)


def _centred(batches: Iterator[pa.RecordBatch], n: int, total: np.ndarray, safe: bool) -> Iterator[np.ndarray]:
    for batch in batches:
        for y in _matrix(batch.column(0), len(total)):
            yield _numerators(y, n, total, safe).astype(np.float64) / n


def _orthonormal(blocks: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of the blocks' span, the first block's directions first; directions that earlier ones nearly hold are left out."""
    basis = np.zeros((blocks[0].shape[0], 0))
    for b in blocks:
        for x in b.T:
            size = np.linalg.norm(x)
            if not size or basis.shape[1] == basis.shape[0]:
                continue
            x = x / size
            for _ in range(2):
                x = x - basis @ (basis.T @ x)
            left = np.linalg.norm(x)
            if left > 1e-8:
                x = x / left
                x = x - basis @ (basis.T @ x)
                basis = np.column_stack([basis, x / np.linalg.norm(x)])
    return basis


def lobpcg(product: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, tolerance: float | None = None, max_steps: int = MAX_STEPS, seed: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The greatest eigenvalues (falling), unit eigenvectors as columns and residual norms of a symmetric, positive semidefinite operator.

    product: the operator times a block. One product a step, of a fresh orthonormal basis, so that errors don't build up. Raises if after max_steps the
    residual of a wanted component is above tolerance * the greatest eigenvalue; by default that is about what rounding leaves of doubles.
    """
    tolerance = 8 * np.finfo(np.float64).eps * math.sqrt(width) if tolerance is None else tolerance
    wanted = min(wanted, width)
    m = min(width, wanted + GUARD)
    x = _orthonormal([np.random.Generator(np.random.PCG64(seed)).standard_normal((width, m))])
    residual, before = np.zeros((width, 0)), np.zeros((width, 0))
    for _ in range(max_steps):
        basis = _orthonormal([x, residual, before])
        image = product(basis)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:m], turn[:, ::-1][:, :m]
        new, image = basis @ turn, image @ turn
        residual = image - new * values
        size = np.linalg.norm(residual, axis=0)
        if (size[:wanted] <= tolerance * max(values[0], 0.0)).all():
            return values[:wanted], new[:, :wanted], size[:wanted]
        held = x.shape[1]
        before = basis[:, held:] @ turn[held:]  # the step's part outside the last iterate
        x = new
    raise RuntimeError(f"LOBPCG: residuals {size[:wanted] / values[0]} after {max_steps} steps")


def fit(rows: DataFrame, scratch: Scratch, components: int = 16, tolerance: float | None = None) -> Whitener | None:
    """The whitener of the distinct vectors in rows (y), which all have one length; None where there is no row."""
    distinct = scratch.write(rows.select("y").distinct(), "fit")
    each = distinct.agg(F.count("*").alias("n"), F.max(F.size("y")).alias("width"), F.max(F.greatest(F.abs(F.array_max("y")), F.abs(F.array_min("y")))).alias("spread")).first()
    if not each.n or not each.width:
        return None
    n, width, spread = each.n, each.width, each.spread

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for batch in batches:
            for y in _matrix(batch.column(0), width):
                part = y.sum(axis=0) if spread < 1 << 48 else y.astype(object).sum(axis=0)
                total = [a + int(b) for a, b in zip(total, part, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([str(t) for t in total])], ["at", "total"])

    found = distinct.mapInArrow(sums, "at int, total string").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    total = [0] * width
    for r in found.collect():  # one row a dimension
        total[r.at] = int(r.total)
    safe = _fits(n, spread)
    sums_ = np.array(total, np.int64 if safe else object)

    def squares(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        return np.array([sum(float((x * x).sum()) for x in _centred(batches, n, sums_, safe))])

    trace = float(_summed(distinct, squares, (1,))[0]) / n
    if not trace:
        return Whitener(n, tuple(total), spread, 0.0, np.zeros(0), np.zeros((width, 0)), np.zeros(0), 0.0)

    def product(block: np.ndarray) -> np.ndarray:
        shared = distinct.sparkSession.sparkContext.broadcast(block)

        def multiply(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            q = shared.value
            out = np.zeros_like(q)
            for x in _centred(batches, n, sums_, safe):
                out += x.T @ (x @ q)
            return out

        found = _summed(distinct, multiply, block.shape) / n
        shared.unpersist()
        return found

    values, vectors, residuals = lobpcg(product, width, components, tolerance)
    stay = values > NULL_SHARE * values[0]
    values, vectors, residuals = values[stay], vectors[:, stay], residuals[stay]
    k = len(values)

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((k + 1, k))
        for x in _centred(batches, n, sums_, safe):
            z = x @ vectors / np.sqrt(values)
            out[:k] += z.T @ z
            out[k] += z.sum(axis=0)
        return out

    found = _summed(distinct, moments, (k + 1, k)) / n
    error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    return Whitener(n, tuple(total), spread, trace, values, vectors, residuals, error)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, tolerance: float | None = None) -> DataFrame:
    """A row for each row of rows and component: id_col, component, n, deviation, whitened, explained, identity_error, residual.

    Rows whose vector is null or holds a null or non-finite entry are left out, as are those of another length than most rows have (of equal numbers the
    shorter length; an empty vector has no entries to whiten). Components are numbered from 1 by falling eigenvalue; there are as many as asked for, or
    as V's rank allows: with one distinct vector, or none, no rows. n: vectors of the fit list. deviation: the sum over dimensions of (n * x - S)^2, exact, null where a long can't hold
    it. whitened: (x - S / n) along the component over the root of its eigenvalue e; explained: e / trace(V); identity_error: the greatest entry, over the fit list, of whitened's
    covariance less the identity; residual: ||V v - e v|| / e. Repeated rows and ids give rows each; other columns don't matter.
    """
    scratch = Scratch(rows.sparkSession, "whitening")
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    good = written = scratch.write(whole_numbers(rows, id_col, vector_col), "numbers")
    lengths = good.where(F.size("y") > 0).groupBy(F.size("y").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    model = None
    if lengths is not None:
        good = good.where(F.size("y") == lengths.width)
        model = fit(good, scratch, components, tolerance)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    scratch.keep(written)
    safe = _fits(model.n, model.spread)
    total = np.array(model.total, np.int64 if safe else object)
    narrow = safe and len(total) * (2 * model.n * (model.spread + 1)) ** 2 < 1 << 63
    k = len(model.values)
    shared = rows.sparkSession.sparkContext.broadcast((model.vectors / np.sqrt(model.values), total))
    figures = model.values / model.trace, np.full(k, model.error), model.residuals / model.values
    n = model.n

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, total = shared.value
        for batch in batches:
            at = 0
            for y in _matrix(batch.column(1), len(total)):
                parts = _numerators(y, n, total, safe)
                if narrow:
                    deviation = pa.array((parts * parts).sum(axis=1))
                else:
                    deviation = pa.array([d if d < 1 << 63 else None for d in (sum(int(p) ** 2 for p in row) for row in parts)], pa.int64())
                z = parts.astype(np.float64) / n @ turn
                each = pa.array(np.repeat(np.arange(len(y)), k))
                flat = [np.tile(f, len(y)) for f in figures]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(y)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))), pa.array(np.full(len(each), n)), deviation.take(each), pa.array(z.ravel()), *map(pa.array, flat)], [c.split()[0] for c in schema.split(", ")])
                at += len(y)

    return good.mapInArrow(project, schema).withColumnRenamed("id", id_col)
