"""Whitened leading components of vectors by Chebyshev-filtered subspace iteration.

Components are fitted to whole numbers ``floor(256 c)``, each distinct vector once. The covariance is never formed: a pass
over the fit list, centred row by row, gives its product with a block of directions, and partial products add up on the executors.
A sweep runs a polynomial recurrence of such passes, which damps the spectrum below the block's smallest Ritz value,
orthonormalises the block and rotates it to Ritz vectors. It ends when the residuals certify the wanted components. Counts,
sums and deviations are exact integers.

Nulls and odd rows: a vector that is null, or holds a null or an entry that isn't finite, is dropped, and so is an empty one, which
has no dimension; vectors of each length make a space of their own; rows with a null or repeated id are rows like any other;
components without variance are left out (fewer than two distinct vectors have none); a deviation beyond a long is null;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paperloom.staging import stage

SCALE, COMPONENTS = 256, 4
#: Directions beside the wanted ones, and the most passes of a sweep's recurrence.
GUARD, DEGREE = 28, 16
#: Largest growth of a direction within a sweep: what is left of the others keeps eight digits.
GROWTH = 1e8
#: Residual of a certified component, as a part of its eigenvalue and of the largest one.
CERTAIN, ROUNDING = 1e-12, 1e-13
SWEEPS = 60
#: Values of a block of rows in a task, and features of a partial product that travels as one row.
BLOCK_VALUES, SLICE = 1_000_000, 512
#: Partial products that one task adds up, and that the driver does.
FAN_IN = 64

OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """``vec_id, x`` of usable rows."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where("v is not null").where(sound).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of batches with their rows ``x`` as a matrix of 64-bit integers."""
    step = max(1, BLOCK_VALUES // width)
    for batch in batches:
        for at in range(0, len(batch), step):
            part = batch.slice(at, step)
            yield part, part.column("x").flatten().to_numpy().reshape(-1, width)


def _exact(x: np.ndarray, rows: int, power: int = 1) -> np.ndarray:
    """``x`` in a type whose sums over ``rows`` of its ``power`` are exact."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    return x if most**power * max(rows, 1) < 1 << 62 else x.astype(object)


def moments(fit: DataFrame, width: int) -> tuple[int, list[int], Fraction]:
    """Number of rows, sums of each dimension, and the trace of the covariance, all exact."""

    def run(batches):
        n, sums, squares = 0, [0] * width, 0
        for _, x in _blocks(batches, width):
            n += len(x)
            sums = [a + int(b) for a, b in zip(sums, _exact(x, len(x)).sum(axis=0).tolist(), strict=True)]
            y = _exact(x, x.size, 2)
            squares += int((y * y).sum())
        yield pa.RecordBatch.from_arrays([pa.array([*range(width), -1, -2], pa.int32()), pa.array([str(s) for s in (*sums, n, squares)])], names=["dim", "value"])

    found = fit.select("x").mapInArrow(run, "dim int, value string").groupBy("dim").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    value = {r["dim"]: int(r["value"]) for r in found.collect()}  # one row for each dimension
    n, sums = value.get(-1, 0), [value.get(i, 0) for i in range(width)]
    return n, sums, Fraction(n * value.get(-2, 0) - sum(s * s for s in sums), max(n, 1) ** 2)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - sums / n``, whose whole part is taken off before rounding."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole).astype(float) - np.array([(s % n) / n for s in sums])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column("slice").to_pylist(), batch.column("rows"), strict=True):
            rows = np.frombuffer(raw.as_buffer())
            sums[part] = sums[part] + rows if part in sums else rows.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["slice", "rows"])


def _added(partial: DataFrame, parts: int, shape: tuple[int, int]) -> np.ndarray:
    """The sum of partial matrices ``(slice, rows)`` of all tasks: by a tree down to ``FAN_IN`` matrices, which the driver adds."""
    schema = "slice int, rows binary"
    slices = -(-shape[0] // SLICE)
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        partial = partial.repartition(parts * slices, "slice", F.pmod(F.spark_partition_id(), F.lit(parts))).mapInArrow(_add, schema)
    out = np.zeros(shape)
    for row in partial.collect():
        rows = np.frombuffer(bytes(row["rows"])).reshape(-1, shape[1])
        out[row["slice"] * SLICE : row["slice"] * SLICE + len(rows)] += rows
    return out


def _partials(fit: DataFrame, width: int, partial: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> DataFrame:
    def run(batches):
        total = np.zeros(shape)
        for _, x in _blocks(batches, width):
            total += partial(x)
        parts = range(0, shape[0], SLICE)
        yield pa.RecordBatch.from_arrays([pa.array([p // SLICE for p in parts], pa.int32()), pa.array([total[p : p + SLICE].tobytes() for p in parts], pa.binary())], names=["slice", "rows"])

    return fit.select("x").mapInArrow(run, "slice int, rows binary")


def covariance_times(fit: DataFrame, n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """The product of the covariance with a block, by one pass over ``fit`` each time."""
    context, parts = fit.sparkSession.sparkContext, fit.rdd.getNumPartitions()

    def times(block: np.ndarray) -> np.ndarray:
        shared = context.broadcast(block)

        def product(x: np.ndarray) -> np.ndarray:
            centred = _centred(x, n, sums)
            return centred.T @ (centred @ shared.value)

        try:
            return _added(_partials(fit, len(sums), product, block.shape), parts, block.shape) / n
        finally:
            shared.destroy()

    return times


def filtered(times: Callable[[np.ndarray], np.ndarray], block: np.ndarray, degree: int, cut: float, top: float) -> np.ndarray:
    """A scaled Chebyshev polynomial of the operator on ``block``: at most 1 in size on [0, ``cut``], large above, 1 at ``top``."""
    half = centre = cut / 2
    sigma = first = half / (top - centre)
    before, now = block, (times(block) - centre * block) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (times(now) - centre * now) * (2 * after / half) - sigma * after * before
        sigma = after
    return now


def leading(times: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, guard: int = GUARD, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues and their vectors; certified components stay in the block and out of the filter."""
    size = min(width, wanted + guard)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0]
    for _ in range(SWEEPS):
        image = times(block)
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, image = block @ turn, image @ turn
        wrong = np.linalg.norm(image - vectors * values, axis=0)
        sure = wrong <= CERTAIN * np.abs(values) + ROUNDING * values[0]
        done = size if sure.all() else int(np.argmin(sure))
        if done >= min(wanted, size):
            return values[:wanted], vectors[:, :wanted]
        locked, rest = vectors[:, :done], vectors[:, done:]
        top = values[done]
        cut = min(max(values[-1], 1e-6 * top), 0.99 * top)  # a spectrum that ends within the block leaves nothing to damp
        ahead = 2 * top / cut - 1
        degree = int(np.clip(np.log(2 * GROWTH) / np.log(ahead + np.sqrt(ahead**2 - 1)), 1, DEGREE))
        apart = lambda y, own=locked: y - own @ (own.T @ y)
        rest = filtered(lambda y: apart(times(y)), rest, degree, cut, top)
        rest = np.linalg.qr(apart(rest))[0]
        block = np.linalg.qr(np.hstack([locked, apart(rest)]))[0]
    raise RuntimeError(f"{wanted} components are not certain after {SWEEPS} sweeps: residuals {wrong[:wanted]}, eigenvalues {values[:wanted]}")


def _whiten_space(rows: DataFrame, width: int, components: int) -> DataFrame:
    spark = rows.sparkSession
    fit = stage(rows.select("x").distinct(), "fit")
    n, sums, trace = moments(fit, width)
    if n < 2 or trace <= 0:
        return spark.createDataFrame([], OUTPUT)
    values, vectors = leading(covariance_times(fit, n, sums), width, min(components, width))
    real = values > 1e-11 * values[0]
    values, axes = values[real], vectors[:, real] / np.sqrt(values[real])
    count = len(values)

    def gram(x: np.ndarray) -> np.ndarray:
        white = _centred(x, n, sums) @ axes
        return np.vstack([white.T @ white, white.sum(axis=0)])

    spread = _added(_partials(fit, width, gram, (count + 1, count)), fit.rdd.getNumPartitions(), (count + 1, count)) / n
    error = float(np.abs(spread[:-1] - np.outer(spread[-1], spread[-1]) - np.eye(count)).max())
    explained = [float(Fraction(float(e)) / trace) for e in values]

    def run(batches):
        for part, x in _blocks(batches, width):
            white = _centred(x, n, sums) @ axes
            most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
            far = n * most + max(map(abs, sums))
            apart = (x if far * far * width < 1 << 62 else x.astype(object)) * n - np.array(sums, np.int64 if far * far * width < 1 << 62 else object)
            deviation = [d if d < 1 << 63 else None for d in (apart * apart).sum(axis=1).tolist()]
            repeat = np.repeat(np.arange(len(x)), count)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id").take(pa.array(repeat)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(len(repeat), n)), pa.array(deviation, pa.int64()).take(pa.array(repeat)),
                 pa.array(white.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(repeat), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, OUTPUT)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """For each usable row of ``vectors(vec_id, embedding)`` and each component its whitened coordinate, and the fit's figures."""
    rows = stage(whole_numbers(vectors), "whole")
    out = vectors.sparkSession.createDataFrame([], OUTPUT)
    for row in rows.select(F.size("x").alias("width")).distinct().orderBy("width").collect():
        out = out.unionByName(_whiten_space(rows.where(F.size("x") == row["width"]), row["width"], components))
    return out
