"""Leading eigenvectors of a symmetric operator that only Spark can hold, by block Krylov iteration.

The basis is a table ``(entity, q array<double>)``: a row has its coordinates in all blocks found so far. A
round applies the operator (given by the caller) to the last block, writes the image beside the basis and
makes it orthonormal to everything before, twice, because once leaves what cancels. The eigenproblem is
solved within all blocks kept (Rayleigh-Ritz), so every round uses what the earlier ones have learnt, and
the length of what the operator leads out of them, the residual, tells when to stop.

Tasks hand back sums of products, one small matrix each; matrices go to tasks as plain values, so no round
compiles a plan of its own for them. The lineage is cut once a round. When the basis is full, the iteration
starts again from its best vectors.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import cut_plan, release
from .merging import added, as_batch

WIDEST_BASIS = 256


class Eigen(NamedTuple):
    """``vectors(entity, y array<double>)``, the largest first, with values and residuals relative to the
    largest value; ``rounds`` applications of the operator."""

    vectors: DataFrame
    values: np.ndarray
    residuals: np.ndarray
    rounds: int


def random_start(entities: DataFrame, width: int, seed: int) -> DataFrame:
    """``(entity, y)``: a start that depends on the entity alone, not on how the table is partitioned."""
    hashed = [F.pmod(F.xxhash64("entity", F.lit(seed), F.lit(i)), F.lit(1_000_003)) / 1_000_003 - 0.5 for i in range(width)]
    return entities.select("entity", F.array(*hashed).alias("y"))


def _dense(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def mapped(table: DataFrame, columns: list[str], work: Callable[..., np.ndarray], name: str) -> DataFrame:
    """``(entity, <name>)``: a function of the rows' arrays, as matrices of a batch of rows."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            out = work(*(_dense(batch.column(c), batch.num_rows) for c in columns))
            width = out.shape[1]
            ends = pa.array(np.arange(0, out.size + 1, width) if width else np.zeros(len(out) + 1), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("entity"), pa.ListArray.from_arrays(ends, pa.array(out.ravel(), pa.float64()))], ["entity", name]
            )

    kind = table.schema["entity"].dataType.simpleString()
    return table.select("entity", *columns).mapInArrow(run, f"entity {kind}, {name} array<double>")


def products(table: DataFrame, columns: list[str], work: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum over batches of rows of a matrix made of the rows' arrays."""

    def sums(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                found = work(*(_dense(batch.column(c), batch.num_rows) for c in columns))
                total = found if total is None else total + found
        if total is not None:
            yield as_batch(total)

    total = added(table.select(*columns).mapInArrow(sums, "m array<double>"))
    if total is None:
        raise ValueError("there are no entities")
    return total


def added_rows(table: DataFrame) -> DataFrame:
    """``(entity, y)`` with the arrays of rows of one entity added up."""

    def run(batches):
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            if not batch.num_rows:
                continue
            entity, y = batch.column("entity"), _dense(batch.column("y"), batch.num_rows)
            here, before = entity.slice(1), entity.slice(0, len(entity) - 1)
            same = pc.or_(pc.fill_null(pc.equal(here, before), False), pc.and_(pc.is_null(here), pc.is_null(before)))
            first = np.flatnonzero(np.concatenate([[True], ~same.to_numpy(zero_copy_only=False)]))
            total = np.add.reduceat(y, first, axis=0)
            ends = pa.array(np.arange(0, total.size + 1, max(1, y.shape[1])), pa.int32())
            values = pa.ListArray.from_arrays(ends, pa.array(total.ravel(), pa.float64()))
            found = pa.RecordBatch.from_arrays([entity.take(pa.array(first)), values], ["entity", "y"])
            held = found.slice(len(first) - 1)  # the next batch may go on with its entity
            yield found.slice(0, len(first) - 1)
        if held is not None:
            yield held

    kind = table.schema["entity"].dataType.simpleString()
    rows = table.select("entity", "y").repartition("entity").sortWithinPartitions("entity")
    return rows.mapInArrow(run, f"entity {kind}, y array<double>")


def whitening(gram: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(matrix that makes columns with these products orthonormal, the columns in terms of those); directions
    that vanish beside ``scale`` are left out."""
    lengths, axes = np.linalg.eigh((gram + gram.T) / 2)
    keep = lengths > 1e-20 * max(scale, 1e-300) ** 2
    root = np.sqrt(lengths[keep])
    return axes[:, keep] / root, root[:, None] * axes[:, keep].T


def centred(table: DataFrame) -> DataFrame:
    """``(entity, y)`` with the mean row taken off."""

    def summed(y):
        return np.concatenate([y.sum(axis=0), [len(y)]])

    *total, rows = products(table, ["y"], summed)
    mean = np.array(total) / rows
    return mapped(table, ["y"], lambda y: y - mean, "y")


def leading_eigenvectors(
    apply: Callable[[DataFrame], DataFrame],
    start: DataFrame,
    wanted: int,
    max_rounds: int = 60,
    tol: float = 1e-8,
    widest: int = WIDEST_BASIS,
    kept: int | None = None,
) -> Eigen:
    """Eigenvectors for the ``wanted`` largest eigenvalues of a symmetric operator on ``(entity, y)`` tables.

    The start has as many columns as each block; several more than ``wanted`` speed convergence up. It ends
    when the residuals of the wanted ones are at most ``tol`` times the largest absolute value found, and
    warns when ``max_rounds`` applications do not reach that. ``kept`` columns of vectors come back (those
    wanted by default): as many as the start has make the start of another iteration. A round's tables are
    removed when the next one has been written.
    """
    before = start = cut_plan(start)
    width = len(start.first()["y"])
    size = products(start, ["y"], lambda y: (y.T @ y).ravel()).reshape(width, width)
    white, _ = whitening(size, np.sqrt(np.abs(size).max()))
    basis = mapped(start, ["y"], lambda y: y @ white, "q")
    widths, inner, rounds = [white.shape[1]], np.zeros((0, 0)), 0
    while True:
        whole, last = sum(widths), widths[-1]
        image = apply(basis.select("entity", F.slice("q", whole - last + 1, last).alias("y")))
        both = cut_plan(basis.join(image.select("entity", F.col("y").alias("w")), "entity"))
        release(before)
        before = both
        rounds += 1

        def sizes(q, w):
            return np.concatenate([q, w], axis=1).T @ w

        found = products(both, ["q", "w"], sizes).reshape(whole + last, last)
        along, scale = found[:whole], float(np.sqrt(np.abs(np.diag(found[whole:])).max(initial=0.0)))

        def again(q, w, along=along):
            rest = w - q @ along
            return np.concatenate([q, rest], axis=1).T @ rest

        found = products(both, ["q", "w"], again).reshape(whole + last, last)
        more = found[:whole]
        along = along + more
        white, onward = whitening(found[whole:] - more.T @ more, scale)
        grown = np.zeros((whole, whole))
        grown[: len(inner), : len(inner)] = inner
        grown[:, whole - last :] = along
        grown[whole - last :, :] = along.T
        inner = grown
        values, axes = np.linalg.eigh(inner)
        values, axes = values[::-1], axes[:, ::-1]
        top = axes[:, :wanted]
        residuals = np.linalg.norm(onward @ top[whole - last :], axis=0) / max(np.abs(values).max(), 1e-300)
        done = white.shape[1] == 0 or residuals.max() <= tol
        if (done and whole >= wanted) or white.shape[1] == 0 or rounds >= max_rounds:
            if residuals.max() > tol:
                warnings.warn(f"after {rounds} rounds the residuals are up to {residuals.max():.1e}", stacklevel=2)
            best = axes[:, : kept or wanted]
            vectors = cut_plan(mapped(both, ["q"], lambda q: q @ best, "y"))
            release(both)
            return Eigen(vectors, values[:wanted], residuals, rounds)
        if whole + white.shape[1] > widest:
            best = axes[:, : max(width, wanted)]
            basis = mapped(both, ["q"], lambda q, best=best: q @ best, "q")
            widths, inner = [best.shape[1]], np.zeros((0, 0))
        else:
            basis = mapped(
                both, ["q", "w"], lambda q, w, a=along, m=white: np.concatenate([q, (w - q @ a) @ m], axis=1), "q"
            )
            widths.append(white.shape[1])
