"""The 24 distances, each as one expression over pair statistics.

A formula reads the statistics of a pair (a, b) and works on Spark columns and on numpy arrays
alike; ``math`` supplies the two functions that differ. For the boolean family "true" means
non-zero, and a 0/0 is 0 (two empty sets are equal).

Statistics of a pair: ``dot`` sum of products, ``shared`` items non-zero in both, ``l1`` sum of
absolute differences, ``canberra`` sum of relative differences, ``neq`` items that differ,
``sum_abs`` sum of absolute sums, ``max_diff`` largest difference. Per side: ``n*`` non-zeros,
``s*`` sum, ``q*`` sum of squares. ``d`` is the number of items.
"""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class ColumnMath:
    @staticmethod
    def positive(x: Column) -> Column:
        return F.greatest(x, F.lit(0.0))

    @staticmethod
    def root(x: Column) -> Column:
        return F.sqrt(F.greatest(x, F.lit(0.0)))

    @staticmethod
    def ratio(x: Column, y: Column) -> Column:
        return F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))


class ArrayMath:
    @staticmethod
    def positive(x):
        return np.maximum(x, 0.0)

    @staticmethod
    def root(x):
        return np.sqrt(np.maximum(x, 0.0))

    @staticmethod
    def ratio(x, y):
        x, y = np.broadcast_arrays(np.asarray(x, float), np.asarray(y, float))
        return np.divide(x, y, out=np.zeros_like(x), where=y != 0)


def _sqeuclidean(p, math):
    return math.positive(p.qa + p.qb - 2 * p.dot)


def _euclidean(p, math):
    return math.root(p.qa + p.qb - 2 * p.dot)


def _cosine(p, math):
    return 1 - math.ratio(p.dot, math.root(p.qa * p.qb))


def _correlation(p, math):
    cross = p.dot - p.sa * p.sb / p.d
    spread_a, spread_b = p.qa - p.sa * p.sa / p.d, p.qb - p.sb * p.sb / p.d
    return 1 - math.ratio(cross, math.root(spread_a * spread_b))


def _differ(p):
    return p.na + p.nb - 2 * p.shared


def _yule(p, math):
    only_a, only_b = p.na - p.shared, p.nb - p.shared
    neither = p.d - p.na - p.nb + p.shared
    cross = only_a * only_b
    return math.ratio(2 * cross, p.shared * neither + cross)


_DOT, _SHARED = {"dot"}, {"shared"}

# name -> (statistics read, formula)
DISTANCES: dict[str, tuple[set[str], Callable]] = {
    "euclidean": (_DOT, _euclidean),
    "l2": (_DOT, _euclidean),
    "minkowski": (_DOT, _euclidean),  # order 2
    "sqeuclidean": (_DOT, _sqeuclidean),
    "seuclidean": (_DOT, _euclidean),  # on values scaled by each item's deviation
    "mahalanobis": (_DOT, _euclidean),  # on whitened values
    "cosine": (_DOT, _cosine),
    "correlation": (_DOT, _correlation),
    "cityblock": ({"l1"}, lambda p, math: p.l1),
    "manhattan": ({"l1"}, lambda p, math: p.l1),
    "l1": ({"l1"}, lambda p, math: p.l1),
    "braycurtis": ({"l1", "sum_abs"}, lambda p, math: math.ratio(p.l1, p.sum_abs)),
    "canberra": ({"canberra"}, lambda p, math: p.canberra),
    "chebyshev": ({"max_diff"}, lambda p, math: p.max_diff),
    "hamming": ({"neq"}, lambda p, math: p.neq / p.d),
    "matching": (_SHARED, lambda p, math: _differ(p) / p.d),
    "jaccard": (_SHARED, lambda p, math: math.ratio(_differ(p), p.shared + _differ(p))),
    "dice": (_SHARED, lambda p, math: math.ratio(_differ(p), 2 * p.shared + _differ(p))),
    "kulsinski": (_SHARED, lambda p, math: (_differ(p) - p.shared + p.d) / (_differ(p) + p.d)),
    "rogerstanimoto": (_SHARED, lambda p, math: 2 * _differ(p) / (p.d + _differ(p))),
    "sokalmichener": (_SHARED, lambda p, math: 2 * _differ(p) / (p.d + _differ(p))),
    "russellrao": (_SHARED, lambda p, math: (p.d - p.shared) / p.d),
    "sokalsneath": (_SHARED, lambda p, math: math.ratio(2 * _differ(p), p.shared + 2 * _differ(p))),
    "yule": (_SHARED, _yule),
}

PAIR_STATS = ("dot", "shared", "l1", "canberra", "neq", "sum_abs", "max_diff")
SIDE_STATS = ("na", "nb", "sa", "sb", "qa", "qb")


def check_metric(metric: str) -> str:
    if metric not in DISTANCES:
        raise ValueError(f"unknown distance {metric!r}; choose from {', '.join(sorted(DISTANCES))}")
    return metric


def distance_column(metric: str) -> Column:
    """The distance over a table with pair-statistics columns."""
    _, formula = DISTANCES[check_metric(metric)]
    names = (*PAIR_STATS, *SIDE_STATS, "d")
    return formula(SimpleNamespace(**{n: F.col(n) for n in names}), ColumnMath).cast("double")


def block_statistics(a: np.ndarray, b: np.ndarray, wanted: set[str]) -> dict[str, np.ndarray]:
    """Pair statistics between the rows of two dense blocks, summed over their columns."""
    out = {}
    if "dot" in wanted:
        out["dot"] = a @ b.T
    if "shared" in wanted:
        out["shared"] = (a != 0).astype(float) @ (b != 0).astype(float).T
    row_by_row = wanted - {"dot", "shared"}
    for name in row_by_row:
        out[name] = np.zeros((len(a), len(b)))
    if row_by_row and a.shape[1] <= min(len(a), len(b)):
        return out | _column_statistics(a, b, row_by_row)
    for i in range(len(a) if row_by_row else 0):
        gap = np.abs(b - a[i])
        if "l1" in wanted:
            out["l1"][i] = gap.sum(axis=1)
        if "neq" in wanted:
            out["neq"][i] = (gap != 0).sum(axis=1)
        if "max_diff" in wanted:
            out["max_diff"][i] = gap.max(axis=1, initial=0.0)
        if "sum_abs" in wanted:
            out["sum_abs"][i] = np.abs(b + a[i]).sum(axis=1)
        if "canberra" in wanted:
            out["canberra"][i] = ArrayMath.ratio(gap, np.abs(b) + np.abs(a[i])).sum(axis=1)
    return out


# Pairs that a pass over the columns keeps in the processor's cache.
_PAIRS_AT_ONCE = 1 << 15
_LEAST = 5e-324  # a sum of sizes below it is 0


def _column_statistics(a: np.ndarray, b: np.ndarray, wanted: set[str]) -> dict[str, np.ndarray]:
    """The statistics without products column by column, for more rows than columns: whole tiles of pairs at a
    time. Differences and sums of all pairs of a column come from a product of two columns with two rows, which
    is exact and twice as fast as broadcasting."""
    out = {name: np.zeros((len(a), len(b))) for name in wanted}
    step = max(1, _PAIRS_AT_ONCE // max(1, len(b)))
    gap, other = np.empty((step, len(b))), np.empty((step, len(b)))

    def beside_ones(values: np.ndarray, ones_first: bool) -> np.ndarray:
        pair = (np.ones_like(values), values) if ones_first else (values, np.ones_like(values))
        return np.ascontiguousarray(np.stack(pair, axis=1))  # column x 2 x rows

    right = {name: beside_ones(y, True) for name, y in (("gap", -b.T), ("sum", b.T), ("size", np.abs(b.T)))}
    for low in range(0, len(a), step):
        rows = a[low : low + step].T
        t, u = gap[: rows.shape[1]], other[: rows.shape[1]]
        part = {name: total[low : low + step] for name, total in out.items()}
        left, sizes = (beside_ones(x, False).transpose(0, 2, 1).copy() for x in (rows, np.abs(rows)))
        for at, x in enumerate(left):
            np.abs(np.dot(x, right["gap"][at], out=t), out=t)
            if "l1" in wanted:
                part["l1"] += t
            if "neq" in wanted:
                part["neq"] += t != 0
            if "max_diff" in wanted:
                np.maximum(part["max_diff"], t, out=part["max_diff"])
            if "sum_abs" in wanted:
                part["sum_abs"] += np.abs(np.dot(x, right["sum"][at], out=u), out=u)
            if "canberra" in wanted:
                np.maximum(np.dot(sizes[at], right["size"][at], out=u), _LEAST, out=u)
                part["canberra"] += np.divide(t, u, out=u)
    return out


def block_distances(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between the rows of two dense blocks.

    Formulas that subtract products from squares lose what a common offset hides, so the offset goes first:
    the mean row for the euclidean kinds, each row's own mean for the correlation.
    """
    wanted, formula = DISTANCES[check_metric(metric)]
    if formula in (_euclidean, _sqeuclidean) and len(b):
        # To a power of two near the spread, so that equal rows and whole numbers stay exact.
        centre = b.mean(axis=0)
        spread = np.abs(b - centre).max(initial=0.0)
        step = 2.0 ** np.floor(np.log2(spread)) if spread > 0 else 0.0
        centre = np.rint(centre / step) * step if step else b[0]
        a, b = a - centre, b - centre
    elif formula is _correlation and a.shape[1]:
        a, b = (x - x.mean(axis=1, keepdims=True) for x in (a, b))
    side = {}
    for key, block, shape in (("a", a, (-1, 1)), ("b", b, (1, -1))):
        side["n" + key] = (block != 0).sum(axis=1).reshape(shape).astype(float)
        side["s" + key] = block.sum(axis=1).reshape(shape)
        side["q" + key] = (block * block).sum(axis=1).reshape(shape)
    return formula(SimpleNamespace(**block_statistics(a, b, wanted), **side, d=a.shape[1]), ArrayMath)
