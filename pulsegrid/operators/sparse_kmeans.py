"""k-means on a sparse matrix of any number of rows and columns: joins and sums only.

The cells ``(entity, item, rate)`` lie together by item once. They meet one row an item with the values of all
centres, and the scalar products give every squared distance as q_x - 2 dot + q_c, absent cells being zeros: a
cell is one row whatever the number of centres. Labels and centres are tables, written each round; only counts
and lengths per label and the few candidates for first centres are on the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import checked_small, cut_lineage
from .kmeans import _ROUNDS, _spread_out


# Centres whose products one pass over the cells adds up.
_CENTRES_AT_ONCE = 64


@dataclass(frozen=True)
class SparseFit:
    assigned: DataFrame  # (entity, label) of the rows it was fitted on
    centres: DataFrame  # (model, label, item, value)
    cost: float
    converged: bool = True

    def labels(self, triples: DataFrame) -> DataFrame:
        """``(entity, label)`` of any rows, by the nearest centre."""
        return nearest(triples, self.centres).select("entity", "label")


@dataclass(frozen=True)
class _Centres:
    slots: list[tuple[int, int]]  # (model, label) by place
    norms: list[float | None]  # squared length of each
    values: DataFrame  # (item, values): an array with a place for every centre, null without a cell

    def spelled_out(self) -> DataFrame:
        """``(model, label, item, value)`` of the cells."""
        table = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(l).alias("label")) for m, l in self.slots])
        cells = self.values.select("item", F.posexplode("values").alias("at", "value")).where("value is not null")
        return cells.withColumn("of", F.get(table, F.col("at"))).select("of.model", "of.label", "item", "value")


def _side_by_side(centres: DataFrame) -> _Centres:
    """From ``(model, label, item, value)``."""
    square = F.sum(F.col("value") * F.col("value"))
    found = sorted(tuple(r) for r in centres.groupBy("model", "label").agg(square.alias("qc")).collect())
    slots, norms = [(m, label) for m, label, _ in found], [qc for *_, qc in found]
    own = [F.sum(F.when((F.col("model") == m) & (F.col("label") == label), F.col("value"))) for m, label in slots]
    return _Centres(slots, norms, cut_lineage(centres.groupBy("item").agg(F.array(*own).alias("values"))))


def _products(cells: DataFrame, centres: _Centres) -> DataFrame:
    """``(entity, qx, dots)``: of every row its squared length and its scalar products with all centres."""
    found, parts = None, []
    for low in range(0, max(1, len(centres.slots)), _CENTRES_AT_ONCE):
        places = range(low, min(len(centres.slots), low + _CENTRES_AT_ONCE))
        values = centres.values.select("item", F.slice("values", low + 1, max(1, len(places))).alias("values"))
        dots = [F.coalesce(F.sum(F.col("rate") * F.get("values", F.lit(i - low))), F.lit(0.0)) for i in places]
        sums = [F.array(*dots).cast("array<double>").alias(f"dots{low}")]
        sums += [F.sum(F.col("rate") * F.col("rate")).alias("qx")] if found is None else []
        summed = cells.join(values, "item", "left").groupBy("entity").agg(*sums)
        found = summed if found is None else found.join(summed, "entity", "left")
        # a row without a name has no products
        none = F.array_repeat(F.lit(0.0), len(places))
        parts.append(F.when(F.col("entity").isNotNull(), F.col(f"dots{low}")).otherwise(none))
    return found.select("entity", "qx", F.concat(*parts).alias("dots"))


def _nearest(cells: DataFrame, centres: _Centres) -> DataFrame:
    """``(entity, model, label, gap)``: the nearest centre of every model (lowest label on a tie)."""
    bests = []
    for model in sorted({m for m, _ in centres.slots}):
        gaps = [
            F.struct(
                F.greatest(
                    F.col("qx") + F.lit(qc).cast("double") - 2 * F.get("dots", F.lit(at)), F.lit(0.0)
                ).alias("gap"),
                F.lit(label).alias("label"),
            )
            for at, ((m, label), qc) in enumerate(zip(centres.slots, centres.norms))
            if m == model
        ]
        bests.append(F.struct(F.lit(model).alias("model"), F.array_min(F.array(*gaps)).alias("best")))
    rows = _products(cells, centres).select("entity", F.inline(F.array(*bests)))
    return rows.select("entity", "model", "best.label", "best.gap")


def nearest(triples: DataFrame, centres: DataFrame) -> DataFrame:
    """``(entity, model, label, gap)``: the nearest centre of every model (lowest label on a tie);
    ``centres(model, label, item, value)``."""
    return _nearest(triples, _side_by_side(centres))


def _means(triples: DataFrame, labels: DataFrame, before: _Centres) -> _Centres:
    """The means of the labelled rows; a centre without rows stays as it was."""
    counted = labels.groupBy("model", "label").agg(F.count("*").alias("size")).collect()
    sizes = {(r["model"], r["label"]): r["size"] for r in counted}
    by_model = F.map_from_entries(F.collect_list(F.struct("model", "label"))).alias("of")
    named = checked_small(labels.where("entity is not null").groupBy("entity").agg(by_model))
    cells = triples.join(named, "entity")
    sums = [
        F.sum(F.when(F.try_element_at("of", F.lit(m)) == label, F.col("rate"))) / F.lit(sizes.get((m, label), 1))
        for m, label in before.slots
    ]
    values = cells.groupBy("item").agg(F.array(*sums).alias("values"))
    empty = [at for at, slot in enumerate(before.slots) if slot not in sizes]
    if empty:
        kept = before.values.select("item", F.col("values").alias("kept"))
        values = kept.join(values, "item", "full").select(
            "item",
            F.array(*[F.get("kept" if at in empty else "values", F.lit(at)) for at in range(len(before.slots))]).alias("values"),
        )
    values = cut_lineage(values)
    squares = [F.sum(F.get("values", F.lit(at)) * F.get("values", F.lit(at))) for at in range(len(before.slots))]
    # a centre of rows without a cell is no row's nearest
    norms = [float("inf") if x is None else x for x in values.agg(F.array(*squares).alias("norms")).first()["norms"]]
    return _Centres(before.slots, [before.norms[at] if at in empty else x for at, x in enumerate(norms)], values)


def _chosen_rows(triples: DataFrame, picks: list[tuple[int, int, object]], entity_type: str) -> DataFrame:
    """Rows of the matrix as centres: picks of (model, label, entity)."""
    table = triples.sparkSession.createDataFrame(picks, f"model int, label int, entity {entity_type}")
    return triples.join(F.broadcast(table), "entity").select("model", "label", "item", F.col("rate").alias("value"))


def _first_centres(triples: DataFrame, ks: Sequence[int], seed: int, restarts: int) -> list[tuple[int, int, object]]:
    """(model, label, entity) of the first centres: candidates in rounds over all rows, then weighted
    k-means++ among them, for each model on its own."""
    entity_type = triples.schema["entity"].dataType.simpleString()
    draws = 2 * max(ks)
    first = triples.select("entity").distinct().orderBy(F.xxhash64("entity", F.lit(seed)), "entity").take(1)
    if not first:
        raise ValueError("there is nothing to cluster")
    names = [first[0][0]]
    for turn in range(_ROUNDS):
        centres = _chosen_rows(triples, [(0, i, e) for i, e in enumerate(names)], entity_type)
        bits = F.shiftrightunsigned(F.xxhash64("entity", F.lit(seed), F.lit(turn)), 11)
        u = (bits.cast("double") + 0.5) / float(1 << 53)
        far = nearest(triples, centres).where((F.col("gap") > 1e-9) & ~F.col("entity").isin(names))
        drawn = far.orderBy(-F.log(u) / F.col("gap"), "entity").select("entity").take(draws)
        if not drawn:
            break
        names += [r[0] for r in drawn]
    rows = _chosen_rows(triples, [(0, i, e) for i, e in enumerate(names)], entity_type)
    centres = _side_by_side(rows)
    counted = _nearest(triples, centres).groupBy("label").count().collect()
    weights = np.zeros(len(names))
    for r in counted:
        weights[r["label"]] = r["count"]
    products = np.zeros((len(names), len(names)))
    cells = rows.select(F.col("label").alias("entity"), "item", F.col("value").alias("rate"))
    for r in _products(cells, centres).collect():  # one row for each candidate
        products[r["entity"], [label for _, label in centres.slots]] = r["dots"]
    # Points with these scalar products, to draw from.
    values, axes = np.linalg.eigh((products + products.T) / 2)
    points = axes * np.sqrt(np.maximum(values, 0.0))
    picks = []
    for number, (k, attempt) in enumerate((k, a) for k in ks for a in range(restarts)):
        rows = _spread_out(points, weights, k, np.random.default_rng([seed, k, attempt]))
        places = [int(((points - row) ** 2).sum(axis=1).argmin()) for row in rows]
        picks += [(number, label, names[p]) for label, p in enumerate(places)]
    return picks


def fit_many(
    triples: DataFrame, ks: Sequence[int], seed: int, restarts: int = 10, max_iter: int = 300
) -> dict[int, SparseFit]:
    """The best of ``restarts`` models for every k, all models in the same rounds.

    A model is done when no row changes its label; one that still moves after ``max_iter`` rounds says so
    (``converged``, and a warning). An empty cluster keeps its centre.
    """
    entity_type = triples.schema["entity"].dataType.simpleString()
    # every round reads it twice; an item's cells lie together, so that they meet its centres without a shuffle
    triples = cut_lineage(triples.select("entity", "item", "rate").repartition("item").sortWithinPartitions("item"))
    models = [(k, a) for k in ks for a in range(restarts)]
    centres = _side_by_side(_chosen_rows(triples, _first_centres(triples, ks, seed, restarts), entity_type))
    labels, moved = cut_lineage(_nearest(triples, centres)), None
    for _ in range(max_iter):
        centres = _means(triples, labels, centres)
        before = labels.select("entity", "model", F.col("label").alias("old"))
        labels = cut_lineage(_nearest(triples, centres))
        changed = labels.join(before, ["entity", "model"]).where("label <> old").select("model").distinct()
        moved = {r["model"] for r in changed.collect()}  # at most one row for each model
        if not moved:
            break
    costs = {r["model"]: r["cost"] for r in labels.groupBy("model").agg(F.sum("gap").alias("cost")).collect()}
    best = {}
    for k in ks:
        number = min((n for n, (own, _) in enumerate(models) if own == k), key=lambda n: (costs[n], n))
        if number in (moved or ()):
            warnings.warn(f"k-means with {k} clusters still moved after {max_iter} rounds", stacklevel=2)
        best[k] = SparseFit(
            labels.where(F.col("model") == number).select("entity", "label"),
            centres.spelled_out().where(F.col("model") == number),
            float(costs[number]),
            number not in (moved or ()),
        )
    return best
