"""Mix sources to target weights by Efraimidis-Spirakis sampling.

Each source has a token budget. The epochs that fit it whole are taken first; the rest of the budget is
filled in the order of exponential keys -ln(u) / w, w a document's quality weight and u a number that
its id and text determine, so reruns agree.

The prefix sum needs an order within a source, and one source may hold a third of all rows: keys are
first counted into BINS ranges per source, map-side combined; only the one range in which the budget
ends is put in order row by row. Everything is DataFrame functions over one narrow checkpointed table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import checked_small, cut_lineage
from .common import whole_text, word_count

# Weights of the sources in code point order, repeating.
CYCLE = (3.0, 1.0, 2.0)
# All targets together, and the largest target of a source, as multiples of what there is.
SHARE, MOST = 1.5, 2.0
# Ranges of keys counted per source. One range of a source holds about 1/BINS of its rows.
BINS = 1 << 16


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) that id and text determine."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(text)))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, cycle=CYCLE, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target: one row per source (sources are counted in thousands, not rows).

    A target is weight * level, at most ``most`` times the source's size; the level is the one at which
    all targets add up to ``share`` times all sizes, which is where resharing every excess ends.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    per = per.withColumn("weight", F.get(weights, (F.row_number().over(by_name) - 1) % len(cycle)))
    per = per.withColumn("cap", F.col("source_size") * float(most))
    # In the order in which sources reach their cap, those before are full; the level is what is left
    # over the weights that are left. The first source that stays under its cap has the final level,
    # and no later one has a higher level.
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", left / weight_left)
    final = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    target = F.least(F.col("weight") * F.coalesce(final, F.lit(float("inf"))), F.col("cap"))
    return per.select("source", "source_size", target.alias("target"))


def sized(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """doc_id, source, size, key of every row; weights: doc_id, weight (absent: 1; not above 0: last)."""
    rows = docs.select(
        "doc_id",
        F.col("source"),
        word_count(whole_text()).alias("size"),
        uniform(F.col("doc_id"), whole_text()).alias("u"),
    )
    weight = F.lit(1.0)
    if weights is not None:
        weights = weights.groupBy(F.col("doc_id").alias("of")).agg(F.max("weight").cast("double").alias("weight"))
        rows = rows.join(weights, F.col("doc_id") == F.col("of"), "left")
        weight = F.coalesce("weight", F.lit(1.0))
    key = F.when(weight > 0, -F.log("u") / weight).otherwise(float("inf"))
    return rows.select("doc_id", "source", "size", key.alias("key"))


def mix(sizes: DataFrame, targets: DataFrame, bins: int = BINS) -> DataFrame:
    """doc_id, size, source_size, target, epochs, rest: each row is taken epochs times and, of one more
    copy, its first rest words.

    A source's rest of a budget goes to the documents in key order; the one in which it ends gives the
    words that are left. Ties in the key go by id, then size. Empty texts and empty sources take 0.
    """
    # 1 - exp(-key) is even for weight 1, so ranges of it hold similar numbers of rows.
    rows = sizes.withColumn("bin", F.least(F.floor((1 - F.exp(-F.col("key"))) * bins), F.lit(bins - 1)).cast("int"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("epochs", epochs.cast("long"))
    plan = plan.withColumn(
        "budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    ).withColumnRenamed("source", "of")
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    ends = ends.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    ends = ends.join(checked_small(plan), F.col("source").eqNullSafe(F.col("of"))).where(
        (F.col("before") < F.col("budget")) & (F.col("before") + F.col("words") >= F.col("budget"))
    )
    ends = ends.select(F.col("of").alias("end_of"), F.col("bin").alias("end_bin"), F.col("before").alias("end_before"))
    plan = plan.join(ends, F.col("of").eqNullSafe(F.col("end_of")), "left")
    rows = rows.join(checked_small(plan), F.col("source").eqNullSafe(F.col("of")))
    # No range ends the budget: it is 0.
    whole = F.col("bin") < F.coalesce("end_bin", F.lit(0))
    last = F.coalesce(F.col("bin") == F.col("end_bin"), F.lit(False))
    kept = ["doc_id", "size", "source_size", "target", "epochs"]
    clear = rows.where(~last).select(*kept, F.when(whole, F.col("size")).otherwise(0).alias("rest"))
    order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
    through = F.col("end_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    part = F.least(F.greatest(F.col("budget") - (through - F.col("size")), F.lit(0)), F.col("size"))
    return clear.unionByName(rows.where(last).select(*kept, part.alias("rest")))


def mix_documents(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """doc_id, size, source_size, target, epochs, rest of every document (see ``mix``).

    Null texts are empty texts, a null source is a source of its own and the last one; repeated rows are
    rows of their own; an empty table gives no rows; other columns are not read.
    """
    sizes = cut_lineage(sized(docs, weights))
    return mix(sizes, source_targets(sizes))


def repeat_documents(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix as documents, whole ones only: every row as often as it is taken, a last copy counting
    when at least half of its words are. Rows that agree in id and size share what they take evenly."""
    copies = F.col("epochs") + (F.col("rest") * 2 >= F.greatest(F.col("size"), F.lit(1))).cast("long")
    per = mixed.withColumn("copies", copies).groupBy(F.col("doc_id").alias("of"), F.col("size").alias("of_size"))
    per = per.agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n_rows"))
    each = Window.partitionBy("doc_id", "size").orderBy("doc_id")
    rows = docs.select("doc_id", word_count(whole_text()).alias("size"), F.struct("*").alias("row"))
    met = rows.join(per, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size")))
    one, many = met.where("n_rows = 1"), met.where("n_rows > 1").withColumn("nth", F.row_number().over(each))
    share = F.floor(F.col("copies") / F.col("n_rows")) + (F.col("nth") <= F.col("copies") % F.col("n_rows")).cast("long")
    rows = one.select("row", "copies").unionByName(many.select("row", share.alias("copies")))
    return rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
