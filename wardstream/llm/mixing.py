"""Mixing sources to target weights by exponential-key sampling without replacement.

Each document gets the key -ln(u) / weight with u from a hash of its id, so that heavier documents
tend to come first; within a source, documents are taken in key order until the source's budget is
spent. A budget of more than the source's size first takes complete epochs, and only the rest is
selected. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, all_of, cut, few_rows

#: Plans of at most this many sources are broadcast; larger ones are joined by a salted shuffle.
BROADCAST_SOURCES = 10_000
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds target to (source, source_size): one row per source, the only table that is sorted as a whole.

    Sources by code point, null last, weigh `weights` in turn and split `share` of all sizes; no
    target exceeds `most` times its source's size, and the excess goes to the others by weight. The
    sources that end at their cap are those with the least cap for their weight, so one pass in that
    order gives the level at which the resharing comes to rest.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    free = F.col("cap") > F.col("level") * F.col("w")
    s = s.withColumn("rest", F.first(F.when(free, F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("source", "source_size", F.coalesce(F.least("cap", F.col("rest") * F.col("w")), F.col("cap")).alias("target"))


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Joins the plan's row of each source; a source that holds most rows is dealt over all salts."""
    if few_rows(plan, BROADCAST_SOURCES):
        return rows.join(F.broadcast(plan), "key")
    dealt = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id", "size"), F.lit(SALTS)).cast("int")).join(dealt, ["key", "salt"]).drop("salt")


def mix(
    docs: DataFrame, weight: Column | None = None, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, size: Column | None = None,
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, epochs, taken.

    size is the text's number of words (null or empty: 0), taken the words the mix takes with
    repeats counted (`size` gives the sizes where they are known already): size * epochs, and one more time for those selected in key order; the document
    at the edge gives the words that are still missing. `weight` is a column of quality weights
    (null, not positive or not finite: 1). Documents of equal id get equal keys and are ordered by
    size; equal rows get shares that add up alike in every run. A null source is a source. The
    empty table gives an empty result.

    No document is shuffled: sums over about sqrt(rows) key ranges of each source show the one
    range that holds the edge, and only its rows are sorted.
    """
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col)))
    given = F.coalesce(weight.cast("double"), F.lit(1.0)) if weight is not None else F.lit(1.0)
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = cut(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("key"), (word_count(F.col(text_col)) if size is None else size.cast("long")).alias("size"), given.alias("w"), u.alias("u"))
        .withColumn("w", F.when((F.col("w") > 0) & (F.col("w") < float("inf")), F.col("w")).otherwise(1.0))
        .select("id", "source", "key", "size", (-F.log("u") / F.col("w")).alias("e"), "w")
    )
    per = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n"), F.avg("w").alias("mean_w"))
    aims = targets(per.select("source", "source_size"), weights, share, most)
    plan = cut(
        per.drop("source_size")
        .join(aims.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + 1e-9), F.floor(F.lit(float(most))))).otherwise(0).cast("long"))
        .withColumn("missing", F.greatest(F.lit(0), F.round(F.col("target") - F.col("epochs") * F.col("source_size"))).cast("long"))
        .withColumn("ranges", F.ceil(F.sqrt("n")))
    )
    at = F.least(F.floor((1 - F.exp(-F.col("e") * F.col("mean_w"))) * F.col("ranges")), F.col("ranges") - 1)
    rows = with_plan(rows, plan.drop("source")).withColumn("range", at)
    sums = rows.groupBy("key", "range").agg(F.sum("size").alias("sum"), F.first("missing").alias("missing"))
    below = F.coalesce(F.sum("sum").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("below", below)
    edge = cut(
        plan.select("key").join(
            sums.where("below < missing AND below + sum >= missing").groupBy("key").agg(F.min("range").alias("edge"), F.min_by("below", "range").alias("below")), "key", "left"
        )
    )
    rows = with_plan(rows, edge)
    full, none = F.col("size"), F.lit(0).cast("long")
    # without an edge nothing is missing, or the whole source is
    far = rows.where("edge IS NULL OR range <> edge").withColumn("part", F.when(F.col("range") < F.col("edge"), full).otherwise(none))
    first = F.sum("size").over(Window.partitionBy("key").orderBy("e", "id", "size").rowsBetween(Window.unboundedPreceding, -1))
    near = rows.where("range = edge").withColumn("part", F.greatest(none, F.least(full, F.col("missing") - F.col("below") - F.coalesce(first, none))))
    return all_of([far, near]).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "epochs", (F.col("size") * F.col("epochs") + F.col("part")).alias("taken")
    )


def quality_weight(labels: DataFrame, docs: DataFrame, id_col: str = "doc_id", good: float = 2.0, bad: float = 0.5) -> DataFrame:
    """docs with a column quality_weight: good or bad as the labels say, 1 where they are silent; the best label counts."""
    best = labels.groupBy(F.col(id_col).alias("labelled")).agg(F.max("quality").alias("best"))
    weight = F.when(F.col("best") == 1, good).when(F.col("best") == 0, bad).otherwise(1.0)
    return docs.join(best, F.col(id_col) == F.col("labelled"), "left").withColumn("quality_weight", weight).drop("labelled", "best")
