"""Tree ensembles as tables: fitting, scores, exact contributions, folds by patient.

A model is a table of nodes (tree, node, feature, threshold, left, right, missing, value, cover): a row
goes left where its feature is below the threshold (or equal, if `closed`), to `missing` where it has no
finite number; leaves have a value and no feature; cover is the weight of the rows that reached a node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stages import folder, stage

#: A model is a parameter that every task holds: more conditions than this are refused.
MOST = 1_000_000
#: Stands for a missing number in fitting, where Spark takes finite ones only.
ABOVE = 1e300
#: Deeper tables are taken for a cycle.
DEEPEST = 100


def from_booster(frame: DataFrame) -> DataFrame:
    """Nodes of a boosted model's table of columns Tree, Node, Feature, Split, Yes, No, Missing, Gain, Cover, where a leaf's Feature is `Leaf` and its Gain the value."""
    leaf = F.col("Feature") == "Leaf"
    place = lambda n: F.substring_index(F.col(n), "-", -1).cast("int")
    return frame.select(
        F.col("Tree").cast("int").alias("tree"), F.col("Node").cast("int").alias("node"), F.when(~leaf, F.col("Feature")).alias("feature"), F.col("Split").cast("double").alias("threshold"),
        place("Yes").alias("left"), place("No").alias("right"), place("Missing").alias("missing"), F.when(leaf, F.col("Gain")).cast("double").alias("value"), F.col("Cover").cast("double").alias("cover"),
    )


def conditions(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, value, feature, low, high, missing, share): what each leaf asks of each feature on its path.

    A feature asked several times is one row: the narrowest bounds, missing only if every question lets
    it through, and the product of the covers' shares. A tree of one leaf has one row without feature.
    Trees are walked level by level, all trees at once; nothing is collected.
    """
    nodes = stage(nodes)
    no_bound = F.lit(None).cast("double")
    sides = F.array(
        F.struct(F.col("left").alias("to"), no_bound.alias("low"), F.col("threshold").alias("high"), (F.col("missing") == F.col("left")).alias("missing")),
        F.struct(F.col("right").alias("to"), F.col("threshold").alias("low"), no_bound.alias("high"), (F.col("missing") == F.col("right")).alias("missing")),
    )
    below = nodes.where("feature IS NOT NULL").select("tree", "node", "feature", "cover", F.inline(sides))
    reached = nodes.select("tree", F.col("node").alias("to"), F.col("cover").alias("_part"))
    share = F.coalesce(F.try_divide("_part", "cover"), F.lit(0.0))
    edges = stage(below.join(reached, ["tree", "to"]).select("tree", "node", "to", F.struct("feature", "low", "high", F.coalesce("missing", F.lit(False)).alias("missing"), share.alias("share")).alias("step")))
    steps = edges.schema["step"].dataType.simpleString()
    front = nodes.select("tree", "node").join(edges.select("tree", F.col("to").alias("node")), ["tree", "node"], "left_anti").withColumn("steps", F.array().cast(f"array<{steps}>"))
    levels = []
    while not (front := stage(front)).isEmpty():
        levels.append(front.join(nodes.where("feature IS NULL").select("tree", "node", "value"), ["tree", "node"]))
        if len(levels) > DEEPEST:
            raise ValueError(f"a tree is deeper than {DEEPEST}, or its nodes lead back to one another")
        front = front.join(edges, ["tree", "node"]).select("tree", F.col("to").alias("node"), F.concat("steps", F.array("step")).alias("steps"))
    if not levels:
        levels = [front.withColumn("value", F.lit(None).cast("double"))]
    leaves = levels[0]
    for level in levels[1:]:
        leaves = leaves.unionByName(level)
    asked = leaves.select("tree", F.col("node").alias("leaf"), "value", F.inline_outer("steps"))
    return asked.groupBy("tree", "leaf", "value", "feature").agg(F.max("low").alias("low"), F.min("high").alias("high"), F.bool_and("missing").alias("missing"), F.product("share").alias("share"))


@dataclass
class Forest:
    """Leaves as arrays: (value, features' places, low, high, missing, share) each; base is the mean score of the rows fitted."""

    features: list[str]
    leaves: list[tuple]
    base: float


def forest(nodes: DataFrame, features: list[str], closed: bool = False) -> Forest:
    """The model in the features' order; features that it doesn't ask have no contribution. An unknown feature is an error."""
    rows = conditions(nodes).orderBy("tree", "leaf", "feature").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"the model asks more than {MOST} conditions")
    at, found, shift = {f: i for i, f in enumerate(features)}, {}, (lambda x: np.nextafter(x, np.inf)) if closed else (lambda x: x)
    for r in rows:
        leaf = found.setdefault((r["tree"], r["leaf"]), (float(r["value"] or 0.0), []))
        if r["feature"] is not None:
            leaf[1].append((at[r["feature"]], -np.inf if r["low"] is None else shift(r["low"]), np.inf if r["high"] is None else shift(r["high"]), r["missing"], r["share"]))
    leaves = [(v, *(np.array(x) for x in (zip(*asked) if asked else [()] * 5))) for v, asked in found.values()]
    return Forest(list(features), leaves, float(sum(v * np.prod(share) for v, *_, share in leaves)))


def shares(value: float, met: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The Shapley values of one leaf's conditions, for each row of `met` (1 where a condition holds).

    A set of known features gets the leaf's value times the shares of the unknown ones, if all its own
    conditions hold. The Shapley value is the integral over t of the product of the others' mixtures
    t * met + (1 - t) * share: a polynomial, which Gauss's rule of half as many points sums exactly.
    """
    d = met.shape[1]
    t, w = np.polynomial.legendre.leggauss(d // 2 + 1)
    t, w = (t + 1) / 2, w / 2
    mixed = met[:, :, None] * t + share[None, :, None] * (1 - t)
    others = np.stack([np.prod(np.delete(mixed, i, axis=1), axis=1) @ w for i in range(d)], axis=1)
    return value * (met - share) * others


def explained(model: Forest) -> callable:
    """A column function of the features: struct(margin, contributions in the features' order), contributions summing up to margin - base.

    Rows that meet the same conditions of a leaf share one computation.
    """

    @F.pandas_udf("margin double, contributions array<double>")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b.to_numpy(dtype=float, na_value=np.nan)
            gone = ~np.isfinite(x)
            margin, parts = np.zeros(len(x)), np.zeros((len(x), len(model.features)))
            for value, at, low, high, missing, share in model.leaves:
                if not len(at):
                    margin += value
                    continue
                col, out = x[:, at], gone[:, at]
                met = np.where(out, missing, (col >= low) & (col < high))
                margin += value * met.all(axis=1)
                kinds, which = np.unique(np.packbits(met, axis=1), axis=0, return_inverse=True)
                seen = np.unpackbits(kinds, axis=1, count=len(at)).astype(float)
                parts[:, at] += shares(value, seen, share)[which.ravel()]
            yield pd.DataFrame({"margin": margin, "contributions": list(parts)})

    return run


def explain(rows: DataFrame, model: Forest, name: str = "explained") -> DataFrame:
    """The rows with a struct column: margin and contributions. A null, text without number, NaN or infinity counts as missing.

    Rows are neither shuffled nor joined, and only the features' columns leave the JVM. Repeated rows
    get equal results; an empty table stays empty; a column of that name is replaced.
    """
    values = F.struct(*[F.col(f"`{f}`").try_cast("double").alias(f) for f in model.features])
    return rows.withColumn(name, explained(model)(values))


def probability(margin: Column, intercept: float = 0.0, scale: float = 1.0) -> Column:
    """The logistic function; scale is 2 for models of `fit`."""
    return 1 / (1 + F.exp(-scale * (margin + intercept)))


def fit(rows: DataFrame, label: str, features: list[str], rounds: int = 10, depth: int = 3, seed: int = 17) -> DataFrame:
    """Nodes of gradient-boosted trees fitted by Spark over all rows whose label is 0 or 1.

    Missing numbers stand above all others while fitting, so they go right; bounds are closed.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    spark, kept = rows.sparkSession, folder(rows.sparkSession)
    number = lambda f: F.col(f"`{f}`").try_cast("double")
    finite = lambda f: F.when(F.abs(number(f)) < ABOVE, number(f)).otherwise(F.lit(ABOVE))
    x = rows.where(F.col(label).isin(0, 1)).select(F.col(label).cast("double").alias("label"), *[finite(f).alias(f"x{i}") for i, f in enumerate(features)])
    x = VectorAssembler(inputCols=[f"x{i}" for i in range(len(features))], outputCol="features").transform(x).select("label", "features")
    fitted = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed).fit(x)
    fitted.write().save(kept)
    n = spark.read.parquet(f"{kept}/data").toDF("treeID", "nodeData").select("treeID", "nodeData.*")
    weight = F.get(F.array(*map(F.lit, fitted.treeWeights)), F.col("treeID").cast("int"))
    inner = F.col("leftChild") >= 0
    return n.select(
        F.col("treeID").cast("int").alias("tree"), F.col("id").cast("int").alias("node"), F.when(inner, F.get(F.array(*map(F.lit, features)), F.col("split.featureIndex"))).alias("feature"),
        F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"), F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"),
        F.when(inner, F.col("rightChild")).alias("missing"), F.when(~inner, F.col("prediction") * weight).alias("value"), F.col("rawCount").cast("double").alias("cover"),
    )


def fold_of(group: Column, folds: int) -> Column:
    """A group's fold, by a hash of its text; rows without group share one fold."""
    return F.pmod(F.xxhash64(F.coalesce(group.cast("string"), F.lit(""))), F.lit(folds)).cast("int")


def out_of_fold(rows: DataFrame, group: str, label: str, features: list[str], folds: int = 3, **how) -> DataFrame:
    """The rows with fold, score (a probability), base and contributions, each from a model that saw no row of its group.

    Folds are dealt by group, so no patient is on both sides. Rows without label are scored, not learned
    from; where the other folds hold no two labels, score, base and contributions are null. Each fold's
    model is fitted by Spark over all other rows; the rows are read once a fold and never joined.
    """
    dealt = stage(rows.withColumn("fold", fold_of(F.col(group), folds)))
    labels = {(r["fold"], r["y"]) for r in dealt.where(F.col(label).isin(0, 1)).groupBy("fold", F.col(label).cast("int").alias("y")).agg(F.lit(1)).collect()}
    out = None
    for k in range(folds):
        held = dealt.where(F.col("fold") == k)
        if len({y for f, y in labels if f != k}) == 2:
            model = forest(fit(dealt.where(F.col("fold") != k), label, features, **how), features, closed=True)
            held = explain(held, model, "_e").withColumns({"score": probability(F.col("_e.margin"), scale=2.0), "base": F.lit(model.base), "contributions": F.col("_e.contributions")}).drop("_e")
        else:
            held = held.withColumns({"score": F.lit(None).cast("double"), "base": F.lit(None).cast("double"), "contributions": F.lit(None).cast("array<double>")})
        out = held if out is None else out.unionByName(held)
    return out
