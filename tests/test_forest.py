"""Tree ensembles: contributions against every set of features, odd rows, folds by patient."""

import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from wardstream.operators import forest, scoring
from wardstream.queries import models
from wardstream.queries.models import NODES, SCHEMA


def expected(nodes, tree, node, row, known):
    """What a tree is expected to say, if only the known features are seen."""
    n = nodes[tree, node]
    if n["feature"] is None:
        return n["value"]
    left, right = (expected(nodes, tree, n[s], row, known) for s in ("left", "right"))
    if n["feature"] in known:
        x = row[n["feature"]]
        if x is None or not math.isfinite(x):
            return left if n["missing"] == n["left"] else right
        return left if x < n["threshold"] or (n.get("closed") and x == n["threshold"]) else right
    part = nodes[tree, n["left"]]["cover"] / n["cover"]
    return part * left + (1 - part) * right


def by_sets(nodes, row, features):
    trees = sorted({t for t, _ in nodes})
    say = lambda known: sum(expected(nodes, t, 0, row, known) for t in trees)
    out, m = [], len(features)
    for f in features:
        rest = [g for g in features if g != f]
        out.append(sum(math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) * (say({*s, f}) - say(set(s))) for k in range(m) for s in combinations(rest, k)))
    return say(set(features)), say(set()), out


def keyed(rows, closed=False):
    return {(r["tree"], r["node"]): r.asDict() | {"closed": closed} for r in rows}


def test_contributions_equal_all_sets(spark):
    inf, nan = float("inf"), float("nan")
    nodes = spark.createDataFrame(NODES, SCHEMA)
    rows = [(19.0, 0.0, 0.01), (20.0, 0.045, 0.035), (None, None, None), (nan, inf, -inf), (5.0, None, 0.5), (5.0, 0.07, 0.0), (30.0, 0.085, 0.2), (30.0, 0.085, 0.2)]
    df = spark.createDataFrame(rows, "quantity double, discount double, tax double").withColumn("explained", F.lit(1))
    got = forest.explain(df, forest.forest(nodes, ["tax", "quantity", "discount"])).collect()
    assert len(got) == len(rows)
    for r in got:
        margin, base, parts = by_sets(keyed(nodes.collect()), r.asDict(), ["tax", "quantity", "discount"])
        assert r["explained"]["margin"] == pytest.approx(margin)
        assert r["explained"]["contributions"] == pytest.approx(parts)
        assert sum(r["explained"]["contributions"]) == pytest.approx(margin - base)


def test_unused_unknown_and_text_features(spark):
    nodes = spark.createDataFrame(NODES, SCHEMA)
    df = spark.createDataFrame([("5", "none", "0.1", "x"), ("25", "0.07", None, None)], "quantity string, discount string, tax string, `odd.name` string")
    got = [r["explained"]["contributions"] for r in forest.explain(df, forest.forest(nodes, ["quantity", "discount", "tax", "odd.name"])).collect()]
    want = [by_sets(keyed(nodes.collect()), row, ["quantity", "discount", "tax"])[2] for row in ({"quantity": 5.0, "discount": None, "tax": 0.1}, {"quantity": 25.0, "discount": 0.07, "tax": None})]
    assert [g[:3] for g in got] == [pytest.approx(w) for w in want] and [g[3] for g in got] == [0.0, 0.0]
    with pytest.raises(KeyError):
        forest.forest(nodes, ["quantity"])
    assert forest.explain(df.limit(0), forest.forest(nodes, ["quantity", "discount", "tax"])).count() == 0


def test_trees_of_one_leaf_and_no_trees(spark):
    df = spark.createDataFrame([(1.0,)], "a double")
    one = spark.createDataFrame([(0, 0, None, None, None, None, None, 0.25, 9.0)], SCHEMA)
    r = forest.explain(df, forest.forest(one, ["a"])).first()["explained"]
    assert (r["margin"], r["contributions"]) == (0.25, [0.0])
    r = forest.explain(df, forest.forest(one.limit(0), ["a"])).first()["explained"]
    assert (r["margin"], r["contributions"]) == (0.0, [0.0])


def test_cycles_are_refused(spark, monkeypatch):
    monkeypatch.setattr(forest, "DEEPEST", 3)
    with pytest.raises(ValueError):
        forest.conditions(spark.createDataFrame([(0, 0, "a", 1.0, 1, 2, 1, None, 4.0), (0, 1, "a", 0.5, 1, 2, 1, None, 2.0), (0, 2, None, None, None, None, None, 1.0, 2.0)], SCHEMA))


def test_booster_table(spark):
    t = spark.createDataFrame([(0, 0, "a", 1.5, "0-1", "0-2", "0-2", 3.0, 10.0), (0, 1, "Leaf", None, None, None, None, -0.5, 4.0), (0, 2, "Leaf", None, None, None, None, 0.5, 6.0)], "Tree int, Node int, Feature string, Split double, Yes string, No string, Missing string, Gain double, Cover double")
    m = forest.forest(forest.from_booster(t), ["a"])
    got = [r["explained"]["margin"] for r in forest.explain(spark.createDataFrame([(1.0,), (1.5,), (None,)], "a double"), m).collect()]
    assert got == [-0.5, 0.5, 0.5] and m.base == pytest.approx(0.1)


def test_fitted_models_say_what_spark_says(spark):
    """The walked table gives the fitted model's own margins, on bounds too, and its contributions equal all sets."""
    rows = spark.range(600).select(F.pmod(F.col("id") * 7, F.lit(23)).cast("double").alias("a"), F.when(F.col("id") % 4 != 0, (F.col("id") % 10).cast("double")).alias("b"))
    rows = rows.withColumn("label", ((F.col("a") > 11) | F.col("b").isNull()).cast("int"))
    nodes = forest.fit(rows, "label", ["a", "b"], rounds=3, depth=3).cache()
    e = forest.explain(rows, forest.forest(nodes, ["a", "b"], closed=True)).distinct().collect()
    for r in e[:60]:
        margin, base, parts = by_sets(keyed(nodes.collect(), True), r.asDict(), ["a", "b"])
        assert r["explained"]["margin"] == pytest.approx(margin) and r["explained"]["contributions"] == pytest.approx(parts)
        assert (r["explained"]["margin"] > 0) == (r["label"] == 1)


def test_folds(spark):
    rows = spark.range(900).select((F.col("id") % 60).alias("p"), F.rand(3).alias("a"), F.rand(4).alias("score"))
    rows = rows.withColumns({"p": F.when(F.col("p") != 7, F.col("p")), "label": F.when(F.col("a") < 0.95, (F.col("a") > 0.5).cast("int"))})
    o = forest.out_of_fold(rows, "p", "label", ["a"], rounds=3).cache()
    assert o.count() == 900 and o.where("score IS NULL").count() == 0
    assert o.groupBy("p").agg(F.count_distinct("fold").alias("n")).where("n <> 1").count() == 0 and o.select("fold").distinct().count() == 3
    assert o.where(F.abs(F.log(F.col("score") / (1 - F.col("score"))) / 2 - F.col("base") - F.get("contributions", F.lit(0))) > 1e-9).count() == 0
    t = scoring.thresholds(scoring.roc(o.where("label IS NOT NULL"))).first()
    assert t["thresh_high"] > 0.5
    assert forest.out_of_fold(rows.withColumn("label", F.lit(1)), "p", "label", ["a"]).where("score IS NULL AND contributions IS NULL").count() == 900
    assert forest.out_of_fold(rows.limit(0), "p", "label", ["a"]).count() == 0


def test_out_of_fold_query(spark, sf_dir):
    days, o = models.stay_days(spark, sf_dir), models.out_of_fold_scores(spark, sf_dir).cache()
    assert o.count() == days.count() == o.select("user_id", "day").distinct().count()
    assert o.groupBy("user_id").agg(F.count_distinct("fold").alias("n")).where("n <> 1").count() == 0
    assert o.where("score < 0 OR score > 1 OR size(factors) <> 2").count() == 0
