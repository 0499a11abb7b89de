"""Releases of several tables: gates, rollback, writes cut off; outputs of which only changed keys are computed."""

import pytest
from pyspark.sql import functions as F

from wardstream.sources import releases as L


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "released")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_all_or_nothing(spark, root):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "id long, t string"), spark.createDataFrame([(1, 5.0), (None, 6.0)], "id long, v double")
    gate = {"checks": {"b": {"positive": F.col("v") > 0}, "a": {"known": F.col("t") == "x"}}, "unique": {"a": ["id"]}, "links": [("b", "a", ["id"])]}
    assert L.current(spark, root) == (0, {}) and L.publish(spark, root, {"a": a, "b": b}, **gate) == 1
    for bad, why in (
        ({"a": a, "b": b.withColumn("v", -F.col("v"))}, {("b", "positive"): 2}), ({"a": a.union(a), "b": b}, {("a", "unique id"): 2}),
        ({"b": b.withColumn("id", F.lit(9).cast("long"))}, {("b", "in a"): 2}), ({"a": a.limit(0)}, {("b", "in a"): 1}),
    ):
        with pytest.raises(L.Rejected) as e:
            L.publish(spark, root, bad, **gate)
        assert e.value.found == why and L.current(spark, root)[0] == 1
        assert rows(L.read(spark, root, "a")) == rows(a) and rows(L.read(spark, root, "b")) == rows(b)


def test_a_killed_write_changes_nothing(spark, root):
    a = spark.range(5).toDF("id")
    L.publish(spark, root, {"a": a, "b": a})
    broken = spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        L.publish(spark, root, {"a": a.union(a), "b": broken})
    assert L.current(spark, root)[0] == 1 and L.read(spark, root, "a").count() == 5
    assert L.publish(spark, root, {"a": a.union(a)}) == 2
    assert L.read(spark, root, "a").count() == 10 and L.read(spark, root, "b").count() == 5


def test_rollback_and_empty_tables(spark, root):
    a = spark.range(3).toDF("id")
    L.publish(spark, root, {"a": a})
    L.publish(spark, root, {"a": a.where("id > 5")}, checks={"a": {"any": F.col("id") > 0}}, unique={"a": ["id"]})
    assert L.read(spark, root, "a").count() == 0 and L.read(spark, root, "a", 1).count() == 3
    assert L.roll_back(spark, root, 1) == 3 and rows(L.read(spark, root, "a")) == rows(a)
    with pytest.raises(LookupError):
        L.roll_back(spark, root, 9)
    assert [r["n_rows"] for r in L.releases(spark, root).orderBy("release").collect()] == [3, 0, None]


def test_digests(spark):
    d = lambda **t: dict(map(tuple, L.digests({n: spark.createDataFrame(x, "k long, v string") for n, x in t.items()}, "k").collect()))
    base = d(a=[(1, "x"), (1, "y"), (None, "z")], b=[(2, "x")])
    assert base == d(a=[(None, "z"), (1, "y"), (1, "x")], b=[(2, "x")]) and set(base) == {1, 2, None}
    assert base[1] != d(a=[(1, "x"), (1, "y"), (1, "y")])[1] and base[2] != d(a=[(2, "x")])[2]
    assert d(a=[(1, None)])[1] != d(a=[(1, "")])[1] and d(a=[(1, "x")] * 2)[1] != d(a=[(1, "y")] * 2)[1]


def test_only_changed_keys_are_computed(spark, root):
    def events(x):
        return spark.createDataFrame(x, "k long, v double")

    given = []

    def compute(inputs):
        e = inputs["e"].cache()
        given.append(sorted((r["k"] for r in e.select("k").distinct().collect()), key=repr))
        return e.groupBy("k").agg(F.sum("v").alias("s"))

    run = lambda x: L.refresh(spark, root, "out", {"e": events(x)}, "k", compute)
    first = [(1, 1.0), (1, 2.0), (2, 5.0), (None, 7.0)]
    assert run(first) == {"computed": 3, "kept": 0, "dropped": 0}
    assert run(first[::-1]) == {"computed": 0, "kept": 3, "dropped": 0} and len(given) == 1 and L.current(spark, root)[0] == 1
    assert run([(1, 1.0), (1, 2.5), (2, 5.0), (None, 7.0)]) == {"computed": 1, "kept": 2, "dropped": 0} and given[-1] == [1]
    assert rows(L.read(spark, root, "out")) == rows(events([(1, 3.5), (2, 5.0), (None, 7.0)]))
    assert run([(2, 5.0), (2, None), (3, 1.0)]) == {"computed": 2, "kept": 0, "dropped": 2} and given[-1] == [2, 3]
    assert rows(L.read(spark, root, "out")) == rows(events([(2, 5.0), (3, 1.0)]))
    assert run([]) == {"computed": 0, "kept": 0, "dropped": 2} and L.read(spark, root, "out").count() == 0


def test_a_refused_refresh_is_computed_again(spark, root):
    e = spark.createDataFrame([(1, 1.0), (2, -1.0)], "k long, v double")
    run = lambda rule: L.refresh(spark, root, "out", {"e": e}, "k", lambda x: x["e"], checks={"out": {"rule": rule}})
    with pytest.raises(L.Rejected):
        run(F.col("v") > 0)
    assert L.current(spark, root) == (0, {}) and run(F.col("v") > -2)["computed"] == 2
