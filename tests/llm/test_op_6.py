"""Operator 6 against all pairs of vectors in double precision."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardstream.llm import vector_dup as V
from wardstream.llm.queries import op6_near_vectors


def brute(rows, cosine=0.9):
    def sound(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ids = [i for i, v in rows if i is not None and sound(v)]
    vecs = [np.array(v, np.float64) for i, v in rows if i is not None and sound(v)]
    parent, links = list(range(len(ids))), [0] * len(ids)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(vecs):
        for j in range(i):
            if len(vecs[j]) == len(x) and x @ vecs[j] / np.sqrt((x @ x) * (vecs[j] @ vecs[j])) >= cosine:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min(least.get(root(k), i), i)
    return {i: (links[k], least[root(k)]) for k, i in enumerate(ids)}


def check(out, rows):
    want = brute(rows)
    assert len(out) == len(rows)
    for r in out:
        assert (r["n_links"], r["component_id"]) == want.get(r["vec_id"], (0, r["vec_id"])), r
        assert r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"])


def test_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(op6_near_vectors(spark, sf_dir).collect(), rows)


@pytest.mark.parametrize("s", [V.Settings(), V.Settings(chunk=20, tile=16), V.Settings(blocks=8, chunk=50)])
def test_groups_chains_and_odd_rows(spark, s):
    rng = np.random.default_rng(3)
    vecs = [*rng.normal(size=(60, 12))]
    for _ in range(150):
        base = vecs[rng.integers(len(vecs))]
        vecs.append(base * rng.uniform(0.1, 10) + rng.normal(size=12) * rng.choice([0, 0.05, 0.2, 0.4]) * np.abs(base).mean())
    rows = [[float(np.float32(x)) for x in v] for v in vecs]
    rows += [rows[0]] * 20 + [None, [], [0.0] * 12, [None] * 12, [float("nan")] + [1.0] * 11, [float("inf")] * 12, [1.0], [2.0], [-1.0], [1.0, 0.0], [1.0, -0.0], [1e-30] * 12, [1e30] * 12]
    rows = [(i, rows[k]) for i, k in enumerate(rng.permutation(len(rows)))] + [(None, rows[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit("clash")).withColumn("n", F.lit(1))
    check(V.near_vectors(df, s).collect(), rows)
    assert V.near_vectors(df.limit(0), s).count() == 0


@pytest.mark.parametrize("s", [V.Settings(blocks=1), V.Settings(blocks=1, chunk=2, tile=2)])
def test_centres_with_the_largest_id(spark, s):
    """Chains 1 - 3 - 2 in planes of their own and a star: the ends are linked through an id larger than theirs only."""
    rows = []
    for k in range(6):
        for i, degrees in zip((1, 3, 2), np.radians([60 * k, 60 * k + 25, 60 * k + 50]), strict=True):
            v = np.zeros(12)
            v[2 * k : 2 * k + 2] = np.cos(degrees), np.sin(degrees)
            rows.append((10 * k + i, v.tolist()))
    one = np.eye(9)
    rows += [(100 + i, (0.45 * one[i] + one[8]).tolist()) for i in range(8)] + [(108, one[8].tolist())]
    check(V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), s).collect(), rows)


@pytest.mark.parametrize("s", [V.Settings(), V.Settings(chunk=50, tile=32)])
def test_chains_of_three_and_four(spark, s):
    """Eighty chains in 64 dimensions, 20 degrees from step to step, ids in all orders: 1-3-2, 1-3-4-2 and the rest."""
    rng, rows = np.random.default_rng(12), []
    orders = [*itertools.permutations((1, 2, 3)), *itertools.permutations((1, 2, 3, 4))]
    for k in range(80):
        a, b = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
        for step, i in enumerate(orders[k % len(orders)]):
            t = np.radians(20 * step)
            rows.append((10 * k + i, [float(np.float32(x)) for x in np.cos(t) * a + np.sin(t) * b]))
    rows += [(2000 + k, [float(np.float32(x)) for x in v]) for k, v in enumerate(rng.normal(size=(60, 64)))]
    df = spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "vec_id long, embedding array<float>")
    check(V.near_vectors(df, s).collect(), rows)


def test_very_large_and_very_small_numbers(spark):
    rows = [(k, v) for k, v in enumerate([[1e200, 1e200], [1e200, 1.1e200], [1e-200, 1e-200], [1e-200, -1e-200], [1e-300, 1.05e-300], [1e300, 1e-300], [1.0, 0.0], [0.0, 5e-324]])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (0, 3), 4: (3, 0), 5: (1, 5), 6: (1, 5), 7: (0, 7)}
