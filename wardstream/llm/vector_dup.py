"""Embedding near-duplicates: a subspace pigeonhole join, verified exactly.

Unit vectors of cosine c or more lie within a squared distance of 2 - 2c. Rotated and split into
blocks, at least one block of such a pair keeps within its proportional share of it. Within each
block, vectors are dealt into slabs along the block's first axis that are as wide as the block's
distance budget, so that a pair meets in one slab or in two adjoining ones; there the block's
distance sieves, and what is left is verified on the whole vectors in double precision. A pair is
counted in the first block that admits it, so the union over blocks needs no further pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, FloatType, IntegerType, LongType, StructField, StructType

from .common import components, cut, map_rows


@dataclass(frozen=True)
class Settings:
    """chunk: vectors of a slab that meet in one task at once; a larger slab is dealt over several chunks, each pair of which meets once."""

    cosine: float = 0.9
    blocks: int = 4
    chunk: int = 16_384
    tile: int = 1024
    seed: int = 9


def rotation(dim: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))[0]


def bounds(dim: int, s: Settings) -> list[tuple[int, int, float]]:
    """(from, to, squared-distance budget) of each block; a little more than its share, for rounding."""
    edge = np.linspace(0, dim, min(s.blocks, dim) + 1).astype(int)
    whole = 2 - 2 * s.cosine + 1e-9
    return [(int(a), int(b), whole * (b - a) / dim + 1e-9) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two, which changes no cosine, so that no square is too large or too small."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def slabs(vectors: DataFrame, s: Settings) -> DataFrame:
    """(rep, n, vec) dealt out as (dim, block, slab, rep, n, vec, home): each into its own slab and into the one below, as a guest."""

    def rows(batch):
        import pyarrow as pa

        reps, vecs = batch.column(0).to_numpy(), batch.column(2)
        by_dim: dict[int, list[int]] = {}
        for i, n in enumerate(vecs.value_lengths().to_pylist()):
            by_dim.setdefault(n, []).append(i)
        out = {k: [] for k in ("dim", "block", "slab", "rep", "at", "home")}
        for dim, rows in by_dim.items():
            x = unit(np.array(vecs.take(pa.array(rows)).to_pylist(), np.float64)) @ rotation(dim, s.seed)
            for k, (a, _, budget) in enumerate(bounds(dim, s)):
                slab = np.floor(x[:, a] / np.sqrt(budget)).astype(np.int64)
                for below in (0, 1):
                    for key, v in (("dim", np.full(len(rows), dim)), ("block", np.full(len(rows), k)), ("slab", slab - below), ("rep", reps[rows]), ("at", np.array(rows)), ("home", np.full(len(rows), below == 0))):
                        out[key].append(v)
        cat = {k: np.concatenate(v) if v else np.empty(0) for k, v in out.items()}
        at = pa.array(cat["at"].astype(np.int64))
        return {"dim": pa.array(cat["dim"].astype(np.int32)), "block": pa.array(cat["block"].astype(np.int32)), "slab": pa.array(cat["slab"].astype(np.int32)), "rep": pa.array(cat["rep"].astype(np.int64)), "n": batch.column(1).take(at), "vec": vecs.take(at), "home": pa.array(cat["home"].astype(bool))}

    schema = StructType([*[StructField(c, IntegerType()) for c in ("dim", "block", "slab")], StructField("rep", LongType()), StructField("n", LongType()), StructField("vec", vectors.schema["vec"].dataType), StructField("home", BooleanType())])
    return map_rows(vectors.select("rep", "n", "vec"), rows, schema)


def linked(x: np.ndarray, y: np.ndarray, fx: np.ndarray, fy: np.ndarray, block: int, s: Settings):
    """Index pairs (i, j) of rows of x and y that are near enough and are admitted by this block first; fx, fy are rotated unit vectors."""
    parts = bounds(x.shape[1], s)
    a, b, budget = parts[block]
    p, q = fx[:, a:b], fy[:, a:b]
    half = lambda v: -0.5 * (v * v).sum(1, keepdims=True)
    one = lambda v: np.ones((len(v), 1))
    # p . q - |p|^2 / 2 - |q|^2 / 2 is minus half the squared distance: one product, one comparison
    left, right = np.hstack([p, half(p), one(p)]).astype(np.float32), np.hstack([q, one(q), half(q)]).astype(np.float32)
    near = left @ right.T >= -0.5 * budget - 1e-5
    i, j = np.divmod(np.flatnonzero(near), len(y))  # much faster than the places of a matrix
    if not len(i):
        return i, j
    for k, (c, d, most) in enumerate(parts[: block + 1]):
        inside = ((fx[i, c:d] - fy[j, c:d]) ** 2).sum(1) <= most
        ok = inside if k == block else ~inside
        i, j = i[ok], j[ok]
    ok = np.einsum("ij,ij->i", x[i], y[j]) / np.sqrt(np.einsum("ij,ij->i", x[i], x[i]) * np.einsum("ij,ij->i", y[j], y[j])) >= s.cosine
    return i[ok], j[ok]


def hung(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root, which names the smallest row of each row's component, after the components of rows i and j have been joined."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j = i[apart], j[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root != (up := root[root])).any():
            root = up
    return root


def joined(pdf, s: Settings):
    """Links among the rows of one slab and pair of chunks: for each row, how many vectors it is linked with here, and the smallest of all that these links reach."""
    import pandas as pd

    pdf = pdf.sort_values(["home", "rep"], ascending=[False, True])  # guests last: two of them aren't compared here
    rep, n, home, part = (pdf[c].to_numpy() for c in ("rep", "n", "home", "own"))
    x = scaled(np.array(pdf["vec"].tolist(), np.float64))
    f = unit(x) @ rotation(x.shape[1], s.seed)
    block, low, high = int(pdf["block"].iloc[0]), int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
    first, _, budget = bounds(x.shape[1], s)[block]
    order = np.lexsort((f[:, first], ~home))
    rep, n, home, part, x, f = (v[order] for v in (rep, n, home, part, x, f))
    links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
    tiles = [np.arange(a, min(a + s.tile, len(rep))) for a in range(0, len(rep), s.tile)]
    ends = [(f[t, first].min(), f[t, first].max()) for t in tiles]
    far = lambda p, q: max(p[0] - q[1], q[0] - p[1]) > np.sqrt(budget) + 1e-6  # noqa: E731  along the block's first axis
    for u, one in enumerate(tiles):
        for two in [t for t, e in zip(tiles[u:], ends[u:], strict=True) if not far(ends[u], e)] if home[one[0]] else []:
            i, j = linked(x[one], x[two], f[one], f[two], block, s)
            i, j = one[i], two[j]
            # both at home, or one a guest from the slab above; each pair of chunks is met once
            ok = (rep[i] != rep[j]) & (home[i] | home[j]) & (np.minimum(part[i], part[j]) == low) & (np.maximum(part[i], part[j]) == high)
            ok &= (i < j) if one is two else True
            i, j = i[ok], j[ok]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            root = hung(root, i, j)
    some, least = links > 0, rep.copy()
    np.minimum.at(least, root, rep)
    return pd.DataFrame({"rep": rep[some], "links": links[some], "least": least[root][some]})


def near_vectors(vectors: DataFrame, s: Settings = Settings(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    n_links counts the other rows with cosine >= s.cosine, component_id is the smallest id reachable
    by links. Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing, and so do vectors of different length. Equal vectors are one class from the start, so
    copies are never paired. Ids are whole numbers; a row of a null id is linked with nothing, and is
    kept; repeated rows count as vectors of their own with their id's component. Other columns are not read.

    How many pairs the sieve sees grows with the square of a slab's rows, as the number of slabs
    doesn't grow with the input; the rows are counted before, and the chunks are dealt accordingly.
    """
    # single precision travels as it is, and is widened where it is compared
    kind = "float" if vectors.schema[vec_col].dataType == ArrayType(FloatType(), vectors.schema[vec_col].dataType.containsNull) else "double"
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast(kind)).alias("vec"))
    sound = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0) & F.col("id").isNotNull(), F.lit(False))
    v = v.withColumn("sound", sound).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0).cast(kind)))  # one zero
    v = v.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.hash("vec"))
    classes = cut(v.where("sound").groupBy("h1", "h2", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("n")).select("h1", "h2", "rep", "n", "vec"))
    dealt = slabs(classes, s)
    sizes = cut(dealt.groupBy("dim", "block", "slab").agg(F.ceil(F.count("*") / s.chunk).cast("int").alias("chunks")))
    own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least("own", k).alias("low"), F.greatest("own", k).alias("high")))
    few = sizes.count() <= 100_000
    met = dealt.join(F.broadcast(sizes) if few else sizes, ["dim", "block", "slab"]).withColumn("own", own).withColumn("pair", F.explode(pairs)).select("dim", "block", "slab", "rep", "n", "vec", "home", "own", "pair.low", "pair.high")
    found = cut(met.groupBy("dim", "block", "slab", "low", "high").applyInPandas(lambda pdf: joined(pdf, s), "rep long, links long, least long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("least").alias("a"), F.col("rep").alias("b")))
    result = cut(
        classes.select("h1", "h2", "vec", "rep", "n").join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
        .select("h1", "h2", F.col("vec").alias("v2"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    one = v.where("sound").join(result, ["h1", "h2"]).where("vec = v2").select("id", "n_links", "component_id")
    alone = v.where("NOT sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return one.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
