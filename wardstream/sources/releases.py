"""Several tables published as one, behind a gate, and outputs of which only changed keys are computed again.

A release is a manifest: one small Parquet file that names each table's folder. Tables are written to
new folders first; readers follow the newest manifest, so they see all tables of a release or none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "release long, token string, name string, path string, n_rows long"


class Rejected(ValueError):
    """What a release was refused for: {(table, constraint): offending rows}."""

    def __init__(self, found: Mapping[tuple[str, str], int]):
        super().__init__(f"not published: {dict(found)}")
        self.found = dict(found)


def releases(spark: SparkSession, root: str) -> DataFrame:
    """(release, token, name, path, n_rows) of every release; empty where there is none yet."""
    try:
        return spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{root}/manifests")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def current(spark: SparkSession, root: str, release: int | None = None) -> tuple[int, dict[str, str]]:
    """The newest release, or the one named, and its tables' folders; (0, {}) where there is none."""
    r = releases(spark, root)
    top = r.where(F.lit(True) if release is None else F.col("release") == release).agg(F.max(F.struct("release", "token")).alias("m")).first()["m"]
    if top is None:
        if release is not None:
            raise LookupError(f"no release {release} in {root}")
        return 0, {}
    return top["release"], {x["name"]: x["path"] for x in r.where((F.col("release") == top["release"]) & (F.col("token") == top["token"])).collect()}


def read(spark: SparkSession, root: str, name: str, release: int | None = None) -> DataFrame:
    return spark.read.parquet(current(spark, root, release)[1][name])


def _named(spark: SparkSession, root: str, tables: Mapping[str, tuple[str, int | None]]) -> int:
    """Write the manifest of the next release: one row a table, one file, which appears by one rename."""
    number, token = current(spark, root)[0] + 1, uuid.uuid4().hex
    spark.createDataFrame([(number, token, n, p, k) for n, (p, k) in tables.items()], SCHEMA).coalesce(1).write.parquet(f"{root}/manifests/{token}")
    if releases(spark, root).where((F.col("release") == number) & (F.col("token") > token)).limit(1).count():
        raise RuntimeError(f"another writer published release {number} at the same time")
    return number


def publish(
    spark: SparkSession, root: str, tables: Mapping[str, DataFrame], checks: Mapping[str, Mapping[str, Column]] | None = None,
    unique: Mapping[str, Sequence[str]] | None = None, links: Sequence[tuple[str, str, Sequence[str]]] = (),
) -> int:
    """Write all tables and make them the newest release, or none of them; returns its number.

    `checks` are conditions by table and name, counted while the rows are written; null passes, as in
    SQL. `unique` names each table's key; `links` (child, parent, columns) wants each child row with no
    null among the columns to have a parent. Keys and links are tried on the written folders. What is
    refused, or cut off by a lost driver, stays in folders that no manifest names. Tables of the last
    release that aren't given are carried over. One writer at a time; of two, one gets an error.
    """
    token, seen, bad = uuid.uuid4().hex, {}, {}
    to = {n: f"{root}/tables/{token}/{n}" for n in tables}
    for n, df in tables.items():
        rules = dict((checks or {}).get(n, {}))
        seen[n] = Observation()
        counted = [F.count_if(~c).alias(f"c{i}") for i, c in enumerate(rules.values())]
        df.observe(seen[n], F.count(F.lit(1)).alias("n"), *counted).write.parquet(to[n])
        bad |= {(n, rule): seen[n].get[f"c{i}"] for i, rule in enumerate(rules)}
    kept = {n: (p, None) for n, p in current(spark, root)[1].items()}
    where = {n: p for n, (p, _) in kept.items()} | to
    for n, key in (unique or {}).items():
        bad[n, f"unique {', '.join(key)}"] = spark.read.parquet(where[n]).groupBy(*key).count().where("count > 1").count()
    for child, parent, cols in links:
        c = spark.read.parquet(where[child]).select(*cols).dropna()
        bad[child, f"in {parent}"] = c.join(spark.read.parquet(where[parent]).select(*cols), list(cols), "left_anti").count()
    if found := {k: v for k, v in bad.items() if v}:
        raise Rejected(found)
    return _named(spark, root, kept | {n: (to[n], seen[n].get["n"]) for n in tables})


def roll_back(spark: SparkSession, root: str, release: int) -> int:
    """Publish an earlier release's folders again, as a new release; nothing is copied."""
    return _named(spark, root, {n: (p, None) for n, p in current(spark, root, release)[1].items()})


def digests(inputs: Mapping[str, DataFrame], key: str) -> DataFrame:
    """(key, digest): what all rows of a key hold over all inputs, whatever their order; repeated rows count.

    Rows are hashed where they lie and summed up before the shuffle. Columns count by name, so their
    order doesn't matter, and a table's rows don't count as another's.
    """
    parts = None
    for name, df in inputs.items():
        row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
        h = df.select(F.col(key), F.xxhash64(F.lit(name), row).alias("a"), F.xxhash64(row, F.lit(name)).alias("b"))
        parts = h if parts is None else parts.unionByName(h)
    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).cast("string")
    return parts.groupBy(key).agg(F.concat_ws(":", F.count(F.lit(1)), total("a"), total("b")).alias("digest"))


def refresh(spark: SparkSession, root: str, name: str, inputs: Mapping[str, DataFrame], key: str, compute: Callable[[dict[str, DataFrame]], DataFrame], **gate) -> dict[str, int]:
    """Bring an output up to date with its inputs; returns how many keys were computed, kept and dropped.

    `compute` makes the output from the inputs' rows of the keys given to it, each key for itself, and
    keeps the key column. Digests are published beside the output, as one release. Keys whose digest is
    unchanged keep their rows and aren't computed; keys without input lose theirs; a null key counts as
    a key. With nothing changed nothing is written. The output's columns must stay the same; for
    another `compute` take another name.
    """
    marks, had = f"{name}_digests", current(spark, root)[1]
    to = f"{root}/tables/{uuid.uuid4().hex}/compared"
    new = digests(inputs, key).select(F.col(key).alias("_k"), F.col("digest").alias("_new"))
    old = spark.read.parquet(had[marks]).select(F.col(key).alias("_o"), F.col("digest").alias("_old")) if marks in had else new.select(F.col("_k").alias("_o"), F.col("_new").alias("_old")).limit(0)
    both = new.join(old, F.col("_k").eqNullSafe(F.col("_o")), "full")
    state = F.when(F.col("_new").isNull(), "dropped").when(F.col("_old").eqNullSafe(F.col("_new")), "kept").otherwise("computed")
    both.select(F.when(F.col("_new").isNull(), F.col("_o")).otherwise(F.col("_k")).alias("_k"), F.col("_new").alias("digest"), state.alias("state")).write.parquet(to)
    compared = spark.read.parquet(to)
    n = {"computed": 0, "kept": 0, "dropped": 0} | {r["state"]: r["count"] for r in compared.groupBy("state").count().collect()}
    if not n["computed"] and not n["dropped"] and marks in had:
        return n
    of = lambda df, *states: df.join(compared.where(F.col("state").isin(*states)).select("_k"), F.col(key).eqNullSafe(F.col("_k")), "left_semi")
    out = compute({k: of(df, "computed") for k, df in inputs.items()})
    if name in had:
        out = out.unionByName(of(spark.read.parquet(had[name]), "kept"))
    publish(spark, root, {name: out, marks: compared.where("state <> 'dropped'").select(F.col("_k").alias(key), "digest")}, **gate)
    return n
