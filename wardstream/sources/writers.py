"""Writers: JSON, CSV with a report, nested documents, refreshes, guarded writes, empty stubs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .stages import folder, stage


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str) -> int:
    """Writes with a header; returns the number of rows written, counted as they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("header", True).csv(path)
    return seen.get["n"]


def file_each(rows: DataFrame, key: str, kind: str, read: Callable[[str], DataFrame], rows_a_pass: int = 20_000, rows_a_task: int = 250) -> DataFrame:
    """Writes a file of this kind for each row, in a folder that its key names, and gives what `read` makes of all of them.

    Each key has one row. Spark's driver holds the name and status of every file that it commits or lists,
    so files are written and read `rows_a_pass` at a time, and the driver's memory does not grow with the
    rows. The files stay; what was read is kept as Parquet.
    """
    spark, to, parts, out = rows.sparkSession, *(folder(rows.sparkSession) for _ in range(3))
    kept = stage(rows)
    n = kept.count()
    passes, tasks = max(1, -(-n // rows_a_pass)), max(1, -(-min(n, rows_a_pass) // rows_a_task))
    dealt = kept.withColumn("_pass", F.pmod(F.xxhash64(key), F.lit(passes)).cast("int"))
    dealt.write.partitionBy("_pass").parquet(parts)
    dealt = spark.read.schema(dealt.schema).parquet(parts)
    for i in range(passes):
        dealt.where(F.col("_pass") == i).drop("_pass").repartition(tasks, key).write.partitionBy(key).format(kind).save(f"{to}/{i}")
        read(f"{to}/{i}").coalesce(tasks).write.mode("append").parquet(out)
    return spark.read.parquet(out)


def nested(parents: DataFrame, children: dict[str, DataFrame], key: str) -> DataFrame:
    """Each parent with arrays of its children's rows, sorted; parents without any have empty arrays."""
    for name, c in children.items():
        cols = [x for x in c.columns if x != key]
        kids = c.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
        parents = parents.join(kids, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kids.schema[name].dataType)))
    return parents


def refresh(df: DataFrame, path: str) -> None:
    """Delete and insert as one overwrite."""
    df.write.mode("overwrite").parquet(path)


def keyed(df: DataFrame, *cols: str, name: str = "id") -> DataFrame:
    """A key that depends on the row alone, known before parent and children are split."""
    return df.withColumn(name, F.sha2(F.to_json(F.struct(*cols)), 256))


def guarded(df: DataFrame, path: str, write: bool) -> int:
    """Counts the rows, and writes them only if asked to; either way they are computed once. A write that fails leaves the old rows, as Spark replaces them only then."""
    if not write:
        return df.count()
    seen = Observation()
    refresh(df.observe(seen, F.count(F.lit(1)).alias("n")), path)
    return seen.get["n"]


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)
