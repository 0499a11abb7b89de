"""Readers: nested documents, JSON lines, CSV with checks, YAML specs, JDBC, text profiles."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def patient_of(path: Column) -> Column:
    """patient_<digits> or <id>_Patient, with ids like T01 too, from a path; else the folder's name."""
    known = [F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for p in (r"patient_(T?\d+)", r"/(T\d+|\d+)_Patient")]
    return F.coalesce(*known, F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))


@contextmanager
def listing(spark: SparkSession, tasks: int = 64) -> Iterator[None]:
    """Folders below a path are listed by so many tasks, as by default each of up to 10,000 folders is a task of its own."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(tasks))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def documents(spark: SparkSession, root: str, schema: StructType | str | None = None, files: str | None = "*/hd_*.json") -> DataFrame:
    """One row per element of `documents` in the files below root, all JSON files if `files` is None; hd and d_number from the file, else from its name."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    reader = reader.schema(schema) if schema else reader
    with listing(spark):
        df = reader.json(f"{root}/{files}") if files else reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    df = df.withColumn("_path", F.input_file_name())
    for c in ("hd", "d_number", "date"):
        df = df if c in df.columns else df.withColumn(c, F.lit(None).cast("string"))
    part = lambda g: F.regexp_extract("_path", r"hd_(\d+)_d([+-]?\d+)\.json", g).try_cast("int")
    out = df.select(
        patient_of(F.col("_path")).alias("patient_id"), F.coalesce(F.col("hd").try_cast("int"), part(1)).alias("hd"), F.coalesce(F.col("d_number").try_cast("int"), part(2)).alias("d_number"), "date", F.explode_outer("documents").alias("d")
    )
    return out.select("patient_id", "hd", "d_number", "date", "d.*")


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines): blank lines are skipped, and numbers such as `.367` are given their zero first."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("value", F.regexp_replace("value", r":\s*\.(\d)", ": 0.$1"))
    parsed = lines.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    bad = F.col("r").isNull() | F.try_parse_json("value").isNull()
    return parsed.where(~bad).select("r.*"), parsed.where(bad).select("value")


def csv(spark: SparkSession, path: str, schema: StructType | str | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """CSV with a header; a byte order mark is dropped, and missing columns are an error."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if lack := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} lacks {', '.join(lack)}")
    return df


def tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Parquet tables as frames and temporary views."""
    out = {}
    for n in names:
        out[n] = spark.read.parquet(f"{folder}/{n}.parquet")
        out[n].createOrReplaceTempView(n)
    return out


def jdbc(spark: SparkSession, url: str, query: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 64, predicates: list[str] | None = None, **options: str) -> DataFrame:
    """The rows of a query. With a number column and its bounds, or with predicates that split it, it is read by as many tasks."""
    read = spark.read.options(**options)
    source = f"({query}) q"  # `query` and a partition column exclude each other
    if predicates:
        return read.jdbc(url, source, predicates=predicates, properties={})
    if column and bounds:
        return read.jdbc(url, source, column=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties={})
    return read.jdbc(url, source, properties={})


def spec(path: str, roots: tuple[str, ...] = ()) -> dict:
    """A YAML spec, by its path or below one of the roots; a missing file or parser is an error."""
    import yaml

    for p in (path, *(os.path.join(r, path) for r in roots)):
        if os.path.exists(p):
            with open(p, encoding="utf-8") as f:
                return yaml.safe_load(f) or {}
    raise FileNotFoundError(path)


def profiles(spark: SparkSession, paths: str, patterns: dict[str, str]) -> DataFrame:
    """(path, one column per pattern's first group) of whole text files, all that are below a folder, null where it doesn't match."""
    with listing(spark):
        t = spark.read.text(paths, wholetext=True, recursiveFileLookup="*" not in paths).withColumn("path", F.input_file_name())
    return t.select("path", *[F.nullif(F.regexp_extract("value", p, 1), F.lit("")).alias(n) for n, p in patterns.items()])


#: What a patient's profile names, and how.
PROFILE = {"infection_code": r"(?mU)^#\s*([A-Z]\d+)", "diagnosis": r"(?U)입원 사유[:\s]*\*\*([^*]+)\*\*", "admit_date": r"(?U)(\d{4}-\d{2}-\d{2})"}


def scraped(text: Column, name: str) -> Column:
    """One of the profile's values, trimmed; null where the text doesn't name it."""
    return F.nullif(F.trim(F.regexp_extract(text, PROFILE[name], 1)), F.lit(""))


def first_dates(docs: DataFrame) -> DataFrame:
    """Each patient's earliest date."""
    return docs.groupBy("patient_id").agg(F.min("date").alias("admit_date"))
