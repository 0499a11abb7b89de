"""A file per row, so many at a time: the driver never commits or lists them all at once."""

import os
from functools import partial

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from test_oracles import plain
from wardstream.queries import files
from wardstream.sources import readers, writers


def below(folder: str) -> list[str]:
    return [f"{d}/{n}" for d, _, names in os.walk(folder.removeprefix("file:")) for n in names if n.startswith("part-")]


def test_files_come_in_passes_and_stay(spark):
    rows, at = spark.range(23).select(F.format_string("k %d/ä", "id").alias("k"), F.concat(F.lit("# A0"), "id", F.lit("\n입원일 2024-01-01")).alias("value")), []
    got = writers.file_each(rows, "k", "text", lambda to: at.append(to) or readers.profiles(spark, to, {"n": r"A0(\d+)", "none": "(x)"}), rows_a_pass=5, rows_a_task=2)
    assert sorted(int(r["n"]) for r in got.collect()) == list(range(23)) and got.where("none IS NOT NULL").isEmpty()
    each = [len(below(x)) for x in at]
    assert len(at) == 5 and sum(each) == 23 and max(each) < 23
    none = writers.file_each(rows.limit(0), "k", "text", lambda to: readers.profiles(spark, to, {"n": r"A0(\d+)"}))
    assert none.count() == 0


def test_listing_is_given_back(spark):
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), readers.listing(spark, 3):
        assert spark.conf.get(name) == "3" and 1 / 0
    assert spark.conf.get(name) == before


@pytest.mark.parametrize("name", ["nested_documents", "profile_files"])
def test_queries_hold_few_files_at_once(spark, monkeypatch, name):
    reader, seen = {"nested_documents": "documents", "profile_files": "profiles"}[name], []
    monkeypatch.setattr(readers, reader, lambda s, at, *a, f=getattr(readers, reader): seen.append(len(below(at))) or f(s, at, *a))
    monkeypatch.setattr(writers, "file_each", partial(writers.file_each, rows_a_pass=4))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    assert plain(files.R.queries[name](spark, SMALL).toPandas()) == plain(con.execute(files.R.sql[name]).df())
    assert sum(seen) == 15 and len(seen) == 4 and max(seen) < 15
