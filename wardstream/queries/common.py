"""What the registered queries share: tables, and measurements derived from the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import hours_between


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as measurements: a user is a stay from its first to its last event, h is the full hours since the first."""
    e = table(spark, sf_dir, "events")
    e = e.join(e.groupBy("user_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1")), "user_id")
    return e.withColumn("h", F.floor(hours_between(F.col("ts"), F.col("t0"))).cast("int"))


#: The same in SQL.
MEASURED = """m AS (SELECT *, CAST(floor((epoch_us(ts) - epoch_us(t0)) / 3600000000) AS INTEGER) AS h FROM
  (SELECT *, min(ts) OVER (PARTITION BY user_id) AS t0, max(ts) OVER (PARTITION BY user_id) AS t1 FROM events))"""


def item(name: str):
    """The value where the event is of this type, else null."""
    return F.when(F.col("event_type") == name, F.col("value"))


class Registry:
    """Queries and their SQL by name."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, sql: str | None = None):
        def keep(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep
