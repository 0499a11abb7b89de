"""Queries that write releases into the shared folder and read them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import releases as L
from ..sources.stages import folder
from .common import Registry, table

R = Registry()
c = F.col


@R.add("""SELECT c_custkey, c_nationkey, n_orders, total FROM (SELECT c_custkey, c_nationkey FROM customer) JOIN (SELECT o_custkey AS c_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) USING (c_custkey)""")
def released_tables(spark, sf):
    """Two tables published as one; a second release, refused by its gate, leaves both as they were."""
    root = folder(spark)
    people = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    sums = table(spark, sf, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    gate = {"checks": {"sums": {"some": c("n_orders") > 0, "paid": c("total") >= 0}}, "unique": {"people": ["c_custkey"], "sums": ["c_custkey"]}, "links": [("sums", "people", ["c_custkey"])]}
    L.publish(spark, root, {"people": people, "sums": sums}, **gate)
    try:
        L.publish(spark, root, {"people": people.where("c_custkey % 3 = 0"), "sums": sums.withColumn("total", -c("total"))}, **gate)
        raise AssertionError("the gate let a bad release through")
    except L.Rejected:
        return L.read(spark, root, "people").join(L.read(spark, root, "sums"), "c_custkey")


def stays(inputs):
    """Counts, sums and last type of each stay."""
    return inputs["events"].groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))


@R.add("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, arg_max(event_type, (ts, event_id)) AS latest, CASE WHEN user_id % 7 = 0 OR user_id % 11 = 0 THEN 2 ELSE 1 END AS run FROM events GROUP BY user_id")
def refreshed_stays(spark, sf):
    """An earlier state of the events, in which some stays had other values, some were missing and some more were there, brought up to date.

    `run` says which of the two runs computed a stay.
    """
    root, e = folder(spark), table(spark, sf, "events")
    before = e.where("user_id % 11 <> 0").withColumn("value", F.when(c("user_id") % 7 == 0, c("value") + 1).otherwise(c("value")))
    before = before.unionByName(e.where("user_id % 11 = 0").withColumn("user_id", -1 - c("user_id")))
    for run, events in enumerate((before, e), 1):
        L.refresh(spark, root, "stays", {"events": events}, "user_id", lambda x: stays(x).withColumn("run", F.lit(run)), unique={"stays": ["user_id"]})
    return L.read(spark, root, "stays")
