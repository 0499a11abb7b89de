"""Files written into the shared folder and read back: nested documents, profiles, JSON lines, CSV, refreshes, views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers, writers
from ..sources.stages import folder
from .common import Registry, table
from .notes import K, _k

R = Registry()
c = F.col


@R.add("SELECT event_id, event_type, value FROM events")
def json_lines_written(spark, sf):
    """Every event as a line of JSON; null values are left out of the line and come back as null."""
    to = folder(spark)
    writers.json_lines(table(spark, sf, "events").select("event_id", "event_type", "value"), to)
    return readers.json_lines(spark, to, "event_id long, event_type string, value double")[0]


@R.add("SELECT l_orderkey, l_partkey, l_quantity, l_returnflag FROM lineitem")
def csv_inferred(spark, sf):
    """CSV whose types are told from its values."""
    to = folder(spark)
    writers.csv(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag"), to)
    got = readers.csv(spark, to)
    return got.select(c("l_orderkey").cast("long"), c("l_partkey").cast("long"), c("l_quantity").cast("double"), "l_returnflag")


@R.add("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def refreshed_rows(spark, sf):
    """An empty stub, then two refreshes, then a dry run: the second refresh's rows are what a reader finds."""
    to, o = folder(spark), table(spark, sf, "orders")
    writers.refresh(writers.empty(spark, "o_orderkey long, o_totalprice double"), to)
    writers.refresh(o.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), to)
    open_ = o.where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")
    wrote = writers.guarded(open_, to, True)
    if writers.guarded(o.select("o_orderkey", "o_totalprice"), to, False) < wrote:
        raise ValueError("a dry run counts all rows")
    return spark.read.parquet(to)


@R.add("SELECT o_orderstatus, c_mktsegment, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2")
def registered_views(spark, sf):
    """Tables by name in a statement of SQL."""
    readers.tables(spark, sf, ["orders", "customer"])
    return spark.sql("SELECT o_orderstatus, c_mktsegment, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2")


@R.add(f"""SELECT 'T' || user_id AS patient_id, CAST(min(day(ts)) OVER (PARTITION BY user_id) AS INTEGER) AS hd, CAST(min(CAST(ts AS DATE)) OVER (PARTITION BY user_id) AS VARCHAR) AS admit_date, event_type AS document_type, {K} AS k FROM events""")
def nested_documents(spark, sf):
    """A file per patient with an array of documents, in folders that name the patient; read back as rows with each patient's first date."""
    e = table(spark, sf, "events").select(F.concat(F.lit("patient_T"), c("user_id").cast("string")).alias("folder"), F.dayofmonth("ts").alias("hd"), F.to_date("ts").cast("string").alias("date"), F.struct(c("event_type").alias("document_type"), _k().alias("k")).alias("d"))
    stays = e.groupBy("folder").agg(F.min("hd").alias("hd"), F.lit(None).cast("int").alias("d_number"), F.min("date").alias("date"), F.collect_list("d").alias("documents"))
    schema = "hd string, d_number string, date string, documents array<struct<document_type:string,k:int>>"
    docs = writers.file_each(stays, "folder", "json", lambda at: readers.documents(spark, at, schema, None))
    return docs.join(readers.first_dates(docs), "patient_id").select("patient_id", "hd", "admit_date", "document_type", "k")


@R.add("""SELECT user_id, chr(CAST(65 + user_id % 26 AS INTEGER)) || lpad(CAST(user_id % 10 AS VARCHAR), 2, '0') AS infection_code, CASE WHEN user_id % 3 <> 1 THEN 'fever ' || user_id END AS diagnosis, strftime(min(ts), '%Y-%m-%d') AS admit_date FROM events GROUP BY user_id""")
def profile_files(spark, sf):
    """A Markdown file per patient, and what its patterns name; null where a file doesn't."""
    u = c("user_id")
    head = F.concat(F.lit("# "), F.chr(u % 26 + 65), F.lpad((u % 10).cast("string"), 2, "0"), F.lit(" - profile\n"))
    reason = F.when(u % 3 != 1, F.concat(F.lit("- 입원 사유: **fever "), u.cast("string"), F.lit("**\n"))).otherwise("- nothing said\n")
    p = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("t")).select("user_id", F.concat(head, reason, F.lit("입원일 "), F.date_format("t", "yyyy-MM-dd")).alias("value"))
    got = writers.file_each(p, "user_id", "text", lambda at: readers.profiles(spark, at, readers.PROFILE))
    return got.select(F.regexp_extract("path", r"user_id=(\d+)", 1).cast("long").alias("user_id"), "infection_code", "diagnosis", "admit_date")
