"""Cohort algebra, serving and scoring queries over the TPC-H-like tables and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import bucket, shift_cutoff
from ..operators import scoring, serving
from ..operators.quantiles import quantiles
from .common import Registry, item, table

R = Registry()
c = F.col

RES = {"beta": ("('R')", "l_partkey % 3 = 0"), "macro": ("('R')", "l_partkey % 3 = 1"), "quin": ("('R')", "l_partkey % 3 = 2")}


@R.add("""WITH f AS (SELECT l_orderkey, """ + ", ".join(f"max(CASE WHEN {cond} AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS {n}" for n, (_, cond) in RES.items()) + """,
  max(CASE WHEN l_suppkey % 2 = 0 AND l_returnflag = 'A' THEN 1 ELSE 0 END) AS carb, max(CASE WHEN l_suppkey % 3 = 0 AND l_returnflag = 'A' THEN 1 ELSE 0 END) AS ceph FROM lineitem GROUP BY l_orderkey),
u AS (SELECT l_orderkey, 'MRSA' AS kind FROM f WHERE beta = 1 AND macro = 1 AND quin = 1 UNION SELECT l_orderkey, 'CRE' FROM f WHERE carb = 1 AND ceph = 1 AND quin = 1)
SELECT l_orderkey, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS kinds FROM u GROUP BY l_orderkey""")
def resistance_cohort(spark, sf):
    """Three classes of resistance each, two organisms, one pass over the results."""
    l, hit = table(spark, sf, "lineitem"), lambda cond, flag="R": F.max(F.when(cond & (c("l_returnflag") == flag), 1).otherwise(0))
    f = l.groupBy("l_orderkey").agg(
        *[hit(c("l_partkey") % 3 == k).alias(n) for k, n in enumerate(RES)], hit(c("l_suppkey") % 2 == 0, "A").alias("carb"), hit(c("l_suppkey") % 3 == 0, "A").alias("ceph")
    )
    kinds = F.array_compact(F.array(F.when((c("carb") == 1) & (c("ceph") == 1) & (c("quin") == 1), "CRE"), F.when((c("beta") == 1) & (c("macro") == 1) & (c("quin") == 1), "MRSA")))
    return f.withColumn("k", kinds).where(F.size("k") > 0).select("l_orderkey", F.array_join("k", ", ").alias("kinds"))


@R.add("SELECT user_id FROM events WHERE value > 30 AND ts < TIMESTAMP '2024-01-05' AND event_type IN ('view', 'click', 'purchase', 'error') GROUP BY user_id HAVING count(DISTINCT event_type) = 4")
def division_having(spark, sf):
    e = table(spark, sf, "events").where((c("value") > 30) & (c("ts") < F.lit("2024-01-05").cast("timestamp_ntz")) & c("event_type").isin("view", "click", "purchase", "error"))
    return e.groupBy("user_id").agg(F.countDistinct("event_type").alias("n")).where("n = 4").select("user_id")


@R.add("SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS types FROM events GROUP BY user_id")
def listagg_types(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ", ").alias("types"))


@R.add("""SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%ring%' THEN 'fastener' WHEN lower(p_name) LIKE '%bolt%' OR lower(p_name) LIKE '%nut%' THEN 'hardware' WHEN p_type LIKE 'S%' THEN 'small' ELSE 'other' END AS class,
  (p_name LIKE '%widget%' OR p_name LIKE '%gear%')::INT AS is_device FROM part""")
def like_family_class(spark, sf):
    n = F.lower("p_name")
    cls = F.when(n.contains("ring"), "fastener").when(n.contains("bolt") | n.contains("nut"), "hardware").when(c("p_type").startswith("S"), "small").otherwise("other")
    return table(spark, sf, "part").select("p_partkey", cls.alias("class"), c("p_name").rlike("widget|gear").cast("int").alias("is_device"))


@R.add("""SELECT o_custkey, kind, min(pos) AS first_pos, CASE WHEN min(pos) = 1 THEN 'Admission' ELSE 'Hospital_Acquired' END AS timing FROM
  (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'Pneumonia' WHEN o_orderpriority LIKE '3%' THEN 'UTI' END AS kind FROM orders)
  WHERE kind IS NOT NULL GROUP BY 1, 2""")
def diagnosis_typing(spark, sf):
    p = c("o_orderpriority")
    o = table(spark, sf, "orders").select("o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("pos"), F.when(p.rlike("^[12]"), "Pneumonia").when(p.startswith("3"), "UTI").alias("kind"))
    g = o.where("kind IS NOT NULL").groupBy("o_custkey", "kind").agg(F.min("pos").alias("first_pos"))
    return g.select("o_custkey", "kind", "first_pos", F.when(c("first_pos") == 1, "Admission").otherwise("Hospital_Acquired").alias("timing"))


@R.add("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal >= 500 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)""")
def semi_anti_cohort(spark, sf):
    o = table(spark, sf, "orders")
    cu = table(spark, sf, "customer").where("c_acctbal >= 500").select("c_custkey", "c_mktsegment")
    wards = o.where("o_orderstatus = 'F'").select(c("o_custkey").alias("c_custkey"))
    icu = o.where("o_orderpriority = '1-URGENT'").select(c("o_custkey").alias("c_custkey"))
    return cu.join(wards, "c_custkey", "left_semi").join(icu, "c_custkey", "left_anti")


@R.add("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_filter(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 300000").select(c("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(big, "c_custkey", "left_anti")


@R.add("SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def union_distinct(spark, sf):
    a = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(c("o_custkey").alias("id"))
    return a.union(table(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey")).distinct()


@R.add("""SELECT id, kind, amount FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY amount DESC, kind) AS rn FROM (SELECT c_custkey AS id, 'customer' AS kind, c_acctbal AS amount FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_acctbal FROM supplier)) WHERE rn = 1""")
def union_all_dedup(spark, sf):
    a = table(spark, sf, "customer").select(c("c_custkey").alias("id"), F.lit("customer").alias("kind"), c("c_acctbal").alias("amount"))
    b = table(spark, sf, "supplier").select(c("s_acctbal").alias("amount"), c("s_suppkey").alias("id"), F.lit("supplier").alias("kind"))
    return serving.latest(a.unionByName(b), ["id"], F.desc("amount"), c("kind"))


@R.add("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 5")
def topk_per_group(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", "value")
    return e.withColumn("rn", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))).where("rn <= 5").drop("rn")


@R.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_n_limit(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@R.add("""SELECT o_custkey, band, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY band, o_orderkey) AS r2 FROM
  (SELECT *, CAST(floor(o_totalprice / 100000) * 10 AS BIGINT) AS band, row_number() OVER (PARTITION BY o_custkey, floor(o_totalprice / 100000) ORDER BY o_orderdate, o_orderkey) AS r1 FROM orders) WHERE r1 = 1) WHERE r2 <= 2""")
def two_level_rank(spark, sf):
    o = table(spark, sf, "orders").withColumn("band", F.floor(c("o_totalprice") / 100000) * 10)
    o = serving.latest(o, ["o_custkey", "band"], c("o_orderdate"), c("o_orderkey"))
    return o.withColumn("r2", F.row_number().over(Window.partitionBy("o_custkey").orderBy("band", "o_orderkey"))).where("r2 <= 2").select("o_custkey", "band", "o_orderkey")


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@R.add("SELECT o_orderstatus, " + ", ".join(f"count(*) FILTER (WHERE o_orderpriority = '{p}') AS \"{p}\"" for p in PRIORITIES) + ", count(*) FILTER (WHERE o_orderpriority IN (" + ", ".join(f"'{p}'" for p in PRIORITIES) + ")) AS total FROM orders GROUP BY o_orderstatus")
def pivot_crosstab(spark, sf):
    p = table(spark, sf, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", list(PRIORITIES)).count().na.fill(0)
    return p.withColumn("total", sum((c(f"`{x}`") for x in PRIORITIES), F.lit(0).cast("long")))


@R.add("""SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, round_even(avg(o_totalprice), 1) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high, round_even(median(o_totalprice), 1) AS mid, round_even(stddev(o_totalprice), 1) AS sd FROM orders GROUP BY o_orderpriority""")
def named_multi_agg(spark, sf):
    p = c("o_totalprice")
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.countDistinct("o_custkey").alias("customers"), F.bround(F.avg(p), 1).alias("mean"), F.min(p).alias("low"), F.max(p).alias("high"), F.bround(F.median(p), 1).alias("mid"), F.bround(F.stddev(p), 1).alias("sd")
    )


@R.add("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 9) AS share FROM orders GROUP BY 1, 2""")
def shares_per_group(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(c("n") / F.sum("n").over(Window.partitionBy("o_orderstatus")), 9))


@R.add("SELECT v, count(*) AS n FROM (SELECT l_returnflag AS v FROM lineitem UNION ALL SELECT l_linestatus FROM lineitem UNION ALL SELECT CAST(l_linenumber AS VARCHAR) FROM lineitem) GROUP BY v ORDER BY n DESC, v LIMIT 15")
def union_columns_topk(spark, sf):
    l = table(spark, sf, "lineitem").select(F.explode(F.array("l_returnflag", "l_linestatus", c("l_linenumber").cast("string"))).alias("v"))
    return l.groupBy("v").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(15)


@R.add("SELECT l_orderkey, min(l_partkey) AS first_id, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def min_id_representative(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("first_id"), F.count("*").alias("n"))


MEASURES = (("l_quantity", "QTY", "pcs"), ("l_extendedprice", "PRICE", "usd"), ("l_discount", "DISC", "pct"), ("l_tax", "TAX", "pct"))


@R.add(" UNION ALL ".join(f"SELECT l_orderkey, l_partkey, l_linenumber, '{n}' AS code, '{u}' AS unit, {x} AS value FROM lineitem WHERE {x} > 0" for x, n, u in MEASURES))
def wide_to_long(spark, sf):
    l = table(spark, sf, "lineitem")
    a = F.array(*[F.struct(F.lit(n).alias("code"), F.lit(u).alias("unit"), F.when(c(x) > 0, c(x)).alias("value")) for x, n, u in MEASURES])
    return l.select("l_orderkey", "l_partkey", "l_linenumber", F.explode(a).alias("m")).select("l_orderkey", "l_partkey", "l_linenumber", "m.*").where("value IS NOT NULL")


@R.add("""SELECT o_custkey, array_to_string(list(DISTINCT o_orderstatus ORDER BY o_orderstatus), '|') AS statuses, string_agg(CAST(o_orderkey AS VARCHAR) || ':' || o_orderpriority, ';' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey""")
def collect_children(spark, sf):
    """A customer's orders as one nested value: as large as what one customer orders."""
    child = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))
    text = F.array_join(F.transform(child, lambda x: F.concat_ws(":", x["o_orderkey"], x["o_orderpriority"])), ";")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderstatus")), "|").alias("statuses"), text.alias("orders"))


@R.add("""SELECT l_orderkey, l_partkey, l_linenumber, p_type, s_name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def dimension_lookup(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    p = table(spark, sf, "part").where("p_size > 10").select(c("p_partkey").alias("l_partkey"), "p_type")
    return l.join(p, "l_partkey", "left").join(table(spark, sf, "supplier").select(c("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey", "left").select("l_orderkey", "l_partkey", "l_linenumber", "p_type", "s_name")


LOOK = "d AS (SELECT user_id, event_type, min(event_id) AS note_id FROM events WHERE value > 100 GROUP BY 1, 2)"


@R.add(f"""WITH {LOOK} SELECT event_id, coalesce(a.note_id, b.note_id) AS note_id FROM events e LEFT JOIN d a ON a.user_id = e.user_id AND a.event_type = e.event_type LEFT JOIN d b ON b.user_id = e.user_id AND b.event_type = 'view'""")
def lookup_cascade(spark, sf):
    """First the exact key, then the alternative."""
    e = table(spark, sf, "events")
    d = e.where("value > 100").groupBy("user_id", "event_type").agg(F.min("event_id").alias("note_id"))
    tries = [{"user_id": c("user_id"), "event_type": c("event_type")}, {"user_id": c("user_id"), "event_type": F.lit("view")}]
    return serving.cascade(e.select("event_id", "user_id", "event_type"), d, "event_id", tries, ["user_id", "event_type"], "note_id").select("event_id", "note_id")


@R.add("""WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'view'), r AS (SELECT user_id, event_id AS span_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'click'),
n AS (SELECT user_id, max(k) AS n FROM r GROUP BY user_id) SELECT l.user_id, l.event_id, r.span_id FROM l LEFT JOIN n ON l.user_id = n.user_id LEFT JOIN r ON r.user_id = l.user_id AND r.k = least(l.k, n.n)""")
def ordered_pairing(spark, sf):
    e = table(spark, sf, "events")
    l = e.where("event_type = 'view'").select("user_id", "event_id")
    r = e.where("event_type = 'click'").select("user_id", c("event_id").alias("span_id"))
    return serving.pair_in_order(l, r, ["user_id"], "event_id", "span_id")


@R.add("SELECT user_id, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END AS cohort FROM events GROUP BY user_id")
def single_valued_set(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(serving.single_value(c("event_type")).alias("cohort"))


@R.add("""SELECT s_suppkey, CASE WHEN busy THEN 'OCCUPIED' WHEN last + INTERVAL 48 HOUR > TIMESTAMP '2000-01-01' THEN 'CLEANING' ELSE 'AVAILABLE' END AS status FROM supplier LEFT JOIN
 (SELECT l_suppkey, bool_or(e IS NULL OR e > TIMESTAMP '2000-01-01') AS busy, max(e) AS last FROM (SELECT l_suppkey, CASE WHEN l_linenumber <> 7 OR l_partkey % 50 <> 0 THEN l_shipdate END AS e FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01' + to_hours(CAST(l_suppkey % 3 AS INTEGER))) GROUP BY 1) ON l_suppkey = s_suppkey""")
def bed_status(spark, sf):
    now = F.lit("2000-01-01").cast("timestamp_ntz")
    l = table(spark, sf, "lineitem").where(c("l_shipdate") < now + F.make_dt_interval(hours=(c("l_suppkey") % 3).cast("int")))
    stays = l.select(c("l_suppkey").alias("s_suppkey"), F.when((c("l_linenumber") != 7) | (c("l_partkey") % 50 != 0), c("l_shipdate")).alias("end"))
    return serving.bed_status(table(spark, sf, "supplier").select("s_suppkey"), stays, "s_suppkey", now, 48)


KIND = {"1-URGENT": "MDRO", "2-HIGH": "Tick-borne", "3-MEDIUM": "Pneumonia", "4-NOT SPECIFIED": "Waterborne", "5-LOW": "UTI"}


@R.add("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'CONTACT' WHEN '2-HIGH' THEN 'DROPLET' WHEN '3-MEDIUM' THEN 'DROPLET' WHEN '4-NOT SPECIFIED' THEN 'CONTACT' ELSE 'STANDARD' END AS isolation, CASE WHEN o_totalprice / 500000 >= 0.8 THEN 'CRITICAL' WHEN o_totalprice / 500000 >= 0.6 THEN 'HIGH' WHEN o_totalprice / 500000 >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM orders")
def rule_maps(spark, sf):
    from ..functions.rules import isolation_of, risk_of

    kind = F.create_map(*[F.lit(x) for kv in KIND.items() for x in kv])[c("o_orderpriority")]
    return table(spark, sf, "orders").select("o_orderkey", isolation_of(kind).alias("isolation"), risk_of(c("o_totalprice") / 500000).alias("risk"))


@R.add("SELECT l_orderkey, l_partkey, l_linenumber, m AS admission FROM lineitem JOIN orders o ON o.o_orderkey = l_orderkey JOIN (SELECT o_custkey, max(o_orderkey) AS m FROM orders GROUP BY 1) x ON x.o_custkey = o.o_custkey")
def admission_remap(spark, sf):
    """What was booked under any admission of a patient goes to the patient's latest one."""
    o = table(spark, sf, "orders").select("o_custkey", c("o_orderkey").alias("l_orderkey"))
    m = o.withColumn("admission", F.max("l_orderkey").over(Window.partitionBy("o_custkey"))).drop("o_custkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(m, "l_orderkey")


@R.add("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END DESC NULLS LAST, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def admission_pick(spark, sf):
    st = c("o_orderstatus")
    return serving.latest(table(spark, sf, "orders"), ["o_custkey"], F.when(st == "O", 0).when(st == "P", 1).otherwise(2), F.when(c("o_orderkey") % 4 != 0, c("o_orderdate")).desc_nulls_last(), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@R.add("""SELECT 'negative_balance' AS rule, count(*) FILTER (WHERE c_acctbal < 0) AS violations FROM customer UNION ALL SELECT 'bad_segment', count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) FROM customer""")
def expectation_counts(spark, sf):
    return serving.violations(table(spark, sf, "customer"), {"negative_balance": c("c_acctbal") >= 0, "bad_segment": c("c_mktsegment").isin("BUILDING", "MACHINERY")})


@R.add("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, sf):
    return serving.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@R.add("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def foreign_key_orphans(spark, sf):
    return serving.orphans(table(spark, sf, "lineitem"), "l_partkey", table(spark, sf, "part").where("p_size < 40"), "p_partkey").select("l_orderkey", "l_partkey", "l_linenumber")


@R.add("""SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS severity, count(*) AS n, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 30 MINUTE) AS recent FROM events GROUP BY 1, 2""")
def alert_distribution(spark, sf):
    since = F.lit("2024-01-29 23:30:00").cast("timestamp_ntz")
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf, "events").groupBy("event_type", (k % 4).alias("severity")).agg(F.count("*").alias("n"), F.count_if(c("ts") >= since).alias("recent"))


@R.add("""SELECT user_id, day, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY new DESC, ts DESC, event_id DESC) AS rn FROM
  (SELECT user_id, CAST(ts AS DATE) AS day, event_id, ts, 0 AS new FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, CAST(ts AS DATE), event_id, ts, 1 FROM events WHERE event_type = 'click')) WHERE rn = 1""")
def upsert_latest(spark, sf):
    e = table(spark, sf, "events").select("user_id", c("ts").cast("date").alias("day"), "event_id", "ts", "event_type")
    old, new = (e.where(c("event_type") == x).drop("event_type") for x in ("view", "click"))
    return serving.upsert(old, new, ["user_id", "day"], F.desc("ts"), F.desc("event_id")).select("user_id", "day", "event_id")


@R.add("""SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity < 25 UNION ALL (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 25 EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity < 25)""")
def insert_if_absent(spark, sf):
    l = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    return serving.insert_if_absent(l.where("l_quantity < 25").drop("l_quantity"), l.where("l_quantity >= 25").drop("l_quantity"))


@R.add("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def scoped_delete(spark, sf):
    scope = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(c("o_orderkey").alias("l_orderkey"))
    return serving.delete_scope(table(spark, sf, "lineitem"), scope, "l_orderkey").select("l_orderkey", "l_partkey", "l_linenumber")


@R.add("""SELECT n_name, k, c_custkey, s_suppkey FROM (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) LEFT JOIN
  (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k2 FROM supplier) ON s_nationkey = c_nationkey AND k = k2 JOIN nation ON n_nationkey = c_nationkey""")
def transfer_plan(spark, sf):
    w = Window.partitionBy("n_nationkey")
    p = table(spark, sf, "customer").select(c("c_nationkey").alias("n_nationkey"), "c_custkey", F.lit(0).alias("priority"), c("c_custkey").alias("patient_id"))
    b = table(spark, sf, "supplier").select(c("s_nationkey").alias("n_nationkey"), "s_suppkey", c("s_suppkey").alias("bed_id"))
    n = F.broadcast(table(spark, sf, "nation").select("n_nationkey", "n_name"))  # a table of fixed size
    return serving.plan_transfers(p, b, "n_nationkey").join(n, "n_nationkey").select("n_name", F.row_number().over(w.orderBy("c_custkey")).cast("long").alias("k"), "c_custkey", "s_suppkey")


@R.add()
def bed_assignment(spark, sf):
    """Greedy and order-dependent: SQL has no form for it; tests compare with a plain loop."""
    kinds = F.array(*map(F.lit, serving.PLACE_FIRST))
    p = table(spark, sf, "customer").select(
        c("c_nationkey").alias("ward"), c("c_custkey").alias("patient_id"), F.element_at(kinds, (c("c_custkey") % 5 + 1).cast("int")).alias("infection_type"),
        F.when(c("c_acctbal") > 4000, "M").otherwise("F").alias("gender"), F.array(F.concat(F.lit("r"), (c("c_custkey") % 4).cast("string"))).alias("preferred"),
    )
    b = table(spark, sf, "supplier").select(c("s_nationkey").alias("ward"), c("s_suppkey").alias("bed_id"), F.concat(F.lit("r"), (c("s_suppkey") % 3).cast("string")).alias("room_id"), (c("s_suppkey") % 2 + 1).cast("int").alias("capacity"))
    return serving.assign_beds(p, b)


# scoring -----------------------------------------------------------------------------------------

SCORED = "s AS (SELECT l.doc_id, round(CAST(length(text) % 1000 AS DOUBLE) / 1000, 3) AS score, toxic AS label FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def _scored(spark, sf):
    # texts stay where they are: only their lengths are joined
    d = table(spark, sf, "documents").select("doc_id", F.round((F.length("text") % 1000).cast("double") / 1000, 3).alias("score"))
    return d.join(table(spark, sf, "labels").select("doc_id", c("toxic").alias("label")), "doc_id")


ROC = f"""{SCORED}, g AS (SELECT score AS threshold, sum((label = 1)::INT) AS p, sum((label = 0)::INT) AS n FROM s GROUP BY 1),
r AS (SELECT threshold, CAST(sum(p) OVER (ORDER BY threshold DESC) AS BIGINT) AS tp, CAST(sum(n) OVER (ORDER BY threshold DESC) AS BIGINT) AS fp, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM g)"""


@R.add(f"WITH {ROC} SELECT threshold, tp, fp, round(tp / ap, 9) AS tpr, round(fp / an, 9) AS fpr FROM r")
def roc_points(spark, sf):
    return scoring.roc(_scored(spark, sf)).select("threshold", "tp", "fp", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


@R.add(f"""WITH {ROC} SELECT thresh_high, round(thresh_high * 0.5, 9) AS thresh_low, (SELECT threshold FROM r ORDER BY tp / ap - fp / an DESC, threshold DESC LIMIT 1) AS youden FROM (SELECT threshold AS thresh_high FROM r WHERE tp / ap >= 0.85 ORDER BY fp / an, threshold DESC LIMIT 1)""")
def roc_threshold(spark, sf):
    return scoring.thresholds(scoring.roc(_scored(spark, sf))).select("thresh_high", F.round("thresh_low", 9).alias("thresh_low"), "youden")


@R.add(f"""WITH {SCORED} SELECT doc_id, CASE WHEN score >= 0.6 THEN 'High' WHEN score >= 0.3 THEN 'Medium' ELSE 'Low' END AS risk_level, CASE WHEN score >= 0.85 THEN 'CRITICAL' WHEN score >= 0.6 THEN 'HIGH' WHEN score >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS api_level,
  CASE WHEN score >= 0.6 THEN '{scoring.ACTIONS["High"]}' WHEN score >= 0.3 THEN '{scoring.ACTIONS["Medium"]}' ELSE '{scoring.ACTIONS["Low"]}' END AS action_message FROM s""")
def risk_tier(spark, sf):
    t = scoring.tier(c("score"), 0.3, 0.6)
    return _scored(spark, sf).select("doc_id", t.alias("risk_level"), scoring.level(c("score")).alias("api_level"), scoring.action(t).alias("action_message"))


@R.add(f"""WITH {SCORED} SELECT tp, fp, fn, tn, round(tp / (tp + fn), 9) AS sensitivity, round(tn / (tn + fp), 9) AS specificity, round(tp / (tp + fp), 9) AS precision FROM
  (SELECT count(*) FILTER (WHERE score >= 0.3 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.3 AND label = 0) AS fp, count(*) FILTER (WHERE score < 0.3 AND label = 1) AS fn, count(*) FILTER (WHERE score < 0.3 AND label = 0) AS tn FROM s)""")
def confusion_counts(spark, sf):
    return scoring.confusion(_scored(spark, sf), c("score") >= 0.3)


@R.add("SELECT quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.8) AS p80 FROM events")
def percentiles(spark, sf):
    q = quantiles(table(spark, sf, "events"), ["value"], (0.5, 0.8))
    return q.select(F.get("q", F.lit(0)).alias("p50"), F.get("q", F.lit(1)).alias("p80"))


@R.add("""SELECT l_orderkey, l_partkey, l_linenumber, round(least(1, greatest(0, (coalesce(a, 0) + coalesce(b, 0) + coalesce(d, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (d IS NOT NULL)::INT))), 9) AS risk FROM
  (SELECT *, l_discount * 12 AS a, CASE WHEN l_linenumber <> 3 THEN l_tax * 10 END AS b, l_quantity / 40 AS d FROM lineitem)""")
def ensemble_mean(spark, sf):
    folds = F.array(c("l_discount") * 12, F.when(c("l_linenumber") != 3, c("l_tax") * 10), c("l_quantity") / 40)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.round(scoring.ensemble(folds), 9).alias("risk"))


@R.add("""WITH n AS (SELECT *, row_number() OVER () AS i FROM lineitem), f AS (SELECT i, l_orderkey, l_partkey, l_linenumber, unnest(['disc', 'qty', 'tax']) AS feature, unnest([(0.05 - l_discount) * 10, (l_quantity - 25) * 0.02, (l_tax - 0.04) * 8]) AS s FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY abs(s) DESC, feature) AS k FROM f)
SELECT l_orderkey, l_partkey, l_linenumber, k, feature, round(abs(s), 6) AS contribution, CASE WHEN s >= 0 THEN 'UP' ELSE 'DOWN' END AS direction FROM r WHERE k <= 2""")
def topk_factors(spark, sf):
    keys = ["l_orderkey", "l_partkey", "l_linenumber"]
    l = table(spark, sf, "lineitem")
    s = F.array((0.05 - c("l_discount")) * 10, (c("l_quantity") - 25) * 0.02, (c("l_tax") - 0.04) * 8)
    top = scoring.factors(F.array(*map(F.lit, ("disc", "qty", "tax"))), s, 2)
    return l.select(*keys, F.posexplode(top).alias("k", "f")).select(*keys, (c("k") + 1).cast("long").alias("k"), "f.feature", "f.contribution", "f.direction")


@R.add("""WITH g AS (SELECT user_id, day, shift, CASE shift WHEN 'Day' THEN day + INTERVAL 14 HOUR WHEN 'Evening' THEN day + INTERVAL 22 HOUR ELSE day + INTERVAL 30 HOUR END AS cutoff FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events) , (VALUES ('Day'), ('Evening'), ('Night')) t(shift))
SELECT g.user_id, cutoff, max_by(event_type, ts) AS event_type, max_by(value, ts) AS value, max_by(value, ts) FILTER (WHERE event_type = 'purchase') AS lactate FROM g LEFT JOIN events e ON e.user_id = g.user_id AND e.ts <= g.cutoff GROUP BY 1, 2""")
def asof_latest(spark, sf):
    """Per user, day and shift: the latest row, and the latest value of one item, at the shift's end."""
    e = table(spark, sf, "events")
    days = e.select("user_id", c("ts").cast("date").alias("day")).distinct()
    grid = days.withColumn("shift", F.explode(F.array(*map(F.lit, ("Day", "Evening", "Night"))))).select("user_id", shift_cutoff(c("day"), c("shift")).alias("cutoff"))
    return scoring.as_of(grid, e.withColumn("lactate", item("purchase")), "user_id", "cutoff", "ts", ["event_type", "value"], ["lactate"])


@R.add(f"WITH {SCORED} SELECT count(*) AS n, round(avg((a = b)::INT), 9) AS agreement FROM (SELECT CASE WHEN score >= 0.6 THEN 2 WHEN score >= 0.3 THEN 1 ELSE 0 END AS a, CASE WHEN score >= 0.55 THEN 2 WHEN score >= 0.35 THEN 1 ELSE 0 END AS b FROM s)")
def tier_agreement(spark, sf):
    s = _scored(spark, sf)
    return scoring.agreement(s.withColumn("t", scoring.tier(c("score"), 0.3, 0.6)), s.withColumn("t", scoring.tier(c("score"), 0.35, 0.55)), ["doc_id"], "t")


@R.add(f"WITH {SCORED} SELECT CASE WHEN score >= 0 AND score < 0.2 THEN 'a' WHEN score >= 0.2 AND score < 0.5 THEN 'b' WHEN score >= 0.5 AND score < 1 THEN 'c' END AS bin, count(*) AS n, round(avg(label), 9) AS rate FROM s GROUP BY 1")
def score_bins(spark, sf):
    return _scored(spark, sf).groupBy(bucket(c("score"), (0, 0.2, 0.5, 1.0), ("a", "b", "c"), right=False).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("label"), 9).alias("rate"))


@R.add("SELECT event_id, round(coalesce(CASE WHEN event_type <> 'view' THEN value END, 12.5), 9) AS hr, round(coalesce(CASE WHEN event_type <> 'click' THEN value END, 0), 9) AS rr FROM events")
def feature_vector(spark, sf):
    v = F.create_map(F.lit("hr"), F.when(c("event_type") != "view", c("value")), F.lit("rr"), F.when(c("event_type") != "click", c("value")))
    x = scoring.vector(v, {"hr": 12.5, "rr": None})
    return table(spark, sf, "events").select("event_id", F.round(x[0]["value"], 9).alias("hr"), F.round(x[1]["value"], 9).alias("rr"))
