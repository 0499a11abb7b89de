"""Cohort, hourly, window, imputation and feature queries over events, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import age_at, bucket, hour_of, in_range, iso_time, micros, saturate, steps
from ..operators import features, icu, impute, intervals, panes, profile
from .common import MEASURED, Registry, item, measured, table

R = Registry()
c = F.col


@R.add("""SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
  FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'P') WHERE rn = 1""")
def first_stay_rn(spark, sf):
    o = table(spark, sf, "orders")
    return icu.first_per(o, "o_custkey", "o_orderdate", "o_orderkey", where=(c("o_totalprice") >= 100000) & (c("o_orderstatus") != "P")).select("o_custkey", "o_orderkey", "o_orderdate")


@R.add("""SELECT c_custkey, c_name, n_name, r_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE c_acctbal BETWEEN 1000 AND 5000""")
def star_join(spark, sf):
    # dimensions of a fixed size
    n = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), c("n_regionkey") == c("r_regionkey"))
    return table(spark, sf, "customer").where(c("c_acctbal").between(1000, 5000)).join(F.broadcast(n), c("c_nationkey") == c("n_nationkey")).select("c_custkey", "c_name", "n_name", "r_name", "c_acctbal")


@R.add("""SELECT user_id, onset FROM (SELECT user_id, CASE WHEN abx IS NOT NULL AND cx IS NOT NULL AND abs(epoch_us(abx) - epoch_us(cx)) <= 24 * 3600000000 THEN least(abx, cx)
    WHEN abx IS NOT NULL AND cx IS NULL THEN abx END AS onset
  FROM (SELECT user_id, min(ts) FILTER (WHERE event_type = 'purchase' AND value > 150) AS abx, min(ts) FILTER (WHERE event_type = 'error' AND value > 150) AS cx FROM events GROUP BY user_id))
  WHERE onset IS NOT NULL""")
def infection_window(spark, sf):
    per = table(spark, sf, "events").groupBy("user_id").agg(
        F.min(F.when((c("event_type") == "purchase") & (c("value") > 150), c("ts"))).alias("abx"), F.min(F.when((c("event_type") == "error") & (c("value") > 150), c("ts"))).alias("cx")
    )
    return per.select("user_id", icu.onset(c("abx"), c("cx")).alias("onset")).where("onset IS NOT NULL")


@R.add("""SELECT user_id, greatest(p, l) AS shock_time FROM (SELECT user_id, min(ts) FILTER (WHERE event_type = 'signup') AS p, min(ts) FILTER (WHERE event_type = 'click' AND value > 20) AS l
  FROM events GROUP BY user_id) WHERE abs(epoch_us(p) - epoch_us(l)) <= 24 * 3600000000""")
def shock_onset(spark, sf):
    per = table(spark, sf, "events").groupBy("user_id").agg(F.min(F.when(c("event_type") == "signup", c("ts"))).alias("p"), F.min(F.when((c("event_type") == "click") & (c("value") > 20), c("ts"))).alias("l"))
    return per.select("user_id", icu.shock(c("p"), c("l")).alias("shock_time")).where("shock_time IS NOT NULL")


ORGANS = {"resp": ("min", "view", 20.0), "coag": ("min", "click", 10.0), "liver": ("max", "error", 0.05), "cns": ("min", "signup", 4.0), "renal": ("max", "purchase", 0.02)}


def _case(x, rules):
    return "CASE " + " ".join(f"WHEN {x} {op} {b} THEN {s}" for op, b, s in rules) + " ELSE 0 END"


@R.add("SELECT user_id, " + ", ".join(f"{_case(n, icu.ORGAN_STEPS[n])} AS score_{n}" for n in ORGANS) + ", " + " + ".join(f"{_case(n, icu.ORGAN_STEPS[n])}" for n in ORGANS) + " AS score_total FROM (SELECT user_id, "
       + ", ".join(f"{how}(value * {k}) FILTER (WHERE event_type = '{e}') AS {n}" for n, (how, e, k) in ORGANS.items()) + " FROM events WHERE user_id % 3 <> 0 OR event_type <> 'click' GROUP BY user_id)")
def organ_score_case(spark, sf):
    """Users without an item score 0 there."""
    e = table(spark, sf, "events").where((c("user_id") % 3 != 0) | (c("event_type") != "click"))
    per = e.groupBy("user_id").agg(*[getattr(F, how)(item(name) * k).alias(n) for n, (how, name, k) in ORGANS.items()])
    s = per.select("user_id", *[steps(c(n), icu.ORGAN_STEPS[n]).alias(f"score_{n}") for n in ORGANS])
    total = sum((c(f"score_{n}") for n in ORGANS), F.lit(0))
    return s.withColumn("score_total", total)


@R.add("""SELECT user_id, CASE WHEN coalesce(d, 0) > 15 OR coalesce(e, 0) > 0.1 OR coalesce(n, 0) > 0.1 THEN 4 WHEN coalesce(d, 0) > 5 OR coalesce(e, 0) > 0 OR coalesce(n, 0) > 0 THEN 3
    WHEN coalesce(d, 0) > 0 THEN 2 WHEN m < 70 THEN 1 ELSE 0 END AS score FROM
  (SELECT user_id, h, max(value) FILTER (WHERE event_type = 'purchase') AS d, max(value - 30) FILTER (WHERE event_type = 'error' AND value > 60) AS e,
     max(value - 30) FILTER (WHERE event_type = 'signup' AND value > 90) AS n, min(value) FILTER (WHERE event_type = 'view') AS m
   FROM (SELECT *, extract(hour FROM ts) AS h FROM events) GROUP BY user_id, h)""")
def cardio_score(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", F.hour("ts").alias("h")).agg(
        F.max(item("purchase")).alias("d"), F.max(F.when(c("value") > 60, item("error") - 30)).alias("e"), F.max(F.when(c("value") > 90, item("signup") - 30)).alias("n"), F.min(item("view")).alias("m")
    )
    return e.select("user_id", icu.cardio_score(c("d"), c("e"), c("n"), c("m")).alias("score"))


@R.add("""SELECT user_id, min(value) AS low, max(value) AS high, count(*) AS n FROM events JOIN (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'purchase' GROUP BY user_id) USING (user_id)
  WHERE abs(epoch_us(ts) - epoch_us(t)) <= 48 * 3600000000 GROUP BY user_id""")
def band_join_min(spark, sf):
    e = table(spark, sf, "events")
    anchors = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("t"))
    near = intervals.within_band(e.select("user_id", "ts", "value"), anchors, "user_id", "ts", "t", 48)
    return near.groupBy("user_id").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))


@R.add("""SELECT a.user_id, round(min(a.value / coalesce(b.value, 0.21)), 9) AS min_ratio FROM (SELECT * FROM events WHERE event_type = 'view' AND value > 0) a
  LEFT JOIN (SELECT * FROM events WHERE event_type = 'click' AND value > 0 AND user_id % 4 <> 0) b ON a.user_id = b.user_id GROUP BY a.user_id""")
def worst_ratio(spark, sf):
    """The reference joins every numerator of a stay with every denominator; the least ratio needs none of that."""
    e = table(spark, sf, "events")
    den = F.when(c("user_id") % 4 != 0, item("click"))
    return e.groupBy("user_id").agg(F.round(icu.worst_ratio(item("view"), den), 9).alias("min_ratio")).where("min_ratio IS NOT NULL")


@R.add("""SELECT user_id, date_trunc('hour', ts) AS hour, median(value) FILTER (WHERE event_type = 'view') AS hr, min(value) FILTER (WHERE event_type = 'click') AS spo2,
  max(value) FILTER (WHERE event_type = 'purchase') AS lactate, coalesce(min(value) FILTER (WHERE event_type = 'error'), min(value) FILTER (WHERE event_type = 'signup')) AS sbp,
  max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS vent_flag,
  max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) + max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS kinds FROM events GROUP BY 1, 2""")
def hourly_pivot(spark, sf):
    is_ = lambda x: c("event_type") == x
    p = icu.pivot(table(spark, sf, "events"), ["user_id", hour_of(c("ts")).alias("hour")], {
        "hr": ("median", is_("view"), c("value")), "spo2": ("min", is_("click"), c("value")), "lactate": ("max", is_("purchase"), c("value")),
        "nbp": ("min", is_("error"), c("value")), "abp": ("min", is_("signup"), c("value")), "vent_flag": ("flag", is_("signup"), c("value")), "press_flag": ("flag", is_("error"), c("value")),
    })
    return p.select("user_id", "hour", "hr", "spo2", "lactate", F.coalesce("nbp", "abp").alias("sbp"), "vent_flag", (c("vent_flag") + c("press_flag")).alias("kinds"))


@R.add("SELECT user_id, max_by(value, ts) FILTER (WHERE event_type = 'view') AS temp FROM events GROUP BY user_id")
def latest_by_max_by(spark, sf):
    return icu.pivot(table(spark, sf, "events"), ["user_id"], {"temp": ("latest", c("event_type") == "view", c("value"))})


@R.add("""SELECT o_orderkey, hour, CAST(1 AS INTEGER) AS vent_flag FROM (SELECT o_orderkey, unnest(generate_series(date_trunc('hour', s), date_trunc('hour', coalesce(e, s)), INTERVAL 1 HOUR)) AS hour FROM
  (SELECT o_orderkey, o_orderdate + to_minutes(o_orderkey % 60) AS s, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + to_minutes(o_orderkey % 60 + 60 * (o_orderkey % 7)) END AS e FROM orders))""")
def interval_expand(spark, sf):
    k = c("o_orderkey")
    o = table(spark, sf, "orders").select(
        k, (c("o_orderdate") + F.make_dt_interval(mins=(k % 60).cast("int"))).alias("s"),
        F.when(k % 5 != 0, c("o_orderdate") + F.make_dt_interval(mins=(k % 60 + 60 * (k % 7)).cast("int"))).alias("e"),
    )
    return icu.expand_hours(o, "s", "e").select("o_orderkey", "hour", F.lit(1).alias("vent_flag"))


@R.add(f"""WITH {MEASURED}, o AS (SELECT DISTINCT user_id, obs FROM m, range(6, 73) t(obs))
SELECT o.user_id, CAST(obs AS INTEGER) AS obs, count(*) AS n, median(value) AS hr, min(value) AS spo2_min, max(value) AS hr_max, max_by(value, ts) AS temp, round(sum(value), 6) AS urine, round(avg(value), 6) AS rate
FROM o JOIN m ON m.user_id = o.user_id AND h > obs - 6 AND h <= obs GROUP BY 1, 2""")
def sliding_window_6h(spark, sf):
    v = c("value")
    w = panes.sliding(measured(spark, sf), "user_id", *panes.hours("h", 6), {
        "n": ("count", F.lit(1)), "hr": ("median", v), "spo2_min": ("min", v), "hr_max": ("max", v), "temp": ("latest", v, c("ts")), "urine": ("sum", v), "rate": ("avg", v),
    })
    return w.withColumns({x: F.round(x, 6) for x in ("urine", "rate")})


@R.add(f"""WITH {MEASURED}, o AS (SELECT DISTINCT user_id, obs FROM m, range(6, 73) t(obs))
SELECT o.user_id, CAST(obs AS INTEGER) AS obs, min(CASE WHEN event_type = 'view' AND value > 10 THEN value END) AS ph, CASE WHEN max(CASE WHEN event_type = 'click' THEN value END) > 20 THEN 20 ELSE max(CASE WHEN event_type = 'click' THEN value END) END AS lactate,
  median(CASE WHEN event_type = 'purchase' THEN value END) AS wbc FROM o JOIN m ON m.user_id = o.user_id AND h > obs - 24 AND h <= obs GROUP BY 1, 2""")
def lab_window_24h(spark, sf):
    w = panes.sliding(measured(spark, sf), "user_id", *panes.hours("h", 24), {"ph": ("min", F.when(c("value") > 10, item("view"))), "lactate": ("max", item("click")), "wbc": ("median", item("purchase"))})
    return w.withColumn("lactate", saturate(c("lactate"), hi=20.0))


@R.add(f"""WITH {MEASURED}, o AS (SELECT user_id, t0 + to_hours(CAST(obs AS INTEGER)) AS hi, t0 + to_hours(CAST(obs - 6 AS INTEGER)) AS lo, obs FROM (SELECT DISTINCT user_id, t0 FROM m), range(6, 73) t(obs))
SELECT o.user_id, CAST(obs AS INTEGER) AS obs, count(*) AS n, round(avg(value), 6) AS mean FROM o JOIN m ON m.user_id = o.user_id AND ts BETWEEN lo AND hi GROUP BY 1, 2""")
def closed_window_mean(spark, sf):
    """Closed on both sides: an event on a full hour since the start belongs to one window more."""
    up = F.ceil((micros(c("ts")) - micros(c("t0"))) / 3.6e9).cast("int")
    w = panes.sliding(measured(spark, sf), "user_id", F.greatest(up, F.lit(6)), F.least(c("h") + 6, F.lit(72)), {"n": ("count", F.lit(1)), "mean": ("avg", c("value"))})
    return w.withColumn("mean", F.round("mean", 6))


EVENTS = {"death": "error", "vent": "purchase", "pressor": "signup"}


def _windows(spark, sf):
    first = [F.min(F.when((c("event_type") == e) & (c("value") > 60), c("ts"))).alias(n) for n, e in EVENTS.items()]
    stays = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), *first)
    return icu.observation_grid(stays, "t0", "t1")


WINDOWS = "w AS (SELECT *, t0 + to_hours(CAST(obs AS INTEGER)) AS window_end FROM (SELECT user_id, min(ts) AS t0, max(ts) AS t1, " + ", ".join(
    f"min(ts) FILTER (WHERE event_type = '{e}' AND value > 60) AS {n}" for n, e in EVENTS.items()) + " FROM events GROUP BY user_id), range(6, 73) t(obs) WHERE t0 + to_hours(CAST(obs AS INTEGER)) <= t1)"


@R.add(f"WITH {WINDOWS} SELECT user_id, CAST(obs AS INTEGER) AS obs, window_end FROM w WHERE " + " AND ".join(f"({n} IS NULL OR window_end < {n})" for n in EVENTS))
def censor_filter(spark, sf):
    return icu.censored(_windows(spark, sf), "window_end", list(EVENTS)).select("user_id", "obs", "window_end")


def _hit(n, h):
    return f"CASE WHEN {n} > window_end AND epoch_us({n}) - epoch_us(window_end) <= {h} * 3600000000 THEN 1 ELSE 0 END"


@R.add(f"WITH {WINDOWS} SELECT user_id, CAST(obs AS INTEGER) AS obs, " + ", ".join(
    f"{_hit(n, h)} AS {n}_next_{h}h" for h in (6, 12, 24) for n in EVENTS) + ", " + ", ".join(f"greatest({', '.join(_hit(n, h) for n in EVENTS)}) AS composite_next_{h}h" for h in (6, 12, 24)) + " FROM w")
def labels_multi_horizon(spark, sf):
    return _windows(spark, sf).select("user_id", "obs", *icu.labels("window_end", {n: n for n in EVENTS}))


@R.add("SELECT event_id, CASE WHEN value BETWEEN 20 AND 80 THEN value END AS hr, CASE WHEN value <= 3 THEN value ELSE 3 END AS index, greatest(value - 10, 0) AS low FROM events")
def clip_null(spark, sf):
    return table(spark, sf, "events").select("event_id", in_range(c("value"), 20, 80).alias("hr"), saturate(c("value"), hi=3.0).alias("index"), saturate(c("value") - 10, lo=0.0).alias("low"))


GAPS = "g AS (SELECT event_id, user_id, ts, CASE WHEN event_type IN ('view', 'click') THEN value END AS x, CASE WHEN event_type = 'error' AND user_id % 7 <> 0 THEN value END AS y FROM events)"


def _gaps(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "ts", F.when(c("event_type").isin("view", "click"), c("value")).alias("x"), F.when((c("event_type") == "error") & (c("user_id") % 7 != 0), c("value")).alias("y"))


@R.add(f"""WITH {GAPS} SELECT event_id, last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS x6,
  last_value(y IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS y12, last_value(y IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts) AS y_all FROM g""")
def ffill_limit(spark, sf):
    g = _gaps(spark, sf)
    return g.select("event_id", impute.ffill("x", "user_id", "ts", 6).alias("x6"), impute.ffill("y", "user_id", "ts", 12).alias("y12"), impute.ffill("y", "user_id", "ts").alias("y_all"))


@R.add(f"""WITH {GAPS} SELECT event_id, coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts), first_value(y IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y FROM g""")
def ffill_bfill_strict(spark, sf):
    return impute.fill_both(_gaps(spark, sf), ["y"], "user_id", "ts").select("event_id", "y")


@R.add(f"""WITH {GAPS}, f AS (SELECT *, last_value(y IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts) AS z FROM g)
SELECT event_id, first_value(z IGNORE NULLS) OVER (ORDER BY user_id, ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y FROM f""")
def ffill_bfill_reference(spark, sf):
    """A back-fill that isn't grouped: users without any value take the next user's first."""
    return impute.fill_both(_gaps(spark, sf), ["y"], "user_id", "ts", mode="reference").select("event_id", "y")


@R.add(f"""WITH {GAPS}, k AS (SELECT event_id, coalesce(x, median(x) OVER (PARTITION BY user_id)) AS x, coalesce(y, median(y) OVER (PARTITION BY user_id)) AS y FROM g)
SELECT event_id, round(x, 9) AS x, round(coalesce(y, (SELECT median(y) FROM k)), 9) AS y FROM k""")
def group_median_fill(spark, sf):
    g = impute.with_median(_gaps(spark, sf), ["x", "y"], "user_id")
    return impute.with_median(g, ["y"]).select("event_id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


GRID = """p AS (SELECT user_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hr_no, median(value) FILTER (WHERE event_type = 'view') AS hr, median(value) FILTER (WHERE event_type = 'click') AS temp,
  max(value) FILTER (WHERE event_type = 'purchase') AS lactate, max(value) FILTER (WHERE event_type = 'error' AND user_id % 5 <> 0) AS bilirubin, min(value) FILTER (WHERE event_type = 'signup') AS sao2 FROM events GROUP BY 1, 2)"""


def _grid(spark, sf):
    e = table(spark, sf, "events").withColumn("hr_no", F.floor(micros(c("ts")) / 3.6e9))
    return e.groupBy("user_id", "hr_no").agg(
        F.median(item("view")).alias("hr"), F.median(item("click")).alias("temp"), F.max(item("purchase")).alias("lactate"), F.max(F.when(c("user_id") % 5 != 0, item("error"))).alias("bilirubin"), F.min(item("signup")).alias("sao2")
    )


def _lv(x, k=None):
    return f"last_value({x} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY hr_no ROWS BETWEEN {k or 'UNBOUNDED'} PRECEDING AND CURRENT ROW)"


def _fv(x):
    return f"first_value({x} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY hr_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


FLAGS = "(sao2 IS NOT NULL)::INT AS abga_checked, (bilirubin IS NULL)::INT AS bilirubin_missing"


@R.add(f"""WITH {GRID}, r AS (SELECT user_id, hr_no, {FLAGS}, CASE WHEN hr BETWEEN 20 AND 250 THEN hr END AS hr, CASE WHEN temp BETWEEN 30 AND 43 THEN temp END AS temp,
  CASE WHEN lactate BETWEEN 0.1 AND 30 THEN lactate END AS lactate, CASE WHEN bilirubin BETWEEN 0.1 AND 60 THEN bilirubin END AS bilirubin FROM p),
f AS (SELECT user_id, hr_no, abga_checked, bilirubin_missing, (lactate IS NULL)::INT AS lactate_missing, coalesce({_lv('hr')}, {_fv('hr')}) AS hr, coalesce({_lv('temp', 6)}, 36.8) AS temp, coalesce({_lv('lactate', 12)}, 1.2) AS lactate, {_lv('bilirubin', 24)} AS bilirubin FROM r)
SELECT user_id, hr_no, abga_checked, bilirubin_missing, lactate_missing, round(coalesce(hr, (SELECT median(hr) FROM f)), 9) AS hr, temp, lactate, round(coalesce(bilirubin, (SELECT median(bilirubin) FROM f)), 9) AS bilirubin FROM f""")
def impute_v1(spark, sf):
    return impute.impute(_grid(spark, sf), "user_id", "hr_no").withColumns({x: F.round(x, 9) for x in ("hr", "bilirubin")})


@R.add(f"""WITH {GRID}, f AS (SELECT user_id, hr_no, {FLAGS}, (lactate IS NULL)::INT AS lactate_missing, coalesce({_lv('hr')}, {_fv('hr')}) AS hr, {_lv('temp', 6)} AS temp, {_lv('lactate', 12)} AS lactate, {_lv('bilirubin', 24)} AS bilirubin FROM p),
k AS (SELECT user_id, hr_no, abga_checked, bilirubin_missing, lactate_missing, hr, coalesce(temp, median(temp) OVER (PARTITION BY user_id), 36.8) AS temp, coalesce(lactate, median(lactate) OVER (PARTITION BY user_id), 1.2) AS lactate,
  coalesce(bilirubin, median(bilirubin) OVER (PARTITION BY user_id)) AS bilirubin FROM f)
SELECT user_id, hr_no, abga_checked, bilirubin_missing, lactate_missing, round(coalesce(hr, (SELECT median(hr) FROM k)), 9) AS hr, round(temp, 9) AS temp, round(lactate, 9) AS lactate, round(coalesce(bilirubin, (SELECT median(bilirubin) FROM k)), 9) AS bilirubin FROM k""")
def impute_v2(spark, sf):
    return impute.impute(_grid(spark, sf), "user_id", "hr_no", version=2).withColumns({x: F.round(x, 9) for x in ("hr", "temp", "lactate", "bilirubin")})


#: Where each of the seventeen columns and the saturation come from: a type of event, and scale and offset that bring most values into their range.
CHARTED = {
    "hr": ("view", 1.2, 15), "rr": ("click", 0.3, 2), "spo2": ("error", -0.3, 105), "sbp": ("purchase", 2.0, 20), "dbp": ("signup", 1.5, 5), "mbp": ("view", 1.5, 10), "temp": ("click", 0.1, 32), "creatinine": ("error", 0.2, 0),
    "wbc": ("purchase", 0.5, 0), "platelets": ("signup", 9.0, 0), "potassium": ("view", 0.08, 1), "sodium": ("click", 0.8, 95), "lactate": ("purchase", 0.25, 0), "ph": ("error", 0.01, 6.4), "bilirubin": ("signup", 0.5, 0),
    "gcs_total": ("click", 0.12, 2), "urine_ml_6h": ("view", 80.0, -200),
}
CHART = "p AS (SELECT user_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hr_no, " + ", ".join(f"avg(value * {a} + {b}) FILTER (WHERE event_type = '{e}') AS {n}" for n, (e, a, b) in CHARTED.items()) + ", min(value) FILTER (WHERE event_type = 'signup') AS sao2 FROM events GROUP BY 1, 2)"


def _chart(spark, sf):
    e = table(spark, sf, "events").withColumn("hr_no", F.floor(micros(c("ts")) / 3.6e9))
    return e.groupBy("user_id", "hr_no").agg(*[F.avg(F.when(c("event_type") == t, c("value") * a + b)).alias(n) for n, (t, a, b) in CHARTED.items()], F.min(item("signup")).alias("sao2"))


def _imputed_sql(version, reference=False):
    """All seventeen columns, each by its own step."""
    limit = {n: s.limit for s in impute.STEPS for n in s.cols}
    fixed = {n: s.constant for s in impute.STEPS if s.constant is not None for n in s.cols}
    ranged = {n: f"CASE WHEN {n} BETWEEN {lo} AND {hi} THEN {n} END" for n, (lo, hi) in impute.RANGES.items()}
    flags = ["(sao2 IS NOT NULL)::INT AS abga_checked", "(bilirubin IS NULL)::INT AS bilirubin_missing"]
    first = f"{CHART}, r AS (SELECT user_id, hr_no, {', '.join(flags)}, " + ", ".join(f"{ranged[n] if version == 1 else n} AS {n}" for n in CHARTED) + " FROM p)"
    missing = ["lactate", "ph"] if version == 2 else ["lactate"]
    names = ["abga_checked", "bilirubin_missing", *[f"{n}_missing" for n in missing]]
    fill = {n: _lv(n, k) if k else f"coalesce({_lv(n)}, {_fv(n)})" for n, k in limit.items()}
    f = f"f AS (SELECT user_id, hr_no, {', '.join(names[:2])}, " + ", ".join(f"({n} IS NULL)::INT AS {n}_missing" for n in missing) + ", " + ", ".join(f"{fill[n]} AS {n}" for n in CHARTED) + " FROM r)"
    if reference:
        flat = lambda n: f"first_value({n} IGNORE NULLS) OVER (ORDER BY user_id, hr_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        g = f"g AS (SELECT user_id, hr_no, {', '.join(names)}, " + ", ".join(f"{flat(n) if limit[n] is None else n} AS {n}" for n in CHARTED) + " FROM f)"
    else:
        g = "g AS (SELECT * FROM f)"
    own = lambda n: f"coalesce({n}, median({n}) OVER (PARTITION BY user_id))" if version == 2 and limit[n] else n
    k = f"k AS (SELECT user_id, hr_no, {', '.join(names)}, " + ", ".join(f"coalesce({own(n)}, {fixed[n]}) AS {n}" if n in fixed else f"{own(n)} AS {n}" for n in CHARTED) + " FROM g), m AS (SELECT " + ", ".join(f"median({n}) AS {n}" for n in CHARTED) + " FROM k)"
    return f"WITH {first}, {f}, {g}, {k} SELECT k.user_id, k.hr_no, {', '.join(names)}, " + ", ".join(f"round(coalesce(k.{n}, m.{n}), 6) AS {n}" for n in CHARTED) + " FROM k, m"


@R.add(_imputed_sql(1))
def impute_all_v1(spark, sf):
    """All seventeen columns of a chart, ranges first."""
    return impute.impute(_chart(spark, sf), "user_id", "hr_no").withColumns({n: F.round(n, 6) for n in CHARTED})


@R.add(_imputed_sql(2))
def impute_all_v2(spark, sf):
    return impute.impute(_chart(spark, sf), "user_id", "hr_no", version=2).withColumns({n: F.round(n, 6) for n in CHARTED})


@R.add(_imputed_sql(1, reference=True))
def impute_all_reference(spark, sf):
    """The back-fill that isn't grouped: stays without any value take the next stay's first."""
    return impute.impute(_chart(spark, sf), "user_id", "hr_no", mode="reference").withColumns({n: F.round(n, 6) for n in CHARTED})


MISS = ("hr", "temp", "lactate", "bilirubin", "sao2")


@R.add(f"WITH {GRID} " + " UNION ALL ".join(f"SELECT '{x}' AS feature, count(*) AS n, round(avg(({x} IS NULL)::INT), 9) AS missing_rate FROM p" for x in MISS))
def missing_profile(spark, sf):
    return profile.missing(_grid(spark, sf), MISS)


@R.add(f"WITH {GRID} " + " UNION ALL ".join(f"SELECT '{x}' AS feature, (lactate > 30)::INT AS label, count(*) AS n, round(avg(({x} IS NULL)::INT), 9) AS missing_rate FROM p GROUP BY 2" for x in MISS))
def missing_by_label(spark, sf):
    return profile.missing(_grid(spark, sf).withColumn("label", (c("lactate") > 30).cast("int")), MISS, "label")


@R.add(f"""WITH {GRID}, b AS (SELECT *, CASE WHEN hr > 0 AND hr <= 20 THEN 'low' WHEN hr > 20 AND hr <= 60 THEN 'mid' WHEN hr > 60 AND hr <= 500 THEN 'high' END AS bin FROM p)
SELECT bin, count(*) AS n, round(avg((lactate IS NULL)::INT), 9) AS lactate_missing FROM b GROUP BY bin""")
def missing_by_bin(spark, sf):
    return _grid(spark, sf).groupBy(bucket(c("hr"), (0, 20, 60, 500), ("low", "mid", "high")).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(c("lactate").isNull().cast("int")), 9).alias("lactate_missing"))


@R.add("WITH v AS (SELECT l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS t FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM v" for a, b in (("q", "p"), ("q", "d"), ("q", "t"), ("p", "d"), ("p", "t"), ("d", "t"))))
def corr_pairs(spark, sf):
    l = table(spark, sf, "lineitem").select(c("l_quantity").alias("q"), c("l_extendedprice").alias("p"), c("l_discount").alias("d"), c("l_tax").alias("t"))
    return profile.correlations(l, ["q", "p", "d", "t"])


@R.add("""SELECT CAST(events AS BIGINT) AS n, flag, rate, odds_ratio, CASE WHEN odds_ratio > 1.0 THEN 'CONFIRM' ELSE 'REJECT' END AS verdict FROM
 (SELECT f AS flag, count(*) AS events, round(avg(y), 9) AS rate, round(max(o), 6) AS odds_ratio FROM (SELECT (l_discount > 0.05)::INT AS f, (l_returnflag = 'R')::INT AS y,
   (sum(CASE WHEN l_discount > 0.05 AND l_returnflag = 'R' THEN 1 ELSE 0 END) OVER () * 1.0 * sum(CASE WHEN NOT l_discount > 0.05 AND NOT l_returnflag = 'R' THEN 1 ELSE 0 END) OVER ())
   / (sum(CASE WHEN l_discount > 0.05 AND NOT l_returnflag = 'R' THEN 1 ELSE 0 END) OVER () * 1.0 * sum(CASE WHEN NOT l_discount > 0.05 AND l_returnflag = 'R' THEN 1 ELSE 0 END) OVER ()) AS o FROM lineitem) GROUP BY f)""")
def flag_event_rate_or(spark, sf):
    l = table(spark, sf, "lineitem")
    return profile.flag_odds(l, (c("l_discount") > 0.05).cast("int"), (c("l_returnflag") == "R").cast("int"))


@R.add("""SELECT round(avg((l_quantity = 25)::INT), 9) AS share, CASE WHEN avg((l_quantity = 25)::INT) > 0.5 THEN 'severe' WHEN avg((l_quantity = 25)::INT) > 0.2 THEN 'moderate' ELSE 'ok' END AS verdict FROM lineitem""")
def spike_share(spark, sf):
    return profile.spike(table(spark, sf, "lineitem"), "l_quantity", 25)


@R.add(f"""WITH {GAPS}, f AS (SELECT y IS NULL AS gap, (user_id % 2) AS label, y AS raw, coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts), 10.0) AS filled FROM g)
SELECT round(raw_gap, 6) AS raw_gap, round(filled_gap, 6) AS filled_gap, round(filled_gap / raw_gap, 6) AS retention FROM (SELECT avg(raw) FILTER (WHERE label = 1) - avg(raw) FILTER (WHERE label = 0) AS raw_gap,
  avg(filled) FILTER (WHERE label = 1) - avg(filled) FILTER (WHERE label = 0) AS filled_gap FROM f)""")
def gap_retention(spark, sf):
    g = _gaps(spark, sf).withColumn("filled", F.coalesce(impute.ffill("y", "user_id", "ts"), F.lit(10.0))).withColumn("label", c("user_id") % 2)
    return profile.retention(g, "y", "filled", "label")


VITALS = "v AS (SELECT user_id, ts, event_id, 40 + value * 0.3 AS hr, 60 + value * 0.5 AS sbp, 8 + value * 0.1 AS rr, 34 + value * 0.02 AS temp, 100 - value * 0.05 AS spo2, CAST(15 - event_id % 3 AS DOUBLE) AS gcs FROM events)"


def _vitals(spark, sf):
    v = c("value")
    return table(spark, sf, "events").select("user_id", "ts", "event_id", (40 + v * 0.3).alias("hr"), (60 + v * 0.5).alias("sbp"), (8 + v * 0.1).alias("rr"), (34 + v * 0.02).alias("temp"), (100 - v * 0.05).alias("spo2"), (15 - c("event_id") % 3).cast("double").alias("gcs"))


@R.add(f"""WITH {VITALS} SELECT event_id,
 CASE WHEN hr < 40 OR hr > 130 THEN 3 WHEN hr < 50 OR hr > 110 THEN 2 WHEN hr < 60 OR hr > 100 THEN 1 ELSE 0 END + CASE WHEN sbp < 70 THEN 3 WHEN sbp < 80 THEN 2 WHEN sbp < 100 THEN 1 ELSE 0 END
 + CASE WHEN rr < 9 OR rr > 30 THEN 3 WHEN rr > 25 THEN 2 WHEN rr < 12 OR rr > 20 THEN 1 ELSE 0 END + CASE WHEN temp < 35 OR temp > 39 THEN 2 WHEN temp < 36 OR temp > 38 THEN 1 ELSE 0 END AS mews_score,
 CASE WHEN rr <= 8 OR rr >= 25 THEN 3 WHEN rr BETWEEN 21 AND 24 THEN 2 WHEN rr BETWEEN 9 AND 11 THEN 1 ELSE 0 END + CASE WHEN spo2 <= 91 THEN 3 WHEN spo2 <= 93 THEN 2 WHEN spo2 <= 95 THEN 1 ELSE 0 END
 + CASE WHEN temp <= 35 OR temp >= 39.1 THEN 3 WHEN (temp > 35 AND temp <= 36) OR (temp >= 38.1 AND temp < 39.1) THEN 1 ELSE 0 END
 + CASE WHEN sbp <= 90 OR sbp >= 220 THEN 3 WHEN sbp BETWEEN 91 AND 100 THEN 2 WHEN sbp BETWEEN 101 AND 110 THEN 1 ELSE 0 END
 + CASE WHEN hr <= 40 OR hr >= 131 THEN 3 WHEN hr BETWEEN 111 AND 130 THEN 2 WHEN hr BETWEEN 41 AND 50 OR hr BETWEEN 91 AND 110 THEN 1 ELSE 0 END + CASE WHEN gcs < 15 THEN 3 ELSE 0 END AS news_score FROM v""")
def ews_scores(spark, sf):
    v = _vitals(spark, sf)
    return v.select("event_id", features.mews(c("hr"), c("sbp"), c("rr"), c("temp")).alias("mews_score"), features.news(c("rr"), c("spo2"), c("temp"), c("sbp"), c("hr"), c("gcs")).alias("news_score"))


@R.add(f"""WITH {MEASURED}, g AS (SELECT user_id, h, avg(value) AS y FROM m GROUP BY 1, 2), s AS (SELECT user_id, h, regr_slope(y, h) OVER (PARTITION BY user_id ORDER BY h ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS r FROM g)
SELECT user_id, h, round(CASE WHEN r IS NULL OR isnan(r) THEN 0 ELSE r END, 6) + 0 AS y_slope FROM s""")
def rolling_slope(spark, sf):
    g = measured(spark, sf).groupBy("user_id", "h").agg(F.avg("value").alias("y"))
    return g.select("user_id", "h", F.round(features.slope("y", "h", "user_id"), 6).alias("y_slope"))


@R.add(f"""WITH {VITALS}, x AS (SELECT event_id, sbp, hr, hr / nullif(CASE WHEN event_id % 10 = 0 THEN 0 ELSE sbp END, 0) AS si FROM v)
SELECT event_id, round(least(coalesce(si, (SELECT median(si) FROM x)), 3), 9) AS shock_index, round(greatest(0, least(200, sbp - hr)), 9) AS pulse_pressure, (sbp < 65)::INT AS map_below_65 FROM x""")
def shock_pulse(spark, sf):
    v = _vitals(spark, sf).withColumn("si", features.shock_index(c("hr"), F.when(c("event_id") % 10 == 0, 0).otherwise(c("sbp"))))
    v = impute.with_median(v, ["si"])
    return v.select("event_id", F.round(saturate(c("si"), 0.0, 3.0), 9).alias("shock_index"), F.round(features.pulse_pressure(c("sbp"), c("hr")), 9).alias("pulse_pressure"), (c("sbp") < 65).cast("int").alias("map_below_65"))


UNITS = ("med", "small", "stand", "promo", "small/med")


@R.add("SELECT p_partkey, " + ", ".join(f"regexp_matches(u, '{x}', 'i')::INT AS icu_{x.replace('/', '_')}" for x in UNITS) + " FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_type || '/MED' END AS u FROM part)")
def icu_flags(spark, sf):
    u = F.when(c("p_size") % 2 == 0, c("p_type")).otherwise(F.concat("p_type", F.lit("/MED")))
    return table(spark, sf, "part").withColumn("u", u).select("p_partkey", *features.unit_flags(c("u"), UNITS))


@R.add("""SELECT user_id, date_trunc('hour', ts) AS hour, max_by(value, ts) FILTER (WHERE event_type = 'view') AS eye, max_by(value, ts) FILTER (WHERE event_type = 'click') AS verbal, max_by(value, ts) FILTER (WHERE event_type = 'error') AS motor,
  round(coalesce(max_by(value, ts) FILTER (WHERE event_type = 'view'), 0) + coalesce(max_by(value, ts) FILTER (WHERE event_type = 'click'), 0) + coalesce(max_by(value, ts) FILTER (WHERE event_type = 'error'), 0), 6) AS total,
  round(coalesce(min(value) FILTER (WHERE event_type = 'view'), 0) + coalesce(min(value) FILTER (WHERE event_type = 'click'), 0) + coalesce(min(value) FILTER (WHERE event_type = 'error'), 0), 6) AS total_min FROM events GROUP BY 1, 2""")
def coma_scale_hourly(spark, sf):
    """A part that isn't charted counts 0, so partial charting totals less than the scale's least."""
    is_ = {"eye": "view", "verbal": "click", "motor": "error"}
    spec = {f"{k}": ("latest", c("event_type") == e, c("value")) for k, e in is_.items()} | {f"{k}_min": ("min", c("event_type") == e, c("value")) for k, e in is_.items()}
    p = icu.pivot(table(spark, sf, "events"), ["user_id", hour_of(c("ts")).alias("hour")], spec)
    total = lambda suffix: F.round(sum((F.coalesce(f"{k}{suffix}", F.lit(0.0)) for k in is_), F.lit(0.0)), 6)
    return p.select("user_id", "hour", *is_, total("").alias("total"), total("_min").alias("total_min"))


@R.add("""WITH w AS (SELECT user_id, avg(value) AS kg FROM events WHERE event_type = 'signup' AND value > 0 AND value < 50 AND user_id % 6 <> 0 GROUP BY user_id),
u AS (SELECT user_id, date_trunc('hour', ts) AS hour, sum(value) AS ml FROM events WHERE event_type = 'view' AND value > 0 AND value < 5000 GROUP BY 1, 2)
SELECT user_id, hour, round(ml, 6) AS urine_ml, round(coalesce(kg, (SELECT median(k2) FROM (SELECT kg AS k2 FROM u LEFT JOIN w USING (user_id)))), 6) AS weight_kg,
  round(ml / coalesce(kg, (SELECT median(k2) FROM (SELECT kg AS k2 FROM u LEFT JOIN w USING (user_id)))), 6) AS urine_ml_kg_hr,
  (ml / coalesce(kg, (SELECT median(k2) FROM (SELECT kg AS k2 FROM u LEFT JOIN w USING (user_id)))) < 0.5)::INT AS oliguria_flag FROM u LEFT JOIN w USING (user_id)""")
def urine_hourly(spark, sf):
    e = table(spark, sf, "events")
    w = e.where("event_type = 'signup' AND value > 0 AND value < 50 AND user_id % 6 <> 0").groupBy("user_id").agg(F.avg("value").alias("kg"))
    u = e.where("event_type = 'view' AND value > 0 AND value < 5000").groupBy("user_id", hour_of(c("ts")).alias("hour")).agg(F.sum("value").alias("ml"))
    j = impute.with_median(u.join(w, "user_id", "left"), ["kg"])
    rate = c("ml") / c("kg")
    return j.select("user_id", "hour", F.round("ml", 6).alias("urine_ml"), F.round("kg", 6).alias("weight_kg"), F.round(rate, 6).alias("urine_ml_kg_hr"), (rate < 0.5).cast("int").alias("oliguria_flag"))


@R.add("SELECT user_id, min(ts) AS dnr_time, arg_min(value, ts) AS first_value FROM events WHERE event_type = 'error' GROUP BY user_id")
def first_order_time(spark, sf):
    """The first row of the item, whatever its value says."""
    return table(spark, sf, "events").where("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("dnr_time"), F.min_by("value", "ts").alias("first_value"))


@R.add("""SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 9) AS delta, CASE WHEN event_type = 'view' AND value > 50 THEN round((value - 32) * 5 / 9, 9) ELSE value END AS celsius, TRY_CAST(CASE WHEN event_id % 9 = 0 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS parsed FROM events""")
def delta_and_units(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    text = F.when(c("event_id") % 9 == 0, "n/a").otherwise(c("event_id").cast("string"))
    f = (c("event_type") == "view") & (c("value") > 50)
    return table(spark, sf, "events").select("event_id", F.round(c("value") - F.lag("value").over(w), 9).alias("delta"), F.when(f, F.round((c("value") - 32) * 5 / 9, 9)).otherwise(c("value")).alias("celsius"), text.try_cast("double").alias("parsed"))


_FORMS = "CASE event_id % 8 WHEN 0 THEN s || 'Z' WHEN 1 THEN s || '+09:00' WHEN 2 THEN s WHEN 3 THEN ' ' || s || '.250Z ' WHEN 4 THEN substr(s, 1, 10) WHEN 5 THEN '' WHEN 6 THEN substr(s, 1, 4) ELSE 'on ' || s END"


@R.add(f"""WITH t AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS s FROM events), p AS (SELECT event_id, ts, user_id, {_FORMS} AS text,
  CASE event_id % 8 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 9 HOUR WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('second', ts) + INTERVAL 250 MILLISECOND WHEN 4 THEN date_trunc('day', ts) END AS moment FROM t)
SELECT event_id, text, epoch_us(moment) AS at_us, CAST(20 + user_id % 60 + year(moment) - (2020 + user_id % 9) AS BIGINT) AS age FROM p""")
def iso_times_and_ages(spark, sf):
    """Times in ISO forms, with zones and without, and ages in those years from an anchor year."""
    e = table(spark, sf, "events").withColumn("s", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).withColumn("text", F.expr(_FORMS))
    at = iso_time(c("text"))
    return e.select("event_id", "text", F.unix_micros(at).alias("at_us"), age_at(20 + c("user_id") % 60, 2020 + c("user_id") % 9, at).cast("long").alias("age"))
