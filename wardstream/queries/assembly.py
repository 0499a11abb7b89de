"""Entities, required fields, medians, samples, joins back, updates and transfers, over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import canonical_patient, contains_map
from ..operators import ner, profile, scoring, serving, slots, snapshots
from ..sources import readers, writers
from ..sources.stages import folder
from .common import Registry, table
from .notes import K, _k

R = Registry()
c = F.col

# entities ----------------------------------------------------------------------------------------

ENTITY = f"""e AS (SELECT event_id, {K} AS k, 'sat ' || (80 + {K} % 20) || ' dyspnea 없음 NC' AS raw FROM events)"""


@R.add(f"""WITH {ENTITY} SELECT event_id, CASE k % 5 WHEN 0 THEN 'spo2_value' WHEN 1 THEN 'spo2_value' WHEN 2 THEN 'o2_device' WHEN 3 THEN 'altered_mentation' ELSE 'hr_value' END AS slot,
  CASE k % 5 WHEN 0 THEN CAST(80 + k % 20 AS DOUBLE) WHEN 1 THEN 91 WHEN 4 THEN 77 END AS v_num, CASE WHEN k % 5 = 3 THEN true END AS v_bool, CASE WHEN k % 5 = 2 THEN 'NC' END AS v_str FROM e""")
def ner_entity_forms(spark, sf):
    """Entities as models write them: text read from the document by its span, lower-case labels, `type`, `slot_name` and `value`."""
    e = table(spark, sf, "events").select("event_id", _k().alias("k")).withColumn("raw", F.concat(F.lit("sat "), (c("k") % 20 + 80).cast("string"), F.lit(" dyspnea 없음 NC")))
    m, none = c("k") % 5, F.lit(None)
    ents = e.select(
        c("event_id").alias("document_id"), F.lit("nursing_note").alias("document_type"), F.when(m == 0, "SPO2").when(m == 1, "spo2").alias("label"), F.when(m == 2, "o2_device").alias("type"),
        F.when(m == 3, "altered_mentation").when(m == 4, "hr_value").alias("slot_name"), F.when(m == 3, "drowsy").alias("text"), F.when(m == 1, "91").when(m == 4, "HR 77").alias("value"),
        F.when(m == 0, 4).when(m == 2, 18).cast("int").alias("start"), F.when(m == 0, 6).when(m == 2, 20).cast("int").alias("end"), none.cast("double").alias("score"),
    )
    known = ner.with_text(ents, e.select(c("event_id").alias("document_id"), c("raw").alias("raw_text")))
    have = e.select(c("event_id").alias("document_id"), F.lit("nothing").alias("slot"))
    return ner.fill(known, have).select(c("document_id").alias("event_id"), "slot", "v_num", "v_bool", "v_str")


@R.add(f"WITH {ENTITY} SELECT event_id, strpos(raw, 'dyspnea') - 1 AS start, strpos(raw, 'dyspnea') + 6 AS \"end\", contains(substr(raw, strpos(raw, 'dyspnea') + 7, 8), '없') AS negated FROM (SELECT event_id, CASE WHEN k % 2 = 0 THEN raw ELSE replace(raw, '없음', '있음') END AS raw FROM e)")
def ner_auto_label(spark, sf):
    """Spans of a pattern, each with whether a negation follows within eight characters."""
    k = _k()
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("sat "), (k % 20 + 80).cast("string"), F.lit(" dyspnea "), F.when(k % 2 == 0, "없음").otherwise("있음"), F.lit(" NC")).alias("raw"))
    return e.select("event_id", F.explode(ner.spans(c("raw"), r"(?i)\bdyspnea\b", "DYSPNEA")).alias("s")).select("event_id", c("s.start").cast("long").alias("start"), c("s.end").cast("long").alias("end"), "s.negated")


@R.add(f"""WITH e AS (SELECT event_id, {K} % 4 AS n FROM events) SELECT event_id, 2 AS start, 2 + n AS "end", 'X' AS label FROM e WHERE n > 0 UNION ALL SELECT event_id, 7, 9, 'Y' FROM e""")
def bio_round_trip(spark, sf):
    """Tags of tokens from spans, and the spans read back from the tags."""
    n = _k() % 4
    token = lambda i: F.struct(F.lit(i).alias("start"), F.lit(i + 1).alias("end"))
    span = lambda a, b, label: F.struct(F.lit(a).alias("start"), b.cast("int").alias("end"), F.lit(label).alias("label"))
    marks = F.filter(F.array(span(2, n + 2, "X"), span(7, F.lit(9), "Y")), lambda s: s["end"] > s["start"])
    e = table(spark, sf, "events").select("event_id", F.array(*[token(i) for i in range(10)]).alias("t"), marks.alias("s")).withColumn("tags", ner.bio(c("t"), c("s")))
    return e.select("event_id", F.explode(ner.unbio(c("t"), c("tags"))).alias("s")).select("event_id", c("s.start").alias("start"), c("s.end").alias("end"), "s.label")


# texts -------------------------------------------------------------------------------------------


@R.add(f"""WITH e AS (SELECT event_id, {K} AS k FROM events) SELECT event_id, CASE k % 4 WHEN 0 THEN CASE WHEN k % 13 <= 10 THEN k % 13 ELSE 5 END WHEN 1 THEN k % 11 WHEN 2 THEN CASE WHEN k % 14 <= 10 THEN k % 14 END END AS nrs FROM e""")
def pain_first_valid(spark, sf):
    """The objective part first, then the whole text; of three patterns the first whose value lies in 0 to 10."""
    k = _k()
    text = lambda *xs: F.concat(*[x if isinstance(x, str) is False else F.lit(x) for x in xs])
    s = lambda n: (k % n).cast("string")
    objective = F.when(k % 4 == 0, text("pain: ", s(13), "/10, NRS 5")).when(k % 4 == 1, text("VAS none, ", s(11), "/10 (NRS)"))
    raw = F.when(k % 4 == 2, text("NRS = ", s(14))).otherwise(F.lit("통증 3/10 later"))
    raw = F.when(k % 4 == 3, F.lit("no pain named")).otherwise(raw)
    return table(spark, sf, "events").select("event_id", slots.first_pain(objective, raw).alias("nrs"))


@R.add(f"""WITH e AS (SELECT event_id, chr(CAST(65 + {K} % 26 AS INTEGER)) || lpad(CAST({K} % 10 AS VARCHAR), 2, '0') AS code, 2150 + {K} AS y, {K} % 3 AS m FROM events)
SELECT event_id, CASE WHEN m <> 2 THEN code END AS infection_code, CASE WHEN m <> 1 THEN 'fever ' || y END AS diagnosis, y || '-03-09' AS admit_date FROM e""")
def profile_scrape(spark, sf):
    """Code, reason and date from profile texts; null where a text doesn't name them."""
    k = _k()
    code = F.concat(F.chr(k % 26 + 65), F.lpad((k % 10).cast("string"), 2, "0"))
    head = F.when(k % 3 != 2, F.concat(F.lit("# "), code, F.lit(" v5 - x\n"))).otherwise(F.lit("no title\n"))
    reason = F.when(k % 3 != 1, F.concat(F.lit("- 입원 사유: **fever "), (k + 2150).cast("string"), F.lit("**\n"))).otherwise(F.lit(""))
    e = table(spark, sf, "events").select("event_id", F.concat(head, reason, F.lit("Date: "), (k + 2150).cast("string"), F.lit("-03-09")).alias("md"))
    return e.select("event_id", *[readers.scraped(c("md"), n).alias(n) for n in ("infection_code", "diagnosis", "admit_date")])


@R.add(f"""SELECT event_id, CASE {K} % 4 WHEN 0 THEN CAST(10000000 + user_id AS VARCHAR) WHEN 1 THEN 'T' || user_id WHEN 2 THEN CAST(user_id AS VARCHAR) END AS patient, split_part(event_type || '_' || user_id, '_', 1) AS first, substr(props, 1, 6) AS cut,
  CASE WHEN event_type LIKE '%ew%' THEN 'seen' WHEN event_type LIKE '%cl%' OR event_type LIKE '%ck%' THEN 'touched' ELSE event_type END AS mapped FROM events""")
def id_and_text_parts(spark, sf):
    """Ids in their canonical form, the first part of a name, a text cut short, and an ordered map of substrings."""
    k, u = _k() % 4, c("user_id").cast("string")
    raw = F.when(k == 0, (c("user_id") + 10_000_000).cast("string")).when(k == 1, F.concat(F.lit("patient_t"), u)).when(k == 2, F.concat(u, F.lit("_Patient"))).otherwise("nobody")
    return table(spark, sf, "events").select(
        "event_id", canonical_patient(raw).alias("patient"), F.split_part(F.concat_ws("_", "event_type", u), F.lit("_"), F.lit(1)).alias("first"), F.substring("props", 1, 6).alias("cut"),
        contains_map(c("event_type"), [("ew", "seen"), ("cl", "touched"), ("ck", "touched")], c("event_type")).alias("mapped"),
    )


@R.add(f"""WITH e AS (SELECT *, {K} AS k FROM events), r AS (SELECT CASE WHEN k % 7 = 0 THEN 'no_patient' WHEN k % 11 = 0 THEN 'no_time' WHEN k % 5 = 0 THEN 'no_slots' ELSE 'kept' END AS outcome FROM e) SELECT outcome, count(*) AS n FROM r GROUP BY 1""")
def required_fields(spark, sf):
    """Documents without patient, time or slots are left out and counted by what they lack first."""
    k = _k()
    e = table(spark, sf, "events").select("event_id", F.when(k % 7 != 0, c("user_id").cast("string")).alias("patient_id"), F.when(k % 11 != 0, c("ts")).alias("doc_datetime"), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("event_type")).alias("slots"))
    return snapshots.outcomes(e, F.size("slots") > 0)


@R.add(f"""SELECT user_id AS patient_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY {K} % 3, coalesce({K} % 2, 0), CASE WHEN hour(ts) BETWEEN 6 AND 13 THEN 0 WHEN hour(ts) BETWEEN 14 AND 21 THEN 1 ELSE 2 END, event_id) AS place FROM events""")
def snapshot_order(spark, sf):
    from ..functions.scalar import shift_of

    e = table(spark, sf, "events").select(c("user_id").alias("patient_id"), F.concat(F.lit("axis"), (_k() % 3).cast("string")).alias("axis"), (_k() % 2).alias("hd"), F.lit(0).alias("d_number"), shift_of(c("ts")).alias("shift"), "event_id")
    w = Window.partitionBy("patient_id").orderBy(*snapshots.order()[1:], "event_id")
    return e.select("patient_id", "event_id", F.row_number().over(w).cast("long").alias("place"))


@R.add(f"""WITH e AS (SELECT event_id, CASE {K} % 4 WHEN 0 THEN ['range', 'enum'] WHEN 1 THEN ['range'] ELSE CAST([] AS VARCHAR[]) END AS warnings, CASE {K} % 3 WHEN 0 THEN ['temp_value'] WHEN 1 THEN ['temp_value', 'o2_device'] ELSE CAST([] AS VARCHAR[]) END AS missing FROM events)
SELECT 'warning' AS kind, unnest AS name, count(*) AS n FROM (SELECT unnest(warnings) AS unnest FROM e) GROUP BY 2 UNION ALL SELECT 'missing', unnest, count(*) FROM (SELECT unnest(missing) AS unnest FROM e) GROUP BY 2""")
def issue_counters(spark, sf):
    """How often each warning and each missing slot occurs."""
    k, none = _k(), F.array().cast("array<string>")
    warn = F.when(k % 4 == 0, F.array(F.lit("range"), F.lit("enum"))).when(k % 4 == 1, F.array(F.lit("range"))).otherwise(none)
    lack = F.when(k % 3 == 0, F.array(F.lit("temp_value"))).when(k % 3 == 1, F.array(F.lit("temp_value"), F.lit("o2_device"))).otherwise(none)
    return profile.counters(table(spark, sf, "events").select(warn.alias("warning"), lack.alias("missing")), ["warning", "missing"])


# profiles, samples, medians ----------------------------------------------------------------------

FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@R.add(" UNION ALL ".join(
    f"SELECT '{x}' AS feature, count({x}) AS n, round(avg({x}), 6) AS mean, round(stddev({x}), 6) AS std, min({x}) AS low, round(quantile_cont({x}, 0.25), 6) AS p25, round(quantile_cont({x}, 0.5), 6) AS p50, round(quantile_cont({x}, 0.75), 6) AS p75, max({x}) AS high FROM lineitem" for x in FEATURES))
def describe(spark, sf):
    return profile.describe(table(spark, sf, "lineitem"), FEATURES)


@R.add("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity - 25 AS off FROM lineitem ORDER BY abs(l_quantity - 25) DESC, l_orderkey, l_partkey, l_linenumber LIMIT 50")
def top_by_absolute(spark, sf):
    """The rows farthest from a value, whichever way."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", (c("l_quantity") - 25).alias("off"))
    return l.orderBy(F.desc(F.abs("off")), "l_orderkey", "l_partkey", "l_linenumber").limit(50)


@R.add("SELECT event_id, CASE WHEN h < 0.8 THEN 'train' WHEN h < 0.9 THEN 'dev' ELSE 'test' END AS part FROM (SELECT event_id, CAST('0x' || substr(md5('7:' || event_id), 1, 8) AS BIGINT) / 4294967296 AS h FROM events)")
def seeded_split(spark, sf):
    """Parts by a hash of seed and id: the same in every run and for every order of the rows."""
    return table(spark, sf, "events").select("event_id", profile.part_of(c("event_id"), 7, {"train": 0.8, "dev": 0.1, "test": 0.1}).alias("part"))


@R.add("""WITH s AS (SELECT event_id, round(value * 0.1, 9) AS shap FROM events WHERE CAST('0x' || substr(md5('3:' || event_id), 1, 8) AS BIGINT) / 4294967296 < 0.25) SELECT e.event_id, value, shap FROM events e LEFT JOIN s ON s.event_id = e.event_id""")
def sampled_join_back(spark, sf):
    """What was computed on a seeded sample, joined back to all rows; the others stay without."""
    e = table(spark, sf, "events")
    s = e.where(profile.unit_hash(c("event_id"), 3) < 0.25).select("event_id", F.round(c("value") * 0.1, 9).alias("shap"))
    return e.select("event_id", "value").join(s, "event_id", "left")


@R.add(" UNION ALL ".join(f"SELECT '{x}' AS feature, round(coalesce(median({x}), 0), 9) AS median FROM lineitem" for x in FEATURES) + " UNION ALL SELECT 'no_such_column', 0.0")
def feature_medians(spark, sf):
    """Medians of the features that a model asks for, built from the data; 0 for a column that isn't there."""
    return scoring.medians(table(spark, sf, "lineitem"), [*FEATURES, "no_such_column"]).select("feature", F.round("median", 9).alias("median"))


# serving -----------------------------------------------------------------------------------------


@R.add("""WITH f AS (SELECT l_orderkey, count(DISTINCT l_linenumber % 4) AS kinds, max((l_returnflag = 'R')::INT) AS r, max((l_returnflag = 'A' AND l_linestatus = 'F')::INT) AS a, max((l_shipdate < TIMESTAMP '1995-01-01')::INT) AS early FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN early = 1 THEN 'Pneumonia' WHEN r = 1 THEN 'UTI' ELSE 'GI' END AS kind FROM f WHERE kinds = 4 AND ((early = 1 AND (r = 1 OR a = 1)) OR (early = 0 AND r = 1 AND a = 0))""")
def representative_cohort(spark, sf):
    """All four specimens, and the drug classes that fit the kind of infection."""
    l, any_ = table(spark, sf, "lineitem"), lambda cond: F.max(cond.cast("int"))
    f = l.groupBy("l_orderkey").agg(
        F.countDistinct(c("l_linenumber") % 4).alias("kinds"), any_(c("l_returnflag") == "R").alias("r"), any_((c("l_returnflag") == "A") & (c("l_linestatus") == "F")).alias("a"), any_(c("l_shipdate") < F.lit("1995-01-01").cast("timestamp_ntz")).alias("early")
    )
    fits = ((c("early") == 1) & ((c("r") == 1) | (c("a") == 1))) | ((c("early") == 0) & (c("r") == 1) & (c("a") == 0))
    return f.where((c("kinds") == 4) & fits).select("l_orderkey", F.when(c("early") == 1, "Pneumonia").when(c("r") == 1, "UTI").otherwise("GI").alias("kind"))


@R.add("""WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'), u AS (SELECT o_orderkey, max(o_totalprice) AS price FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_orderkey IN (SELECT o_orderkey FROM gone) THEN NULL ELSE l_suppkey END AS supplier, CASE WHEN u.o_orderkey IS NOT NULL THEN price ELSE l_extendedprice END AS price FROM lineitem LEFT JOIN u ON u.o_orderkey = l_orderkey""")
def detach_and_update(spark, sf):
    """Dependants of what goes are detached, and rows that an update names take its values."""
    o = table(spark, sf, "orders").select(c("o_orderkey").alias("l_orderkey"), "o_orderstatus", c("o_totalprice").alias("price"))
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", c("l_suppkey").alias("supplier"), c("l_extendedprice").alias("price"))
    gone, changed = o.where("o_orderstatus = 'F'").select("l_orderkey"), o.where("o_orderstatus = 'P'").groupBy("l_orderkey").agg(F.max("price").alias("price"))
    return serving.updated(serving.detached(l, gone, "l_orderkey", ["supplier"]), changed, "l_orderkey", ["price"])


@R.add()
def transfer_cases(spark, sf):
    """Each patient gets the next bed of its ward, or of the last ward of its region that has one: what one gets depends on
    all before, so SQL has no form for it; tests compare with a plain loop."""
    n = F.broadcast(table(spark, sf, "nation").select("n_nationkey", "n_regionkey"))  # a table of fixed size
    p = table(spark, sf, "customer").join(n, c("c_nationkey") == c("n_nationkey")).select(c("n_regionkey").alias("site"), c("c_nationkey").alias("ward"), c("c_custkey").alias("patient_id"))
    b = table(spark, sf, "supplier").join(n, c("s_nationkey") == c("n_nationkey")).select(c("n_regionkey").alias("site"), c("s_nationkey").alias("ward"), c("s_suppkey").alias("bed_id"))
    return serving.plan_with_fallback(p, b)


# files -------------------------------------------------------------------------------------------


@R.add("SELECT event_id, event_type, value FROM events WHERE value IS NOT NULL")
def csv_round_trip(spark, sf):
    """Written with a header into the shared folder, and read back with its types and required columns checked."""
    to = folder(spark)
    writers.csv(table(spark, sf, "events").select("event_id", "event_type", "value").where("value IS NOT NULL"), to)
    return readers.csv(spark, to, "event_id long, event_type string, value double", ("event_id", "value"))


@R.add(f"SELECT event_id, CAST({K} AS DOUBLE) / 100 AS share FROM events WHERE {K} % 10 <> 3")
def json_lines_round_trip(spark, sf):
    """JSON lines with numbers such as .07, blank lines and broken ones: the numbers are mended, the rest is left out."""
    k, to = _k(), folder(spark)
    line = F.when(k % 10 == 3, F.when(k % 20 == 3, "{broken").otherwise("")).otherwise(F.concat(F.lit('{"event_id": '), c("event_id").cast("string"), F.lit(', "share": .'), F.lpad(k.cast("string"), 2, "0"), F.lit("}")))
    table(spark, sf, "events").select(line.alias("value")).write.text(to)
    return readers.json_lines(spark, to, "event_id long, share double")[0]
