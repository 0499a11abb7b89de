"""Literal notes, files, beds, streaming."""

import json

from pyspark.sql import functions as F

from wardstream.functions import rules, scalar
from wardstream.operators import ner, scoring, serving, slot_specs
from wardstream.plans import notes
from wardstream.queries import assembly, cohort
from wardstream.sources import readers, writers
from wardstream.streaming import events as streaming

NOTES = [
    (1, "V/S) 120/70 - 88 - 18 - 37.2 - 96% NC 2L → 4L no diarrhea NRS 11/10 HFNC 30L", "nursing_note", True), (2, "WBC: 14000 Plt: 250000 SpO2 49% SpO2 97", "lab_result", None),
    (3, "Specimen: URINE\nStatus: FINAL\nOrganism: E. coli\n  CIPRO : R\n  AMP : S\nMDRO ALERT: ESBL", "microbiology", None), (4, "increased bilateral opacities, moderate", "radiology", None), (5, None, "nursing_note", None),
    (6, "Organism: pending", "microbiology", None), (7, "격리 시행. 격리 아직", "physician_note", None),
]


def test_slots_and_events(spark):
    docs = spark.createDataFrame(NOTES, "document_id long, raw_text string, document_type string, notify_md boolean")
    found = notes.document_slots(docs)
    got = {(r["document_id"], r["slot"]): next((r[k] for k in ("v_num", "v_bool", "v_str", "v_arr", "v_obj") if r[k] is not None), None) for r in found.collect()}
    assert got[1, "bp_sys"] == 120 and got[1, "spo2_value"] == 96 and got[1, "o2_device"] == "NC" and got[1, "resp_support_event"] == "increase" and got[1, "diarrhea"] is True and (1, "pain_nrs_value") not in got
    assert got[2, "wbc_value"] == 14.0 and got[2, "platelet_value"] == 250 and got[2, "spo2_value"] == 97 and got[2, "o2_device"] == "RA"
    assert got[3, "specimen_type"] == "urine" and got[3, "culture_result"]["status"] == "pos" and got[3, "resistance_detected"] == ["CIPRO"] and got[3, "mdro_flag"] == "ESBL"
    assert got[4, "cxr_severity"] == "moderate" and got[4, "cxr_location"] == ["bilateral"] and got[4, "cxr_lesion_type"] == ["opacity"]
    assert got[5, "notify_mentioned"] is False and (6, "organism") not in got and got[7, "isolation_applied"] is True
    lack = {(r["document_id"]): r["missing"] for r in notes.slots.mandatory_missing(docs, found, slot_specs.MANDATORY).collect()}
    assert 1 not in lack and 5 in lack
    placed = docs.withColumns({"patient_id": F.lit("p"), "hd": F.lit(1), "d_number": F.col("document_id").cast("int"), "doc_datetime": (F.lit("2024-01-01 08:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("document_id").cast("int")))})
    assert {"new_mdro_detection", "culture_result_arrived"} <= {r["event_type"] for r in notes.patient_events(placed, found).collect()}


def test_files(spark, tmp_path):
    for p, hd in (("patient_10000001", "hd_01_d-2"), ("T03_Patient", "hd_02_d+1")):
        (tmp_path / p).mkdir()
        (tmp_path / p / f"{hd}.json").write_text(json.dumps({"date": "2024-01-0" + hd[4], "documents": [{"document_type": "lab_result", "raw_text": "a"}, {"document_type": "radiology", "raw_text": "b"}]}))
    rows = sorted((r["patient_id"], r["hd"], r["d_number"], r["document_type"]) for r in readers.documents(spark, str(tmp_path)).collect())
    assert rows == [("10000001", 1, -2, "lab_result"), ("10000001", 1, -2, "radiology"), ("T03", 2, 1, "lab_result"), ("T03", 2, 1, "radiology")]
    (tmp_path / "x.jsonl").write_text('{"a": .367}\n\n{"a": 2}\n{bad\n')
    good, bad = readers.json_lines(spark, str(tmp_path / "x.jsonl"), "a double")
    assert sorted(r["a"] for r in good.collect()) == [0.367, 2.0] and bad.count() == 1
    (tmp_path / "x.csv").write_text("﻿a,b\n1,2\n", encoding="utf-8")
    assert readers.csv(spark, str(tmp_path / "x.csv"), required=("a", "b")).columns == ["a", "b"]
    parents = spark.createDataFrame([(1,), (2,)], "k long")
    kids = spark.createDataFrame([(1, "b"), (1, "a")], "k long, v string")
    out = {r["k"]: [x["v"] for x in r["kids"]] for r in writers.nested(parents, {"kids": kids}, "k").collect()}
    assert out == {1: ["a", "b"], 2: []}
    assert writers.guarded(kids, str(tmp_path / "t"), False) == 2 and not (tmp_path / "t").exists() and writers.csv(kids, str(tmp_path / "c")) == 2


def test_beds_by_hand(spark):
    p = spark.createDataFrame([("w", 1, "UTI", "F", ["b"]), ("w", 2, "MDRO", "M", ["b"]), ("w", 3, "UTI", "M", None), ("w", 4, "UTI", "F", ["a"])], "ward string, patient_id long, infection_type string, gender string, preferred array<string>")
    b = spark.createDataFrame([("w", 1, "a", 2), ("w", 2, "a", 2), ("w", 3, "b", 1)], "ward string, bed_id long, room_id string, capacity int")
    got = {r["patient_id"]: (r["bed_id"], r["room_id"]) for r in serving.assign_beds(p, b).collect()}
    assert got == {2: (3, "b"), 1: (1, "a"), 3: (None, None), 4: (2, "a")}


def placed(people, beds):
    """The greedy rule as a plain loop over one ward."""
    first = {x: i for i, x in enumerate(serving.PLACE_FIRST)}
    free, shared, inside, out = {}, {}, {}, {}
    for b in beds:
        free.setdefault(b["room_id"], []).append(b["bed_id"])
        shared[b["room_id"]] = shared.get(b["room_id"], False) or b["capacity"] > 1
    for p in sorted(people, key=lambda p: (first.get(p["infection_type"], 9), p["patient_id"])):
        wanted = [r for r in p["preferred"] or [] if r in free]
        for r in [*wanted, *[r for r in sorted(free) if r not in wanted]]:
            if free[r] and (not shared[r] or inside.setdefault(r, set()) <= {p["gender"]}):
                inside.setdefault(r, set()).add(p["gender"])
                out[p["patient_id"]] = (min(free[r]), r)
                free[r].remove(min(free[r]))
                break
        else:
            out[p["patient_id"]] = (None, None)
    return out


def test_beds_against_a_loop(spark, sf_dir):
    """The registered query on its whole table; most wards have fewer beds than patients."""
    got = {}
    for r in cohort.bed_assignment(spark, sf_dir).collect():
        assert r["patient_id"] not in got
        got[r["patient_id"]] = (r["bed_id"], r["room_id"])
    kinds = serving.PLACE_FIRST
    people, beds = {}, {}
    for r in spark.read.parquet(f"{sf_dir}/customer.parquet").collect():
        people.setdefault(r["c_nationkey"], []).append({"patient_id": r["c_custkey"], "infection_type": kinds[r["c_custkey"] % 5], "gender": "M" if r["c_acctbal"] > 4000 else "F", "preferred": [f"r{r['c_custkey'] % 4}"]})
    for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").collect():
        beds.setdefault(r["s_nationkey"], []).append({"bed_id": r["s_suppkey"], "room_id": f"r{r['s_suppkey'] % 3}", "capacity": r["s_suppkey"] % 2 + 1})
    want = {}
    for ward, ps in people.items():
        want |= placed(ps, beds.get(ward, []))
    assert got == want and any(b is not None for b, _ in got.values())


def test_transfers_against_a_loop(spark, sf_dir):
    got = {r["patient_id"]: (r["to_ward"], r["bed_id"]) for r in assembly.transfer_cases(spark, sf_dir).collect()}
    region = {r["n_nationkey"]: r["n_regionkey"] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()}
    free, want = {}, {}
    for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").collect():
        free.setdefault(region[r["s_nationkey"]], {}).setdefault(r["s_nationkey"], []).append(r["s_suppkey"])
    for r in sorted(spark.read.parquet(f"{sf_dir}/customer.parquet").collect(), key=lambda r: r["c_custkey"]):
        pool = free.get(region[r["c_nationkey"]], {})
        ward = next((w for w in [r["c_nationkey"], *sorted(pool, reverse=True)] if pool.get(w)), None)
        bed = min(pool[ward]) if ward is not None else None
        if ward is not None:
            pool[ward].remove(bed)
        want[r["c_custkey"]] = (ward, bed)
    assert got == want and any(b is None for _, b in got.values()) and any(b is not None for _, b in got.values())


def test_places_of_a_hot_ward(spark):
    """A ward with most patients, rooms that hold one class, ties in priority, wishes for rooms that don't exist, nulls, and a ward without beds."""
    import random

    rnd = random.Random(5)
    people = [(rnd.choice(["a", "a", "a", "b", "c", None]), i, rnd.choice([*serving.PLACE_FIRST, "x", None]), rnd.choice(["F", "M", None]), rnd.choice([None, [], ["r1", "r9"], ["r3", "r0"], ["r2"]])) for i in range(600)]
    beds = [(rnd.choice(["a", "a", "b"]), i, f"r{rnd.randrange(6)}", rnd.choice([1, 1, 2])) for i in range(60)]
    p = spark.createDataFrame(people, "ward string, patient_id long, infection_type string, gender string, preferred array<string>")
    b = spark.createDataFrame(beds, "ward string, bed_id long, room_id string, capacity int")
    want = {i: (None, None) for _, i, *_ in people}
    for w in "abc":
        ps = [dict(zip(("patient_id", "infection_type", "gender", "preferred"), x[1:])) for x in people if x[0] == w]
        want |= placed(ps, [dict(zip(("bed_id", "room_id", "capacity"), x[1:])) for x in beds if x[0] == w])
    assert {r["patient_id"]: (r["bed_id"], r["room_id"]) for r in serving.assign_beds(p, b).collect()} == want and sum(x[0] is not None for x in want.values()) > 20
    assert {tuple(r)[2:] for r in serving.assign_beds(p, b.where("false")).collect()} == {(None, None)} and serving.assign_beds(p.where("false"), b).count() == 0


def test_updates_that_repeat(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    twice = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "k long, v string, at long")
    assert {tuple(r) for r in serving.updated(rows, twice, "k", ["v"], F.col("at")).collect()} == {(1, "y"), (2, "b")}
    try:
        serving.updated(rows, twice, "k", ["v"]).collect()
        raise AssertionError("two changes of a key went through")
    except Exception as e:
        assert "changed more than once: 1" in str(e)


def test_models_thresholds_and_medians(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "x"), (3.0, "4"), (None, "6")], "a double, b string")
    want = {"a": 2.0, "b": 5.0, "c": 0.0}
    assert scoring.kept_medians(spark, str(tmp_path / "m"), df, ["a", "b", "c"]) == want == scoring.kept_medians(spark, str(tmp_path / "m"), None, ["a"])
    assert scoring.kept_thresholds(spark, str(tmp_path / "t")) == {"low": 0.3, "high": 0.6, "critical": 0.85}
    spark.createDataFrame([("thresh_high", 0.7)], "thresh_name string, value double").coalesce(1).write.option("header", True).csv(str(tmp_path / "u"))
    assert scoring.kept_thresholds(spark, str(tmp_path / "u"))["critical"] == 0.7 + 0.2


def test_keys_that_repeat(spark):
    rows, keys = spark.createDataFrame([(1, "a")], "id long, k string"), spark.createDataFrame([("a", 5), ("a", 3)], "k string, v long")
    assert [r["v"] for r in serving.cascade(rows, keys, "id", [{"k": F.col("k")}], ["k"], "v").collect()] == [3]


def test_small_expressions(spark):
    df = spark.createDataFrame([("MDRO", "patient_10000001", 0.7), ("x", "T05_Patient", 0.1), (None, "??", None)], "kind string, raw string, s double")
    got = df.select(rules.isolation_of(F.col("kind")), scalar.canonical_patient(F.col("raw")), rules.risk_of(F.col("s")), rules.risk_series(F.col("kind"))[0], F.array_join(rules.clinical_flags(F.col("kind")), ",")).collect()
    assert [tuple(r) for r in got] == [("CONTACT", "10000001", "HIGH", 0.54, "isolation_required,cohort_consideration"), ("STANDARD", "T05", "LOW", 0.22, "monitoring"), ("STANDARD", None, "LOW", 0.22, "monitoring")]
    t = spark.range(1).select(F.expr("array(named_struct('start',0,'end',3),named_struct('start',4,'end',6),named_struct('start',7,'end',9))").alias("t"), F.expr("array(named_struct('start',4,'end',9,'label','X'))").alias("s"))
    assert t.select(ner.bio(F.col("t"), F.col("s"))).first()[0] == ["O", "B-X", "I-X"]


def test_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = str(tmp_path / "in")
    e.coalesce(1).write.parquet(src)
    q = streaming.windowed(spark.readStream.schema(e.schema).parquet(src)).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = streaming.windowed(e).groupBy("user_id").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, spark.table("w").groupBy("user_id").agg(F.sum("n")).collect())) == sorted(map(tuple, want.collect()))


def test_mute_numbers_are_read_by_their_span(spark):
    from wardstream.operators import ner

    docs = spark.createDataFrame([("d", "sat 91 on NC")], "document_id string, raw_text string")
    ents = spark.createDataFrame(
        [("d", "SPO2", "low", None, 4, 6), ("d", "hr", "fast", "88", 4, 6), ("d", "RR", "quick", None, None, None), ("d", "TEMP", "37.5", None, 0, 3), ("d", "WOB", "labored", None, 0, 3)],
        "document_id string, label string, text string, value string, start int, end int",
    )
    got = {r["label"]: r["text"] for r in ner.with_text(ents, docs).collect()}
    assert got == {"SPO2": "91", "hr": "88", "RR": "quick", "TEMP": "37.5", "WOB": "labored"}


def test_iso_times(spark):
    from pyspark.sql import functions as F

    from wardstream.functions.scalar import age_at, iso_time

    texts = ["2024-02-29T10:00:00Z", " 2024-02-29 10:00+02:00 ", "2024-02-29", "2023-02-29", "2024", "", None, "at 2024-02-29", "2024-02-29T25:00:00Z"]
    r = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.unix_seconds(iso_time(F.col("t"))).alias("s"), age_at(F.lit(40), F.lit(2020), iso_time(F.col("t"))).alias("age")).orderBy("i").collect()
    assert [x["s"] for x in r] == [1709200800, 1709193600, 1709164800] + [None] * 6 and [x["age"] for x in r] == [44] * 3 + [None] * 6


def test_database(spark):
    """Against the Derby that ships with Spark, as one task, split by a number, and split by predicates."""
    import glob
    import os

    import pyspark
    import pytest

    if not glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "derby-*.jar")):
        pytest.skip("no Derby here")
    url, how = "jdbc:derby:memory:wards;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.range(100).select(F.col("id").alias("K"), (F.col("id") % 7).alias("V")).write.jdbc(url, "T", properties=how)
    want = sorted((i, i % 7) for i in range(100) if i % 7 > 2)
    query = "SELECT K, V FROM T WHERE V > 2"
    for split, tasks in (({}, 1), ({"column": "K", "bounds": (0, 100), "parts": 4}, 4), ({"predicates": ["K < 50", "K >= 50"]}, 2)):
        df = readers.jdbc(spark, url, query, **split, **how)
        assert sorted(map(tuple, df.collect())) == want and df.rdd.getNumPartitions() == tasks


def test_specs(tmp_path):
    import pytest

    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text("slots:\n  hr: {type: integer}\n")
    assert readers.spec("s.yaml", (str(tmp_path),)) == {"slots": {"hr": {"type": "integer"}}} == readers.spec(str(tmp_path / "s.yaml"))
    with pytest.raises(FileNotFoundError):
        readers.spec("t.yaml", (str(tmp_path),))
