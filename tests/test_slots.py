"""Slot extraction against patterns tried one by one, and serialization of odd texts."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from wardstream import queries as Q
from wardstream.operators import slot_specs, slots
from wardstream.queries import charts

ODD = [
    None, "", " \n", "SPO2 97 SpO2: 40% sp o 2 88", "NRS 3/10, pain score: 11/10; 통증 7점", "no dyspnea, denies nausea; 설사 없음", "ＳＰＯ２ 95", "SIMPLE MASK then room air", "O2 5L → 2L", "suction, NEB, fluid bolus 시행",
    "chest pain and flank pain", "Specimen : Blood\nStatus : FINAL\nOrganism : \"E\" \\coli\n\tAMP/SUL: R\n\tCTX : R", "worsening opacities, improved effusion RLL both", "BILİRUBIN ıSOLATION dIARRHEA K: 4.5 Cr: 1.25 Na:140", "x" * 50_000 + " Temp 37.5 V/S) 120/80 - 70 - 18 - 36.5 - 98%",
]


def test_only_rules_that_cannot_match_are_left_out(spark):
    rng = random.Random(4)
    every = slots.rules()
    words = sorted({w for r in every for w in slots.literals(r.pattern)}) + ["Temp 37.5", "WBC: 12.5", "3/10", "q4h", "R\n", ": ", " ", "L", "→", "2", "applied", "isolation"]
    texts = [t for t in ODD if t is not None] + ["".join(rng.choice(words) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    assert all(slots.literals(r.pattern) for r in every)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    tried = df.select("id", *[F.col("t").rlike(r.pattern).alias(str(i)) for i, r in enumerate(every)]).collect()
    held = {r["id"]: set(r["h"]) for r in df.select("id", slots.hits(F.col("t"), every).alias("h")).collect()}
    for r in tried:
        assert {i for i in range(len(every)) if r[str(i)]} <= held[r["id"]]
    assert sum(len(h) for h in held.values()) < 0.5 * len(every) * len(texts)


def test_odd_notes(spark):
    rows = [(i, kind, t) for i, t in enumerate(ODD) for kind in ("nursing_note", "microbiology", "radiology")]
    df = spark.createDataFrame(rows, "document_id int, document_type string, raw_text string").withColumn("_m", F.lit("clash"))
    got = {}
    for r in slots.extract(df).orderBy("document_id", "seq").collect():
        got.setdefault((r["document_id"], r["document_type"]), []).append((r["slot"], next((x for x in (r["v_num"], r["v_bool"], r["v_str"], r["v_arr"], r["v_obj"] and tuple(r["v_obj"])) if x is not None), None)))
    assert all((i, "nursing_note") not in got for i in range(3))
    assert got[3, "nursing_note"] == [("spo2_value", 97.0), ("spo2_value", 88.0)]
    assert [v for n, v in got[4, "nursing_note"] if n == "pain_nrs_value"] == [3.0, 7.0]
    assert ("dyspnea", True) in got[5, "nursing_note"] and ("nausea_vomiting", True) in got[5, "nursing_note"]
    assert ("o2_device", "SM") in got[7, "nursing_note"] and ("resp_support_event", "decrease") in got[8, "nursing_note"]
    assert ("prn_interventions", ["iv_fluid", "suction"]) in got[9, "nursing_note"] and ("pain_location_hint", "chest") in got[10, "nursing_note"]
    micro = dict(got[11, "microbiology"])
    assert micro["culture_result"] == ("pos", '"E" \\coli') and micro["resistance_detected"] == ["AMP/SUL", "CTX"] and (11, "radiology") not in got
    rad = dict(got[12, "radiology"])
    assert rad["cxr_lesion_type"] == ["effusion", "opacity"] and rad["cxr_location"] == ["RLL", "bilateral"] and rad["cxr_change_direction"] == "worsening" and rad["cxr_severity"] == "severe"
    assert dict(got[13, "nursing_note"])["creatinine_value"] == 1.2 and dict(got[13, "nursing_note"])["k_value"] == 4.5
    assert dict(got[14, "nursing_note"])["bp_sys"] == 120.0 and [v for n, v in got[14, "nursing_note"] if n == "temp_value"] == [36.5]
    assert slots.extract(df.limit(0)).count() == 0


def test_serialized_texts_are_json(spark):
    odd = ['a "b" \\c', "line\nfeed\ttab", "한국어", "", None]
    rows = [(1, "cxr_location", None, None, None, odd, None), (1, "culture_result", None, None, None, None, ("pos", odd[0])), (1, "culture_result", None, None, None, None, (odd[1], None)), (1, "spo2_value", 97.0, None, None, None, None), (1, "organism", None, None, odd[0], None, None), (1, "dyspnea", None, False, None, None, None)]
    df = spark.createDataFrame(rows, f"document_id int, slot string, v_num double, v_bool boolean, v_str string, v_arr array<string>, v_obj {slots.OBJ}").withColumn("vtype", F.lit("x"))
    text = [r["value_text"] for r in slots.serialized(df, slot_specs.SLOTS).collect()]
    assert json.loads(text[0]) == odd and json.loads(text[1]) == {"status": "pos", "organism": odd[0]} and json.loads(text[2]) == {"status": odd[1], "organism": None}
    assert text[3:] == ["97", odd[0], "false"] and not re.search("\n", text[0])


def test_copied_notes_are_tried_once_and_joined_to_all(spark):
    kinds = ("nursing_note", "microbiology", "radiology", None)
    rows = [(len(ODD) * 4 * r + 4 * i + j, k, t, (None, True, False)[r % 3]) for r in range(9) for i, t in enumerate(ODD) for j, k in enumerate(kinds)] + [(9999, "a\nb", "c SpO2 97", None), (9998, "a", "b\nc SpO2 97", None)]
    df = spark.createDataFrame(rows, "document_id int, document_type string, raw_text string, notify_md boolean")
    notes = slots.distinct_notes(df, notify_col="notify_md", rows_a_task=10)
    # null and empty texts, and null flags and false ones, say the same
    assert notes.count() == 4 * (len(ODD) - 1) * 2 + 2 and notes.rdd.getNumPartitions() > 10
    steps = lambda d, by: slots.merged(slots.with_defaults(slots.extract(d, by, notify_col="notify_md"), by), by)
    key = slots.note_id(F.col("raw_text"), F.col("document_type"), F.col("notify_md"))
    got = df.select("document_id", key.alias("note_id")).join(steps(notes, "note_id"), "note_id").drop("note_id")
    want = steps(df, "document_id").select(*got.columns)
    assert got.count() == want.count() > 900 and got.exceptAll(want).isEmpty()
    assert slots.distinct_notes(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["note_slots", "slot_words", "slot_lists", "slot_objects", "slot_numbers", "slot_evidence_split"])
def test_queries_try_a_text_once(spark, monkeypatch, name):
    read = []
    monkeypatch.setattr(slots, "extract", lambda docs, *a, f=slots.extract, **b: read.append(docs.count()) or f(docs, *a, **b))
    monkeypatch.setattr(charts, "_KEPT", {})
    assert Q.QUERIES[name](spark, SMALL).count() > 0
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    n = events.select("event_type", "props").distinct().count()
    assert 0 < read[0] <= n < events.count() and len(read) == 1
