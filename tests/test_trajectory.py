"""Change rules: literal rows for each kind of condition, and a plain fold over random snapshots."""

import datetime as dt
import random

import pytest

from wardstream.operators import trajectory as E
from wardstream.operators import trajectory_rules as T

T0 = dt.datetime(2024, 1, 1)
SLOTS = "temp_value double, wbc_value double, spo2_value int, o2_device string, o2_flow_lpm double, bp_sys int, bp_dia int, cxr_severity string, prn_interventions array<string>, altered_mentation boolean, pain_location_hint string, isolation_required string, isolation_applied boolean, mdro_status string, mdro_flag string, pain_nrs_value int, notify_mentioned boolean"
NAMES = [x.split()[0] for x in SLOTS.split(", ")]


def snapshots(spark, rows):
    """rows: (patient, hours, {slot: value})"""
    data = [(p, 1, i, "Day", T0 + dt.timedelta(hours=h), [f"d{i}"], *[s.get(n) for n in NAMES]) for i, (p, h, s) in enumerate(rows)]
    return spark.createDataFrame(data, f"patient_id string, hd int, d_number int, shift string, doc_datetime timestamp_ntz, source_docs array<string>, {SLOTS}")


def fired(spark, axis, event, steps, hours=None):
    rows = [("p", hours[i] if hours else i, s) for i, s in enumerate(steps)]
    out = E.events(snapshots(spark, rows), axis, [r for r in T.RULES[axis] if r[0] == event]).collect()
    return sorted(r["d_number"] for r in out), out


@pytest.mark.parametrize("axis,event,steps,hours,want", [
    ("B_infection_activity", "temp_spike", [{"temp_value": 37.0}, {"temp_value": 37.49}], None, []),
    ("B_infection_activity", "temp_spike", [{"temp_value": 37.0}, {"temp_value": 37.5}], None, [1]),
    ("B_infection_activity", "temp_spike", [{}, {"temp_value": 38.0}], None, []),
    ("B_infection_activity", "temp_spike", [{"temp_value": 37.0}, {}, {"temp_value": 37.6}], None, [2]),
    ("A_respiratory", "spo2_drop_same_o2", [{"spo2_value": 96, "o2_device": "NC"}, {"spo2_value": 95, "o2_device": "VM"}, {"spo2_value": 94}], None, [2]),
    ("A_respiratory", "spo2_drop_same_o2", [{"spo2_value": 96, "o2_flow_lpm": 2.0}, {"spo2_value": 95, "o2_flow_lpm": 3.0}, {"spo2_value": 95}], None, []),
    ("B_infection_activity", "lab_worsening", [{"wbc_value": 10.0}, {"wbc_value": 12.0}], [0, 48], [1]),
    ("B_infection_activity", "lab_worsening", [{"wbc_value": 10.0}, {"wbc_value": 12.0}], [0, 48.01], []),
    ("B_infection_activity", "lab_worsening", [{"wbc_value": 0.0}, {"wbc_value": 1.0}, {"wbc_value": 1.19}], None, [1]),
    ("A_respiratory", "cxr_severity_up", [{"cxr_severity": "mild"}, {"cxr_severity": "moderate"}, {"cxr_severity": "bogus"}], None, [1]),
    ("C_clinical_action", "notify_first_seen", [{"notify_mentioned": True}, {"notify_mentioned": True}, {"notify_mentioned": False}, {"notify_mentioned": True}], None, [0]),
    ("F_symptom_subjective", "mental_status_change", [{}, {"altered_mentation": True}, {"altered_mentation": True}, {"altered_mentation": False}, {"altered_mentation": True}], None, [1, 4]),
    ("C_clinical_action", "prn_increase", [{"prn_interventions": ["neb"]}, {"prn_interventions": ["neb", "suction"]}, {"prn_interventions": ["neb"]}], None, [0, 1]),
    ("F_symptom_subjective", "pain_location_change", [{"pain_location_hint": "unknown"}, {"pain_location_hint": "back"}, {"pain_location_hint": "flank"}, {}], None, [2]),
    ("E_infection_control", "isolation_gap", [{"isolation_required": "contact"}, {"isolation_required": "contact"}, {"isolation_required": "droplet"}, {"isolation_required": "contact", "isolation_applied": True}], None, [0, 2]),
    ("B_infection_activity", "hemodynamic_instability", [{"bp_sys": 89, "bp_dia": 80}, {"bp_sys": 95, "bp_dia": 45}, {"bp_sys": 90, "bp_dia": 60}], None, [0, 1]),
    ("F_symptom_subjective", "pain_escalation", [{"pain_nrs_value": 3}, {"pain_nrs_value": 4}, {"pain_nrs_value": 4}], None, [1]),
])
def test_conditions(spark, axis, event, steps, hours, want):
    assert fired(spark, axis, event, steps, hours)[0] == want


def test_texts(spark):
    _, out = fired(spark, "A_respiratory", "cxr_severity_up", [{"cxr_severity": "mild"}, {"cxr_severity": "severe"}])
    assert out[0]["render_text"] == "CXR: {cxr_location} {cxr_lesion_type} mild → severe (HD1 D+1)"
    assert out[0]["evidence_text"] == "cxr_severity: mild → severe; delta: 2.0" and out[0]["supporting_docs"] == ["d0", "d1"]
    assert out[0]["event_id"] == "EVT_p_A_001" and out[0]["axis_priority"] == 60


def fold(rows):
    """temp_spike, lab_worsening and mdro_confirmed, one patient after the other."""
    out, patients = set(), {}
    for i, (p, h, s) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        known, told = patients.setdefault(p, ({}, {}))
        for slot, event in (("temp_value", "temp_spike"), ("wbc_value", "lab_worsening")):
            if s.get(slot) is None or slot not in known:
                continue
            was, when, last = *known[slot], known.get("time")
            delta = s[slot] - was
            if event == "temp_spike" and delta >= 0.5:
                out.add((p, i, event))
            if event == "lab_worsening" and delta > 0 and (100.0 if was == 0 else delta / abs(was) * 100) >= 20 and h - min(when, last) <= 48:
                out.add((p, i, event))
        if s.get("mdro_status") == "confirmed" and told.get("flag", "never") != s.get("mdro_flag"):
            told["flag"] = s.get("mdro_flag")
            out.add((p, i, "mdro_confirmed"))
        known |= {k: (v, h) for k, v in s.items() if v is not None} | {"time": h}
    return out


def test_against_fold(spark):
    rng = random.Random(2)
    rows = []
    for p in range(20):
        h = 0
        for _ in range(25):
            h += rng.choice([1, 5, 30])
            rows.append((f"p{p}", h, {
                "temp_value": rng.choice([None, 36.0 + rng.randint(0, 30) / 10]), "wbc_value": rng.choice([None, float(rng.randint(0, 20))]),
                "mdro_status": rng.choice([None, "confirmed"]), "mdro_flag": rng.choice([None, "MRSA", "VRE"]),
            }))
    df = snapshots(spark, rows)
    rules = lambda axis, *names: [r for r in T.RULES[axis] if r[0] in names]
    e = E.events(df, "B_infection_activity", [r if r[0] == "temp_spike" else (*r[:2], r[2]["any"][0], r[3]) for r in rules("B_infection_activity", "temp_spike", "lab_worsening")])
    e = e.unionByName(E.events(df, "E_infection_control", rules("E_infection_control", "mdro_confirmed")))
    assert {(r["patient_id"], r["d_number"], r["event_type"]) for r in e.collect()} == fold(rows)
    assert E.in_order(e).count() == e.count() and E.coverage_gap(e).count() == 38 - 3
