"""The change rules of each axis, as (event, severity, condition, template), in order of priority."""

AXIS_PRIORITY = {"A_respiratory": 60, "D_escalation": 55, "B_infection_activity": 50, "C_clinical_action": 45, "E_infection_control": 40, "F_symptom_subjective": 30}
ALIASES = {"device": "o2_device"}
RANKS = {
    "cxr_severity": ("unknown", "normal", "minimal", "mild", "moderate", "severe"), "monitoring_level": ("unknown", "standard", "enhanced", "intensive"),
    "vitals_frequency": ("unknown", "q8h", "q6h", "q4h", "q2h", "continuous"),
}


def _eq(slot, v, **more):
    return {"slot": slot, "equals": v} | more


def _dir(slot, direction, **more):
    return {"slot": slot, "direction": direction} | more


_O2 = "{o2_device} {o2_flow_prev}L → {o2_flow_new}L ({day})"

RULES = {
    "A_respiratory": [
        ("resp_support_increase", "high", {"any": [_eq("resp_support_event", "increase"), _dir("o2_flow_lpm", "up", threshold_abs=1)]}, f"Resp support increased: {_O2}"),
        ("o2_start_or_increase", "high", {"any": [_eq("resp_support_event", "start"), _eq("resp_support_event", "increase"), _dir("o2_flow_lpm", "up", threshold_abs=1)]}, f"O2: {_O2}"),
        ("spo2_drop_same_o2", "medium", _dir("spo2_value", "down", condition="same_o2_if_possible"), "SpO2: {spo2_prev}% → {spo2_new}% (same O2) ({day})"),
        ("resp_support_decrease", "low", {"any": [_eq("resp_support_event", "decrease"), _eq("resp_support_event", "stop"), _dir("o2_flow_lpm", "down", threshold_abs=1)]}, f"Resp support decreased: {_O2}"),
        ("cxr_severity_up", "medium", _dir("cxr_severity", "up"), "CXR: {cxr_location} {cxr_lesion_type} {cxr_severity_prev} → {cxr_severity_new} ({day})"),
        ("cxr_severity_down", "low", _dir("cxr_severity", "down"), "CXR improved: {cxr_location} {cxr_lesion_type} {cxr_severity_prev} → {cxr_severity_new} ({day})"),
    ],
    "B_infection_activity": [
        ("abx_escalation", "high", {"any": [_eq("abx_event", "escalate"), _eq("abx_event", "start")]}, "Antibiotics escalated: {abx_event} ({day})"),
        ("abx_escalate_or_change", "high", {"any": [_eq("abx_event", "escalate"), _eq("abx_event", "change"), _eq("abx_event", "start")]}, "Antibiotics: {abx_event} ({day})"),
        ("culture_ordered_new", "low", {"slot": "culture_ordered", "new_item": True}, "Culture ordered: {culture_type} ({day})"),
        ("hemodynamic_instability", "critical", {"any": [{"slot": "sbp_mmhg", "lt": 90}, {"slot": "map_mmhg", "lt": 65}]}, "Hemodynamic instability: SBP {sbp_mmhg}, MAP {map_mmhg} ({day})"),
        ("platelet_drop", "medium", _dir("platelet_value", "down", threshold_abs=30), "Platelet: {plt_prev} → {plt_new} ({day})"),
        ("culture_result_arrived", "info", {"slot": "culture_status", "in": ["positive", "negative", "no_growth"]}, "Culture result: {culture_result_text} ({day})"),
        ("temp_spike", "medium", _dir("temp_value", "up", threshold_abs=0.5), "Temp: {temp_prev}℃ → {temp_new}℃ ({day})"),
        ("wbc_rise", "medium", _dir("wbc_value", "up", threshold_abs=3.0), "WBC: {wbc_prev} → {wbc_new} ({day})"),
        ("crp_rise", "medium", _dir("crp_value", "up", threshold_abs=3.0), "CRP: {crp_prev} → {crp_new} ({day})"),
        ("lab_worsening", "medium", {"any": [_dir("wbc_value", "up", threshold_pct=20, within_hours=48), _dir("crp_value", "up", threshold_pct=50, within_hours=48)]}, "Lab worsening detected ({day})"),
        ("hemodynamic_recovery", "low", {"all": [
            {"slot": "sbp_mmhg", "gte": 90, "within_hours": 24}, {"slot": "map_mmhg", "gte": 65, "within_hours": 24},
            {"any": [_dir("sbp_mmhg", "up", threshold_abs=10, within_hours=24), _dir("map_mmhg", "up", threshold_abs=5, within_hours=24)]},
        ]}, "Hemodynamic recovery: SBP {sbp_mmhg}, MAP {map_mmhg} ({day})"),
        ("platelet_recover", "low", _dir("platelet_value", "up", threshold_abs=30), "Platelet recovered: {platelet_prev} → {platelet_new} ({day})"),
        ("temp_down", "low", _dir("temp_value", "down", threshold_abs=0.5), "Temp down: {temp_prev}℃ → {temp_new}℃ ({day})"),
        ("wbc_down", "low", _dir("wbc_value", "down", threshold_abs=3.0), "WBC down: {wbc_prev} → {wbc_new} ({day})"),
        ("crp_down", "low", _dir("crp_value", "down", threshold_abs=3.0), "CRP down: {crp_prev} → {crp_new} ({day})"),
        ("lab_improving", "low", {"any": [_dir("wbc_value", "down", threshold_pct=20, within_hours=48), _dir("crp_value", "down", threshold_pct=50, within_hours=48)]}, "Lab improving detected ({day})"),
        ("abx_deescalation", "low", _eq("abx_event", "change"), "Antibiotics de-escalated ({day})"),
        ("abx_discontinuation", "low", _eq("abx_event", "stop"), "Antibiotics stopped ({day})"),
    ],
    "C_clinical_action": [
        ("monitoring_escalated", "low", {"any": [_dir("monitoring_level", "up"), _dir("vitals_frequency", "up")]}, "Monitoring: {monitoring_prev} → {monitoring_new} ({day})"),
        ("vitals_frequency_escalated", "low", _dir("vitals_frequency", "up"), "Vitals freq: {freq_prev} → {freq_new} ({day})"),
        ("notify_first_seen", "medium", _eq("notify_mentioned", True, first_seen=True), "Dr notify mentioned ({day})"),
        ("prn_increase", "low", {"slot": "prn_interventions", "list_grew": True}, "PRN added: {new_prn_items} ({day})"),
    ],
    "E_infection_control": [
        ("new_mdro_detection", "high", _eq("mdro_status", "confirmed", first_seen=True), "New MDRO detection: {mdro_flag} ({day})"),
        ("mdro_confirmed", "high", _eq("mdro_status", "confirmed"), "MDRO confirmed: {mdro_flag} ({day})"),
        ("isolation_gap", "high", {"all": [{"slot": "isolation_required", "not_equals": "none"}, _eq("isolation_applied", False)]}, "Isolation not applied (gap): {isolation_required} ({day})"),
        ("isolation_applied", "low", _eq("isolation_applied", True), "Isolation applied: {isolation_required} ({day})"),
        ("cluster_suspected", "medium", _eq("cluster_suspected", True), "Cluster suspected: {cluster_reason} ({day})"),
    ],
    "F_symptom_subjective": [
        ("mental_status_change", "high", {"slot": "altered_mentation", "from": ["unknown", False], "to": True}, "Alert: Altered Mentation detected ({day})"),
        ("pain_escalation", "medium", {"slot": "pain_nrs_value", "delta_gte": 1, "require_both": True}, "Pain Escalated: {prev} → {new} ({location}) ({day})"),
        ("pain_relief", "low", _dir("pain_nrs_value", "down", threshold_abs=1), "Pain Relief: {prev} → {new} ({location}) ({day})"),
        ("new_symptom_detected", "medium", {"any": [{"slot": "nausea_vomiting", "from": ["unknown", False], "to": True}, {"slot": "diarrhea", "from": ["unknown", False], "to": True}]}, "New Symptom: {symptom_name} ({day})"),
        ("pain_location_change", "info", {"slot": "pain_location_hint", "changed": True, "not_from": "unknown", "require_both": True}, "Pain Migrated: {prev_loc} → {new_loc} ({day})"),
    ],
}
#: emitted again only when this slot's value has changed since the last time
REPEATS = {"mdro_confirmed": "mdro_flag", "new_mdro_detection": "mdro_flag", "isolation_gap": "isolation_required"}
