"""Fixed maps of infection kinds and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
ISOLATION = {"MDRO": "CONTACT", "Tick-borne": "DROPLET", "Pneumonia": "DROPLET", "Waterborne": "CONTACT"}
PATHOGEN_FLAGS = {"Tick-borne": ("sfts_suspected", "tick_borne_pattern"), "Pneumonia": ("respiratory_infection",), "UTI": ("urinary_source",), "Waterborne": ("gastrointestinal_source",)}
CLINICAL_FLAGS = {
    "MDRO": ("isolation_required", "cohort_consideration"), "Tick-borne": ("high_fever", "thrombocytopenia"), "Pneumonia": ("cough", "oxygen_support"), "UTI": ("dysuria", "fever"), "Waterborne": ("diarrhea", "dehydration_risk"),
}
RISK_SERIES = {"MDRO": (0.54, 0.66, 0.77), "Pneumonia": (0.34, 0.45, 0.56), "UTI": (0.31, 0.41, 0.50), "Waterborne": (0.25, 0.34, 0.43)}
OTHER_SERIES = (0.22, 0.30, 0.38)


def _pick(kind: Column, values: dict, other: Column) -> Column:
    out = other
    for k, v in values.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def isolation_of(kind: Column) -> Column:
    return _pick(kind, ISOLATION, F.lit("STANDARD"))


def _array(values) -> Column:
    return F.array(*map(F.lit, values))


def pathogen_flags(kind: Column, mdro: Column) -> Column:
    special = F.array(F.coalesce(F.lower(mdro), F.lit("mdro")), F.lit("contact_precaution"))
    return F.when(kind == "MDRO", special).otherwise(_pick(kind, {k: _array(v) for k, v in PATHOGEN_FLAGS.items()}, _array(("infection_unknown",))))


def clinical_flags(kind: Column) -> Column:
    return _pick(kind, {k: _array(v) for k, v in CLINICAL_FLAGS.items()}, _array(("monitoring",)))


def risk_series(kind: Column) -> Column:
    """Scores of three days in turn."""
    return _pick(kind, {k: _array(v) for k, v in RISK_SERIES.items()}, _array(OTHER_SERIES))


def risk_of(score: Column) -> Column:
    return F.when(score >= 0.8, "CRITICAL").when(score >= 0.6, "HIGH").when(score >= 0.35, "MEDIUM").otherwise("LOW")
