"""Entities by a learned tagger, over notes derived from events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ner, slots, tagger
from ..operators.forest import fold_of
from ..sources.stages import stage
from .common import Registry
from .notes import NOTE, _notes

R = Registry()
c = F.col
#: What marks the notes that the tagger learns from: label and pattern.
MARKS = {
    "BP_SYS": r"(?<=V/S\) )\d+", "BP_DIA": r"(?<=\d/)\d+(?= - )", "HR": r"(?<=/\d\d - )\d+", "RR": r"\d+(?= - 3\d+\.)", "TEMP": r"\d+\.\d(?= - \d+%)", "SPO2": r"\d+(?=%)", "PAIN_NRS": r"(?<=NRS )\d+(?=/10)",
    "DYSPNEA": "dyspnea", "NAUSEA": "nausea", "ABX_EVENT": "vancomycin", "O2_DEVICE": r"\bNC\b", "O2_FLOW": r"\d+(?=L$)",
}
FOLDS = 4
#: Different notes that a task tags.
NOTES_A_TASK = 2000


def marked(df: DataFrame, text: str) -> DataFrame:
    """df and _marks, the spans of all patterns; words that are negated right behind don't count, measured values do."""
    numbers = [x for x, slot in ner.LABELS.items() if slot in ner.NUMBERS]
    found = F.concat(*[F.filter(ner.spans(c(text), p, label), lambda s: ~s["negated"] | s["label"].isin(*numbers)) for label, p in MARKS.items()])
    return df.withColumn("_marks", F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))))


def _learned(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Notes by note_id, and each distinct note's spans and entities; the tagger saw three of four patients' notes, each as often as it stands there."""
    k = slots.note_id(c("note"), c("kind"))
    rows = _notes(spark, sf).select("event_id", "kind", "note", (fold_of(c("user_id"), FOLDS) == 0).alias("held_out"), k.alias("note_id"))
    notes = stage(marked(slots.distinct_notes(rows, "note", "kind"), "raw_text").select("note_id", "document_type", "raw_text", "_marks"))
    seen = rows.where("NOT held_out").select("event_id", "note_id").join(notes, "note_id")
    model = tagger.fitted(seen, "raw_text", "_marks", "event_id")
    return rows, stage(tagger.tagged(notes.repartition(max(1, -(-notes.count() // NOTES_A_TASK)), "note_id"), "raw_text", model))


def learned(spark, sf) -> DataFrame:
    """Notes with their spans, and the entities of a tagger that saw three of four patients' notes; held_out says whose it didn't."""
    rows, notes = _learned(spark, sf)
    return rows.join(notes.select("note_id", "_marks", "entities"), "note_id").drop("note_id")


@R.add()
def learned_entities(spark, sf):
    """Every entity found in every note; the model is fitted, so tests hold decoding against enumeration and the spans of held-out patients against the marks."""
    rows, notes = _learned(spark, sf)
    e = rows.select("event_id", "held_out", "note_id").join(stage(notes.select("note_id", F.explode("entities").alias("e"))), "note_id")
    return e.select("event_id", "held_out", "e.start", "e.end", "e.label", "e.text")


@R.add(f"""WITH {NOTE}, v AS (SELECT event_id, unnest([{{'slot': 'bp_sys', 'v': 90 + k}}, {{'slot': 'bp_dia', 'v': 50 + k % 40}}, {{'slot': 'hr_value', 'v': 60 + k}}, {{'slot': 'rr_value', 'v': 12 + k % 20}},
  {{'slot': 'temp_value', 'v': CAST('3' || (6 + k % 5) || '.' || (k % 10) AS DOUBLE)}}, {{'slot': 'spo2_value', 'v': 80 + k % 19}}, {{'slot': 'pain_nrs_value', 'v': CASE WHEN event_type = 'view' THEN k % 13 END}}, {{'slot': 'o2_flow_lpm', 'v': CASE WHEN event_type = 'error' THEN k % 9 END}}]) AS x FROM n)
SELECT event_id, x.slot AS slot, CAST(x.v AS DOUBLE) AS v_num FROM v WHERE x.v IS NOT NULL""")
def learned_numbers(spark, sf):
    """The slots of numbers that learned entities fill; the SQL says what the notes hold."""
    rows, notes = _learned(spark, sf)
    e = notes.select(c("note_id").alias("document_id"), "document_type", F.explode("entities").alias("e")).select("document_id", "document_type", "e.*").withColumn("score", F.lit(None).cast("double"))
    none = e.select("document_id", F.lit("").alias("slot")).where("false")
    filled = stage(ner.fill(e, none).where("v_num IS NOT NULL").select(c("document_id").alias("note_id"), "slot", "v_num"))
    return rows.select("event_id", "note_id").join(filled, "note_id").drop("note_id")
