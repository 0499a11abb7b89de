"""Merging entity predictions into slots, and BIO labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import contains_map

#: The slot of each label, and the slots' kinds.
LABELS = {
    "PAIN_NRS": "pain_nrs_value", "PAIN_LOCATION": "pain_location_hint", "DYSPNEA": "dyspnea", "WOB": "work_of_breathing", "NAUSEA": "nausea_vomiting", "DIARRHEA": "diarrhea", "O2_DEVICE": "o2_device", "O2_FLOW": "o2_flow_lpm",
    "SPO2": "spo2_value", "TEMP": "temp_value", "HR": "hr_value", "RR": "rr_value", "BP_SYS": "bp_sys", "BP_DIA": "bp_dia", "ISOLATION_REQUIRED": "isolation_required", "MDRO_FLAG": "mdro_flag", "CULTURE_ORDERED": "culture_ordered", "ABX_EVENT": "abx_event",
}
WHOLE = ("spo2_value", "hr_value", "rr_value", "bp_sys", "bp_dia", "pain_nrs_value")
NUMBERS = (*WHOLE, "temp_value", "o2_flow_lpm")
FLAGS = ("dyspnea", "nausea_vomiting", "diarrhea", "altered_mentation")
#: Words that negate what stands right before them.
NEGATION = r"(?i)(없|안\s|부인|deny|no\s|not\s|negative|resolved)"
ISOLATION = [(x, x) for x in ("contact", "droplet", "airborne", "enteric")]
DEVICES = [("nasal", "NC"), ("nc", "NC"), ("room air", "RA"), ("simple mask", "SM"), ("venturi", "VM"), ("non-rebreather", "NRM"), ("nrm", "NRM"), ("hfnc", "HFNC"), ("high flow", "HFNC")]


def slot_of(label: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[label]


def fill(entities: DataFrame, slots: DataFrame, least: float = 0.5, id_col: str = "document_id") -> DataFrame:
    """(id, slot, v_num, v_bool, v_str, confidence): entities of known labels for slots that their document lacks.

    An entity names its slot itself (slot_name) or by its label, in either case of letters. A missing
    score counts 0.75; scores below `least` go; mdro_flag counts in microbiology only; a number
    without digits goes. A given `value` is read like a text, as lanes are typed here: `HR 77` is 77.
    """
    e = entities if "slot_name" in entities.columns else entities.withColumn("slot_name", F.lit(None).cast("string"))
    e = e.withColumns({"slot": F.coalesce("slot_name", slot_of(F.upper("label"))), "confidence": F.coalesce("score", F.lit(0.75))})
    e = e.where(F.col("slot").isNotNull() & (F.col("confidence") >= least) & ((F.col("slot") != "mdro_flag") | (F.col("document_type") == "microbiology")))
    number = F.regexp_extract("text", r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    low = F.lower(F.trim("text"))
    value = F.when(F.col("slot") == "isolation_required", contains_map(low, ISOLATION, F.trim("text"))).when(F.col("slot") == "o2_device", F.when(low == "ra", "RA").otherwise(contains_map(low, DEVICES, F.trim("text")))).otherwise(F.trim("text"))
    e = e.withColumns({
        "v_num": F.when(F.col("slot").isin(*WHOLE), F.floor(number).cast("double")).when(F.col("slot").isin(*NUMBERS), number), "v_bool": F.when(F.col("slot").isin(*FLAGS), True),
        "v_str": F.when(~F.col("slot").isin(*NUMBERS, *FLAGS), value),
    }).where(F.coalesce(F.col("v_num").cast("string"), F.col("v_bool").cast("string"), F.col("v_str")).isNotNull())
    return e.join(slots.select(id_col, "slot").distinct(), [id_col, "slot"], "left_anti").select(id_col, "slot", "v_num", "v_bool", "v_str", "confidence")


def with_text(entities: DataFrame, docs: DataFrame, id_col: str = "document_id", raw_col: str = "raw_text") -> DataFrame:
    """Entities with label and text, whatever form they came in: `type` stands in for a label, `value` comes before `text`.

    Where both are missing, or a slot of numbers has a text without digits and no value, the text is
    read from the document by the span (start, end); only these entities meet the documents' texts.
    """
    have = set(entities.columns)
    col = lambda n, t="string": F.col(n) if n in have else F.lit(None).cast(t)
    e = entities.withColumns({"label": F.coalesce(col("label"), col("type")), "text": F.coalesce(col("value"), col("text"))})
    slot = F.coalesce(col("slot_name"), slot_of(F.upper("label")))
    mute = col("value").isNull() & slot.isin(*NUMBERS) & ~F.col("text").rlike(r"\d")
    bare = (F.col("text").isNull() | F.coalesce(mute, F.lit(False))) & col("start", "int").isNotNull() & col("end", "int").isNotNull()
    read = e.where(bare).join(docs.select(id_col, F.col(raw_col).alias("_raw")), id_col, "left")
    read = read.withColumn("text", F.substring(F.col("_raw"), F.col("start") + 1, F.col("end") - F.col("start"))).select(*e.columns)
    return e.where(~F.coalesce(bare, F.lit(False))).unionByName(read)


def spans(text: Column, pattern: str, label: str, window: int = 8) -> Column:
    """Array of struct(start, end, label, negated): every match of the pattern, negated where a word of negation follows within some characters.

    Places follow from the lengths of the matches and of what stands between them.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    step = lambda acc, h: F.struct(
        (acc["at"] + F.length(F.get(gaps, F.size(acc["out"]))) + F.length(h)).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(F.get(gaps, F.size(acc["out"])))).alias("start"), (acc["at"] + F.length(F.get(gaps, F.size(acc["out"]))) + F.length(h)).alias("end")))).alias("out"),
    )
    places = F.aggregate(hits, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")), step, lambda acc: acc["out"])
    return F.transform(places, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.lit(label).alias("label"), F.substring(text, p["end"] + 1, F.lit(window)).rlike(NEGATION).alias("negated")))


def unbio(tokens: Column, tags: Column) -> Column:
    """Array of struct(start, end, label) from tags: B- opens a span, I- of the same label goes on, all else ends it."""
    z = F.transform(F.arrays_zip(tokens.alias("t"), tags.alias("g")), lambda x: F.struct(x["t"]["start"].alias("start"), x["t"]["end"].alias("end"), F.substring(x["g"], 1, 2).alias("kind"), F.substr(x["g"], F.lit(3)).alias("label")))
    kind = "array<struct<start:int,end:int,label:string,open:boolean>>"

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        goes_on = (F.size(acc) > 0) & (x["kind"] == "I-") & F.coalesce(last["open"] & (last["label"] == x["label"]), F.lit(False))
        span = lambda a, b, label, is_open: F.array(F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), label.alias("label"), F.lit(is_open).alias("open")))
        longer = F.concat(F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1)), span(last["start"], x["end"], last["label"], True))
        ended = F.transform(acc, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), F.lit(False).alias("open")))
        return F.when(goes_on, longer).when(x["kind"] == "B-", F.concat(ended, span(x["start"], x["end"], x["label"], True))).otherwise(ended)

    return F.transform(F.aggregate(z, F.array().cast(kind), step), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))


def bio(tokens: Column, spans: Column) -> Column:
    """A tag per token struct(start, end): B- at the first token of a span struct(start, end, label), I- inside, else O."""
    def tag(t):
        hit = F.get(F.filter(spans, lambda s: (s["start"] <= t["start"]) & (t["end"] <= s["end"])), F.lit(0))
        return F.when(hit.isNull(), "O").when(hit["start"] == t["start"], F.concat(F.lit("B-"), hit["label"])).otherwise(F.concat(F.lit("I-"), hit["label"]))

    return F.transform(tokens, tag)
