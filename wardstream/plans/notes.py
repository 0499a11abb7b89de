"""The notes chain: documents to slots to snapshots to events; stage outputs are kept where the cluster says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import shift_of
from ..operators import ner, slot_specs, slots, snapshots, trajectory
from ..operators import trajectory_rules as T
from ..sources.stages import stage

KEYS = ["patient_id", "hd", "d_number", "shift"]


def document_slots(docs: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Normalized slots of documents (document_id, document_type, raw_text, notify_md); entities fill what the rules leave empty."""
    found = stage(slots.extract(docs, notify_col="notify_md"))
    s = slots.enabled(slots.merged(slots.with_defaults(found)), slot_specs.DISABLED)
    if entities is not None:
        more = ner.fill(entities, s)
        s = s.unionByName(more.withColumn("method", F.lit("ner")), allowMissingColumns=True)
    return slots.normalized(stage(s), slot_specs.SLOTS)


def patient_events(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Events of all axes from documents (with patient_id, hd, d_number, doc_datetime) and their slots."""
    spec = slot_specs.SLOTS
    numbers = [n for n, d in spec.items() if d["type"] in ("integer", "float")]
    lists = [n for n, d in spec.items() if d["type"].startswith("list")]
    flags = [n for n, d in spec.items() if d["type"] in ("boolean", "tri_bool")]
    words = [n for n, d in spec.items() if d["type"] in ("enum", "string")]
    lane = lambda names, col: [F.max(F.when(F.col("slot") == n, F.col(col))).alias(n) for n in names]
    pick = [F.max(F.when(F.col("slot") == "culture_result", F.col("v_obj")[k])).alias(f"culture_{k}") for k in ("status", "organism")]
    wide = found.groupBy("document_id").agg(*lane(numbers, "v_num"), *lane(flags, "v_bool"), *lane(words, "v_str"), *[F.first(F.when(F.col("slot") == n, F.col("v_arr")), ignorenulls=True).alias(n) for n in lists], *pick)
    d = stage(docs.select("document_id", "patient_id", "hd", "d_number", "doc_datetime", shift_of(F.col("doc_datetime")).alias("shift")).join(wide, "document_id"))
    d = d.withColumns({"abx_event": snapshots.abx_event(F.col("abx_event")), "culture_status": snapshots.culture_status(F.col("culture_status")), "mdro_status": snapshots.mdro_status(F.col("mdro_flag"), F.col("mdro_status"))})
    scalars = [*numbers, *flags, *words, "culture_status", "culture_organism"]
    d = stage(snapshots.merged(d, KEYS, list(dict.fromkeys(scalars)), lists))
    out = None
    for axis, rules in T.RULES.items():
        used = {s for r in rules for s in trajectory.slots_of(r[2])} | {"o2_device", "o2_flow_lpm", "mdro_flag", "isolation_required", "pain_location_hint", "cxr_location", "cxr_lesion_type", "abx_event", "culture_organism", *trajectory.PRESSURES}
        e = trajectory.events(d.select(*trajectory.BASE, *[x for x in d.columns if x in used]), axis)
        out = e if out is None else out.unionByName(e)
    return out
