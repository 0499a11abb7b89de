"""Per-shift snapshots of slots: repairs, axes, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import shift_rank

#: Fixed values.
ABX_EVENTS = ("start", "change", "escalate", "deescalate", "stop", "none", "unknown")
CHANGE_WORDS = ("변경", "changed", "change", "switched")
STATUS = {"pos": "positive", "neg": "negative"}


def abx_event(v: Column) -> Column:
    """A known event, change where the text says so, else start: a drug's name means that it was started."""
    low = F.lower(F.trim(v))
    return F.when(low.isin(*ABX_EVENTS), low).when(low.rlike("|".join(CHANGE_WORDS)), "change").when(v.isNotNull(), "start")


def culture_status(status: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[status], status)


def mdro_status(flag: Column, status: Column) -> Column:
    """confirmed where an organism is flagged and nothing else is said."""
    return F.coalesce(status, F.when(~F.lower(F.trim(flag)).isin("none", "unknown", ""), "confirmed"))


def merged(docs: DataFrame, keys: list[str], scalars: list[str], lists: list[str], ts: str = "doc_datetime", id_col: str = "document_id") -> DataFrame:
    """One row per key: of scalars the latest non-null (ties: the larger id), of lists the sorted union, the latest time, and the documents in order."""
    order = F.struct(F.col(ts), F.col(id_col))
    aggs = [F.max_by(s, F.when(F.col(s).isNotNull(), order)).alias(s) for s in scalars]
    aggs += [F.array_sort(F.array_distinct(F.flatten(F.collect_list(x)))).alias(x) for x in lists]
    names = F.transform(F.array_sort(F.collect_set(order)), lambda x: x[id_col].cast("string"))
    return docs.groupBy(*keys).agg(*aggs, F.max(ts).alias(ts), names.alias("source_docs"))


def outcome(has_slots: Column, patient: str = "patient_id", ts: str = "doc_datetime") -> Column:
    """kept, or what a document lacks first: patient, time or slots."""
    lacks = F.col(patient).isNull() | (F.trim(F.col(patient).cast("string")) == "")
    return F.when(lacks, "no_patient").when(F.col(ts).isNull(), "no_time").when(~F.coalesce(has_slots, F.lit(False)), "no_slots").otherwise("kept")


def complete(docs: DataFrame, has_slots: Column) -> DataFrame:
    """The documents that have all that a snapshot needs."""
    return docs.where(outcome(has_slots) == "kept")


def outcomes(docs: DataFrame, has_slots: Column) -> DataFrame:
    """(outcome, n): how many documents are kept, and how many are skipped for what."""
    return docs.groupBy(outcome(has_slots).alias("outcome")).agg(F.count("*").alias("n"))


def order() -> list[Column]:
    """Patient, axis, hospital day, day number, shift."""
    return [F.col("patient_id"), F.col("axis"), F.coalesce("hd", F.lit(0)), F.coalesce("d_number", F.lit(0)), shift_rank(F.col("shift"))]


def in_order(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy(*order())
