"""Events from changes between snapshots: declarative rules compiled to window expressions.

Snapshots are rows of (patient_id, hd, d_number, shift, doc_datetime, source_docs) and one column per
slot. Everything a rule compares with is a window over (patient, axis) in time order: the previous
row, the last known value of a slot, when and in which documents it was known, whether a value has
been seen. Rules read columns only, so all of an axis run in one pass after one sort.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalar import hours_between, shift_rank
from . import trajectory_rules as T

BASE = ("patient_id", "hd", "d_number", "shift", "doc_datetime", "source_docs")
#: Slots that stand in for others.
STAND_INS = {"sbp_mmhg": "bp_sys", "dbp_mmhg": "bp_dia", "hr_bpm": "hr_value"}
PRESSURES = ("map_mmhg", "sbp_mmhg", "dbp_mmhg", "bp_sys", "bp_dia")
SEVERITIES = ("critical", "high", "medium", "low", "info")


def slots_of(cond: Mapping) -> list[str]:
    if "slot" in cond:
        return [cond["slot"]]
    return list(dict.fromkeys(s for sub in [*cond.get("any", []), *cond.get("all", [])] for s in slots_of(sub)))


class Axis:
    """The columns that the rules of one axis read."""

    def __init__(self, snapshots: DataFrame):
        self.types = {f.name: f.dataType.simpleString() for f in snapshots.schema if f.name not in BASE}
        order = [F.col("doc_datetime").asc_nulls_last(), shift_rank(F.col("shift")), F.col("hd"), F.col("d_number")]
        self.by = Window.partitionBy("patient_id").orderBy(*order)
        self.prior = self.by.rowsBetween(Window.unboundedPreceding, -1)

    def prepared(self, df: DataFrame) -> DataFrame:
        """Adds, for each slot s: s_lag, s_last (struct of value, time and documents when last known), and the previous time and documents."""
        keep = lambda s: F.last(F.when(F.col(s).isNotNull(), F.struct(F.col(s).alias("v"), F.col("doc_datetime").alias("t"), F.col("source_docs").alias("d"))), ignorenulls=True).over(self.prior)
        cols = {"_t": F.lag("doc_datetime").over(self.by), "_d": F.lag("source_docs").over(self.by), "_row": F.row_number().over(self.by)}
        for s in self.types:
            cols |= {f"{s}_lag": F.lag(s).over(self.by), f"{s}_last": keep(s)}
        return df.withColumns(cols)

    def has(self, s: str) -> bool:
        return s in self.types

    def null(self) -> Column:
        return F.lit(None).cast("double")

    def raw(self, s: str) -> Column:
        return F.col(s) if self.has(s) else self.null()

    def before(self, s: str, refs: list[str]) -> Column:
        """The previous row's value; of slots that the rule names, else the last known one."""
        if not self.has(s):
            return self.null()
        return F.coalesce(f"{s}_lag", F.col(f"{s}_last")["v"]) if s in refs else F.col(f"{s}_lag")

    def value(self, s: str, at) -> Column:
        """A slot's value with its stand-ins; `at` says from which row."""
        if s == "map_mmhg":
            sbp, dbp = (self.value(x, at).cast("double") for x in ("sbp_mmhg", "dbp_mmhg"))
            return F.coalesce(at("map_mmhg").cast("double"), F.bround((sbp + 2 * dbp) / 3.0, 1))
        if s in STAND_INS:
            return F.coalesce(at(s).cast("double"), at(STAND_INS[s]).cast("double"))
        return at(s)


DETAIL = "struct<slot:string,prev:string,curr:string,delta:double,delta_pct:double,new_items:array<string>>"


def shown(c: Column, kind: str) -> Column:
    """A value as text: True and False, lists as ['a', 'b']."""
    if kind == "boolean":
        return F.initcap(c.cast("string"))
    if kind.startswith("array"):
        return F.when(c.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]")))
    return c.cast("string")


class Condition:
    """Compiles one rule's condition to (matches, detail)."""

    def __init__(self, axis: Axis, cond: Mapping, seen: dict[str, Column]):
        self.axis, self.refs, self.seen = axis, slots_of(cond), seen
        self.curr, self.prev = (lambda s: axis.raw(s)), (lambda s: axis.before(s, self.refs))
        known = [F.when(F.col(f"{s}_lag").isNull(), F.col(f"{s}_last")["t"]) for s in self.refs if axis.has(s)]
        self.prev_time = F.least("_t", *known) if known else F.col("_t")
        docs = [F.coalesce("_d", F.array().cast("array<string>"))] + [F.coalesce(F.when(F.col(f"{s}_lag").isNull(), F.col(f"{s}_last")["d"]), F.array().cast("array<string>")) for s in self.refs if axis.has(s)]
        self.prev_docs = F.array_distinct(F.concat(*docs))
        self.matches, self.detail = self.both(cond)

    def both(self, cond: Mapping) -> tuple[Column, Column]:
        if "any" in cond:
            subs = [self.both(x) for x in cond["any"]]
            hit, detail = F.lit(False), F.lit(None).cast(DETAIL)
            for m, d in reversed(subs):
                hit, detail = m | hit, F.when(m, d).otherwise(detail)
            return hit, detail
        if "all" in cond:
            subs = [self.both(x) for x in cond["all"]]
            hit = F.lit(True)
            for m, _ in subs:
                hit = hit & m
            # later details replace earlier ones where they say something
            fields = {k: F.coalesce(*[d[k] for _, d in reversed(subs)]) for k in ("delta", "delta_pct", "new_items")}
            last = subs[-1][1]
            return hit, F.struct(last["slot"].alias("slot"), last["prev"].alias("prev"), last["curr"].alias("curr"), *[c.alias(k) for k, c in fields.items()])
        return self.single(cond)

    def single(self, cond: Mapping) -> tuple[Column, Column]:
        s, kind = cond["slot"], self.axis.types.get(cond["slot"], "double")
        curr, prev = self.axis.value(s, self.curr), self.axis.value(s, self.prev)
        if s == "isolation_applied":
            curr = F.coalesce(curr, F.lit(False))
        delta = pct = self.axis.null()
        items = F.lit(None).cast("array<string>")
        text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
        same = lambda c, v: c.cast("string") == text(v)
        num = lambda c: c.try_cast("double") if kind == "string" else c.cast("double")
        if "equals" in cond:
            hit = same(curr, cond["equals"])
            if cond.get("first_seen"):
                hit = hit & ~F.coalesce(self.seen[f"{s}={cond['equals']}"], F.lit(False))
        elif "not_equals" in cond:
            hit = curr.isNotNull() & ~same(curr, cond["not_equals"])
        elif "in" in cond:
            hit = curr.cast("string").isin([text(v) for v in cond["in"]])
        elif any(k in cond for k in ("lt", "lte", "gt", "gte")):
            k = next(k for k in ("lt", "lte", "gt", "gte") if k in cond)
            v, bound = num(curr), float(cond[k])
            hit = {"lt": v < bound, "lte": v <= bound, "gt": v > bound, "gte": v >= bound}[k]
        elif "direction" in cond:
            sign = 1 if cond["direction"] == "up" else -1
            if s in T.RANKS:
                rank = F.create_map(*[x for i, v in enumerate(T.RANKS[s]) for x in (F.lit(v), F.lit(i))])
                delta = ((rank[curr] - rank[prev]) * sign).cast("double")
                hit = delta >= float(cond.get("threshold_abs") or 1)
            elif kind.startswith("array"):
                hit = F.lit(False)
            else:
                delta = (num(curr) - num(prev)) * sign
                if cond.get("threshold_pct") is not None:
                    pct = F.when(num(prev) == 0, F.when(delta > 0, 100.0).otherwise(0.0)).otherwise(F.try_divide(delta, F.abs(num(prev))) * 100.0)
                    hit = (delta > 0) & (pct >= float(cond["threshold_pct"]))
                else:
                    hit = delta >= (float(cond["threshold_abs"]) if cond.get("threshold_abs") is not None else 0.01)
            if cond.get("condition") == "same_o2_if_possible":
                for x in ("o2_device", "o2_flow_lpm"):
                    a, b = self.prev(x), self.curr(x)
                    other = (F.abs(a - b) > 1e-6) if x == "o2_flow_lpm" else (a != b)
                    hit = hit & ~F.coalesce(other, F.lit(False))
        elif "from" in cond:
            before = F.coalesce(prev.cast("string"), F.lit("unknown"))
            hit = before.isin([text(v) for v in (cond["from"] if isinstance(cond["from"], list) else [cond["from"]])]) & same(curr, cond["to"])
        elif "delta_gte" in cond:
            delta = num(curr) - num(prev)
            hit = delta >= float(cond["delta_gte"])
        elif cond.get("list_grew") or cond.get("new_item"):
            none = F.array().cast("array<string>")
            items = F.array_sort(F.array_except(F.coalesce(curr, none), F.coalesce(prev, none)))
            hit = F.size(items) > 0
        elif cond.get("changed"):
            hit = ~curr.eqNullSafe(prev)
            if cond.get("require_both"):
                hit = hit & curr.isNotNull() & prev.isNotNull()
            if cond.get("not_from") is not None:
                hit = hit & ~F.coalesce(same(prev, cond["not_from"]), F.lit(False))
        else:
            hit = F.lit(False)
        if cond.get("within_hours") is not None:
            gap = hours_between(F.col("doc_datetime"), self.prev_time)
            hit = hit & (gap >= 0) & (gap <= float(cond["within_hours"]))
        detail = F.struct(F.lit(s).alias("slot"), shown(prev, kind).alias("prev"), shown(curr, kind).alias("curr"), delta.alias("delta"), pct.alias("delta_pct"), items.alias("new_items"))
        return F.coalesce(hit, F.lit(False)), detail


def rendered(axis: Axis, c: Condition, template: str) -> Column:
    """The template with its variables filled in; what nothing is known of stays as it is written."""
    d, out = c.detail, []
    now = lambda s: shown(axis.raw(s), axis.types.get(s, "double"))
    known = lambda s: shown(F.coalesce(f"{s}_lag", F.col(f"{s}_last")["v"]), axis.types[s]) if axis.has(s) else F.lit(None).cast("string")
    na = lambda x: F.coalesce(x, F.lit("N/A"))
    said = {f"{x}_mmhg": F.coalesce(axis.value(f"{x}_mmhg", axis.raw).cast("string"), F.lit("None")) for x in ("map", "sbp")}
    organism = axis.raw("culture_organism").cast("string")
    said |= {
        "day": F.concat(F.lit("HD"), F.coalesce(F.col("hd").cast("string"), F.lit("None")), F.lit(" D+"), F.coalesce(F.col("d_number").cast("string"), F.lit("None"))),
        "prev_loc": na(known("pain_location_hint")), "new_loc": na(now("pain_location_hint")), "location": na(now("pain_location_hint")), "cluster_reason": F.lit(""),
        "monitoring_prev": na(known("monitoring_level")), "monitoring_new": na(now("monitoring_level")), "freq_prev": na(known("vitals_frequency")), "freq_new": na(now("vitals_frequency")),
        "cxr_severity_prev": na(known("cxr_severity")), "cxr_severity_new": na(now("cxr_severity")), "mdro_flag": na(now("mdro_flag")), "isolation_required": na(now("isolation_required")),
        "culture_result_text": na(F.when(organism.isNotNull(), F.concat(now("culture_status"), F.lit(" ("), organism, F.lit(")"))).otherwise(now("culture_status"))),
    }
    for part in re.split(r"(\{\w+\})", template):
        name = T.ALIASES.get(part[1:-1], part[1:-1])
        if not re.fullmatch(r"\{\w+\}", part):
            out.append(F.lit(part))
            continue
        value = said.get(name)
        if value is None and name in ("prev", "new"):
            pick = known if name == "prev" else now
            value = F.lit("N/A")
            for s in c.refs:
                value = F.when(d["slot"] == s, na(pick(s))).otherwise(value)
        elif value is None and name in ("new_prn_items", "symptom_name", "culture_type"):
            value = F.array_join(d["new_items"], ", ")
        elif value is None and (m := re.fullmatch(r"(\w+)_(prev|new)", name)):
            pick = known if m[2] == "prev" else now
            value = F.lit(None).cast("string")
            if axis.has(m[1]):
                value = pick(m[1])
            for s in c.refs:
                if m[1] in (s, *(s.removesuffix(x) for x in ("_value", "_percent", "_lpm") if s.endswith(x))):
                    value = F.when(d["slot"] == s, na(pick(s))).otherwise(value)
        elif value is None:
            value = now(name) if axis.has(name) else F.lit(None).cast("string")
        out.append(F.coalesce(value, F.lit("{" + name + "}")))
    return F.concat(*out)


def events(snapshots: DataFrame, axis: str, rules: list[tuple] | None = None) -> DataFrame:
    """The events of one axis' snapshots, one row per patient, snapshot and rule that fires.

    Columns: event_id, patient_id, axis, event_type, severity, priority_rank, axis_priority, doc_datetime,
    prev_doc_datetime, hd, d_number, shift, render_text, evidence_text, supporting_docs, is_carried_forward.
    Snapshots of one patient and axis are one window partition, as long as the patient's stay.
    """
    rules = T.RULES[axis] if rules is None else rules
    a = Axis(snapshots)
    df = a.prepared(snapshots)
    firsts = {(c["slot"], c["equals"]) for r in rules for c in flat(r[2]) if c.get("first_seen") and a.has(c["slot"])}
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    names = {f"{s}={v}": f"_seen{i}" for i, (s, v) in enumerate(sorted(firsts, key=str))}
    df = df.withColumns({names[f"{s}={v}"]: F.max(F.col(s).cast("string") == text(v)).over(a.prior) for s, v in firsts})
    seen = {k: F.col(c) for k, c in names.items()}
    made = []
    for rank, (event, severity, cond, template) in enumerate(rules, 1):
        if not any(a.has(s) or s in ("map_mmhg", "sbp_mmhg", "dbp_mmhg", "hr_bpm") for s in slots_of(cond)):
            continue
        c = Condition(a, cond, {k: seen.get(k, F.lit(False)) for k in {f"{x['slot']}={x['equals']}" for x in flat(cond) if x.get("first_seen")}})
        hit = c.matches & F.coalesce(c.prev_time <= F.col("doc_datetime"), F.lit(True))
        repeat = T.REPEATS.get(event)
        body = F.struct(
            F.lit(event).alias("event_type"), F.lit(severity if severity in SEVERITIES else "info").alias("severity"), F.lit(rank).alias("priority_rank"), c.prev_time.alias("prev_doc_datetime"), rendered(a, c, template).alias("render_text"),
            c.detail.alias("detail"), F.array_distinct(F.concat(c.prev_docs, F.coalesce("source_docs", F.array().cast("array<string>")))).alias("supporting_docs"), (a.raw(repeat).cast("string") if repeat else F.lit(None).cast("string")).alias("again"), F.lit(bool(repeat)).alias("repeats"),
        )
        made.append(F.when(hit, body))
    e = df.select("patient_id", "hd", "d_number", "shift", "doc_datetime", "_row", F.explode(F.array_compact(F.array(*made))).alias("e")).select("patient_id", "hd", "d_number", "shift", "doc_datetime", "_row", "e.*")
    # an event that repeats is told only when its value has changed since it was last matched
    w = Window.partitionBy("patient_id", "event_type").orderBy("_row")
    e = e.withColumns({"_before": F.lag("again").over(w), "_n": F.row_number().over(w)}).where(~F.col("repeats") | (F.col("_n") == 1) | ~F.col("again").eqNullSafe(F.col("_before")))
    d = F.col("detail")
    evidence = F.array_compact(F.array(
        F.when(d["prev"].isNotNull(), F.concat(d["slot"], F.lit(": "), d["prev"], F.lit(" → "), F.coalesce(d["curr"], F.lit("None")))).when(d["curr"].isNotNull(), F.concat(d["slot"], F.lit(": "), d["curr"])),
        F.when(d["delta"].isNotNull(), F.concat(F.lit("delta: "), d["delta"].cast("string"))), F.when(d["delta_pct"].isNotNull(), F.concat(F.lit("delta_pct: "), F.bround(d["delta_pct"], 2).cast("string"))),
        F.when(F.size(d["new_items"]) > 0, F.concat(F.lit("new: "), shown(d["new_items"], "array<string>"))),
    ))
    number = F.row_number().over(Window.partitionBy("patient_id").orderBy("_row", "priority_rank"))
    return e.select(
        F.format_string("EVT_%s_%s_%03d", F.col("patient_id").cast("string"), F.lit(axis.split("_")[0]), number).alias("event_id"), "patient_id", F.lit(axis).alias("axis"), "event_type", "severity", "priority_rank",
        F.lit(T.AXIS_PRIORITY.get(axis, 0)).alias("axis_priority"), "doc_datetime", "prev_doc_datetime", "hd", "d_number", "shift", "render_text",
        F.when(F.size(evidence) > 0, F.array_join(evidence, "; ")).otherwise(F.col("render_text")).alias("evidence_text"), "supporting_docs", F.lit(False).alias("is_carried_forward"),
    )


def flat(cond: Mapping) -> list[Mapping]:
    return [cond] if "slot" in cond else [x for sub in [*cond.get("any", []), *cond.get("all", [])] for x in flat(sub)]


def order_of(keys: list[str]) -> WindowSpec:
    """A window over keys in the events' order."""
    return Window.partitionBy(*keys).orderBy(F.col("doc_datetime").asc_nulls_last(), shift_rank(F.col("shift")), F.desc("axis_priority"), "priority_rank", "event_type")


def in_order(e: DataFrame) -> DataFrame:
    """Patient, time (none last), shift, the axes' and rules' priorities, type."""
    return e.orderBy("patient_id", F.col("doc_datetime").asc_nulls_last(), shift_rank(F.col("shift")), F.desc("axis_priority"), "priority_rank", "event_type")


def coverage_gap(e: DataFrame, rules: Mapping[str, list[tuple]] = T.RULES) -> DataFrame:
    """(axis, event_type) of rules that never fired."""
    want = e.sparkSession.createDataFrame([(a, r[0]) for a, rs in rules.items() for r in rs], "axis string, event_type string")
    return want.join(e.select("axis", "event_type").distinct(), ["axis", "event_type"], "left_anti")
