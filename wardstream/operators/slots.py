"""Slots from the text of clinical documents: rules as columns, typed lanes, merging, validation, normalization.

A rule is a pattern with the slot, lane and confidence that a match gives. All rules are one array of
data: an automaton says which of them a note can match at all, and one expression tries those and
builds the note's slots. Values live in lanes (v_num, v_bool, v_str, v_arr, v_obj), as each slot has
one known type.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import let, sorted_distinct
from ..sources.stages import stage
from . import slot_specs as S

OBJ = "struct<status:string,organism:string>"
SLOT = f"struct<slot:string,vtype:string,v_num:double,v_bool:boolean,v_str:string,v_arr:array<string>,v_obj:{OBJ},method:string,confidence:double,evidence:string>"


def slot(name: str, lane: str, value: Column, confidence: float, evidence: Column, method: str = "regex") -> Column:
    lanes = {"num": "double", "bool": "boolean", "str": "string", "arr": "array<string>", "obj": OBJ}
    cols = [(value if k == lane else F.lit(None)).cast(t).alias(f"v_{k}") for k, t in lanes.items()]
    vtype = {"num": "number", "bool": "boolean", "str": "string", "arr": "array", "obj": "object"}[lane]
    return F.struct(F.lit(name).alias("slot"), F.lit(vtype).alias("vtype"), *cols, F.lit(method).alias("method"), F.lit(confidence).alias("confidence"), evidence.alias("evidence"))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match's group; null without a match or where the group took no part in it."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def one(when: Column, s: Column) -> Column:
    return F.when(when, F.array(s)).otherwise(F.array().cast(f"array<{SLOT}>"))


def _num(v: Column) -> Column:
    return v.try_cast("double")


@dataclass(frozen=True)
class Rule:
    """What a match of a pattern gives, as data: all rules are one array, which one expression walks.

    kind: first (the first match's group), all (every match's), flag and false (true or false where
    anything matches), part (kept for slots that need several patterns, under the rule's name). how
    makes the group's text a value: num, whole, lower, upper, trim, hours, or map: the value of the
    first key that the lower-cased text holds, else `other` (*lower and *upper: the text itself).
    Numbers beyond `unit` are in single units and are divided by 1000, then rounded half-even to
    `digits`, or cut to a whole number (0). lo, hi and barred say which values count.
    """

    slot: str
    pattern: str
    lane: str = "bool"
    kind: str = "flag"
    group: int = 1
    confidence: float = 0.9
    how: str = "keep"
    cut: int | None = None
    doc_types: tuple[str, ...] = ()
    lo: float | None = None
    hi: float | None = None
    barred: tuple[str, ...] = ()
    digits: int | None = None
    unit: float | None = None
    keys: tuple[tuple[str, str], ...] = ()
    other: str | None = None


#: Types of what isn't text.
NUMBERS = {"group": "int", "cut": "int", "digits": "int", "confidence": "double", "lo": "double", "hi": "double", "unit": "double"}


def rules() -> list[Rule]:
    vs = lambda name, g: Rule(name, S.VS_LINE, "num", "first", g, 0.95, "num", cut=60)
    p, micro = S.PATTERNS, ("microbiology",)
    flags = lambda *names: [Rule(n, p[n], cut=80 if n == "cluster_suspected" else None, confidence=0.85 if n == "cluster_suspected" else 0.9) for n in names]
    words = lambda n, how="lower", **more: Rule(n, p[n], "str", "first", how=how, **more)
    mapped = lambda n, pattern, keys, other, **more: Rule(n, p[pattern], "str", "first", how="map", keys=tuple(keys), other=other, **more)
    return [
        *[vs(n, g) for g, n in enumerate(("bp_sys", "bp_dia", "hr_value", "rr_value", "temp_value", "spo2_value"), 1)],
        Rule("spo2_value", p["spo2"], "num", "all", how="num", lo=50, hi=100),
        mapped("o2_device", "o2_device", S.O2_DEVICES, "*upper"),
        Rule("o2_flow_lpm", p["o2_flow"], "num", "first", how="num"),
        mapped("resp_support_event", "o2_action", S.O2_ACTIONS, "*lower"),
        words("vitals_frequency", "hours"),
        *flags("dyspnea"),
        mapped("work_of_breathing", "work_of_breathing", S.BREATHING, "mild", group=0),
        *flags("altered_mentation", "diarrhea", "nausea_vomiting"),
        *[Rule("pain_nrs_value", p["pain_nrs"], "num", "all", g, how="num", lo=0, hi=10) for g in (1, 2, 3, 4)],
        words("breath_sounds"),
        words("sputum_character"),
        *flags("foley_catheter", "tick_eschar", "tick_exposure", "intake_output_monitoring"),
        words("isolation_required"),
        *flags("isolation_applied"),
        Rule("isolation_applied", p["isolation_gap"], kind="false"),
        Rule("mdro_flag", p["mdro_alert"], "str", "first", confidence=0.95, how="upper", doc_types=micro),
        *flags("cluster_suspected", "icu_eval_mentioned", "transfer_consideration", "rapid_response", "sepsis_bundle_mentioned", "vasopressor_mentioned"),
        Rule("culture_ordered", p["culture_ordered"], "str", "all", how="lower"),
        *[Rule(n, pat, "num", "first", 1, 0.95, "num", digits=digits or 0, unit=unit) for n, pat, digits, unit in S.LABS],
        Rule("specimen_type", p["specimen"], "str", "first", confidence=0.95, how="lower", doc_types=micro),
        Rule("gram_stain", p["gram_stain"], "str", "first", how="trim", doc_types=micro),
        Rule("colony_count", p["colony_count"], "str", "first", how="trim", doc_types=micro, barred=S.NO_VALUE),
        *[Rule(n, S.VS_LINE if n == "vs_line" else p[n], kind="part", group=0 if n in WHOLE else 1) for n in PARTS],
        Rule("o2_change_to", p["o2_change"], kind="part", group=2),
        Rule("pain_location_2", p["pain_location"], kind="part", group=2),
    ]


#: Patterns whose matches go into slots that need more than one of them; of some the whole match is wanted.
WHOLE = ("vs_line", "abx_start", "abx_start_after", "abx_change", "abx_escalate", "cxr_worsening", "cxr_improving", "cxr_normal")
PARTS = (
    "vs_line", "temp", "o2_change", "abx_start", "abx_start_after", "abx_change", "abx_escalate", "prn", "pain_location", "organism", "culture_status", "resistant", "cxr_finding", "cxr_location", "cxr_severity",
    "cxr_worsening", "cxr_improving", "cxr_normal",
)


def folded(text: str) -> str:
    """Without case, as the patterns are read: the dotted and the dotless i are i."""
    return text.translate({0x130: "i", 0x131: "i"}).casefold()


def literals(pattern: str) -> frozenset[str] | None:
    """Texts one of which every match holds, without case: the longest that the pattern's parts give; None if there are none."""
    from re import _parser  # the tree that Python itself makes of a pattern

    def of(nodes) -> frozenset[str] | None:
        found, run = [], ""
        for op, arg in [*nodes, (None, None)]:
            name = str(op)
            if name == "LITERAL":
                run += folded(chr(arg))
                continue
            found.append(frozenset([run]) if run else None)
            run = ""
            if name == "SUBPATTERN":
                found.append(of(arg[3]))
            elif name == "BRANCH":
                each = [of(x) for x in arg[1]]
                found.append(None if None in each else frozenset().union(*each))
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
                found.append(of(arg[2]))
            elif name == "IN" and all(str(x) == "LITERAL" for x, _ in arg):
                found.append(frozenset(folded(chr(x)) for _, x in arg))
        found = [x for x in found if x]
        return max(found, key=lambda x: (min(map(len, x)), -len(x))) if found else None

    return of(_parser.parse(re.sub(r"^\(\?[imU]+\)", "", pattern)))


def hits(text: Column, every: list[Rule]) -> Column:
    """The places of the rules one of whose texts a note holds, rising: one pass of an Aho-Corasick automaton over it."""
    asked: dict[str, list[int]] = {}
    always = []
    for i, r in enumerate(every):
        for x in literals(r.pattern) or always.append(i) or ():
            asked.setdefault(x, []).append(i)
    made = []

    @F.pandas_udf("array<int>")
    def found(texts: pd.Series) -> pd.Series:
        if not made:
            import ahocorasick

            a = ahocorasick.Automaton()
            for x, rules_of in asked.items():
                a.add_word(x, rules_of)
            a.make_automaton()
            made.append(a)
        return pd.Series([sorted({i for _, ids in made[0].iter(folded(t)) for i in ids}.union(always)) for t in texts])

    return found(text)


def text_rule(r: Rule) -> str:
    """SQL for a rule as a struct."""
    def value(name: str, x) -> str:
        if name in NUMBERS:
            return f"CAST({'NULL' if x is None else x} AS {NUMBERS[name]})"
        if name == "keys":
            return f"CAST(array({', '.join(f'array({quoted(k)}, {quoted(v)})' for k, v in x)}) AS array<array<string>>)"
        return f"CAST(array({', '.join(map(quoted, x))}) AS array<string>)" if isinstance(x, tuple) else f"CAST({'NULL' if x is None else quoted(x)} AS string)"

    return "struct(" + ", ".join(f"{value(n, x)} AS {n}" for n, x in vars(r).items()) + ")"


def quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_slot(name: str, lane: str, value: str, confidence: float, evidence: str, method: str = "regex") -> str:
    """SQL for a slot; as text, as hundreds of calls for each part of an expression take seconds to build."""
    types = {"num": ("number", "double"), "bool": ("boolean", "boolean"), "str": ("string", "string"), "arr": ("array", "array<string>"), "obj": ("object", OBJ)}
    lanes = ", ".join(f"CAST({value if k == lane else 'NULL'} AS {t}) AS v_{k}" for k, (_, t) in types.items())
    return f"struct({name} AS slot, {quoted(types[lane][0])} AS vtype, {lanes}, {quoted(method)} AS method, CAST({confidence} AS double) AS confidence, {evidence} AS evidence)"


def text_map(text: str, pairs: Sequence[tuple[str, str]], other: str) -> str:
    """SQL for the value of the first key, in order, that the text holds."""
    known = ", ".join(f"struct({quoted(k)} AS k, {quoted(v)} AS v)" for k, v in pairs)
    return f"coalesce(get(filter(array({known}), q -> contains({text}, q.k)), 0).v, {other})"


def matches(every: list[Rule]) -> str:
    """SQL for an array of (r, z): each rule that fits the document's type and matches, with its group (v) and the whole (w) of each match; only rules whose texts the note holds are tried."""
    held = f"array({', '.join(map(text_rule, every))})"  # constant, so that Spark makes it once
    fits = f"filter(transform(_hits, i -> get({held}, i)), r -> size(r.doc_types) = 0 OR array_contains(r.doc_types, document_type))"
    pairs = "transform(arrays_zip(regexp_extract_all(_text, r.pattern, r.group), regexp_extract_all(_text, r.pattern, 0)), x -> struct(x.`0` AS v, x.`1` AS w))"
    return f"filter(transform({fits}, r -> struct(r AS r, {pairs} AS z)), m -> size(m.z) > 0)"


#: The slots of one rule m's matches: each match's value in the rule's lane, those that count, as slots.
TOLD = f"""transform(filter(transform(IF(m.r.kind = 'all', m.z, slice(m.z, 1, 1)), x -> transform(array(IF(m.r.kind = 'all', x.v, nullif(x.v, ''))), v -> struct(v AS v, x.w AS w,
    IF(m.r.lane = 'num', transform(array(try_cast(v AS double)), n -> transform(array(IF(n > m.r.unit, n / 1000, n)), y ->
      CASE m.r.digits WHEN 0 THEN CAST(CAST(y AS bigint) AS double) WHEN 1 THEN bround(y, 1) WHEN 2 THEN bround(y, 2) ELSE y END)[0])[0], CAST(NULL AS double)) AS n,
    CASE m.r.how WHEN 'lower' THEN lower(v) WHEN 'upper' THEN upper(v) WHEN 'trim' THEN trim(v) WHEN 'hours' THEN concat('q', v, 'h')
      WHEN 'map' THEN IF(v IS NULL, NULL, coalesce(get(get(filter(m.r.keys, k -> contains(lower(v), get(k, 0))), 0), 1), CASE m.r.other WHEN '*upper' THEN upper(v) WHEN '*lower' THEN lower(v) ELSE m.r.other END)) END AS s))[0]),
  x -> (m.r.lo IS NULL OR coalesce(x.n BETWEEN m.r.lo AND m.r.hi, false)) AND (size(m.r.barred) = 0 OR coalesce(NOT array_contains(m.r.barred, lower(x.s)), false)) AND (m.r.kind <> 'first' OR x.v IS NOT NULL)),
  x -> struct(m.r.slot AS slot, CASE m.r.lane WHEN 'num' THEN 'number' WHEN 'bool' THEN 'boolean' ELSE 'string' END AS vtype, x.n AS v_num, IF(m.r.lane = 'bool', m.r.kind = 'flag', CAST(NULL AS boolean)) AS v_bool,
    IF(m.r.lane = 'str', x.s, CAST(NULL AS string)) AS v_str, CAST(NULL AS array<string>) AS v_arr, CAST(NULL AS {OBJ}) AS v_obj, 'regex' AS method, m.r.confidence AS confidence, IF(m.r.cut IS NULL, trim(x.w), substring(x.w, 1, m.r.cut)) AS evidence))"""


def parts() -> str:
    """SQL for a struct of the pieces of text that several slots look at, from the matches."""
    of = lambda name, side="v": f"coalesce(get(transform(filter(_m, m -> m.r.kind = 'part' AND m.r.slot = '{name}'), m -> transform(m.z, x -> x.{side})), 0), CAST(array() AS array<string>))"
    first = lambda name, side="v": f"nullif(get({of(name, side)}, 0), '')"
    cased = lambda how, name: f"transform({of(name)}, x -> {how}(x))"
    found = {
        "temp": f"IF(size({of('vs_line', 'w')}) = 0, try_cast({first('temp')} AS double), NULL)", "temp_w": first("temp", "w"), "o2_from": f"try_cast({first('o2_change')} AS int)", "o2_to": f"try_cast({first('o2_change_to')} AS int)",
        "o2_w": first("o2_change", "w"), "started": f"coalesce({first('abx_start')}, {first('abx_start_after')})", "changed": first("abx_change"), "escalated": first("abx_escalate"), "prn": of("prn"),
        "place": f"coalesce({first('pain_location')}, {first('pain_location_2')})", "place_w": first("pain_location", "w"), "org": f"trim({first('organism')})", "org_w": first("organism", "w"), "status": f"upper(trim({first('culture_status')}))",
        "status_w": first("culture_status", "w"), "resistant": of("resistant"), "finds": cased("lower", "cxr_finding"), "spots": cased("upper", "cxr_location"), "said": cased("lower", "cxr_severity"),
        "worse": first("cxr_worsening"), "better": first("cxr_improving"), "normal": f"size({of('cxr_normal', 'w')}) > 0",
    }
    return "struct(" + ", ".join(f"{x} AS {n}" for n, x in found.items()) + ")"


def special() -> str:
    """SQL for the array of slots that need more than one pattern, from the struct p of `parts`; of p and g, what follows from several parts."""
    derived = {
        "org": f"IF(lower(p.org) IN ({', '.join(map(quoted, S.NO_VALUE))}), NULL, p.org)", "n": "size(p.finds)",
        "named": "get(array('minimal', 'mild', 'moderate', 'severe'), array_max(transform(p.said, x -> CASE WHEN x IN ('marked', 'extensive', 'severe') THEN 4 WHEN x = 'moderate' THEN 3 WHEN x = 'mild' THEN 2 ELSE 1 END)) - 1)",
        "change": "CASE WHEN p.worse IS NOT NULL THEN 'worsening' WHEN p.better IS NOT NULL THEN 'improving' END",
    }
    status = """CASE WHEN p.status IN ('COLLECTED', 'PENDING') THEN 'pending' WHEN p.status = 'PRELIMINARY' THEN 'preliminary' WHEN p.status IN ('POSITIVE', 'POS') THEN 'pos'
      WHEN p.status IN ('NEGATIVE', 'NEG', 'NO GROWTH') THEN 'neg' WHEN p.status = 'FINAL' THEN IF(g.org IS NOT NULL, 'pos', 'neg') ELSE lower(p.status) END"""
    guess = "CASE WHEN p.worse IS NOT NULL AND g.n >= 2 THEN 'severe' WHEN p.worse IS NOT NULL THEN 'moderate' WHEN p.better IS NOT NULL THEN 'mild' WHEN g.n >= 2 THEN 'moderate' ELSE 'mild' END"
    distinct = lambda x: f"array_sort(array_distinct({x}))"
    micro, rad = "document_type = 'microbiology' AND ", "document_type = 'radiology' AND "
    every = [
        ("p.temp BETWEEN 35 AND 42", text_slot("'temp_value'", "num", "p.temp", 0.9, "p.temp_w")),
        ("p.o2_from IS NOT NULL AND p.o2_to IS NOT NULL", text_slot("'resp_support_event'", "str", "CASE WHEN p.o2_to > p.o2_from THEN 'increase' WHEN p.o2_to < p.o2_from THEN 'decrease' ELSE 'none' END", 0.9, "p.o2_w")),
        *[(f"p.{k} IS NOT NULL", text_slot("'abx_event'", "str", quoted(v), 0.9, f"substring(p.{k}, 1, 60)")) for k, v in (("started", "start"), ("changed", "change"), ("escalated", "escalate"))],
        ("size(p.prn) > 0", text_slot("'prn_interventions'", "arr", distinct(f"transform(p.prn, x -> {text_map('lower(x)', S.PRN, quoted('unknown'))})"), 0.9, "array_join(p.prn, ', ')")),
        ("p.place IS NOT NULL", text_slot("'pain_location_hint'", "str", text_map("lower(p.place)", S.PAIN_PLACES, quoted("unknown")), 0.9, "p.place_w")),
        (micro + "g.org IS NOT NULL", text_slot("'organism'", "str", "g.org", 0.95, "trim(p.org_w)")),
        (micro + "p.status IS NOT NULL", text_slot("'culture_result'", "obj", f"struct({status} AS status, g.org AS organism)", 0.95, "p.status_w")),
        (micro + "size(p.resistant) > 0", text_slot("'resistance_detected'", "arr", distinct("p.resistant"), 0.95, "array_join(slice(p.resistant, 1, 3), ' | ')")),
        (rad + "g.n > 0", text_slot("'cxr_lesion_type'", "arr", distinct(f"transform(p.finds, x -> {text_map('x', S.FINDINGS, 'x')})"), 0.9, "array_join(p.finds, ', ')")),
        (rad + "size(p.spots) > 0", text_slot("'cxr_location'", "arr", distinct("transform(p.spots, x -> IF(x = 'BOTH', 'bilateral', x))"), 0.9, "array_join(p.spots, ', ')")),
        (rad + "g.change IS NOT NULL", text_slot("'cxr_change_direction'", "str", "g.change", 0.9, "coalesce(p.worse, p.better)")),
        (rad + "size(p.said) > 0", text_slot("'cxr_severity'", "str", "g.named", 0.85, "concat('severity: ', g.named)")),
        (rad + "size(p.said) = 0 AND p.normal", text_slot("'cxr_severity'", "str", "'normal'", 0.85, "'no active findings'")),
        (rad + "size(p.said) = 0 AND NOT p.normal AND g.n > 0", text_slot("'cxr_severity'", "str", guess, 0.7, "concat('inferred from findings=', CAST(g.n AS string))", "regex_inferred")),
    ]
    none = f"CAST(array() AS array<{SLOT}>)"
    slots = ", ".join(f"IF({when}, array({made}), {none})" for when, made in every)
    return f"get(transform(array({parts()}), p -> get(transform(array(struct({', '.join(f'{x} AS {n}' for n, x in derived.items())})), g -> concat({slots})), 0)), 0)"


def extract(docs: DataFrame, id_col: str = "document_id", text_col: str = "raw_text", type_col: str = "document_type", notify_col: str | None = None) -> DataFrame:
    """(id, document_type, seq, slot and its lanes), all slots that any rule emits, in the rules' order.

    One pass over a note finds which rules' texts it holds, and only their patterns are tried. notify_mentioned
    is set for nursing notes only, from the structured flag. Null texts give none; a note is read whole.
    """
    text, kind, every = F.col("_text"), F.col("document_type"), rules()
    told_ = F.coalesce(F.col(notify_col).cast("boolean"), F.lit(False)) if notify_col else F.lit(False)
    base = docs.select(F.col(id_col), F.col(type_col).alias("document_type"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), told_.alias("_told"))
    made = f"concat(flatten(transform(filter(_m, m -> m.r.kind <> 'part'), m -> {TOLD})), {special()})"
    # _m is a variable of the expression, so that its patterns are tried once however often it is used
    arrays = [F.expr(f"get(transform(array({matches(every)}), _m -> {made}), 0)")]
    if notify_col:
        arrays.append(one(kind == "nursing_note", slot("notify_mentioned", "bool", F.col("_told"), 0.99, F.concat(F.lit("notify_md="), F.col("_told").cast("string")), "structured")))
    rows = base.withColumn("_hits", hits(text, every)).select(id_col, "document_type", F.concat(*arrays).alias("s"))
    return rows.select(id_col, "document_type", F.posexplode("s").alias("seq", "s")).select(id_col, "document_type", "seq", "s.*")


def note_id(text: Column, kind: Column, told: Column | None = None) -> Column:
    """A key of all that a note's slots depend on: its text, type and flag. Null and empty texts say the same, as do a null flag and false."""
    flag = F.coalesce(told.cast("boolean"), F.lit(False)) if told is not None else F.lit(False)
    key = F.sha2(F.concat_ws("\n", flag.cast("string"), F.coalesce(F.length(kind), F.lit(-1)).cast("string"), kind, F.coalesce(text, F.lit(""))), 256)
    return F.coalesce(key, F.lit(""))  # never null, so that a join needs no filter that makes the text once more


def distinct_notes(docs: DataFrame, text_col: str = "raw_text", type_col: str = "document_type", notify_col: str | None = None, rows_a_task: int = 2000) -> DataFrame:
    """(note_id, document_type, raw_text, notify_md): each text of a type and flag once, whole, in partitions of some `rows_a_task` of them.

    Notes are copied forward, and patterns cost far more than a row's bytes do, so texts are tried once and
    dealt out by their number: what `extract` and the steps behind it find by note_id is joined to the
    documents by `note_id`.
    """
    text, kind, told = F.col(text_col), F.col(type_col), F.col(notify_col) if notify_col else None
    flag = F.coalesce(told.cast("boolean"), F.lit(False)) if notify_col else F.lit(False)
    kept = stage(docs.select(note_id(text, kind, told).alias("note_id"), kind.alias("document_type"), F.coalesce(text, F.lit("")).alias("raw_text"), flag.alias("notify_md")).distinct())
    return kept.repartition(max(1, -(-kept.count() // rows_a_task)), "note_id")


def with_defaults(slots: DataFrame, id_col: str = "document_id") -> DataFrame:
    """Adds o2_device RA to documents with a saturation and no device."""
    per = slots.groupBy(id_col, "document_type").agg(F.max("seq").alias("seq"), F.bool_or(F.col("slot") == "spo2_value").alias("sat"), F.bool_or(F.col("slot") == "o2_device").alias("dev"))
    made = per.where("sat AND NOT dev").select(id_col, "document_type", (F.col("seq") + 1).alias("seq"), slot("o2_device", "str", F.lit("RA"), 0.8, F.lit("o2_device not mentioned, assume RA"), "inferred").alias("s"))
    return slots.unionByName(made.select(id_col, "document_type", "seq", "s.*"))


def merged(slots: DataFrame, id_col: str = "document_id") -> DataFrame:
    """The most confident slot of each name per document; ties go to the first emitted."""
    w = Window.partitionBy(id_col, "slot").orderBy(F.desc("confidence"), "seq")
    return slots.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def enabled(slots: DataFrame, disabled: Sequence[str]) -> DataFrame:
    return slots.where(~F.col("slot").isin(*disabled)) if disabled else slots


def spec_columns(spec: dict[str, dict]) -> tuple[Column, Column, Column, Column]:
    """Columns (type, lo, hi, allowed) by a slot's name: a map literal as large as the spec."""
    def lookup(values: dict[str, Column], kind: str) -> Column:
        items = [x for k, v in values.items() for x in (F.lit(k), v.cast(kind))]
        return F.create_map(*items)[F.col("slot")] if items else F.lit(None).cast(kind)

    return (
        lookup({n: F.lit(d.get("type", "string")) for n, d in spec.items()}, "string"),
        lookup({n: F.lit(d["range"][0]) for n, d in spec.items() if d.get("range")}, "double"), lookup({n: F.lit(d["range"][1]) for n, d in spec.items() if d.get("range")}, "double"),
        lookup({n: F.array(*[F.lit(str(v)) for v in d["allowed_values"]]) for n, d in spec.items() if d.get("allowed_values")}, "array<string>"),
    )


def validated(slots: DataFrame, spec: dict[str, dict]) -> DataFrame:
    """Adds issue (null, unknown_slot, out_of_range, invalid_value) and kept: what is out of range goes, the rest stays with a warning."""
    kind, lo, hi, allowed = spec_columns(spec)
    value = F.coalesce(F.col("v_str"), F.initcap(F.col("v_bool").cast("string")))
    outside = F.col("v_num").isNotNull() & lo.isNotNull() & ~F.col("v_num").between(lo, hi)
    odd = (kind == "enum") & allowed.isNotNull() & value.isNotNull() & ~F.array_contains(allowed, value)
    issue = F.when(kind.isNull(), "unknown_slot").when(outside, "out_of_range").when(odd, "invalid_value")
    return slots.withColumn("issue", issue).withColumn("kept", F.coalesce(F.col("issue") != "out_of_range", F.lit(True)))


def mandatory_missing(docs: DataFrame, slots: DataFrame, mandatory: dict[str, Sequence[str]], id_col: str = "document_id", type_col: str = "document_type") -> DataFrame:
    """(id, document_type, missing): the mandatory slots of its type that a document lacks, where there are any."""
    need = F.create_map(*[x for k, v in mandatory.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    per = slots.groupBy(id_col).agg(F.collect_set("slot").alias("have"))
    d = docs.select(id_col, F.col(type_col).alias("document_type")).join(per, id_col, "left")
    lack = F.array_except(need[F.col("document_type")], F.coalesce("have", F.array().cast("array<string>")))
    return d.select(id_col, "document_type", lack.alias("missing")).where(F.size("missing") > 0)


def normalized(slots: DataFrame, spec: dict[str, dict]) -> DataFrame:
    """Maps, unit fixes, types, empty values, ranges and enums in this order; adds changed and issue.

    Values that are empty or out of range go; enum values are matched without case; lists become
    sorted, distinct and canonical; a value outside its enum stays with a warning.
    """
    kind, lo, hi, allowed = spec_columns(spec)
    maps = {n: {str(k): str(v) for k, v in d["normalize"].items() if k is not None} for n, d in spec.items() if isinstance(d.get("normalize"), dict)}
    pairs = [F.lit(x) for n, m in maps.items() for k, v in m.items() for x in (f"{n}\n{k}", v)]
    mapped = F.coalesce(F.create_map(*pairs)[F.concat_ws("\n", "slot", "v_str")], "v_str") if pairs else F.col("v_str")
    out = slots.withColumns({"_k": kind, "_allowed": allowed, "_m": F.when(F.col("slot") == "specimen_type", F.lower(F.trim(mapped))).otherwise(mapped)})
    k, m, name = F.col("_k"), F.col("_m"), F.col("slot")
    unit = lambda n: F.when(F.isnan(n) | (F.abs(n) == float("inf")), None).when((name == "wbc_value") & (n > 100), F.bround(n / 1000, 2)).when((name == "platelet_value") & (n > 1000), F.bround(n / 1000, 1)).otherwise(n)
    n = F.when(k.isin("integer", "float"), F.coalesce("v_num", F.regexp_extract(m, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double"))).otherwise(F.col("v_num"))
    n = let(let(n, unit), lambda x: F.when(k == "integer", x.cast("long").cast("double")).otherwise(x))
    said = F.create_map(*[x for ws, v in ((("true", "yes", "1", "t"), True), (("false", "no", "0", "f"), False)) for w in ws for x in (F.lit(w), F.lit(v))])
    b = F.when(k.isin("boolean", "tri_bool"), F.coalesce("v_bool", said[F.lower(F.trim(m))])).otherwise(F.col("v_bool"))
    canon = lambda x: F.coalesce(F.get(F.filter("_allowed", lambda a: F.lower(a) == F.lower(F.trim(x))), F.lit(0)), x)
    # distinct without case, the first form kept, sorted without case
    first = lambda xs: F.filter(xs, lambda x, i: F.array_position(F.transform(xs, lambda y: F.lower(y)), F.lower(x)) == i + 1)
    ordered = lambda xs: F.transform(F.array_sort(F.transform(xs, lambda x: F.struct(F.lower(x).alias("o"), x.alias("x")))), lambda t: t["x"])
    listed = let(F.transform(F.coalesce("v_arr", F.when(m.isNotNull(), F.array(m))), canon), lambda xs: ordered(first(xs)))
    a = F.when(k.startswith("list"), listed).otherwise(F.col("v_arr"))
    s = F.when(k.startswith("list"), None).when(k == "enum", canon(m)).otherwise(m)
    out = out.withColumns({"_n": n, "_b": b, "_s": s, "_a": a})
    n, s = F.col("_n"), F.col("_s")
    empty = F.coalesce(F.col("_n").cast("string"), F.col("_b").cast("string"), F.nullif(F.trim("_s"), F.lit("")), F.when(F.size("_a") > 0, F.lit("x")), F.when(F.col("v_obj").isNotNull(), F.lit("x"))).isNull()
    same = n.eqNullSafe(F.col("v_num")) & F.col("_b").eqNullSafe(F.col("v_bool")) & s.eqNullSafe(F.col("v_str")) & F.col("_a").eqNullSafe(F.col("v_arr"))
    out = out.where(~empty).withColumn("changed", ~same)
    out = out.select("changed", *[F.col({"v_num": "_n", "v_bool": "_b", "v_str": "_s", "v_arr": "_a"}.get(c, c)).alias(c) for c in slots.columns])
    return validated(out.select(*slots.columns, "changed"), spec).where("kept").drop("kept")


def context_tags(text: Column, spec: dict[str, dict] = S.CONTEXT) -> Column:
    """struct(negation, uncertainty, plan: sorted distinct matches; temporality: past, present, future)."""
    def tagged(name: str) -> Column:
        d = spec[name]
        hits = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in d["patterns"]]) if d["patterns"] else F.array().cast("array<string>")
        joined = F.array_join(hits, " ")
        words = F.filter(F.array(*map(F.lit, d["words"])), lambda w: text.contains(w) & ~joined.contains(w))
        return sorted_distinct(F.concat(hits, words))

    times = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in spec["temporality"]["patterns"]])
    has = lambda x, ws: F.lower(x).rlike("|".join(ws))
    when = lambda x: F.when(has(x, S.PAST), "past").when(has(x, S.PRESENT), "present").when(has(x, S.FUTURE), "future").otherwise("present")
    tense = F.struct(*[F.filter(times, lambda x, k=k: when(x) == k).alias(k) for k in ("past", "present", "future")])
    return F.struct(*[tagged(n).alias(n) for n in ("negation", "uncertainty", "plan")], tense.alias("temporality"))


#: How a nursing note writes a pain score; the first of these, in order, whose value lies in 0 to 10 counts.
FIRST_PAIN = (r"(?iU)(?:통증|pain)\s*:?\s*(\d{1,2})\s*/\s*10", r"(?iU)(\d{1,2})\s*/\s*10\s*(?:\(NRS\)|NRS)", r"(?iU)NRS\s*[:=]?\s*(\d{1,2})")


def first_pain(*texts: Column) -> Column:
    """The first valid pain score: texts in order, in each the patterns in order; null where none is valid."""
    tries = [_num(found(t, p, 1)) for t in texts for p in FIRST_PAIN]
    return F.coalesce(*[F.when(v.between(0, 10), v.cast("int")) for v in tries])


def serialized(slots: DataFrame, spec: dict[str, dict]) -> DataFrame:
    """Adds value_type and value_text: numbers and words as they are, flags, lists and objects as JSON, whatever stands in their texts; null items are null."""
    whole = F.col("slot").isin(*[n for n, d in spec.items() if d["type"] == "integer"])
    number = F.when(whole, F.col("v_num").cast("long").cast("string")).otherwise(F.col("v_num").cast("string"))
    held = F.to_json("v_obj", {"ignoreNullFields": "false"})
    return slots.withColumns({"value_type": F.col("vtype"), "value_text": F.coalesce(number, F.col("v_bool").cast("string"), "v_str", F.to_json("v_arr"), held)})


def split(slots: DataFrame, id_col: str = "document_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, slots, evidence): a slot's key is a hash of its document and name, so that all three can be written apart."""
    keyed = slots.withColumn("slot_id", F.sha2(F.concat_ws("\n", F.col(id_col).cast("string"), "slot"), 256))
    docs = slots.groupBy(id_col, "document_type").agg(F.count("*").alias("slots"))
    return docs, keyed.drop("evidence", "method", "confidence", "document_type"), keyed.select("slot_id", "method", "confidence", F.substring("evidence", 1, 120).alias("evidence"))
