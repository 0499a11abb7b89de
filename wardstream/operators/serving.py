"""Keeping and serving tables: latest rows, upserts, expectations, cascaded lookups, beds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import places


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The newest row per key; `order` must end in something unique."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """All keys of both; the new row where both have one, the newest where `new` has several."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, F.desc("_new"), *order).drop("_new")


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """old and the distinct new rows that it lacks, by all columns (null equals null) or by keys."""
    cols = keys or old.columns
    fresh = new.dropDuplicates(cols).alias("n")
    o = old.select(*[F.col(c).alias(f"_{c}") for c in cols]).distinct()
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"_{c}")) for c in cols]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return old.unionByName(fresh.join(o, cond, "left_anti"))


def delete_scope(children: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """Rows outside the scope: a delete as a rewrite."""
    return children.join(scope.select(key).distinct(), key, "left_anti")


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, violations): how many rows break each rule, in one pass; a null outcome isn't a violation."""
    one = df.agg(*[F.coalesce(F.sum(F.when(~ok, 1).otherwise(0)), F.lit(0)).cast("long").alias(n) for n, ok in rules.items()])
    return one.unpivot([], list(rules), "rule", "violations")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key isn't null and has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def cascade(rows: DataFrame, lookup: DataFrame, id_col: str, attempts: list[dict[str, Column]], key_cols: list[str], value: str) -> DataFrame:
    """Adds `value` from the first attempt that finds a row: each attempt gives the key columns' values to look up."""
    for k, attempt in enumerate(attempts):
        # one value per key, the least, so that no row is doubled
        side = lookup.groupBy(*[F.col(c).alias(f"_{c}") for c in key_cols]).agg(F.min(value).alias(f"_v{k}"))
        cond = F.lit(True)
        for c in key_cols:
            cond = cond & (attempt[c] == F.col(f"_{c}"))
        rows = rows.join(side, cond, "left").drop(*[f"_{c}" for c in key_cols])
    return rows.withColumn(value, F.coalesce(*[f"_v{k}" for k in range(len(attempts))])).drop(*[f"_v{k}" for k in range(len(attempts))])


def pair_in_order(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str) -> DataFrame:
    """The k-th left row of each key with the k-th right row; beyond the right side's end, with its last."""
    l = left.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(left_order)))
    w = Window.partitionBy(*keys)
    r = right.withColumn("_k", F.row_number().over(w.orderBy(right_order)))
    n = r.groupBy(*keys).agg(F.max("_k").alias("_n"))
    l = l.join(n, keys, "left").withColumn("_k", F.least("_k", "_n"))
    return l.join(r, [*keys, "_k"], "left").drop("_k", "_n")


def single_value(values: Column) -> Column:
    """The value, if a group holds exactly one distinct; else null."""
    s = F.collect_set(values)
    return F.when(F.size(s) == 1, F.element_at(s, 1))


def bed_status(beds: DataFrame, stays: DataFrame, bed: str, now: Column, clean_hours: int = 2) -> DataFrame:
    """OCCUPIED while a stay lasts, CLEANING for some hours after the last one, else AVAILABLE."""
    per = stays.groupBy(bed).agg(F.max(F.when(F.col("end").isNull() | (F.col("end") > now), 1).otherwise(0)).alias("_busy"), F.max("end").alias("_last"))
    out = beds.join(per, bed, "left")
    cleaning = F.col("_last") + F.make_dt_interval(hours=F.lit(clean_hours)) > now
    return out.withColumn("status", F.when(F.col("_busy") == 1, "OCCUPIED").when(cleaning, "CLEANING").otherwise("AVAILABLE")).drop("_busy", "_last")


#: Who is placed first.
PLACE_FIRST = ("MDRO", "Tick-borne", "Pneumonia", "UTI", "Waterborne")


def assign_beds(patients: DataFrame, beds: DataFrame, ward: str = "ward") -> DataFrame:
    """(ward, patient_id, bed_id, room_id): greedy, each ward on its own, in rounds over all wards (see `places`).

    patients: ward, patient_id, infection_type, gender, preferred (array of rooms). beds: ward, bed_id,
    room_id, capacity. By priority and id, a patient gets the lowest bed of the first room, preferred
    ones first and then by name, that has one and, if shared, holds no other gender; patients without
    a place or a ward get nulls. (ward, patient_id) is a key. Once a patient finds no place, nobody
    later with the same gender and preferences does, so of each such class only as many as the ward
    has beds ask for one.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PLACE_FIRST)), F.col("infection_type")), F.lit(0)), F.lit(10))
    people = patients.select(ward, F.col("patient_id").alias("_id"), F.struct(rank, "patient_id").alias("_order"), F.coalesce(F.concat(F.lit("="), F.col("gender").cast("string")), F.lit("")).alias("_class"), F.col("preferred").alias("_wish"))
    asking = places.first_of(people, [ward, "_class", "_wish"], F.col("_order"), places.most_in(beds, [ward])).drop("_turn")
    shared = F.max(F.col("capacity") > 1).over(Window.partitionBy(ward, "room_id"))
    got = places.granted(asking, beds.select(ward, F.col("room_id").alias("room"), F.col("bed_id").alias("bed"), shared.alias("shared")), ward)
    got = got.select(ward, F.col("_id").alias("patient_id"), F.col("bed").alias("bed_id"), F.col("room").alias("room_id"))
    return patients.select(ward, "patient_id").join(got, [ward, "patient_id"], "left")


def plan_transfers(patients: DataFrame, beds: DataFrame, ward: str = "ward") -> DataFrame:
    """The k-th patient of a ward (by priority, id) with its k-th free bed; patients beyond the last bed have none."""
    p = patients.withColumn("_k", F.row_number().over(Window.partitionBy(ward).orderBy("priority", "patient_id")))
    b = beds.withColumn("_k", F.row_number().over(Window.partitionBy(ward).orderBy("bed_id")))
    return p.join(b, [ward, "_k"], "left").drop("_k")


def plan_with_fallback(patients: DataFrame, beds: DataFrame, site: str = "site", ward: str = "ward") -> DataFrame:
    """(site, patient_id, to_ward, bed_id, status): in the order of ids, a patient gets the lowest free bed of its ward, or of the
    last ward by name that has one; where the site has none left, the case needs an exception.

    Given out in rounds over all sites (see `places`): a site takes at most as many as it has wards. Every
    patient takes a bed as long as there is one, so only as many as the site has beds ask for one.
    (site, patient_id) is a key; patients without a site need an exception.
    """
    people = patients.select(site, F.col("patient_id").alias("_id"), F.col("patient_id").alias("_order"), F.lit("").alias("_class"), F.array(ward).alias("_wish"))
    asking = places.first_of(people, [site], F.col("_order"), places.most_in(beds, [site])).drop("_turn")
    got = places.granted(asking, beds.select(site, F.col(ward).alias("room"), F.col("bed_id").alias("bed"), F.lit(False).alias("shared")), site, last=True)
    got = got.select(site, F.col("_id").alias("patient_id"), F.col("room").alias("to_ward"), F.col("bed").alias("bed_id"), F.lit("PLANNED").alias("status"))
    return patients.select(site, "patient_id").join(got, [site, "patient_id"], "left").withColumn("status", F.coalesce("status", F.lit("NEEDS_EXCEPTION")))


def detached(rows: DataFrame, gone: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Rows whose key goes lose their links (cols become null); all rows stay, and so can be linked again."""
    mark = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    j = rows.join(mark, key, "left")
    return j.select(*[F.when(F.col("_gone"), None).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in rows.columns])


def updated(rows: DataFrame, changes: DataFrame, key: str, cols: list[str], newest: Column | None = None) -> DataFrame:
    """An update by a join: rows whose key is among the changes take their values, nulls too.

    Of several changes of a key the one with the greatest `newest` wins; without it, they are an error.
    """
    value = F.struct(*cols)
    one = F.max_by(value, newest) if newest is not None else F.when(F.count("*") == 1, F.first(value)).otherwise(F.raise_error(F.concat(F.lit("changed more than once: "), F.col(key).cast("string"))))
    j = rows.join(changes.groupBy(key).agg(one.alias("_new")), key, "left")
    return j.select(*[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in rows.columns])
