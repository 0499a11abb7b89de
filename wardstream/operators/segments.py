"""Windows over keys that are longer than a task.

The rows of a long key are cut into segments of its order. What a window carries from earlier rows
into a segment, a last value or a running sum, is one row per segment; a window over those rows
passes it on, and it enters the segment as a row before its first. Short keys take the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import few_rows, range_of
from ..sources.stages import stage

#: Rows of a key that one task sorts; about as many make a segment of a longer key.
FITS = 1_000_000
#: A table of at most this many cuts is broadcast.
BROADCAST_CUTS = 1_000_000
SAMPLES = 64


def placed(df: DataFrame, key: str, order: Sequence[str], fits: int = FITS) -> tuple[DataFrame, DataFrame | None]:
    """(rows of short keys, rows of long keys with _o, their order as a struct, and _seg, their segment from 0); the second is None if no key is long.

    Cuts are rows of the key itself, from a sample by the hash of the order, some SAMPLES to a
    segment; rows of equal order stay together, so the order should tell rows apart. Nulls come first.
    """
    n = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where(F.col("_n") > fits)
    n = stage(n)
    if n.isEmpty():
        return df, None
    names = F.broadcast(n.select("_key")) if few_rows(n, BROADCAST_CUTS) else n.select("_key")
    same = F.col(key).eqNullSafe(F.col("_key"))
    short = df.join(names, same, "left_anti")
    long = df.join(names, same).drop("_key").withColumn("_o", F.struct(*order))
    step = max(1, fits // SAMPLES)
    some = long.where(F.pmod(F.xxhash64("_o"), F.lit(step)) == 0).groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_set("_o")).alias("_s"))
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.size("_s") / SAMPLES).cast("int"))), lambda i: F.get("_s", i * SAMPLES))
    cuts = stage(some.select("_key", F.filter(cuts, lambda x: x.isNotNull()).alias("_cuts")))
    size = cuts.agg(F.coalesce(F.sum(F.size("_cuts")), F.lit(0)) + F.count("*")).first()[0]
    long = long.join(F.broadcast(cuts) if size <= BROADCAST_CUTS else cuts, same, "left").drop("_key")
    seg = F.when(F.col("_cuts").isNull(), 0).otherwise(range_of(F.col("_o"), F.col("_cuts"), F.size("_cuts")))
    return short, long.withColumn("_seg", seg).drop("_cuts")


def _carry(how: str, value: Column, o: Column, limit: int | None = None) -> Column:
    """What a segment hands on; with a limit, the value and where in the segment it stood."""
    if limit is not None:
        return F.max_by(F.struct(value.alias("x"), F.col("_rn").alias("at")), F.when(value.isNotNull(), o))
    return {"last": lambda: F.max_by(value, F.when(value.isNotNull(), o)), "next": lambda: F.min_by(value, F.when(value.isNotNull(), o)), "lag": lambda: F.max_by(F.struct(value.alias("x")), o), "sum": lambda: F.sum(value), "min": lambda: F.min(value), "max": lambda: F.max(value)}[how]()


def _within(how: str, value: Column, ahead, back, before) -> Column:
    return {
        "last": lambda: F.last(value, ignorenulls=True).over(ahead), "next": lambda: F.first(value, ignorenulls=True).over(back), "lag": lambda: F.lag(value).over(before),
        "sum": lambda: F.sum(value).over(ahead), "min": lambda: F.min(value).over(ahead), "max": lambda: F.max(value).over(ahead),
    }[how]()


def windows(df: DataFrame, key: str, order: Sequence[str], spec: Mapping[str, tuple], fits: int = FITS) -> DataFrame:
    """df with a column for each name of spec: name -> (how, column[, limit]), over the key's rows in order.

    last: the last value at or before the row, with a limit at most so many rows back; next: the
    first at or after it; lag: the previous row's value, null or not; sum, min, max: of all rows up
    to this one. A null key is a key. Equal to the plain windows, whatever share of all rows a key
    has: a task sorts the rows of short keys, or a segment.
    """
    spec = {n: (how, c, limit[0] if limit else None) for n, (how, c, *limit) in spec.items()}
    by = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    ahead, back = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    short, long = placed(df, key, order, fits)
    plain = short.withColumns({n: _within(how, F.col(c), ahead if k is None else by.rowsBetween(-k, 0), back, by) for n, (how, c, k) in spec.items()})
    if long is None:
        return plain
    long = stage(long.withColumn("_rn", F.row_number().over(Window.partitionBy(key, "_seg").orderBy("_o"))))
    handed = long.groupBy(key, "_seg").agg(F.count("*").alias("_n"), *[_carry(how, F.col(c), F.col("_o"), k).alias(f"_c_{n}") for n, (how, c, k) in spec.items()])
    up = Window.partitionBy(key).orderBy("_seg")
    prior, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(1, Window.unboundedFollowing)
    handed = handed.withColumn("_before", F.coalesce(F.sum("_n").over(prior), F.lit(0)))

    def passed(n: str, how: str, k: int | None) -> Column:
        c = F.col(f"_c_{n}")
        if k is not None:  # where the value stands, from this segment's first row
            far = F.last(F.when(c.isNotNull(), F.struct(c["x"].alias("x"), (c["at"] + F.col("_before")).alias("at"))), ignorenulls=True).over(prior)
            return F.when(far.isNotNull(), F.struct(far["x"].alias("x"), (far["at"] - F.col("_before")).alias("at")))
        return {
            "last": lambda: F.last(c, ignorenulls=True).over(prior), "next": lambda: F.first(c, ignorenulls=True).over(after), "lag": lambda: F.lag(c).over(up)["x"],
            "sum": lambda: F.sum(c).over(prior), "min": lambda: F.min(c).over(prior), "max": lambda: F.max(c).over(prior),
        }[how]()

    handed = handed.select(key, "_seg", *[passed(n, how, k).alias(f"_c_{n}") for n, (how, _, k) in spec.items()])
    # what is carried stands before the segment's rows, and what comes from behind after them
    out = long.withColumns({f"_c_{n}": F.lit(None).cast(handed.schema[f"_c_{n}"].dataType) for n in spec} | {"_at": F.lit(1)})
    missing = [c for c in out.columns if c not in {key, "_seg", "_at", *[f"_c_{n}" for n in spec]}]
    guests = handed.withColumns({c: F.lit(None).cast(out.schema[c].dataType) for c in missing})
    guests = guests.withColumn("_at", F.explode(F.array(F.lit(0), F.lit(2)))).select(*out.columns)
    seg = Window.partitionBy(key, "_seg").orderBy("_at", "_o")
    ahead, back = seg.rowsBetween(Window.unboundedPreceding, 0), seg.rowsBetween(0, Window.unboundedFollowing)
    made = {}
    for n, (how, c, k) in spec.items():
        held, own = F.when(F.col("_at") == (2 if how == "next" else 0), F.col(f"_c_{n}")), F.when(F.col("_at") == 1, F.col(c))
        if k is None:
            made[n] = _within(how, F.coalesce(held, own), ahead, back, seg)
        else:
            near = F.last(F.coalesce(held, F.when(own.isNotNull(), F.struct(own.alias("x"), F.col("_rn").cast("long").alias("at")))), ignorenulls=True).over(ahead)
            made[n] = F.when(F.col("_rn") - near["at"] <= k, near["x"])
    both = out.unionByName(guests).withColumns(made).where("_at = 1")
    return plain.unionByName(both.select(*df.columns, *spec))
