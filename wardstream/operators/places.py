"""Places given out in order: who comes first takes the first place that is open to them, in rounds over all groups at once.

What one gets depends on all before. Yet as long as nobody of a group has been refused, everybody before
got what they asked for, and in the right order. So in each round every open person asks for their first
open room; each room grants in order; and within a group all grants before the group's first refusal stand.
A refusal closes a room (it is full, or now holds one class only), so a group takes at most two rounds for
each of its rooms. No group is ever gathered in one task: its rooms are, as an array, and no room's requests
are more than its group's beds for each class and wish, as others could not be served (see `first_of`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import stage

SALTS = 64


def first_of(df: DataFrame, keys: list[Column | str], order: Column, most: int) -> DataFrame:
    """The first `most` rows of each key by `order`, with their place as _turn; a key with any number of rows is first cut down in parts."""
    part = F.pmod(F.xxhash64(order), F.lit(SALTS))
    cut = df.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys, part).orderBy(order))).where(F.col("_turn") <= most).drop("_turn")
    return cut.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_turn") <= most)


def most_in(df: DataFrame, keys: list[str]) -> int:
    """The largest number of rows of a key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def granted(people: DataFrame, beds: DataFrame, group: str, last: bool = False) -> DataFrame:
    """(group, _id, room, bed) of everybody who gets a place.

    people: group, _id, _order, _class (string), _wish (array of rooms). beds: group, room, bed, shared.
    One takes the lowest free bed of the first wished room that is open, else of the first (or last, by
    `last`) open room by name. A shared room is open to the class that it holds. (group, _id) is a key;
    people or beds without a group get nothing.
    """
    spark = people.sparkSession
    known = F.col(group).isNotNull()
    beds = stage(beds.where(known & F.col("room").isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy(group, "room").orderBy("bed"))))
    rooms = stage(beds.groupBy(group, "room").agg(F.count("*").alias("n"), F.max("shared").alias("shared")))
    most = rooms.agg(F.max("n")).first()[0] or 0
    waiting, given = stage(people.where(known)), None
    while not waiting.isEmpty():
        now = rooms.withColumns({"used": F.lit(0).cast("long"), "held": F.lit(None).cast("string")})
        if given is not None:
            so_far = given.groupBy(group, "room").agg(F.count("*").alias("used"), F.max("_class").alias("held"))
            now = rooms.join(so_far, [group, "room"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
        now = now.where("used < n").groupBy(group).agg(F.sort_array(F.collect_list(F.struct("room", "n", "used", "shared", F.when(F.col("shared"), F.col("held")).alias("held"))), asc=not last).alias("_rooms"))
        open_ = F.filter("_rooms", lambda r: ~r["shared"] | r["held"].isNull() | (r["held"] == F.col("_class")))
        wished = F.filter(F.transform("_wish", lambda w: F.get(F.filter("_open", lambda r: r["room"] == w), F.lit(0))), lambda r: r.isNotNull())
        asks = waiting.join(now, group).withColumn("_open", open_)
        asks = asks.withColumn("ask", F.coalesce(F.get(wished, F.lit(0)), F.get("_open", F.lit(0)))).drop("_open", "_rooms").where("ask IS NOT NULL")
        asks = stage(asks)
        w = Window.partitionBy(group, "ask.room").orderBy("_order")
        # beyond one more than a room has beds, everybody is refused, and later than the first who is
        heard = asks.withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") <= most + 1)
        fits = ~F.col("ask.shared") | (F.col("_class") == F.coalesce("ask.held", F.first("_class").over(w)))
        heard = heard.withColumn("_yes", fits & (F.col("_turn") + F.col("ask.used") <= F.col("ask.n")))
        refused = heard.where("NOT _yes").groupBy(group).agg(F.min("_order").alias("_until"))
        grants = heard.join(refused, group, "left").where("_yes AND (_until IS NULL OR _order < _until)")
        grants = stage(grants.select(group, "_id", "_class", F.col("ask.room").alias("room"), (F.col("_turn") + F.col("ask.used")).alias("_k")))
        given = grants if given is None else given.unionByName(grants)
        waiting = stage(asks.drop("ask").join(grants.select(group, "_id"), [group, "_id"], "left_anti"))
    if given is None:
        return spark.createDataFrame([], people.select(group, "_id").schema).join(beds.select(group, "room", "bed"), group)
    return given.join(beds, [group, "room", "_k"]).select(group, "_id", "room", "bed")
