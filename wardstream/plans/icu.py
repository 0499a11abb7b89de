"""The ICU chain over a stream of measurements: grid, windows, fills, slopes, tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import hours_between
from ..operators import features, impute, panes, scoring


def trends(events: DataFrame, key: str = "user_id", ts: str = "ts", kind: str = "event_type", value: str = "value", width: int = 6) -> DataFrame:
    """(key, obs, n, hr, temp, lactate, hr_slope, risk_level): one row per stay and observation hour with measurements.

    view, click and purchase stand for heart rate, temperature and lactate. All steps are keyed by the
    stay, so what is shuffled is summed up by stay and hour before.
    """
    m = events.join(events.groupBy(key).agg(F.min(ts).alias("_t0")), key).withColumn("h", F.floor(hours_between(F.col(ts), F.col("_t0"))).cast("int"))
    item = lambda name: F.when(F.col(kind) == name, F.col(value))
    g = panes.sliding(m, key, *panes.hours("h", width), {
        "n": ("count", F.lit(1)), "hr": ("median", item("view")), "temp": ("latest", item("click"), F.when(F.col(kind) == "click", F.col(ts))), "lactate": ("max", item("purchase")),
    })
    g = g.withColumns({c: impute.ffill(c, key, "obs", k) for c, k in (("hr", 24), ("temp", 6), ("lactate", 12))})
    g = g.fillna({"temp": 36.8, "lactate": 1.2, "hr": 0.0})
    g = g.withColumn("hr_slope", F.round(features.slope("hr", "obs", key), 6))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 + F.col("hr_slope") / 50 + F.col("lactate") / 400))
    return g.withColumn("risk_level", scoring.tier(score, 0.3, 0.6))
