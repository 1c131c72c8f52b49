"""Monthly climatology of stations and zones, and the checks made with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily(df: DataFrame) -> DataFrame:
    """Daily mean, min and max of temperature and humidity by station."""
    return df.groupBy("station_id", "climate_zone", F.to_date("timestamp").alias("day")).agg(
        *[f(c).alias(f"{s}_{n}") for c, s in (("temperature_c", "t"), ("humidity_pct", "rh")) for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    )


def climatology(days: DataFrame) -> DataFrame:
    """(key, month, temp_mean, temp_std, temp_min, temp_max, rh_mean, rh_min, rh_max) of stations and of pooled zones, by grouping sets."""
    rows = days.withColumn("month", F.month("day")).withColumn("zone", F.concat(F.lit("zone_"), "climate_zone")).withColumn("station", F.lower("station_id"))
    sets = rows.groupingSets([["station", "month"], ["zone", "month"]], "station", "zone", "month")
    r = lambda c: F.round(c, 2)
    made = sets.agg(
        r(F.avg("t_mean")).alias("temp_mean"), r(F.stddev_samp("t_mean")).alias("temp_std"), r(F.min("t_min")).alias("temp_min"), r(F.max("t_max")).alias("temp_max"),
        r(F.avg("rh_mean")).alias("rh_mean"), r(F.greatest(F.lit(0.0), F.min("rh_min"))).alias("rh_min"), r(F.least(F.lit(100.0), F.max("rh_max"))).alias("rh_max"),
    )
    return made.select(F.coalesce("station", "zone").alias("key"), "month", "temp_mean", "temp_std", "temp_min", "temp_max", "rh_mean", "rh_min", "rh_max")
