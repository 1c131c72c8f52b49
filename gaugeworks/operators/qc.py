"""Deterministic quality control: rules, sentinels, climatology bounds. Predicates treat null as not met."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics

SENSORS = ["temperature_c", "pressure_hpa", "humidity_pct"]
# Inclusive ranges, and values that loggers write for "no reading".
RANGES = {"temperature_c": (-30.0, 60.0), "pressure_hpa": (500.0, 1100.0), "humidity_pct": (0.0, 100.0)}
SENTINELS = {"temperature_c": [-999.0, -99.9, 999.9, 9999.0], "pressure_hpa": [-999.0, -99.9, 999.9, 9999.0], "humidity_pct": [-999.0, -25.0, 160.0]}
STREAM_SENTINELS = {"temperature_c": [-999.0, -99.9, 999.9, 9999.0], "pressure_hpa": [-999.0, -99.9, 9999.0], "humidity_pct": [-999.0, -25.0, 160.0]}


def flag(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def any_of(parts) -> Column:
    return reduce(lambda a, b: a | b, [flag(p) for p in parts])


def all_of(parts) -> Column:
    return reduce(lambda a, b: a & b, parts)


def nan_to_null(df: DataFrame, cols=SENSORS) -> DataFrame:
    """The ingest rule: a reading is null or a number, never NaN."""
    return df.withColumns({c: F.nanvl(c, F.lit(None)) for c in cols})


def rule_qc(df: DataFrame, sentinels: dict | None = None, priority: str = "sentinel_first") -> DataFrame:
    """Adds is_flagged and flag_reason."""
    if priority not in ("sentinel_first", "range_first"):
        raise ValueError(f"unknown priority {priority!r}")
    missing = [c for c in SENSORS if c not in df.columns]
    if missing:
        raise ValueError(f"missing sensor columns {missing}")
    sentinels = sentinels or SENTINELS
    everything = all_of([F.col(c).isNull() for c in SENSORS])
    something = any_of([F.col(c).isNull() for c in SENSORS])
    sentinel = any_of([F.col(c).isin(sentinels[c]) for c in SENSORS])
    outside = any_of([(F.col(c) < lo) | (F.col(c) > hi) for c, (lo, hi) in RANGES.items()])
    last = [(sentinel, "sentinel_value"), (outside, "range_violation")]
    reason = F.when(everything, "communication_dropout").when(something, "partial_nan_anomaly")
    for test, name in last if priority == "sentinel_first" else last[::-1]:
        reason = reason.when(test, name)
    return df.withColumn("flag_reason", reason).withColumn("is_flagged", F.col("flag_reason").isNotNull())


def discover_sentinels(df: DataFrame) -> DataFrame:
    """(sensor, value): readings of corrupt rows that are out of range or known as sentinels."""
    known = sorted({v for vs in SENTINELS.values() for v in vs})
    long = df.where("anomaly_type = 'data_corruption'").select(F.explode(F.create_map(*[x for c in SENSORS for x in (F.lit(c), F.col(c))])).alias("sensor", "value"))
    outside = reduce(lambda a, b: a | b, [(F.col("sensor") == c) & ((F.col("value") < lo) | (F.col("value") > hi)) for c, (lo, hi) in RANGES.items()])
    return long.where(F.col("value").isNotNull() & (outside | F.col("value").isin(known))).distinct()


def climate_qc(df: DataFrame, climate: DataFrame, station_keys: DataFrame, zone_keys: DataFrame, sigmas: float = 3.0, default_key: str = "zone_plains") -> DataFrame:
    """Adds tier1b_flagged and its bounds. climate: (key, month, temp_std, temp_min, temp_max).

    A station's entry is looked for under its lower-cased id, its city (station_keys: station_id, city), its zone
    (climate_zone, else zone_keys: city, zone) and the default, in this order; each lookup is a join with a small table.
    """
    entry = lambda n: F.broadcast(climate.select(F.col("key").alias(f"_k{n}"), F.col("month").alias(f"_m{n}"), F.struct("temp_std", "temp_min", "temp_max").alias(f"_e{n}")))
    city = F.broadcast(station_keys.select(F.col("station_id").alias("_st"), F.col("city").alias("_city")))
    zone = F.broadcast(zone_keys.select(F.col("city").alias("_zc"), F.col("zone").alias("_zone")))
    out = df.join(city, F.col("station_id") == F.col("_st"), "left").join(zone, F.col("_city") == F.col("_zc"), "left").withColumn("_month", F.month("timestamp"))
    keys = [F.lower("station_id"), F.col("_city"), F.concat(F.lit("zone_"), F.coalesce("climate_zone", "_zone")), F.lit(default_key)]
    for n, key in enumerate(keys):
        out = out.withColumn(f"_w{n}", key).join(entry(n), (F.col(f"_w{n}") == F.col(f"_k{n}")) & (F.col("_month") == F.col(f"_m{n}")), "left")
    e = F.coalesce(*[F.col(f"_e{n}") for n in range(len(keys))])
    lower, upper = e["temp_min"] - sigmas * e["temp_std"], e["temp_max"] + sigmas * e["temp_std"]
    t = F.col("temperature_c")
    bounded = t.isNotNull() & e.isNotNull()
    out = out.withColumns({
        "tier1b_flagged": flag((t < lower) | (t > upper)),
        "tier1b_t_lower": F.when(bounded, lower).otherwise(F.lit(float("-inf"))), "tier1b_t_upper": F.when(bounded, upper).otherwise(F.lit(float("inf"))),
    })
    return out.select(*df.columns, "tier1b_flagged", "tier1b_t_lower", "tier1b_t_upper")


def with_climate(flagged: DataFrame) -> DataFrame:
    """Rule reasons win over the climatology's."""
    return flagged.withColumn("flag_reason", F.coalesce("flag_reason", F.when(F.col("tier1b_flagged"), "climatology_range_violation"))).withColumn(
        "is_flagged", F.col("flag_reason").isNotNull()
    )


def stream_qc(df: DataFrame) -> DataFrame:
    """The streaming rules: any null is a sentinel, tolerance on sentinels, -40 degrees, and three equal triples."""
    order = Window.partitionBy("station_id").orderBy("timestamp")
    missing = any_of([F.col(c).isNull() for c in SENSORS])
    sentinel = any_of([F.abs(F.col(c) - v) < 0.01 for c in SENSORS for v in STREAM_SENTINELS[c]])
    outside = any_of([(F.col(c) < (-40.0 if c == "temperature_c" else lo)) | (F.col(c) > hi) for c, (lo, hi) in RANGES.items()])
    flat = all_of([flag((F.col(c) == F.lag(c, 1).over(order)) & (F.col(c) == F.lag(c, 2).over(order))) for c in SENSORS])
    reason = F.when(missing | sentinel, "sentinel_value").when(outside, "range_violation").when(flat, "communication_dropout")
    return df.withColumn("flag_reason", reason).withColumn("is_flagged", F.col("flag_reason").isNotNull())


EXCLUDED = ["communication_dropout", "data_corruption"]


def excluded_type() -> Column:
    return flag(F.col("anomaly_type").isin(EXCLUDED))


def exclusion() -> Column:
    return excluded_type() | any_of([F.col(c).isNull() for c in SENSORS])


def clean_reference() -> Column:
    """Rows that may serve as a neighbour."""
    return ~excluded_type() & all_of([F.col(c).isNotNull() for c in SENSORS]) & flag(F.col("temperature_c") >= -50)


def sea_level_reference() -> Column:
    return ~excluded_type() & flag((F.col("temperature_c") > -50) & (F.col("temperature_c") < 65) & (F.col("pressure_hpa") > 300) & (F.col("pressure_hpa") < 1150) & F.col("humidity_pct").between(0, 100))


def normal_training() -> Column:
    return ~F.col("is_anomaly") & all_of([F.col(c).isNotNull() for c in SENSORS]) & flag(F.col("temperature_c") > -50)


def any_null(cols) -> Column:
    return any_of([F.col(c).isNull() for c in cols])


def physics_checks(df: DataFrame) -> DataFrame:
    t, rh, p = F.col("temperature_c"), F.col("humidity_pct"), F.col("pressure_hpa")
    return df.withColumns({"consistent": physics.physically_consistent(t, rh, p), "dew_violation": physics.dew_violation(t, rh)})
