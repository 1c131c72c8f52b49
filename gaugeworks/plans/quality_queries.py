"""Sources, rule checks and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import physics
from ..operators import climate, features, qc
from ..sources import payloads
from . import fragments as fr
from . import telemetry as tel
from .registry import query

R = lambda c, n=6: F.round(c, n)


@query("src1_parquet_scan", "SELECT event_id, user_id, value FROM events WHERE value > 150")
def src1(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").where("value > 150").select("event_id", "user_id", "value")


@query("src7_payload_rows", fr.TEL + "SELECT station_id, timestamp, temperature_c, humidity_pct, pressure_hpa FROM tel")
def src7(spark, d):
    docs = payloads.to_payload(fr.telemetry(spark, d))
    return payloads.from_payload(docs)


@query("src8_station_catalog", fr.TEL + "SELECT station_id, latitude, longitude, altitude_m, climate_zone FROM st WHERE climate_zone IN ('coastal')")
def src8(spark, d):
    return tel.stations(spark).where(F.col("climate_zone").isin("coastal"))


@query("src9_time_index", "SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-03 23:50:00', INTERVAL 10 MINUTE)) AS timestamp")
def src9(spark, d):
    return payloads.time_index(spark, "2024-01-01 00:00:00", days=3, step_minutes=10)


@query("flt1_tier1_qc", fr.QC + "SELECT station_id, flag_reason, is_flagged, count(*) AS n FROM qc GROUP BY ALL")
def flt1(spark, d):
    return qc.rule_qc(fr.telemetry(spark, d)).groupBy("station_id", "flag_reason", "is_flagged").agg(F.count(F.lit(1)).alias("n"))


@query("flt1_range_first", fr.TEL + """SELECT station_id, timestamp, CASE
  WHEN temperature_c IS NULL AND pressure_hpa IS NULL AND humidity_pct IS NULL THEN 'communication_dropout'
  WHEN temperature_c IS NULL OR pressure_hpa IS NULL OR humidity_pct IS NULL THEN 'partial_nan_anomaly'
  WHEN temperature_c < -30 OR temperature_c > 60 OR pressure_hpa < 500 OR pressure_hpa > 1100 OR humidity_pct < 0 OR humidity_pct > 100 THEN 'range_violation'
  WHEN temperature_c IN (-999.0, -99.9, 999.9, 9999.0) OR humidity_pct IN (-999.0, -25.0, 160.0) THEN 'sentinel_value' END AS flag_reason FROM tel""")
def flt1b(spark, d):
    return qc.rule_qc(fr.telemetry(spark, d), priority="range_first").select("station_id", "timestamp", "flag_reason")


@query("flt2_sentinel_discovery", fr.TEL + """SELECT DISTINCT sensor, value FROM (
  SELECT 'temperature_c' AS sensor, temperature_c AS value FROM tel WHERE anomaly_type = 'data_corruption' AND (temperature_c < -30 OR temperature_c > 60 OR temperature_c IN (-999, -99.9, 999.9, 9999))
  UNION ALL SELECT 'pressure_hpa', pressure_hpa FROM tel WHERE anomaly_type = 'data_corruption' AND (pressure_hpa < 500 OR pressure_hpa > 1100)
  UNION ALL SELECT 'humidity_pct', humidity_pct FROM tel WHERE anomaly_type = 'data_corruption' AND (humidity_pct < 0 OR humidity_pct > 100))""")
def flt2(spark, d):
    return qc.discover_sentinels(fr.telemetry(spark, d))


CLIM = """,
days AS (SELECT station_id, climate_zone, CAST(timestamp AS DATE) AS day, avg(temperature_c) AS t_mean, min(temperature_c) AS t_min, max(temperature_c) AS t_max,
  avg(humidity_pct) AS rh_mean, min(humidity_pct) AS rh_min, max(humidity_pct) AS rh_max FROM normal GROUP BY ALL),
clim AS (SELECT key, month(day) AS month, round(avg(t_mean), 2) AS temp_mean, round(stddev_samp(t_mean), 2) AS temp_std, round(min(t_min), 2) AS temp_min, round(max(t_max), 2) AS temp_max,
  round(avg(rh_mean), 2) AS rh_mean, round(greatest(0.0::DOUBLE, min(rh_min)), 2) AS rh_min, round(least(100.0::DOUBLE, max(rh_max)), 2) AS rh_max
  FROM (SELECT lower(station_id) AS key, * FROM days UNION ALL SELECT 'zone_' || climate_zone, * FROM days) GROUP BY key, month(day))
"""


def _climate(spark, d):
    return climate.climatology(climate.daily(fr.telemetry(spark, d).where(qc.normal_training())))


@query("agg18_climatology", fr.KEPT + CLIM + "SELECT * FROM clim")
def agg18(spark, d):
    return _climate(spark, d)


T1B = CLIM + """,
pick AS (SELECT t.station_id, t.timestamp, t.temperature_c, t.flag_reason, coalesce(a.temp_min - 0.5::DOUBLE * a.temp_std, b.temp_min - 0.5::DOUBLE * b.temp_std) AS lo,
  coalesce(a.temp_max + 0.5::DOUBLE * a.temp_std, b.temp_max + 0.5::DOUBLE * b.temp_std) AS hi
  FROM qc t LEFT JOIN clim a ON a.key = lower(t.station_id) AND t.station_id <> 'ST_1' AND a.month = month(t.timestamp)
  LEFT JOIN clim b ON b.key = 'zone_' || t.climate_zone AND b.month = month(t.timestamp)),
b1 AS (SELECT station_id, timestamp, flag_reason, coalesce(temperature_c < lo OR temperature_c > hi, FALSE) AS tier1b_flagged,
  CASE WHEN temperature_c IS NULL THEN -1e9 ELSE round(lo, 4) END AS lower, CASE WHEN temperature_c IS NULL THEN 1e9 ELSE round(hi, 4) END AS upper FROM pick)
"""


def _tier1b(spark, d):
    table = _climate(spark, d).where("key <> 'st_1'")
    cities = spark.createDataFrame([("ST_1", "delhi")], "station_id string, city string")
    zones = spark.createDataFrame([("delhi", "plains")], "city string, zone string")
    return qc.climate_qc(qc.rule_qc(fr.telemetry(spark, d)), table, cities, zones, sigmas=0.5)


@query("flt3_climatology_qc", fr.KEPT + T1B + "SELECT station_id, timestamp, tier1b_flagged, CAST(lower AS DOUBLE) AS lower, CAST(upper AS DOUBLE) AS upper FROM b1")
def flt3(spark, d):
    finite = lambda c, x: F.when(F.abs(c) == float("inf"), x).otherwise(R(c, 4))
    return _tier1b(spark, d).select("station_id", "timestamp", "tier1b_flagged", finite(F.col("tier1b_t_lower"), -1e9).alias("lower"), finite(F.col("tier1b_t_upper"), 1e9).alias("upper"))


@query("flt4_tier1_composed", fr.KEPT + T1B + "SELECT coalesce(flag_reason, CASE WHEN tier1b_flagged THEN 'climatology_range_violation' END) AS reason, count(*) AS n FROM b1 GROUP BY 1")
def flt4(spark, d):
    return qc.with_climate(_tier1b(spark, d)).groupBy(F.col("flag_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("flt5_stream_rules", fr.TEL + """SELECT station_id, timestamp, CASE
  WHEN temperature_c IS NULL OR pressure_hpa IS NULL OR humidity_pct IS NULL OR abs(temperature_c + 999) < 0.01 OR abs(temperature_c + 99.9) < 0.01 OR abs(temperature_c - 999.9) < 0.01 OR abs(temperature_c - 9999) < 0.01
    OR abs(pressure_hpa + 999) < 0.01 OR abs(pressure_hpa + 99.9) < 0.01 OR abs(pressure_hpa - 9999) < 0.01 OR abs(humidity_pct + 999) < 0.01 OR abs(humidity_pct + 25) < 0.01 OR abs(humidity_pct - 160) < 0.01 THEN 'sentinel_value'
  WHEN temperature_c < -40 OR temperature_c > 60 OR pressure_hpa < 500 OR pressure_hpa > 1100 OR humidity_pct < 0 OR humidity_pct > 100 THEN 'range_violation'
  WHEN temperature_c = lag(temperature_c) OVER w AND temperature_c = lag(temperature_c, 2) OVER w AND pressure_hpa = lag(pressure_hpa) OVER w AND pressure_hpa = lag(pressure_hpa, 2) OVER w
    AND humidity_pct = lag(humidity_pct) OVER w AND humidity_pct = lag(humidity_pct, 2) OVER w THEN 'communication_dropout' END AS flag_reason
  FROM tel WINDOW w AS (PARTITION BY station_id ORDER BY timestamp)""")
def flt5(spark, d):
    return qc.stream_qc(fr.telemetry(spark, d)).select("station_id", "timestamp", "flag_reason")


@query("flt6_feature_exclusion", fr.KEPT + "SELECT (SELECT count(*) FROM kept) AS n_kept, (SELECT count(*) FROM tel) - (SELECT count(*) FROM kept) AS n_excluded")
def flt6(spark, d):
    return fr.telemetry(spark, d).agg(F.count_if(~qc.exclusion()).alias("n_kept"), F.count_if(qc.exclusion()).alias("n_excluded"))


@query("flt7_gap_edge", fr.FEAT + """, v AS (SELECT *, CASE WHEN count(*) OVER f >= 6 THEN var_samp(temperature_c) OVER f END AS var6 FROM feat
  WINDOW f AS (PARTITION BY station_id, segment_id ORDER BY timestamp ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
  SELECT station_id, count(*) FILTER (WHERE "delta_T" IS NULL OR var6 IS NULL) AS gap_edge, count(*) FILTER (WHERE "delta_T" IS NOT NULL AND var6 IS NOT NULL) AS retained FROM v GROUP BY station_id""")
def flt7(spark, d):
    rows = fr.deltas(spark, d).withColumn("var6", features.full_window(F.var_samp, "temperature_c", 6))
    edge = qc.any_null(["delta_T", "var6"])
    return rows.groupBy("station_id").agg(F.count_if(edge).alias("gap_edge"), F.count_if(~edge).alias("retained"))


@query("flt8_clean_reference", fr.KEPT + fr.GRAPH + "SELECT station_id, count(*) AS n FROM ref GROUP BY station_id")
def flt8(spark, d):
    return fr.telemetry(spark, d).where(qc.clean_reference()).groupBy("station_id").agg(F.count(F.lit(1)).alias("n"))


@query("flt9_sea_level_reference", fr.TEL + """SELECT station_id, count(*) AS n FROM tel WHERE coalesce(anomaly_type NOT IN ('communication_dropout', 'data_corruption'), TRUE)
  AND temperature_c > -50 AND temperature_c < 65 AND pressure_hpa > 300 AND pressure_hpa < 1150 AND humidity_pct >= 0 AND humidity_pct <= 100 GROUP BY station_id""")
def flt9(spark, d):
    return fr.telemetry(spark, d).where(qc.sea_level_reference()).groupBy("station_id").agg(F.count(F.lit(1)).alias("n"))


@query("flt10_normal_training", fr.KEPT + "SELECT station_id, timestamp FROM normal")
def flt10(spark, d):
    return fr.telemetry(spark, d).where(qc.normal_training()).select("station_id", "timestamp")


MAGNUS = """, ph AS (SELECT station_id, timestamp, temperature_c AS t, humidity_pct AS rh, pressure_hpa AS p, altitude_m AS z, latitude AS lat,
  ln(6.112 * exp(17.67 * temperature_c / (temperature_c + 243.5)) * CASE WHEN humidity_pct < 0.1 THEN 0.1 ELSE humidity_pct END / 100 / 6.112) AS g,
  6.112 * exp(17.67 * temperature_c / (temperature_c + 243.5)) AS es, hour(timestamp) AS h FROM tel WHERE coalesce(temperature_c > -200, TRUE)),
dw AS (SELECT *, 243.5 * g / (17.67 - g) AS td FROM ph)
"""


def _physical(spark, d):
    return fr.telemetry(spark, d).where("coalesce(temperature_c > -200, true)")


@query("flt13_physical_consistency", fr.TEL + MAGNUS + """SELECT station_id, timestamp, CASE WHEN t IS NULL OR rh IS NULL OR p IS NULL THEN TRUE
  ELSE rh BETWEEN 0 AND 100.05 AND t BETWEEN -25 AND 60 AND p BETWEEN 550 AND 1060 AND td <= t + 0.05 END AS consistent FROM dw""")
def flt13(spark, d):
    return qc.physics_checks(_physical(spark, d)).select("station_id", "timestamp", "consistent")


@query("flt14_dew_invariant", fr.TEL + MAGNUS + "SELECT station_id, count(*) FILTER (WHERE coalesce(t - td < -0.5, FALSE)) AS violations, count(*) AS n FROM dw GROUP BY station_id")
def flt14(spark, d):
    return qc.physics_checks(_physical(spark, d)).groupBy("station_id").agg(F.count_if("dew_violation").alias("violations"), F.count(F.lit(1)).alias("n"))


@query("flt16_out_of_bounds", fr.TEL + """SELECT count(*) FILTER (WHERE temperature_c < -30 OR temperature_c > 60) AS t_out, count(*) FILTER (WHERE pressure_hpa < 500 OR pressure_hpa > 1100) AS p_out,
  count(*) FILTER (WHERE humidity_pct < 0 OR humidity_pct > 100) AS rh_out, count(*) FILTER (WHERE temperature_c IN (-999, 999, -9999, 9999)) AS t_sentinel FROM tel""")
def flt16(spark, d):
    out = lambda c: F.count_if((F.col(c) < qc.RANGES[c][0]) | (F.col(c) > qc.RANGES[c][1]))
    return fr.telemetry(spark, d).agg(out("temperature_c").alias("t_out"), out("pressure_hpa").alias("p_out"), out("humidity_pct").alias("rh_out"),
                                      F.count_if(F.col("temperature_c").isin(-999.0, 999.0, -9999.0, 9999.0)).alias("t_sentinel"))


@query("prj1_harmonics", fr.TEL + "SELECT station_id, timestamp, round(sin(2 * pi() * hour(timestamp) / 24), 6) AS sin_hour, round(cos(2 * pi() * hour(timestamp) / 24), 6) AS cos_hour FROM tel")
def prj1(spark, d):
    return features.harmonics(fr.telemetry(spark, d)).select("station_id", "timestamp", R(F.col("sin_hour")).alias("sin_hour"), R(F.col("cos_hour")).alias("cos_hour"))


@query("prj2_thermo", fr.TEL + MAGNUS + """SELECT station_id, timestamp, round(CASE WHEN t - td < 0 THEN 0 ELSE t - td END, 5) AS dew_point_dep,
  round(CASE WHEN es * (1 - rh / 100) < 0 THEN 0 ELSE es * (1 - rh / 100) END, 5) AS vpd FROM dw""")
def prj2(spark, d):
    return features.thermodynamics(_physical(spark, d)).select("station_id", "timestamp", R(F.col("dew_point_dep"), 5).alias("dew_point_dep"), R(F.col("vpd"), 5).alias("vpd"))


@query("fn1_isa_pressure", fr.TEL + "SELECT station_id, round(1013.25 * pow(1 - 0.0065 * greatest(altitude_m, 0) / 288.15, 9.80665 * 0.0289644 / (8.3144598 * 0.0065)), 6) AS p0 FROM st")
def fn1(spark, d):
    return tel.stations(spark).select("station_id", R(physics.isa_pressure(F.col("altitude_m"))).alias("p0"))


@query("fn2_fn5_vapour", fr.TEL + MAGNUS + """SELECT station_id, timestamp, round(es, 5) AS es, round(es * rh / 100, 5) AS e, round(td, 5) AS td,
  round(243.5 * (ln(least(greatest(rh, 0.001), 100) / 100) + 17.67 * t / (243.5 + t)) / (17.67 - (ln(least(greatest(rh, 0.001), 100) / 100) + 17.67 * t / (243.5 + t))), 5) AS td_clipped FROM dw WHERE rh IS NOT NULL""")
def fn2(spark, d):
    t, rh = F.col("temperature_c"), F.col("humidity_pct")
    return _physical(spark, d).where("humidity_pct is not null").select(
        "station_id", "timestamp", R(physics.saturation_vapour(t), 5).alias("es"), R(physics.actual_vapour(t, rh), 5).alias("e"),
        R(physics.dew_point(t, rh), 5).alias("td"), R(physics.dew_point_clipped(t, rh), 5).alias("td_clipped"))


@query("fn6_thermal_tide", fr.TEL + "SELECT station_id, timestamp, round(1.65 * cos(radians(latitude)) * cos(2 * pi() * (hour(timestamp) - 10) / 12), 6) AS tide FROM tel")
def fn6(spark, d):
    return fr.telemetry(spark, d).select("station_id", "timestamp", R(physics.thermal_tide(F.hour("timestamp").cast("double"), F.col("latitude"))).alias("tide"))


@query("fn7_sea_level_pressure", fr.TEL + MAGNUS + """SELECT station_id, timestamp, round(CASE WHEN z <= 0 THEN p ELSE
  p * exp(9.80665 * z / (287.05 * (t + 273.15) * (1 + 0.61 * least(greatest(0.622 * (es * rh / 100) / greatest(greatest(p, 300) - 0.378 * (es * rh / 100), 100), 0), 0.1)))) END, 4) AS pressure_msl
  FROM dw WHERE t IS NOT NULL AND rh IS NOT NULL AND p IS NOT NULL""")
def fn7(spark, d):
    rows = _physical(spark, d).dropna(subset=qc.SENSORS)
    return rows.select("station_id", "timestamp", R(physics.sea_level_pressure(F.col("pressure_hpa"), F.col("temperature_c"), F.col("humidity_pct"), F.col("altitude_m")), 4).alias("pressure_msl"))


@query("fn11_calendar", fr.TEL + "SELECT station_id, timestamp, hour(timestamp) AS h, minute(timestamp) AS mi, month(timestamp) AS mo, dayofyear(timestamp) AS doy FROM tel")
def fn11(spark, d):
    return fr.telemetry(spark, d).select("station_id", "timestamp", *[f("timestamp").cast("long").alias(n) for f, n in ((F.hour, "h"), (F.minute, "mi"), (F.month, "mo"), (F.dayofyear, "doy"))])


@query("fn16_rationale_text", fr.TEL + "SELECT station_id, timestamp, replace(lower('Temp_Reading'), '_', ' ') || ' ' || printf('%.3f', temperature_c) AS txt FROM tel WHERE temperature_c IS NOT NULL")
def fn16(spark, d):
    return fr.telemetry(spark, d).where("temperature_c is not null").select("station_id", "timestamp", F.concat(F.replace(F.lower(F.lit("Temp_Reading")), F.lit("_"), F.lit(" ")), F.format_string(" %.3f", "temperature_c")).alias("txt"))


@query("set4_splits", fr.TEL + """, u AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT timestamp FROM tel WHERE station_id <> 'ST_3'))
  SELECT split, count(*) AS n FROM (SELECT CASE WHEN t.station_id = 'ST_3' THEN 'spatial_holdout' WHEN u.i < floor(u.n * 0.7) THEN 'train' WHEN u.i < floor(u.n * 0.85) THEN 'val' ELSE 'test' END AS split
  FROM tel t LEFT JOIN u ON t.timestamp = u.timestamp) GROUP BY split""")
def set4(spark, d):
    return payloads.split_rows(fr.telemetry(spark, d), holdout=["ST_3"]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
