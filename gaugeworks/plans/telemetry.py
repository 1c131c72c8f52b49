"""The telemetry view over `events`: 4 stations, hourly, every slot present; and the same view as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN = "2024-01-01 00:00:00"
CADENCE_S = 3600
SENSORS = ["temperature_c", "pressure_hpa", "humidity_pct"]
#: station_id, latitude, longitude, altitude_m, climate_zone, tide_lat
STATIONS = [
    ("ST_0", 19.25, 72.5, 12.0, "coastal"),
    ("ST_1", 28.5, 77.25, 216.0, "plains"),
    ("ST_2", 31.0, 77.0, 2205.0, "hills"),
    ("ST_3", 13.0, 80.25, 0.0, "coastal"),
]


def stations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATIONS, "station_id string, latitude double, longitude double, altitude_m double, climate_zone string")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per station and hour; slots without events are null on all sensors."""
    hour = F.floor(F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'{ORIGIN}', cast(ts as timestamp_ntz))") / 3600).cast("long")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("ST_"), (F.col("user_id") % 4).cast("string")).alias("station_id"), hour.alias("slot"), "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"),
    )
    cells = events.groupBy("station_id", "slot").agg(
        F.sum(F.round(100 * F.col("value")).cast("long")).alias("v"), F.max("value").alias("m"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("n")
    )
    # The spine is as long as the events' time range, whatever the number of events.
    spine = events.agg(F.min("slot").alias("a"), F.max("slot").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("slot"))
    rows = spine.crossJoin(F.broadcast(stations(spark))).join(cells, ["station_id", "slot"], "left")
    return rows.select(
        "station_id", "slot", F.expr(f"timestampadd(HOUR, int(slot), TIMESTAMP_NTZ'{ORIGIN}')").alias("timestamp"), "latitude", "longitude", "altitude_m", "climate_zone",
        F.when(F.col("n").isNull(), None).when(F.col("slot") % 97 == 11, -999.0).otherwise(15 + 0.002970137713 * F.col("v") / F.col("n")).alias("temperature_c"),
        F.when(F.col("slot") % 83 == 7, None).otherwise(1000 + 0.200037119 * (F.col("m") - 50)).alias("pressure_hpa"),
        F.when(F.col("n").isNull(), None).when(F.col("slot") % 89 == 5, 160.0).otherwise(20 + 0.600012347 * F.col("k") / F.col("n")).alias("humidity_pct"),
        F.when(F.col("n").isNull(), "communication_dropout").when((F.col("slot") % 97 == 11) | (F.col("slot") % 89 == 5), "data_corruption")
        .when(F.col("slot") % 61 == 3, "spike_or_drop").when((F.col("slot") % 53).isin(10, 11, 12), "frozen_sensor")
        .when((F.col("slot") % 120).between(60, 80), "calibration_drift").alias("anomaly_type"),
    ).withColumn("is_anomaly", F.col("anomaly_type").isNotNull())


#: DuckDB: `WITH ... tel AS (...)`; append further CTEs with a comma.
SQL = """
WITH st(station_id, latitude, longitude, altitude_m, climate_zone) AS (VALUES
  ('ST_0', 19.25::DOUBLE, 72.5::DOUBLE, 12.0::DOUBLE, 'coastal'), ('ST_1', 28.5::DOUBLE, 77.25::DOUBLE, 216.0::DOUBLE, 'plains'),
  ('ST_2', 31.0::DOUBLE, 77.0::DOUBLE, 2205.0::DOUBLE, 'hills'), ('ST_3', 13.0::DOUBLE, 80.25::DOUBLE, 0.0::DOUBLE, 'coastal')),
ev AS (SELECT 'ST_' || CAST(user_id % 4 AS VARCHAR) AS station_id, date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', date_trunc('hour', ts)) AS slot,
              value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
cell AS (SELECT station_id, slot, sum(CAST(round(100 * value) AS BIGINT)) AS v, max(value) AS m, sum(k) AS k, count(*) AS n FROM ev GROUP BY station_id, slot),
spine AS (SELECT unnest(generate_series(min(slot), max(slot))) AS slot FROM ev),
tel AS (SELECT s.*, (anomaly_type IS NOT NULL) AS is_anomaly FROM (
  SELECT st.station_id, spine.slot, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(spine.slot AS INTEGER)) AS timestamp, latitude, longitude, altitude_m, climate_zone,
    CASE WHEN n IS NULL THEN NULL WHEN spine.slot % 97 = 11 THEN -999.0::DOUBLE ELSE 15 + 0.002970137713::DOUBLE * v / n END AS temperature_c,
    CASE WHEN spine.slot % 83 = 7 THEN NULL ELSE 1000 + 0.200037119::DOUBLE * (m - 50) END AS pressure_hpa,
    CASE WHEN n IS NULL THEN NULL WHEN spine.slot % 89 = 5 THEN 160.0::DOUBLE ELSE 20 + 0.600012347::DOUBLE * cell.k / n END AS humidity_pct,
    CASE WHEN n IS NULL THEN 'communication_dropout' WHEN spine.slot % 97 = 11 OR spine.slot % 89 = 5 THEN 'data_corruption'
         WHEN spine.slot % 61 = 3 THEN 'spike_or_drop' WHEN spine.slot % 53 IN (10, 11, 12) THEN 'frozen_sensor'
         WHEN spine.slot % 120 BETWEEN 60 AND 80 THEN 'calibration_drift' END AS anomaly_type
  FROM spine CROSS JOIN st LEFT JOIN cell ON cell.station_id = st.station_id AND cell.slot = spine.slot) s)
"""
