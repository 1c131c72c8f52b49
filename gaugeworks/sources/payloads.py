"""Readers and writers: declared schemas, payload documents, splits, sinks."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TELEMETRY = (
    "station_id string, timestamp timestamp_ntz, latitude double, longitude double, temperature_c double, pressure_hpa double, humidity_pct double, "
    "is_anomaly boolean, anomaly_type string, anomaly_severity double"
)
#: Hourly payloads name their series so.
HOURLY = {"temperature_2m": "temperature_c", "relative_humidity_2m": "humidity_pct", "surface_pressure": "pressure_hpa"}
#: And daily ones so.
DAILY = {
    **{f"temperature_2m_{k}": f"temperature_2m_{k}" for k in ("mean", "max", "min")}, **{f"relative_humidity_2m_{k}": f"relative_humidity_2m_{k}" for k in ("mean", "max", "min")},
    "surface_pressure_mean": "surface_pressure_mean", "pressure_msl_mean": "pressure_msl_mean",
}


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or CSV with a header, by suffix; NaN readings become null."""
    reader = spark.read.schema(TELEMETRY)
    df = reader.option("header", True).csv(path) if path.rstrip("/").endswith(".csv") else reader.parquet(path)
    return df.withColumns({c: F.nanvl(c, F.lit(None)) for c in HOURLY.values()})


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """(station_id, body) of JSON files, one payload a file; the station is the file's name."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("station_id"), F.col("value").alias("body"))


def from_payload(docs: DataFrame, section: str = "hourly", names: dict[str, str] = HOURLY) -> DataFrame:
    """Columnar JSON (section "daily" with DAILY for daily payloads) to rows; values that aren't numbers become null."""
    series = ", ".join(f"{c}: array<string>" for c in ["time", *names])
    body = F.from_json("body", f"struct<{section}: struct<{series}>>")[section]
    rows = docs.select("station_id", F.explode(F.arrays_zip(*[body[c].alias(c) for c in ["time", *names]])).alias("x"))
    return rows.select("station_id", F.col("x.time").cast("timestamp_ntz").alias("timestamp"), *[F.col(f"x.{c}").try_cast("double").alias(n) for c, n in names.items()])


def daily_telemetry(days: DataFrame) -> DataFrame:
    """Daily rows with the telemetry's column names beside the providers'."""
    return days.withColumns({"temperature_c": F.col("temperature_2m_mean"), "humidity_pct": F.col("relative_humidity_2m_mean"), "pressure_hpa": F.col("surface_pressure_mean")})


def to_payload(df: DataFrame, section: str = "hourly") -> DataFrame:
    """One payload a station and day, in the providers' layout."""
    row = F.struct(F.col("timestamp").alias("time"), *[F.col(n).alias(c) for c, n in HOURLY.items()])
    days = df.groupBy("station_id", F.to_date("timestamp").alias("day")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    text = lambda c: F.transform("r", lambda x: F.coalesce(x[c].cast("string"), F.lit("n/a")))
    return days.select("station_id", F.to_json(F.struct(F.struct(*[text(c).alias(c) for c in ["time", *HOURLY]]).alias(section))).alias("body"))


def read_climatology(spark: SparkSession, path: str) -> DataFrame:
    """(key, month, ...) of a nested JSON document {key: {month: {...}}}; empty with a missing file."""
    fields = ["temp_mean", "temp_std", "temp_min", "temp_max", "rh_mean", "rh_std", "rh_min", "rh_max"]
    schema = "key string, month int, " + ", ".join(f"{f} double" for f in fields)
    if "://" not in path and not Path(path).exists():
        return spark.createDataFrame([], schema)
    body = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, map<string, struct<{', '.join(f'{f}: double' for f in fields)}>>>").alias("m"))
    keys = body.select(F.explode("m").alias("key", "months")).where(~F.col("key").startswith("_"))
    return keys.select("key", F.explode("months").alias("month", "e")).select("key", F.col("month").cast("int").alias("month"), "e.*")


def time_index(spark: SparkSession, start: str, days: int, step_minutes: int = 10) -> DataFrame:
    first = f"TIMESTAMP_NTZ'{start}'"
    return spark.sql(f"SELECT explode(sequence({first}, {first} + INTERVAL {days * 1440 - step_minutes} MINUTES, INTERVAL {step_minutes} MINUTES)) AS timestamp")


def split_rows(df: DataFrame, holdout: list[str], train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Adds split: held-out stations, and the others by cutoffs among their distinct timestamps (found by rank, not collected)."""
    held = F.col("station_id").isin(holdout)
    times = df.where(~held).select("timestamp").distinct()
    n = times.agg(F.count(F.lit(1)).alias("n"))
    cuts = [F.expr(f"int(floor(n * {x!r}))") for x in (train, train + val)]
    order = Window.orderBy("timestamp")
    # The distinct timestamps are one row a step, however many stations there are.
    ranked = times.withColumn("_i", F.row_number().over(order) - 1).crossJoin(F.broadcast(n))
    named = ranked.select("timestamp", F.when(F.col("_i") < cuts[0], "train").when(F.col("_i") < cuts[1], "val").otherwise("test").alias("_split"))
    return df.join(named, "timestamp", "left").withColumn("split", F.when(held, "spatial_holdout").otherwise(F.col("_split"))).drop("_split")


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_stations(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("station_id").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_summary(df: DataFrame, path: str) -> dict:
    """Counts by type and the time range, as a JSON file on the driver."""
    facts = df.agg(F.count(F.lit(1)).alias("rows"), F.min("timestamp").cast("string").alias("start"), F.max("timestamp").cast("string").alias("end")).first().asDict()
    facts["anomalies"] = {r["anomaly_type"]: r["count"] for r in df.where("anomaly_type is not null").groupBy("anomaly_type").count().collect()}
    Path(path).write_text(json.dumps(facts, indent=2, sort_keys=True))
    return facts
