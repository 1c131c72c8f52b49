"""Sessions, lags, rolling statistics and other per-station features. All windows share one order and one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics
from .qc import SENSORS

SHORT = {"temperature_c": "T", "pressure_hpa": "P", "humidity_pct": "RH"}
DEFAULT_VOLATILITY = {"temperature_c": 5.0, "pressure_hpa": 3.5, "humidity_pct": 12.0}
STREAM_VOLATILITY = {"temperature_c": 4.0, "pressure_hpa": 3.0, "humidity_pct": 10.0}
STREAM_VARIANCE = {"temperature_c": 0.1, "pressure_hpa": 0.1, "humidity_pct": 1.0}
EPSILON = 1e-4


def per_station() -> Window:
    return Window.partitionBy("station_id").orderBy("timestamp")


def seconds_since(before: Column, now: Column) -> Column:
    """Seconds between two zoneless timestamps."""
    return F.timestamp_diff("SECOND", before, now)


def with_segments(df: DataFrame, cadence_s: int = 600) -> DataFrame:
    """Adds segment_id, per station: a new one wherever the step isn't exactly the cadence."""
    step = seconds_since(F.lag("timestamp").over(per_station()), F.col("timestamp"))
    return df.withColumn("_gap", F.when(step.isNull() | (step == cadence_s), 0).otherwise(1)).withColumn(
        "segment_id", F.sum("_gap").over(per_station().rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_gap")


def per_segment() -> Window:
    return Window.partitionBy("station_id", "segment_id").orderBy("timestamp")


def full_window(fn, col: str, rows: int, least: int | None = None, order: Window | None = None) -> Column:
    """fn over the last `rows` rows; null with fewer than `least` (all) readings."""
    frame = (order or per_segment()).rowsBetween(-(rows - 1), 0)
    return F.when(F.count(col).over(frame) >= (least or rows), fn(col).over(frame))


def rolling_features(df: DataFrame, baselines: DataFrame | None = None) -> DataFrame:
    """Deltas, 6- and 36-row variances and volatility ratios inside segments. baselines: station_id, base_T, base_P, base_RH."""
    if baselines is not None:
        df = df.join(F.broadcast(baselines), "station_id", "left")
    out = {}
    for c, s in SHORT.items():
        out[f"delta_{s}"] = F.col(c) - F.lag(c).over(per_segment())
        out[f"var_{s}_1h"] = full_window(F.var_samp, c, 6)
        out[f"var_{s}_6h"] = full_window(F.var_samp, c, 36)
        base = F.lit(DEFAULT_VOLATILITY[c]) if baselines is None else F.coalesce(f"base_{s}", F.lit(DEFAULT_VOLATILITY[c]))
        out[f"vol_ratio_{s}"] = full_window(F.stddev_samp, c, 6) / (base + EPSILON)
    df = df.withColumns(out)
    return df if baselines is None else df.drop("base_T", "base_P", "base_RH")


def stream_rolling(df: DataFrame) -> DataFrame:
    """The streaming variant: population variances over partial, gap-blind windows."""
    out = {}
    for c, s in SHORT.items():
        six, all_ = per_station().rowsBetween(-5, 0), per_station().rowsBetween(-36, 0)
        one = F.when(F.count(c).over(six) >= 6, F.var_pop(c).over(six)).otherwise(STREAM_VARIANCE[c])
        out[f"var_{s}_1h"] = one
        out[f"var_{s}_6h"] = F.when(F.count(c).over(all_) >= 12, F.var_pop(c).over(all_)).otherwise(2 * one)
        out[f"vol_ratio_{s}"] = F.sqrt(one) / (STREAM_VOLATILITY[c] + EPSILON)
    return df.withColumns(out)


def harmonics(df: DataFrame, whole_hours: bool = False) -> DataFrame:
    h = F.hour("timestamp") if whole_hours else F.hour("timestamp") + F.minute("timestamp") / 60.0
    angle = 2 * F.pi() * h / 24.0
    return df.withColumns({"sin_hour": F.sin(angle), "cos_hour": F.cos(angle)})


def thermodynamics(df: DataFrame) -> DataFrame:
    t, rh = F.col("temperature_c"), F.col("humidity_pct")
    return df.withColumns({"dew_point_dep": physics.dew_depression(t, rh), "vpd": physics.vapour_deficit(t, rh)})


def near_exclusion(df: DataFrame, excluded: Column, seconds: int = 3600) -> DataFrame:
    """Adds near_excluded_gap: the nearest excluded row of the station, before or after, is at most `seconds` away.

    Two as-of windows instead of a range join, so rows don't multiply.
    """
    order = per_station()
    at = F.when(excluded, F.col("timestamp"))
    before = F.last(at, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    close = (seconds_since(before, F.col("timestamp")) <= seconds) | (seconds_since(F.col("timestamp"), after) <= seconds)
    return df.withColumn("near_excluded_gap", F.coalesce(seconds_since(before, F.col("timestamp")) <= seconds, F.lit(False)) | F.coalesce(close, F.lit(False)))


def episodes(df: DataFrame, kind: Column, cadence_s: int) -> DataFrame:
    """Episodes and stations of each type: a new episode wherever the step within (station, type) isn't the cadence."""
    order = Window.partitionBy("station_id", "_kind").orderBy("timestamp")
    step = seconds_since(F.lag("timestamp").over(order), F.col("timestamp"))
    rows = df.withColumn("_kind", kind).where("_kind is not null").withColumn("_new", F.when(step.isNull() | (step != cadence_s), 1).otherwise(0))
    return rows.groupBy(F.col("_kind").alias("anomaly_type")).agg(F.sum("_new").alias("n_episodes"), F.countDistinct("station_id").alias("n_stations"))


def training_windows(df: DataFrame, size: int = 72, stride: int = 2) -> DataFrame:
    """(station_id, segment_id, start) of windows inside one segment whose rows are all normal."""
    ahead = per_segment().rowsBetween(0, size - 1)
    rows = df.withColumns({
        "_n": F.count(F.lit(1)).over(ahead), "_bad": F.max(F.col("is_anomaly").cast("int")).over(ahead), "_i": F.row_number().over(per_segment()),
    })
    return rows.where((F.col("_n") == size) & (F.col("_bad") == 0) & ((F.col("_i") - 1) % stride == 0)).select("station_id", "segment_id", F.col("timestamp").alias("start"))


def interpolate(df: DataFrame, col: str, out: str) -> DataFrame:
    """Fills nulls linearly by row position, ends with the nearest value."""
    order = per_station()
    i = F.row_number().over(order)
    df = df.withColumn("_i", i)
    past, future = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(col).isNotNull(), F.col("_i"))
    df = df.withColumns({
        "_pv": F.last(col, ignorenulls=True).over(past), "_nv": F.first(col, ignorenulls=True).over(future),
        "_pi": F.last(at, ignorenulls=True).over(past), "_ni": F.first(at, ignorenulls=True).over(future),
    })
    blend = F.col("_pv") + (F.col("_nv") - F.col("_pv")) * (F.col("_i") - F.col("_pi")) / (F.col("_ni") - F.col("_pi"))
    return df.withColumn(out, F.when(F.col(col).isNotNull(), F.col(col)).when(F.col("_pi").isNull(), F.col("_nv")).when(F.col("_ni").isNull(), F.col("_pv")).otherwise(blend)).drop(
        "_i", "_pv", "_nv", "_pi", "_ni"
    )


def centred_average(col: str, period: int) -> Column:
    """The 2 x period moving average of an even period; null where the frame isn't full."""
    order, half = per_station(), period // 2
    inner = F.sum(col).over(order.rowsBetween(-(half - 1), half - 1))
    ends = (F.lag(col, half).over(order) + F.lead(col, half).over(order)) / 2
    return (inner + ends) / period
