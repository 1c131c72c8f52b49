"""Synthetic telemetry: base signals per station, weather overlays, scheduled faults. Same seed, same data."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP_S = 600
#: station_id, latitude, altitude_m, mean temperature, daily range, mean humidity, daily range
PROFILES = [("SN_0", 19.0, 11.0, 29.5, 6.0, 78.0, 18.0), ("SN_1", 28.5, 216.0, 32.0, 12.0, 52.0, 30.0), ("SN_2", 31.1, 2205.0, 17.5, 9.0, 64.0, 26.0)]
SIGNAL = "station_id string, timestamp timestamp_ntz, idx long, temperature_c double, pressure_hpa double, humidity_pct double"


def station_ids() -> list[str]:
    return [p[0] for p in PROFILES]


def ar1(n: int, rng, tau_days: float = 3.5, sigma: float = 3.5) -> np.ndarray:
    """Stationary first-order autoregression with time constant tau."""
    phi = np.exp(-STEP_S / 86400 / tau_days)
    shock = rng.normal(0, sigma * np.sqrt(1 - phi**2), n)
    out = np.empty(n)
    x = rng.normal(0, sigma)
    for i in range(n):
        x = phi * x + shock[i]
        out[i] = x
    return out


def station_signal(profile, steps: int, seed: int, start: str = "2024-04-01") -> pd.DataFrame:
    name, lat, alt, t0, dtr, rh0, rhr = profile
    rng = np.random.default_rng([seed, zlib.crc32(name.encode())])
    time = pd.date_range(start, periods=steps, freq=f"{STEP_S}s")
    hour = (time.hour + time.minute / 60).to_numpy()
    day = time.dayofyear.to_numpy()
    wave = np.cos(2 * np.pi * (hour - 14.5) / 24) + 0.25 * np.cos(4 * np.pi * (hour - 14.5) / 24)
    wave = (wave - wave.min()) / max(np.ptp(wave), 1e-9) - 0.5
    front = ar1(steps, rng)
    t = t0 + 3 * np.cos(2 * np.pi * (day - 145) / 365) + dtr * wave * (1 - 0.2 * np.tanh(front / 5)) + 0.4 * front + rng.normal(0, 0.12, steps)
    rh = np.clip(rh0 - rhr * wave - 2.2 * 0.4 * front + rng.normal(0, 0.5, steps), 5.0, 99.8)
    p = 1013.25 * (1 - 0.0065 * alt / 288.15) ** 5.2558 + 1.65 * np.cos(np.radians(lat)) * np.cos(2 * np.pi * (hour - 10) / 12) + 0.5 * front + rng.normal(0, 0.18, steps)
    return pd.DataFrame({"station_id": name, "timestamp": time, "idx": np.arange(steps), "temperature_c": t, "pressure_hpa": p, "humidity_pct": rh})


def base_signals(spark: SparkSession, days: int, seed: int = 42) -> DataFrame:
    steps = days * 86400 // STEP_S

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return station_signal(next(p for p in PROFILES if p[0] == pdf["station_id"].iloc[0]), steps, seed)

    return spark.createDataFrame([(p[0],) for p in PROFILES], "station_id string").groupBy("station_id").applyInPandas(run, SIGNAL)


def ramp(x: np.ndarray, edge: float = 0.15) -> np.ndarray:
    """0..1 progress -> cosine-edged plateau."""
    return np.where(x < edge, 0.5 - 0.5 * np.cos(np.pi * x / edge), np.where(x > 1 - edge, 0.5 - 0.5 * np.cos(np.pi * (1 - x) / edge), 1.0))


def overlay(df: DataFrame, events: DataFrame) -> DataFrame:
    """Heatwave (ramped warmth), squall (sharp drop and pressure jump) and fog (humid plateau), by an interval join."""
    e = F.broadcast(events.select(F.col("station_id").alias("_s"), "event_type", "start_idx", "duration_steps", "strength"))
    x = (F.col("idx") - F.col("start_idx")) / F.greatest(F.col("duration_steps") - 1, F.lit(1))
    edge = lambda z: 0.5 - 0.5 * F.cos(F.pi() * z / 0.15)
    shape = F.when(F.col("event_type") == "heatwave", F.when(x < 0.15, edge(x)).when(x > 0.85, edge(1 - x)).otherwise(1.0)).when(
        F.col("event_type") == "squall", F.exp(-3 * x) * F.sin(F.pi() * F.sqrt(x))).otherwise(F.sqrt(F.sin(F.pi() * x)))
    on = df.join(e, (F.col("station_id") == F.col("_s")) & F.col("idx").between(F.col("start_idx"), F.col("start_idx") + F.col("duration_steps") - 1), "left")
    kick = F.coalesce(shape * F.col("strength"), F.lit(0.0))
    kind = F.col("event_type")
    return on.withColumns({
        "temperature_c": F.col("temperature_c") + F.when(kind == "heatwave", kick).when(kind == "squall", -kick).otherwise(0.0),
        "pressure_hpa": F.col("pressure_hpa") + F.when(kind == "squall", 0.5 * kick).otherwise(0.0),
        "humidity_pct": F.least(F.lit(99.8), F.col("humidity_pct") + F.when(kind.isin("fog", "squall"), 2 * kick).otherwise(0.0)),
    }).select(*df.columns)


KINDS = {"spike_or_drop": 1, "frozen_sensor": 18, "communication_dropout": 12, "calibration_drift": 72, "power_fluctuation_glitch": 4, "data_corruption": 1, "cross_sensor_inconsistency": 12}


def plan_faults(stations: list[str], steps: int, seed: int = 42, per_kind: int = 2) -> list[dict]:
    """Non-overlapping (station, start, length) faults with a margin, by bounded random attempts."""
    rng = np.random.default_rng(seed)
    out: list[dict] = []
    for station in stations:
        taken: list[tuple[int, int]] = []
        for kind, length in KINDS.items():
            for _ in range(per_kind):
                for _ in range(200):
                    a = int(rng.integers(12, max(13, steps - length - 12)))
                    if all(a + length + 6 <= x or y + 6 <= a for x, y in taken):
                        taken.append((a, a + length))
                        out.append({"station_id": station, "kind": kind, "start_idx": a, "length": length, "size": float(rng.uniform(0.5, 1.0)), "sign": int(rng.choice([-1, 1]))})
                        break
    return out


def inject(df: DataFrame, faults: DataFrame) -> DataFrame:
    """Applies scheduled faults by an interval join; adds anomaly_type and is_anomaly. Faults of a station don't overlap."""
    f = F.broadcast(faults.select(F.col("station_id").alias("_s"), "kind", "start_idx", "length", "size", "sign"))
    on = df.join(f, (F.col("station_id") == F.col("_s")) & F.col("idx").between(F.col("start_idx"), F.col("start_idx") + F.col("length") - 1), "left")
    first = on.where("idx = start_idx").select(F.col("station_id").alias("_fs"), F.col("start_idx").alias("_fi"), *[F.col(c).alias(f"_f{i}") for i, c in enumerate(("temperature_c", "pressure_hpa", "humidity_pct"))])
    on = on.join(F.broadcast(first), (F.col("station_id") == F.col("_fs")) & (F.col("start_idx") == F.col("_fi")), "left")
    kind, size = F.col("kind"), F.col("size") * F.col("sign")
    progress = (F.col("idx") - F.col("start_idx") + 1) / F.col("length")
    wobble = F.sin(F.col("idx") * 2.399963)

    def made(c, frozen, spike, drift, noise, sentinel, cross):
        x = F.col(c)
        return F.when(kind == "communication_dropout", None).when(kind == "frozen_sensor", F.col(frozen)).when(kind == "spike_or_drop", x + spike * size).when(
            kind == "calibration_drift", x + drift * size * progress).when(kind == "power_fluctuation_glitch", x + noise * F.col("size") * wobble).when(
            kind == "data_corruption", sentinel).when(kind == "cross_sensor_inconsistency", x + cross * F.col("size")).otherwise(x)

    return on.withColumns({
        "temperature_c": made("temperature_c", "_f0", 22.0, 6.0, 2.4, -999.0, 8.0), "pressure_hpa": made("pressure_hpa", "_f1", 55.0, 8.0, 3.6, -999.0, 0.0),
        "humidity_pct": made("humidity_pct", "_f2", 65.0, 15.0, 10.0, 160.0, 20.0),
    }).select(*df.columns, kind.alias("anomaly_type"), kind.isNotNull().alias("is_anomaly"))
