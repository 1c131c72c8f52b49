"""Order-dependent state: the sensor health index, its projection, and online covariance baselines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fusion import SECOND_TRACK
from .qc import SENSORS, flag


def batch_penalty() -> Column:
    """Additive, at most 100."""
    part = lambda test, x: F.when(flag(test), x).otherwise(0.0)
    total = part(F.col("tier1_flagged"), 40.0) + part(F.col("hard_rule_flagged"), 25.0) + part(F.col("mahalanobis_flagged") & ~F.col("hard_rule_suppressed"), 15.0)
    total = total + part(F.col("fusion_flagged") & F.col("fusion_predicted_type").isin(SECOND_TRACK), 10.0)
    return F.least(F.lit(100.0), total)


def health_step(state: float, penalty: float, decay: float = 0.05, recovery: float = 0.01) -> float:
    return (1 - decay) * state + decay * max(0.0, 100.0 - penalty) if penalty > 0 else (1 - recovery) * state + recovery * 100.0


def health_index(df: DataFrame, penalty: str, decay: float = 0.05, recovery: float = 0.01) -> DataFrame:
    """Adds sensor_health_index, an exponential average whose rate depends on the penalty; 100 before the first row.

    Rows are sorted once by station and time and pass through in batches that carry only the last state.
    """
    names = df.columns

    def run(batches):
        station, state = None, 100.0
        for b in batches:
            out = np.empty(len(b))
            for i, (s, p) in enumerate(zip(b["station_id"], b[penalty].fillna(0.0))):
                if s != station:
                    station, state = s, 100.0
                state = health_step(state, p, decay, recovery)
                out[i] = state
            yield b[names].assign(sensor_health_index=out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.repartition("station_id").sortWithinPartitions("station_id", "timestamp").mapInPandas(run, f"{fields}, sensor_health_index double")


def project_health(df: DataFrame, cadence_s: int = 600, threshold: float = 70.0, window_hours: float = 48.0) -> DataFrame:
    """Trend of the last window_hours per station, and the hours until the threshold."""
    steps = int(window_hours * 3600 / cadence_s)
    back = Window.partitionBy("station_id").orderBy(F.col("timestamp").desc())
    recent = df.withColumn("_i", F.row_number().over(back)).where(F.col("_i") <= steps)
    x = -F.col("_i") * (cadence_s / 3600.0)
    fit = recent.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("_n"), F.regr_slope("sensor_health_index", x).alias("_s"), F.max_by("sensor_health_index", "timestamp").alias("_c")
    ).where("_n >= 12")
    s, c = F.col("_s"), F.col("_c")
    left = F.when((s < -0.01) & (c > threshold), (c - threshold) / F.abs(s)).when(s < -0.01, 0.0)
    status = F.when((s < -0.01) & (c > threshold), "degrading").when(s < -0.01, "below_threshold").when(s > 0.01, "recovering").otherwise("stable")
    return fit.select("station_id", F.round(c, 2).alias("current_shi"), F.round(s, 4).alias("slope_pts_per_hr"), status.alias("status"), F.round(left, 1).alias("hours_to_threshold"))


class OnlineCovariance:
    """Exponentially weighted mean and covariance; a reading is judged by the state before it."""

    def __init__(self, mu, cov, alpha: float = 0.0235, slow: float = 0.1, bound: float = 6.5, freeze: bool = False):
        self.mu, self.cov, self.alpha, self.slow, self.bound, self.freeze, self.run = np.array(mu, float), np.array(cov, float).reshape(3, 3), alpha, slow, bound, freeze, 0

    def update(self, x) -> float:
        x = np.asarray(x, float)
        d = x - self.mu
        dm = float(np.sqrt(max(0.0, d @ np.linalg.pinv(self.cov) @ d)))
        high = dm > self.bound
        self.run = self.run + 1 if high else 0
        if not (self.freeze and self.run >= 3):
            w = self.alpha * (self.slow if high else 1.0)
            self.mu = (1 - w) * self.mu + w * x
            v = x - self.mu
            self.cov = (1 - w) * self.cov + w * np.outer(v, v) + 1e-4 * np.eye(3)
        return dm


def rolling_distance(df: DataFrame, prior_mu=(20.0, 1000.0, 50.0), prior_cov=tuple(np.eye(3).ravel()), freeze: bool = False) -> DataFrame:
    """Adds mahalanobis_dist_rolling per (station, hour of day); rows with a null reading have 0 and don't update."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state = OnlineCovariance(prior_mu, prior_cov, freeze=freeze)
        pdf = pdf.sort_values("timestamp")
        x = pdf[SENSORS].to_numpy(float)
        out = [0.0 if np.isnan(r).any() else state.update(r) for r in x]
        return pdf.assign(mahalanobis_dist_rolling=out).drop(columns="_hour")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.withColumn("_hour", F.hour("timestamp")).groupBy("station_id", "_hour").applyInPandas(run, f"{fields}, mahalanobis_dist_rolling double")
