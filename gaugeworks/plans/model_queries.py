"""Learned operators and streaming replays; they have no SQL oracle and are tested against independent code."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import features, ml, stats, synth
from ..streaming import pipeline as streaming
from . import fragments as fr
from . import telemetry as tel
from .registry import query

K = ["station_id", "timestamp"]
CHANNELS = ["temperature_c", "pressure_hpa", "humidity_pct"]
CLASSIFIER = ["if_score", "gru_score", "mahalanobis_dist", "t1", "buddy", "isolated"]
CLASS_WEIGHTS = {"normal": 1.0, "calibration_drift": 3.0, "frozen_sensor": 5.0, "spike_or_drop": 15.0}


def _normal(spark, d):
    return fr.kept(spark, d).where(~F.col("is_anomaly"))


def _forest_scores(spark, d):
    x = ml.bounded_sample(_normal(spark, d), CHANNELS, K, 2000).to_numpy(float)
    forest = ml.IsolationForest(x, trees=150)
    return ml.add_scores(fr.kept(spark, d), CHANNELS, forest.score, "if_score").select(*K, F.round("if_score", 6).alias("if_score"))


@query("ml1_isolation_forest")
def ml1(spark, d):
    return _forest_scores(spark, d)


def _training_windows(scaled, cols, size, most):
    """(windows, size, channels): at most `most` windows of normal rows, each inside one segment, chosen by hash of (station, segment, start).

    Without any such window a single one of zeros, so that every step's prediction is the mean.
    """
    by = ["station_id", "segment_id"]
    starts = features.training_windows(scaled, size)
    chosen = starts.withColumn("_h", F.xxhash64(*by, "start")).orderBy("_h", *by, "start").limit(most).drop("_h")
    rows = scaled.select(*by, "timestamp", *cols).join(F.broadcast(chosen), by).where((F.col("timestamp") >= F.col("start")) & (F.col("timestamp") < F.col("start") + F.make_dt_interval(secs=F.lit(size * tel.CADENCE_S))))
    z = rows.toPandas().sort_values([*by, "start", "timestamp"])[cols].to_numpy(float)
    return z.reshape(-1, size, len(cols)) if len(z) else np.zeros((1, size, len(cols)))


def _autoencoder(spark, d, size=24, most=1000):
    fitted = {r["feature"]: r for r in stats.scaler(_normal(spark, d), CHANNELS).collect()}
    scaled = fr.kept(spark, d).withColumns({f"z{i}": (F.col(c) - float(fitted[c]["mean"] or 0)) / float(fitted[c]["std"] or 1) for i, c in enumerate(CHANNELS)})
    cols = [f"z{i}" for i in range(3)]
    return scaled, ml.RecurrentAutoencoder(3).fit(_training_windows(scaled, cols, size, most)), cols


def _recurrent_scores(spark, d):
    scaled, model, cols = _autoencoder(spark, d)
    return ml.window_scores(scaled.select(*K, "segment_id", *cols), model, cols, 24, "gru_score").select(*K, F.round("gru_score", 6).alias("gru_score"))


@query("ml2_recurrent_scores")
def ml2(spark, d):
    return _recurrent_scores(spark, d)


def _classified(spark, d):
    scores = _forest_scores(spark, d).join(_recurrent_scores(spark, d), K, "full_outer")
    typed = fr.tier4(spark, d, scores).where("tier_coverage = 'full'").withColumns({
        "t1": F.col("tier1_flagged").cast("double"), "buddy": F.col("buddy_flagged").cast("double"), "isolated": F.col("isolated_deviation").cast("double"),
        "truth": F.coalesce("anomaly_type", F.lit("normal")),
    }).fillna(0.0, subset=CLASSIFIER)
    rows = ml.bounded_sample(typed, [*CLASSIFIER, "truth"], K, 3000)
    return typed, ml.MetaClassifier(rows[CLASSIFIER].to_numpy(float), rows["truth"].tolist(), CLASS_WEIGHTS), rows[CLASSIFIER].to_numpy(float).mean(0)


@query("ml4_meta_classifier")
def ml4(spark, d):
    typed, model, _ = _classified(spark, d)

    def run(batches):
        for b in batches:
            p = model.probabilities(b[CLASSIFIER].to_numpy(float))
            yield b[K].assign(predicted=[model.classes[i] for i in p.argmax(1)], confidence=p.max(1).round(6))

    return typed.select(*K, *CLASSIFIER).mapInPandas(run, "station_id string, timestamp timestamp_ntz, predicted string, confidence double")


@query("ml7_shapley_rationale")
def ml7(spark, d):
    typed, model, base = _classified(spark, d)

    def run(batches):
        for b in batches:
            x = b[CLASSIFIER].to_numpy(float)
            best = model.margin(x).argmax(1)
            phi = np.zeros(x.shape)
            for k in np.unique(best):
                own = best == k
                phi[own] = ml.shapley(lambda z, k=k: model.margin(z)[:, k], x[own], base)
            top = phi.argmax(1)
            yield b[K].assign(predicted=[model.classes[i] for i in best], top_feature=[CLASSIFIER[i] for i in top], top_value=phi[np.arange(len(x)), top].round(6))

    found = typed.select(*K, *CLASSIFIER).mapInPandas(run, "station_id string, timestamp timestamp_ntz, predicted string, top_feature string, top_value double")
    return ml.rationale(found)


@query("str1_stream_replay")
def str1(spark, d):
    return streaming.replay(fr.telemetry(spark, d).select(*K, *CHANNELS)).select(*K, "flag_reason", "coverage", F.round("sensor_health_index", 6).alias("shi"))


@query("gen1_base_signal")
def gen1(spark, d):
    return synth.base_signals(spark, days=3, seed=42).select(*K, *[F.round(c, 4).alias(c) for c in CHANNELS])


@query("gen5_faults")
def gen5(spark, d):
    faults = synth.plan_faults(synth.station_ids(), steps=3 * 144, seed=42)
    return synth.inject(synth.base_signals(spark, days=3, seed=42), spark.createDataFrame(pd.DataFrame(faults))).select(*K, *[F.round(c, 4).alias(c) for c in CHANNELS], "anomaly_type")
