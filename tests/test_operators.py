"""Operators without SQL, against independent code; sources, streaming and properties."""

import json
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import features, fusion, health, ml, qc, spatial, synth
from gaugeworks.plans import analysis_queries, telemetry
from gaugeworks.sources import config, payloads
from gaugeworks.streaming import pipeline

SF = "/root/testdata/sf0.001"


def readings(spark, rows):
    return spark.createDataFrame([("S", datetime(2024, 1, 1) + timedelta(hours=i), *r) for i, r in enumerate(rows)], "station_id string, timestamp timestamp_ntz, temperature_c double, pressure_hpa double, humidity_pct double")


def test_rule_qc_boundaries(spark):
    nan = float("nan")
    rows = [(60.0, 1100.0, 100.0), (-30.0, 500.0, 0.0), (60.1, 1000.0, 50.0), (None, None, None), (1.0, None, 5.0), (-999.0, 1000.0, 50.0), (20.0, 1000.0, 160.0), (nan, nan, nan)]
    df = qc.nan_to_null(readings(spark, rows))
    got = [r["flag_reason"] for r in qc.rule_qc(df).orderBy("timestamp").collect()]
    assert got == [None, None, "range_violation", "communication_dropout", "partial_nan_anomaly", "sentinel_value", "sentinel_value", "communication_dropout"]
    assert [r["flag_reason"] for r in qc.rule_qc(df, priority="range_first").orderBy("timestamp").collect()][5:7] == ["range_violation"] * 2
    again = qc.rule_qc(qc.rule_qc(df)).select("flag_reason", "is_flagged")
    assert again.exceptAll(qc.rule_qc(df).select("flag_reason", "is_flagged")).count() == 0
    with pytest.raises(ValueError):
        qc.rule_qc(df, priority="other")
    with pytest.raises(ValueError):
        qc.rule_qc(df.drop("humidity_pct"))


def test_gate_treats_unknown_isolation_as_neither(spark):
    rows = [(False, True, False, False, False, x, "full") for x in (True, False, None)]
    df = spark.createDataFrame(rows, "tier1_flagged boolean, if_flagged boolean, gru_flagged boolean, mahalanobis_flagged boolean, buddy_flagged boolean, isolated_deviation boolean, tier_coverage string")
    got = {r["isolated_deviation"]: (r["hard_rule_flagged"], r["hard_rule_suppressed"]) for r in fusion.gated_rule(df).collect()}
    assert got == {True: (True, False), False: (False, True), None: (False, False)}


def test_rolling_variance_matches_pandas(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=50)
    df = features.with_segments(readings(spark, [(float(v), 1000.0, 50.0) for v in x]), 3600)
    got = [r["var_T_1h"] for r in features.rolling_features(df).orderBy("timestamp").collect()]
    want = pd.Series(x).rolling(6, min_periods=6).var()
    assert all((a is None) == np.isnan(b) and (a is None or abs(a - b) < 1e-9) for a, b in zip(got, want))


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_health_is_a_plain_recurrence(spark, parts):
    rng = np.random.default_rng(1)
    p = rng.choice([0.0, 10.0, 40.0, 100.0], 80)
    rows = [(s, datetime(2024, 1, 1) + timedelta(hours=i), float(v)) for s in "ab" for i, v in enumerate(p)]
    df = spark.createDataFrame(rows, "station_id string, timestamp timestamp_ntz, penalty double").repartition(parts)
    got = health.health_index(df, "penalty").where("station_id = 'a'").orderBy("timestamp").toPandas()["sensor_health_index"]
    state, want = 100.0, []
    for v in p:
        state = 0.95 * state + 0.05 * (100 - v) if v > 0 else 0.99 * state + 1.0
        want.append(state)
    assert np.allclose(got, want, atol=0) and got.between(0, 100).all()


def test_online_covariance_matches_a_loop():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)) + [20, 1000, 50]
    state = health.OnlineCovariance([20, 1000, 50], np.eye(3), freeze=True)
    mu, cov, run = np.array([20.0, 1000, 50]), np.eye(3), 0
    for r in x:
        d = np.sqrt((r - mu) @ np.linalg.inv(cov) @ (r - mu))
        run = run + 1 if d > 6.5 else 0
        if run < 3:
            w = 0.0235 * (0.1 if d > 6.5 else 1)
            mu = (1 - w) * mu + w * r
            cov = (1 - w) * cov + w * np.outer(r - mu, r - mu) + 1e-4 * np.eye(3)
        assert abs(state.update(r) - d) < 1e-8


def test_isolation_forest_separates():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    forest = ml.IsolationForest(x, trees=60)
    assert forest.score(np.full((5, 3), 7.0)).min() > np.quantile(forest.score(x), 0.99)
    assert (forest.score(x) == ml.IsolationForest(x, trees=60).score(x)).all()


def test_isolation_forest_parts_neighbouring_floats():
    x = np.where(np.arange(40) % 2, np.nextafter(20.6, 21), 20.6)[:, None] * [[1.0, 0.0]]
    forest = ml.IsolationForest(x, trees=40)
    assert all(f.tolist() == [0, -1, -1] and len(set(cut)) == 2 and (path[1:] > 1).all() for f, cut, _, _, path in forest.trees)
    assert np.isfinite(forest.score(x)).all()


def test_recurrent_errors_rise_on_a_spike():
    t = np.arange(600)
    z = np.stack([np.sin(t / 9), np.cos(t / 9), np.sin(t / 5)], 1)
    windows = np.stack([z[i : i + 24] for i in range(0, 560, 2)])
    model = ml.RecurrentAutoencoder(3).fit(windows)
    odd = windows[:1].copy()
    odd[0, 12] += 4
    assert model.errors(odd)[0, 12] > 5 * model.errors(windows).mean()
    assert np.allclose(ml.scatter_mean(np.ones((5, 3)), 7), 1)


def test_shapley_sums_to_the_margin():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 4))
    labels = np.where(x[:, 0] + x[:, 1] * x[:, 2] > 0, "a", "b").tolist()
    model = ml.MetaClassifier(x, labels, {"b": 3.0})
    f = lambda z: model.margin(z)[:, 0]
    phi = ml.shapley(f, x, x.mean(0))
    assert np.allclose(phi.sum(1), f(x) - f(x.mean(0)[None])[0])
    assert np.mean([model.classes[i] == v for i, v in zip(model.probabilities(x).argmax(1), labels)]) > 0.8


def test_partial_autocorrelation_of_ar1():
    acf = 0.6 ** np.arange(6)
    assert np.allclose(analysis_queries.partial_autocorrelation(acf), [1, 0.6, 0, 0, 0, 0])


def test_near_exclusion_is_the_range_join(spark):
    t = telemetry.telemetry(spark, SF)
    a = features.near_exclusion(t, qc.exclusion()).where("near_excluded_gap").select("station_id", "timestamp")
    ex = t.where(qc.exclusion()).select("station_id", F.col("timestamp").alias("x"))
    b = t.join(ex, "station_id").where(F.abs(F.timestamp_diff("SECOND", F.col("x"), F.col("timestamp"))) <= 3600).select("station_id", "timestamp").distinct()
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_synthesis_is_deterministic_and_labelled(spark):
    a, b = (synth.base_signals(spark, days=1, seed=5).orderBy("station_id", "timestamp").toPandas() for _ in range(2))
    pd.testing.assert_frame_equal(a, b)
    assert a["humidity_pct"].between(5, 99.8).all() and a["pressure_hpa"].between(550, 1060).all()
    faults = synth.plan_faults(synth.station_ids(), 432)
    spans = sorted((f["station_id"], f["start_idx"], f["start_idx"] + f["length"]) for f in faults)
    assert all(x[0] != y[0] or x[2] <= y[1] for x, y in zip(spans, spans[1:]))
    out = synth.inject(synth.base_signals(spark, days=3, seed=5), spark.createDataFrame(pd.DataFrame(faults))).toPandas()
    assert out[out.anomaly_type == "communication_dropout"][qc.SENSORS].isna().all().all()
    frozen = out[out.anomaly_type == "frozen_sensor"].groupby("station_id")["temperature_c"].nunique()
    assert (frozen <= 2).all() and set(out["anomaly_type"].dropna()) <= set(synth.KINDS)
    events = spark.createDataFrame([("SN_0", "heatwave", 10, 40, 8.0), ("SN_1", "squall", 5, 12, 10.0), ("SN_2", "fog", 5, 12, 10.0)], "station_id string, event_type string, start_idx long, duration_steps long, strength double")
    base = synth.base_signals(spark, days=1, seed=5)
    lifted = synth.overlay(base, events).join(base.select("station_id", "idx", F.col("temperature_c").alias("t0")), ["station_id", "idx"])
    assert abs(lifted.where("station_id = 'SN_0' and idx = 30").selectExpr("temperature_c - t0").first()[0] - 8.0) < 1e-9 and lifted.count() == base.count()


def test_stream_equals_replay(spark, tmp_path):
    rows = telemetry.telemetry(spark, SF).where("slot < 72").select("station_id", "timestamp", *qc.SENSORS)
    for k in range(3):
        rows.where(f"hour(timestamp) >= {8 * k} and hour(timestamp) < {8 * k + 8}").where("timestamp < timestamp_ntz'2024-01-02 00:00:00'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = pipeline.stateful(stream).writeStream.format("memory").queryName("streamed").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("streamed").orderBy("station_id", "timestamp").toPandas()
    want = pipeline.replay(spark.read.parquet(f"{tmp_path}/in")).orderBy("station_id", "timestamp").toPandas()
    assert len(got) == len(want) > 0
    on_time = got["coverage"] != "late"
    assert on_time.all()
    pd.testing.assert_frame_equal(got, want)


def test_stream_rules_match_the_column_form(spark):
    rows = telemetry.telemetry(spark, SF).select("station_id", "timestamp", *qc.SENSORS)
    a = qc.stream_qc(rows).select("station_id", "timestamp", "flag_reason").orderBy("station_id", "timestamp").collect()
    b = pipeline.replay(rows).orderBy("station_id", "timestamp").collect()
    assert [r["flag_reason"] for r in a] == [r["flag_reason"] for r in b]


def test_late_rows_leave_the_state_alone():
    state = pipeline.fresh()
    pipeline.process(state, "2024-01-01T01:00:00", [20.0, 1000.0, 50.0])
    before = json.dumps(state)
    assert pipeline.process(state, "2024-01-01T00:00:00", [99.0, 1000.0, 50.0])[1] == "late" and json.dumps(state) == before


def test_latest_neighbours(spark):
    schema = "station_id string, timestamp timestamp_ntz, temperature_c double"
    t = datetime(2024, 1, 1)
    batch = spark.createDataFrame([("a", t, 1.0), ("b", t, None)], schema)
    known = spark.createDataFrame([("b", t, 7.0)], schema)
    graph = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "station_id string, neighbor_id string, rank int")
    got = {r["station_id"]: r["neighbour_temperature_c"] for r in pipeline.with_latest_neighbours(batch, known, graph).collect()}
    assert got == {"a": 7.0, "b": None}
    assert {r["station_id"]: r["temperature_c"] for r in pipeline.latest_after(known, batch).collect()} == {"a": 1.0, "b": 7.0}


def test_sources_round_trip(spark, tmp_path):
    t = telemetry.telemetry(spark, SF).where("slot < 48").withColumn("anomaly_severity", F.lit(None).cast("double"))
    cols = [c.split()[0] for c in payloads.TELEMETRY.split(", ")]
    payloads.write_csv(t.select(*cols).coalesce(1), f"{tmp_path}/t.csv")
    payloads.write_splits(payloads.split_rows(t, ["ST_3"]), f"{tmp_path}/splits")
    payloads.write_stations(t, f"{tmp_path}/stations")
    a = payloads.read_telemetry(spark, f"{tmp_path}/t.csv")
    assert a.count() == spark.read.parquet(f"{tmp_path}/splits").count() == spark.read.parquet(f"{tmp_path}/stations").count() == t.count()
    assert a.where("temperature_c is null").count() == t.where("temperature_c is null").count()
    facts = payloads.write_summary(t, f"{tmp_path}/m.json")
    assert facts["rows"] == t.count() and json.loads((tmp_path / "m.json").read_text()) == facts
    body = {"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1.5, None], "relative_humidity_2m": [50, "bad"], "surface_pressure": [1000, 1001]}}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "ST_9.json").write_text(json.dumps(body))
    got = payloads.from_payload(payloads.read_payload(spark, f"{tmp_path}/p/*.json")).orderBy("timestamp").collect()
    assert [(r["station_id"], r["temperature_c"], r["humidity_pct"]) for r in got] == [("ST_9", 1.5, 50.0), ("ST_9", None, None)]
    (tmp_path / "c.json").write_text(json.dumps({"k": {"6": {"temp_mean": 1.0, "temp_std": 2.0}}, "_metadata": {}}))
    assert payloads.read_climatology(spark, f"{tmp_path}/c.json").select("key", "month", "temp_std").collect() == [("k", 6, 2.0)]
    assert payloads.read_climatology(spark, f"{tmp_path}/none.json").count() == 0


def test_config(tmp_path):
    (tmp_path / "a.yaml").write_text("seed: 7\nother: 1\nsplits:\n  temporal:\n    train: 0.6\n  holdout: [x]\n")
    (tmp_path / "a.json").write_text('{"days": 3}')
    c = config.Config.from_file(tmp_path / "a.yaml")
    assert (c.seed, c.splits.train, c.splits.holdout) == (7, 0.6, ("x",)) and config.Config.from_file(tmp_path / "a.json").days == 3
    (tmp_path / "a.txt").write_text("")
    with pytest.raises(ValueError):
        config.Config.from_file(tmp_path / "a.txt")
    with pytest.raises(FileNotFoundError):
        config.Config.from_file(tmp_path / "none.json")


def test_nearest_stations_can_be_restricted(spark):
    got = spatial.nearest_stations(telemetry.stations(spark), 3, references=["ST_0", "ST_1"])
    assert {r["neighbor_id"] for r in got.collect()} == {"ST_0", "ST_1"}


def test_daily_payload(spark):
    body = {"daily": {"time": ["2024-01-01"], **{k: [1.5] for k in payloads.DAILY}}}
    docs = spark.createDataFrame([("C", json.dumps(body))], "station_id string, body string")
    got = payloads.daily_telemetry(payloads.from_payload(docs, "daily", payloads.DAILY)).first()
    assert got["temperature_c"] == got["pressure_msl_mean"] == 1.5 and str(got["timestamp"]) == "2024-01-01 00:00:00"


def test_watermarked_stream(spark, tmp_path):
    rows = telemetry.telemetry(spark, SF).where("slot < 30").select("station_id", "timestamp", *qc.SENSORS)
    rows.unionByName(rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    assert run(pipeline.deduplicated(stream), "once", "append").count() == rows.count()
    counts = run(pipeline.hourly_counts(stream), "hours", "complete")
    assert counts.agg(F.sum("n")).first()[0] == 2 * rows.count() and counts.agg(F.sum("n_null")).first()[0] == 2 * rows.where("temperature_c is null").count()


def test_recurrent_training_windows_are_whole_and_from_all_stations(spark):
    from gaugeworks.plans import fragments, model_queries

    d = "/root/testdata/sf0.01"
    normal = fragments.kept(spark, d).where("not is_anomaly").toPandas()
    scaled, _, cols = model_queries._autoencoder(spark, d)
    rows = scaled.toPandas().sort_values(["station_id", "timestamp"]).reset_index(drop=True)
    for z, c in zip(cols, model_queries.CHANNELS):
        assert np.allclose(rows[z], (rows[c] - normal[c].mean()) / normal[c].std(ddof=0))
    allowed = {}
    for (station, _), part in rows.groupby(["station_id", "segment_id"]):
        x, bad = part[cols].to_numpy(), part["is_anomaly"].to_numpy()
        allowed |= {x[i : i + 24].round(9).tobytes(): station for i in range(0, len(x) - 23, 2) if not bad[i : i + 24].any()}
    everything = model_queries._training_windows(scaled, cols, 24, 10**6)
    assert sorted(w.round(9).tobytes() for w in everything) == sorted(allowed)
    few = model_queries._training_windows(scaled, cols, 24, 40)
    assert few.shape == (40, 24, 3) and {allowed[w.round(9).tobytes()] for w in few} == set(rows["station_id"])


def test_learned_queries_use_the_fitted_scores(spark):
    from gaugeworks.plans import extra_queries, model_queries

    keys = ["station_id", "timestamp"]
    typed, _, _ = model_queries._classified(spark, SF)
    got = typed.select(*keys, "if_score", "gru_score").toPandas().sort_values(keys).reset_index(drop=True)
    want = model_queries.ml1(spark, SF).join(model_queries.ml2(spark, SF), keys).toPandas().sort_values(keys).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want[got.columns])
    found = {r["weight"]: r for r in extra_queries.ml6(spark, SF).collect()}
    assert set(found) == {1, 5, 20, 50, 100} and {r["n"] for r in found.values()} == {len(got)}
