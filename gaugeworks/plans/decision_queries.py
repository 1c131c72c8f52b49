"""Consistency flags, fusion, routing, health and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion, health, qc, stats
from . import fragments as fr
from . import telemetry as tel
from .registry import query
from .signal_queries import EVENT_SQL, events

from ..operators import spatial

R = lambda c, n=6: F.round(c, n)
count_all = lambda: F.count(F.lit(1))
K = ["station_id", "timestamp"]


@query("agg2_mahalanobis", fr.DIST + "SELECT station_id, timestamp, round(mahalanobis_dist, 4) AS dist FROM dist")
def agg2(spark, d):
    return fr.distances(spark, d).select(*K, R(F.col("mahalanobis_dist"), 4).alias("dist"))


@query("jn8_fallback_chain", fr.BUDDY + """,
lv AS (SELECT 1 AS lvl, station_id, hour(timestamp) AS hr, * EXCLUDE (station_id) FROM normal WHERE station_id = 'ST_0' UNION ALL
       SELECT 2, 'zone_' || climate_zone, hour(timestamp), * EXCLUDE (station_id) FROM normal UNION ALL SELECT 3, 'all', -1, * EXCLUDE (station_id) FROM normal),
cv AS (SELECT lvl, station_id AS key, hr, avg(temperature_c) AS m0, avg(pressure_hpa) AS m1, avg(humidity_pct) AS m2,
  covar_samp(temperature_c, temperature_c) + 1e-4::DOUBLE AS a, covar_samp(temperature_c, pressure_hpa) AS b, covar_samp(temperature_c, humidity_pct) AS d,
  covar_samp(pressure_hpa, pressure_hpa) + 1e-4::DOUBLE AS e, covar_samp(pressure_hpa, humidity_pct) AS f, covar_samp(humidity_pct, humidity_pct) + 1e-4::DOUBLE AS i
  FROM lv WHERE lvl <> 2 OR climate_zone = 'plains' GROUP BY lvl, station_id, hr HAVING count(*) >= 5),
pk AS (SELECT t.station_id, t.timestamp, t.temperature_c AS x, t.pressure_hpa AS y, t.humidity_pct AS w, min(c.lvl) AS lvl FROM tel t JOIN cv c ON
  (c.lvl = 1 AND c.key = t.station_id AND c.hr = hour(t.timestamp)) OR (c.lvl = 2 AND c.key = 'zone_' || t.climate_zone AND c.hr = hour(t.timestamp)) OR c.lvl = 3 GROUP BY ALL)
SELECT p.station_id, p.timestamp, round(CASE WHEN x IS NULL OR y IS NULL OR w IS NULL THEN 0 ELSE sqrt(greatest(0.0::DOUBLE,
    ((e * i - f * f) * (x - m0) * (x - m0) + (a * i - d * d) * (y - m1) * (y - m1) + (a * e - b * b) * (w - m2) * (w - m2) + 2 * (d * f - b * i) * (x - m0) * (y - m1)
     + 2 * (b * f - d * e) * (x - m0) * (w - m2) + 2 * (b * d - a * f) * (y - m1) * (w - m2)) / (a * (e * i - f * f) + b * (d * f - b * i) + d * (b * f - d * e)))) END, 4) AS dist
FROM pk p JOIN cv c ON p.lvl = c.lvl AND ((c.lvl = 1 AND c.key = p.station_id AND c.hr = hour(p.timestamp)) OR (c.lvl = 2 AND c.key = 'zone_' || (SELECT climate_zone FROM st WHERE st.station_id = p.station_id) AND c.hr = hour(p.timestamp)) OR c.lvl = 3)""")
def jn8(spark, d):
    t = fr.telemetry(spark, d).withColumn("hr", F.hour("timestamp"))
    normal = t.where(qc.normal_training())
    models = [
        (stats.covariance_model(normal.where("station_id = 'ST_0'"), ["station_id", "hr"]), ["station_id", "hr"]),
        (stats.covariance_model(normal.where("climate_zone = 'plains'"), ["climate_zone", "hr"]), ["climate_zone", "hr"]),
        (stats.covariance_model(normal, []), []),
    ]
    return stats.mahalanobis(t, models).select(*K, R(F.col("mahalanobis_dist"), 4).alias("dist"))


@query("flt11_tier3_flags", fr.TIER3 + "SELECT station_id, timestamp, mahalanobis_flagged, buddy_flagged, isolated_deviation FROM t3")
def flt11(spark, d):
    return fr.tier3(spark, d).select(*K, "mahalanobis_flagged", "buddy_flagged", "isolated_deviation")


@query("flt15_ensemble", fr.TIER3 + "SELECT station_id, count(*) FILTER (WHERE if_score >= 0.9) AS n_if, count(*) FILTER (WHERE gru_score >= 1.2) AS n_gru, count(*) FILTER (WHERE if_score >= 0.9 OR gru_score >= 1.2) AS n_any FROM t3 GROUP BY station_id")
def flt15(spark, d):
    rows = fusion.ensemble_flags(fr.tier3(spark, d), 0.9, 1.2)
    return rows.groupBy("station_id").agg(F.count_if("if_flagged").alias("n_if"), F.count_if("gru_flagged").alias("n_gru"), F.count_if("ensemble_flagged").alias("n_any"))


@query("jn1_full_outer", fr.TIER3 + """, a AS (SELECT station_id, timestamp, if_score FROM t3 WHERE if_score > 0.3), b AS (SELECT station_id, timestamp, mahalanobis_dist FROM t3 WHERE mahalanobis_flagged)
  SELECT coalesce(a.station_id, b.station_id) AS station_id, coalesce(a.timestamp, b.timestamp) AS timestamp, if_score, round(mahalanobis_dist, 4) AS dist
  FROM a FULL OUTER JOIN b ON a.station_id = b.station_id AND a.timestamp = b.timestamp""")
def jn1(spark, d):
    t = fr.tier3(spark, d)
    both = t.where("if_score > 0.3").select(*K, "if_score").join(t.where("mahalanobis_flagged").select(*K, "mahalanobis_dist"), K, "full_outer")
    return both.select(*K, "if_score", R(F.col("mahalanobis_dist"), 4).alias("dist"))


@query("jn2_reconcile", fr.TIER3 + "SELECT tier_coverage, tier1_flagged, count(*) AS n FROM t4 GROUP BY ALL")
def jn2(spark, d):
    return fr.tier4(spark, d).groupBy("tier_coverage", "tier1_flagged").agg(count_all().alias("n"))


@query("flt12_hard_rule", fr.TIER3 + "SELECT station_id, timestamp, hard_rule_flagged, hard_rule_t2_suppressed, hard_rule_t3_suppressed, hard_rule_suppressed, insufficient_context FROM t5")
def flt12(spark, d):
    return fr.tier4(spark, d).select(*K, "hard_rule_flagged", "hard_rule_t2_suppressed", "hard_rule_t3_suppressed", "hard_rule_suppressed", "insufficient_context")


@query("flt17_upstream_fired", fr.TIER3 + "SELECT count(*) FILTER (WHERE tier1_flagged OR if_flagged OR gru_flagged OR mahalanobis_flagged OR buddy_flagged) AS fired, count(*) AS n FROM t4")
def flt17(spark, d):
    return fr.tier4(spark, d).agg(F.count_if(fusion.upstream_fired()).alias("fired"), count_all().alias("n"))


@query("prj7_fused_type", fr.TIER3 + "SELECT fusion_predicted_type, fusion_flagged, count(*) AS n FROM t6 GROUP BY ALL")
def prj7(spark, d):
    return fr.tier4_typed(spark, d).groupBy("fusion_predicted_type", "fusion_flagged").agg(count_all().alias("n"))


@query("prj8_two_track_route", fr.TIER3 + """SELECT station_id, timestamp, CASE WHEN hard_rule_flagged THEN '1' WHEN predicted IN ('calibration_drift', 'cross_sensor_inconsistency', 'frozen_sensor', 'power_fluctuation_glitch', 'spike_or_drop') AND NOT hard_rule_suppressed THEN '2' ELSE '1' END AS which_track,
  CASE WHEN hard_rule_flagged THEN CASE WHEN predicted IN ('power_fluctuation_glitch', 'spike_or_drop') THEN predicted WHEN gru_score > 5 THEN 'spike_or_drop' ELSE 'power_fluctuation_glitch' END
       WHEN predicted <> 'normal' AND NOT hard_rule_suppressed THEN predicted ELSE 'normal' END AS predicted_type,
  CAST(CASE WHEN hard_rule_flagged THEN 25 WHEN predicted = 'cross_sensor_inconsistency' AND NOT hard_rule_suppressed THEN 15 WHEN predicted <> 'normal' AND NOT hard_rule_suppressed THEN 10 ELSE 0 END AS DOUBLE) AS penalty FROM t5""")
def prj8(spark, d):
    rows = fr.tier4(spark, d).withColumn("predicted", fr.predicted()).withColumns({"confidence": F.lit(0.8), "p_normal": F.lit(0.9)})
    return fusion.route(rows).select(*K, "which_track", "predicted_type", "penalty")


PENALTY = """, pen AS (SELECT station_id, timestamp, least(100.0::DOUBLE, CASE WHEN tier1_flagged THEN 40.0 ELSE 0.0 END + CASE WHEN hard_rule_flagged THEN 25.0 ELSE 0.0 END
  + CASE WHEN mahalanobis_flagged AND NOT hard_rule_suppressed THEN 15.0 ELSE 0.0 END + CASE WHEN fusion_flagged AND fusion_predicted_type IN ('calibration_drift', 'cross_sensor_inconsistency', 'frozen_sensor') THEN 10.0 ELSE 0.0 END) AS p FROM t6),
ord AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY timestamp) AS i FROM pen),
shi AS (SELECT station_id, i, timestamp, CASE WHEN p > 0 THEN 0.95::DOUBLE * 100 + 0.05::DOUBLE * (100 - p) ELSE 0.99::DOUBLE * 100 + 1.0 END AS s FROM ord WHERE i = 1
  UNION ALL SELECT o.station_id, o.i, o.timestamp, CASE WHEN o.p > 0 THEN 0.95::DOUBLE * s.s + 0.05::DOUBLE * (100 - o.p) ELSE 0.99::DOUBLE * s.s + 1.0 END FROM shi s JOIN ord o ON o.station_id = s.station_id AND o.i = s.i + 1)
"""


def recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


def _health(spark, d):
    return health.health_index(fr.tier4_typed(spark, d).select(*K, health.batch_penalty().alias("penalty")), "penalty")


@query("rec1_health_index", recursive(fr.TIER3 + PENALTY) + "SELECT station_id, timestamp, round(s, 6) AS shi FROM shi")
def rec1(spark, d):
    return _health(spark, d).select(*K, R(F.col("sensor_health_index")).alias("shi"))


@query("agg28_health_in_events", recursive(fr.TIER3 + PENALTY + EVENT_SQL) + """SELECT event_id, round(min(s), 5) AS shi_min, round(avg(s), 5) AS shi_mean, round(arg_max(s, timestamp), 5) AS shi_final
  FROM shi JOIN evt ON station_id = es AND timestamp BETWEEN t_start AND t_end GROUP BY event_id""")
def agg28(spark, d):
    s = F.col("sensor_health_index")
    return spatial.event_rows(_health(spark, d), events(spark)).groupBy("event_id").agg(R(F.min(s), 5).alias("shi_min"), R(F.avg(s), 5).alias("shi_mean"), R(F.max_by(s, "timestamp"), 5).alias("shi_final"))


@query("win13_health_trend", recursive(fr.TIER3 + PENALTY) + """, back AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY timestamp DESC) AS b FROM shi),
  fit AS (SELECT station_id, regr_slope(s, -b) AS sl, arg_max(s, timestamp) AS c FROM back WHERE b <= 48 GROUP BY station_id)
  SELECT station_id, round(c, 2) AS current_shi, round(sl, 4) AS slope_pts_per_hr, CASE WHEN sl < -0.01 AND c > 70 THEN 'degrading' WHEN sl < -0.01 THEN 'below_threshold' WHEN sl > 0.01 THEN 'recovering' ELSE 'stable' END AS status,
  round(CASE WHEN sl < -0.01 AND c > 70 THEN (c - 70) / abs(sl) WHEN sl < -0.01 THEN 0 END, 1) AS hours_to_threshold FROM fit""")
def win13(spark, d):
    return health.project_health(_health(spark, d), tel.CADENCE_S)


@query("rec2_stream_health", recursive(fr.QC + """, ord AS (SELECT station_id, timestamp, CASE WHEN is_flagged THEN 40.0 ELSE 0.0 END::DOUBLE AS p, row_number() OVER (PARTITION BY station_id ORDER BY timestamp) AS i FROM qc),
  shi AS (SELECT station_id, i, timestamp, CASE WHEN p > 0 THEN 95.0::DOUBLE + 0.05::DOUBLE * (100 - p) ELSE 100.0::DOUBLE END AS s FROM ord WHERE i = 1
  UNION ALL SELECT o.station_id, o.i, o.timestamp, CASE WHEN o.p > 0 THEN 0.95::DOUBLE * s.s + 0.05::DOUBLE * (100 - o.p) ELSE 0.99::DOUBLE * s.s + 1.0 END FROM shi s JOIN ord o ON o.station_id = s.station_id AND o.i = s.i + 1)
  SELECT station_id, timestamp, round(s, 6) AS shi FROM shi"""))
def rec2(spark, d):
    rows = qc.rule_qc(fr.telemetry(spark, d)).select(*K, F.when(F.col("is_flagged"), 40.0).otherwise(0.0).alias("penalty"))
    return health.health_index(rows, "penalty").select(*K, R(F.col("sensor_health_index")).alias("shi"))


@query("rec3_online_mahalanobis")
def rec3(spark, d):
    rows = fr.telemetry(spark, d).select(*K, *qc.SENSORS)
    return health.rolling_distance(rows, prior_mu=(30.0, 1015.0, 50.0), prior_cov=(100.0, 0, 0, 0, 100.0, 0, 0, 0, 100.0)).select(*K, R(F.col("mahalanobis_dist_rolling"), 4).alias("dist"))


@query("agg6_confusion", fr.QC + """, c AS (SELECT count(*) FILTER (WHERE is_anomaly AND is_flagged) AS tp, count(*) FILTER (WHERE NOT is_anomaly AND is_flagged) AS fp, count(*) FILTER (WHERE is_anomaly AND NOT is_flagged) AS fn,
  count(*) FILTER (WHERE NOT is_anomaly AND NOT is_flagged) AS tn FROM qc) SELECT *, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM c""")
def agg6(spark, d):
    c = stats.confusion(qc.rule_qc(fr.telemetry(spark, d)), F.col("is_anomaly"), F.col("is_flagged"))
    return c.select("tp", "fp", "fn", "tn", *[R(F.col(x)).alias(x) for x in ("precision", "recall", "f1")])


@query("agg7_recall_by_type", fr.QC + "SELECT coalesce(anomaly_type, 'normal') AS kind, count(*) AS n, count(*) FILTER (WHERE is_flagged) AS hit, round(count(*) FILTER (WHERE is_flagged) / count(*)::DOUBLE, 6) AS rate FROM qc GROUP BY 1")
def agg7(spark, d):
    rows = qc.rule_qc(fr.telemetry(spark, d)).groupBy(F.coalesce("anomaly_type", F.lit("normal")).alias("kind"))
    return rows.agg(count_all().alias("n"), F.count_if("is_flagged").alias("hit"), R(stats.ratio(F.count_if("is_flagged"), count_all(), empty=1.0)).alias("rate"))


@query("agg8_threshold_sweep", fr.TIER3 + """, p AS (SELECT unnest(generate_series(0, 19)) AS step),
  qs AS (SELECT quantile_cont(gru_score, [0.5 + (0.95 - 0.5) * x / 19.0 FOR x IN range(20)]) AS q FROM t3), cut AS (SELECT step, q[step + 1] AS th FROM p, qs),
  s AS (SELECT step, th, count(*) FILTER (WHERE is_anomaly AND gru_score >= th) AS tp, count(*) FILTER (WHERE NOT is_anomaly AND gru_score >= th) AS fp FROM t3, cut GROUP BY step, th)
  SELECT step, round(th, 5) AS threshold, tp, fp, round(2 * tp / (tp + fp + (SELECT count(*) FROM t3 WHERE is_anomaly AND gru_score IS NOT NULL))::DOUBLE, 6) AS f1 FROM s""")
def agg8(spark, d):
    s = stats.threshold_sweep(fr.tier3(spark, d), "gru_score", "is_anomaly", steps=20, lo=0.5, hi=0.95)
    return s.select(F.col("step").cast("long").alias("step"), R(F.col("threshold"), 5).alias("threshold"), "tp", "fp", R(F.col("f1")).alias("f1"))


@query("agg9_percentile_calibration", fr.DIST + "SELECT round(quantile_cont(mahalanobis_dist, 0.998), 5) AS p998, round(quantile_cont(mahalanobis_dist, 0.98), 5) AS p98 FROM dist WHERE NOT is_anomaly")
def agg9(spark, d):
    p = F.percentile("mahalanobis_dist", F.array(F.lit(0.998), F.lit(0.98)))
    return fr.distances(spark, d).where("not is_anomaly").agg(p.alias("p")).select(R(F.col("p")[0], 5).alias("p998"), R(F.col("p")[1], 5).alias("p98"))


@query("agg20_row_balance", fr.TIER3 + "SELECT tier_coverage, count(*) AS n, count(*) FILTER (WHERE insufficient_context) AS waiting, (SELECT count(*) FROM tel) AS raw FROM t5 GROUP BY tier_coverage")
def agg20(spark, d):
    raw = fr.telemetry(spark, d).agg(count_all().alias("raw"))
    return fr.tier4(spark, d).groupBy("tier_coverage").agg(count_all().alias("n"), F.count_if("insufficient_context").alias("waiting")).crossJoin(F.broadcast(raw))


@query("agg22_station_summary", recursive(fr.TIER3 + PENALTY) + """SELECT t.station_id, count(*) AS n, count(*) FILTER (WHERE hard_rule_flagged) AS track1, count(*) FILTER (WHERE fusion_flagged AND NOT hard_rule_flagged) AS track2,
  round(min(s), 4) AS shi_min, round(arg_max(s, t.timestamp), 4) AS shi_final FROM t6 t JOIN shi ON shi.station_id = t.station_id AND shi.timestamp = t.timestamp GROUP BY t.station_id""")
def agg22(spark, d):
    typed = fr.tier4_typed(spark, d)
    rows = health.health_index(typed.select(*K, "hard_rule_flagged", "fusion_flagged", health.batch_penalty().alias("penalty")), "penalty")
    s = F.col("sensor_health_index")
    return rows.groupBy("station_id").agg(count_all().alias("n"), F.count_if("hard_rule_flagged").alias("track1"), F.count_if(F.col("fusion_flagged") & ~F.col("hard_rule_flagged")).alias("track2"),
                                          R(F.min(s), 4).alias("shi_min"), R(F.max_by(s, "timestamp"), 4).alias("shi_final"))


@query("agg25_suppression", fr.TIER3 + EVENT_SQL + """SELECT event_id, count(*) FILTER (WHERE if_flagged OR gru_flagged) AS t2_alarms, count(*) FILTER (WHERE hard_rule_t2_suppressed) AS suppressed,
  round(coalesce(count(*) FILTER (WHERE hard_rule_t2_suppressed) / nullif(count(*) FILTER (WHERE if_flagged OR gru_flagged), 0)::DOUBLE, 0), 6) AS rate FROM t5 JOIN evt ON station_id = es AND timestamp BETWEEN t_start AND t_end GROUP BY event_id""")
def agg25(spark, d):
    alarm = F.col("if_flagged") | F.col("gru_flagged")
    rows = fr.tier4(spark, d).withColumns({"if_flagged": qc.flag(F.col("if_flagged")), "gru_flagged": qc.flag(F.col("gru_flagged"))})
    return spatial.event_rows(rows, events(spark)).groupBy("event_id").agg(F.count_if(alarm).alias("t2_alarms"), F.count_if("hard_rule_t2_suppressed").alias("suppressed"), R(stats.ratio(F.count_if("hard_rule_t2_suppressed"), F.count_if(alarm))).alias("rate"))


@query("agg26_multiclass_report", fr.TIER3 + """, x AS (SELECT coalesce(anomaly_type, 'normal') AS truth, fusion_predicted_type AS guess FROM t6),
  k AS (SELECT truth AS kind FROM x UNION SELECT guess FROM x) SELECT kind, (SELECT count(*) FROM x WHERE truth = kind) AS support, (SELECT count(*) FROM x WHERE guess = kind) AS predicted, (SELECT count(*) FROM x WHERE truth = kind AND guess = kind) AS hits FROM k""")
def agg26(spark, d):
    x = fr.tier4_typed(spark, d).select(F.coalesce("anomaly_type", F.lit("normal")).alias("truth"), F.col("fusion_predicted_type").alias("guess"))
    side = F.explode(F.array(F.struct(F.col("truth").alias("kind"), F.lit(1).alias("s"), F.lit(0).alias("p")), F.struct(F.col("guess").alias("kind"), F.lit(0).alias("s"), F.lit(1).alias("p"))))
    cells = x.groupBy("truth", "guess").agg(count_all().alias("n")).select("truth", "guess", "n", side.alias("x"))
    return cells.groupBy(F.col("x.kind").alias("kind")).agg(F.sum(F.col("n") * F.col("x.s")).alias("support"), F.sum(F.col("n") * F.col("x.p")).alias("predicted"),
                                                            F.sum(F.when((F.col("truth") == F.col("guess")) & (F.col("x.s") == 1), F.col("n")).otherwise(0)).alias("hits"))


@query("win12_episode_lead", fr.TIER3 + """SELECT station_id, min(timestamp) FILTER (WHERE hard_rule_flagged) AS first_flag, min(timestamp) AS first_drift,
  date_diff('second', min(timestamp), min(timestamp) FILTER (WHERE hard_rule_flagged)) / 3600.0::DOUBLE AS delay_h FROM t5 WHERE anomaly_type = 'calibration_drift' GROUP BY station_id""")
def win12(spark, d):
    hit = F.min(F.when(F.col("hard_rule_flagged"), F.col("timestamp")))
    rows = fr.tier4(spark, d).where("anomaly_type = 'calibration_drift'").groupBy("station_id").agg(hit.alias("first_flag"), F.min("timestamp").alias("first_drift"))
    return rows.withColumn("delay_h", F.timestamp_diff("SECOND", F.col("first_drift"), F.col("first_flag")) / 3600.0)
