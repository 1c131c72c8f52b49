"""SQL fragments (DuckDB) that the oracles share, and the Spark plans they stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, fusion, qc, spatial, stats
from . import telemetry as tel

TEL = tel.SQL
QC = TEL + """,
qc AS (SELECT *, flag_reason IS NOT NULL AS is_flagged FROM (SELECT *, CASE
  WHEN temperature_c IS NULL AND pressure_hpa IS NULL AND humidity_pct IS NULL THEN 'communication_dropout'
  WHEN temperature_c IS NULL OR pressure_hpa IS NULL OR humidity_pct IS NULL THEN 'partial_nan_anomaly'
  WHEN temperature_c IN (-999.0, -99.9, 999.9, 9999.0) OR pressure_hpa IN (-999.0, -99.9, 999.9, 9999.0) OR humidity_pct IN (-999.0, -25.0, 160.0) THEN 'sentinel_value'
  WHEN temperature_c < -30 OR temperature_c > 60 OR pressure_hpa < 500 OR pressure_hpa > 1100 OR humidity_pct < 0 OR humidity_pct > 100 THEN 'range_violation' END AS flag_reason FROM tel) x)
"""
KEPT = QC + """,
kept AS (SELECT * FROM tel WHERE coalesce(anomaly_type NOT IN ('communication_dropout', 'data_corruption'), TRUE)
  AND temperature_c IS NOT NULL AND pressure_hpa IS NOT NULL AND humidity_pct IS NOT NULL),
gaps AS (SELECT *, CASE WHEN coalesce(date_diff('second', lag(timestamp) OVER (PARTITION BY station_id ORDER BY timestamp), timestamp), 3600) <> 3600 THEN 1 ELSE 0 END AS gap FROM kept),
seg AS (SELECT * EXCLUDE (gap), CAST(sum(gap) OVER (PARTITION BY station_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id FROM gaps),
normal AS (SELECT * FROM tel WHERE NOT is_anomaly AND temperature_c IS NOT NULL AND pressure_hpa IS NOT NULL AND humidity_pct IS NOT NULL AND temperature_c > -50)
"""
FEAT = KEPT + """,
feat AS (SELECT *, temperature_c - lag(temperature_c) OVER w AS "delta_T", pressure_hpa - lag(pressure_hpa) OVER w AS "delta_P", humidity_pct - lag(humidity_pct) OVER w AS "delta_RH"
  FROM seg WINDOW w AS (PARTITION BY station_id, segment_id ORDER BY timestamp))
"""
GRAPH = """,
pairs AS (SELECT a.station_id, b.station_id AS neighbor_id,
  pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2) AS h
  FROM st a JOIN st b ON a.station_id <> b.station_id),
km AS (SELECT station_id, neighbor_id, 2 * 6371.0::DOUBLE * atan2(sqrt(h), sqrt(1 - h)) AS km FROM pairs),
graph AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY km, neighbor_id) AS rank FROM km) WHERE rank <= 2),
ref AS (SELECT * FROM tel WHERE coalesce(anomaly_type NOT IN ('communication_dropout', 'data_corruption'), TRUE)
  AND temperature_c IS NOT NULL AND pressure_hpa IS NOT NULL AND humidity_pct IS NOT NULL AND temperature_c >= -50)
"""
BUDDY = FEAT + GRAPH + """,
near AS (SELECT f.station_id, f.timestamp, arg_min(r.temperature_c, g.rank) AS nt, quantile_cont(r.pressure_hpa, 0.5) AS np
  FROM feat f JOIN graph g ON f.station_id = g.station_id JOIN ref r ON r.station_id = g.neighbor_id AND r.timestamp = f.timestamp GROUP BY f.station_id, f.timestamp),
buddy AS (SELECT f.*, coalesce(abs(f.temperature_c - nt), 0.0::DOUBLE) AS "delta_T_buddy", coalesce(f.pressure_hpa - np, 0.0::DOUBLE) AS "delta_P_cluster"
  FROM feat f LEFT JOIN near n ON f.station_id = n.station_id AND f.timestamp = n.timestamp)
"""
COV = """,
cov AS (SELECT lvl, key, hr, avg(temperature_c) AS m0, avg(pressure_hpa) AS m1, avg(humidity_pct) AS m2,
  covar_samp(temperature_c, temperature_c) + 1e-4::DOUBLE AS a, covar_samp(temperature_c, pressure_hpa) AS b, covar_samp(temperature_c, humidity_pct) AS d,
  covar_samp(pressure_hpa, pressure_hpa) + 1e-4::DOUBLE AS e, covar_samp(pressure_hpa, humidity_pct) AS f, covar_samp(humidity_pct, humidity_pct) + 1e-4::DOUBLE AS i
  FROM (SELECT 1 AS lvl, station_id AS key, hour(timestamp) AS hr, temperature_c, pressure_hpa, humidity_pct FROM normal
        UNION ALL SELECT 2, '', hour(timestamp), temperature_c, pressure_hpa, humidity_pct FROM normal
        UNION ALL SELECT 3, '', -1, temperature_c, pressure_hpa, humidity_pct FROM normal)
  GROUP BY lvl, key, hr HAVING count(*) >= CASE lvl WHEN 1 THEN 5 ELSE 2 END),
inv AS (SELECT lvl, key, hr, struct_pack(a := a, b := b, d := d, e := e, f := f, i := i, m0 := m0, m1 := m1, m2 := m2, det := a * (e * i - f * f) + b * (d * f - b * i) + d * (b * f - d * e)) AS s FROM cov)
"""
DIST = BUDDY + COV + """,
dist AS (SELECT x.* EXCLUDE (s), CASE WHEN s IS NULL THEN NULL ELSE sqrt(greatest(0.0::DOUBLE, ((s.e * s.i - s.f * s.f) * u * u + (s.a * s.i - s.d * s.d) * v * v + (s.a * s.e - s.b * s.b) * z * z
    + 2 * (s.d * s.f - s.b * s.i) * u * v + 2 * (s.b * s.f - s.d * s.e) * u * z + 2 * (s.b * s.d - s.a * s.f) * v * z) / s.det)) END AS mahalanobis_dist
  FROM (SELECT *, temperature_c - s.m0 AS u, pressure_hpa - s.m1 AS v, humidity_pct - s.m2 AS z
        FROM (SELECT bu.*, coalesce(c1.s, c2.s, c3.s) AS s FROM buddy bu LEFT JOIN inv c1 ON c1.lvl = 1 AND bu.station_id = c1.key AND hour(bu.timestamp) = c1.hr
              LEFT JOIN inv c2 ON c2.lvl = 2 AND hour(bu.timestamp) = c2.hr LEFT JOIN inv c3 ON c3.lvl = 3) w) x)
"""
TIER3 = DIST + """,
t3 AS (SELECT *, buddy_flagged AND own AS isolated_deviation FROM (SELECT *,
  coalesce(mahalanobis_dist > 3.0, FALSE) AS mahalanobis_flagged, coalesce(("delta_T_buddy" - 20) / 20 > 2.0, FALSE) OR coalesce(abs("delta_P_cluster") / 15 > 2.0, FALSE) AS buddy_flagged,
  coalesce(abs("delta_T") / 15 > 2.0, FALSE) OR coalesce(abs("delta_P") / 12 > 2.0, FALSE) AS own,
  round(abs("delta_T") / 40, 6) AS if_score, round(abs("delta_P") / 20, 6) AS gru_score FROM dist) y),
t4 AS (SELECT q.station_id, q.timestamp, q.anomaly_type, q.is_anomaly, q.is_flagged AS tier1_flagged, q.flag_reason AS tier1_reason, t.if_score, t.gru_score, t.mahalanobis_dist,
  coalesce(t.if_score >= 0.9, FALSE) AS if_flagged, coalesce(t.gru_score >= 1.2, FALSE) AS gru_flagged, coalesce(t.mahalanobis_flagged, FALSE) AS mahalanobis_flagged,
  coalesce(t.buddy_flagged, FALSE) AS buddy_flagged, t.isolated_deviation, CASE WHEN t.gru_score IS NOT NULL THEN 'full' ELSE 'tier1_only' END AS tier_coverage
  FROM qc q LEFT JOIN t3 t ON q.station_id = t.station_id AND q.timestamp = t.timestamp),
t5 AS (SELECT *, tier1_flagged OR ((if_flagged OR gru_flagged OR mahalanobis_flagged OR buddy_flagged) AND coalesce(isolated_deviation, FALSE)) AS hard_rule_flagged,
  (if_flagged OR gru_flagged) AND coalesce(NOT isolated_deviation, FALSE) AS hard_rule_t2_suppressed,
  (mahalanobis_flagged OR buddy_flagged) AND coalesce(NOT isolated_deviation, FALSE) AS hard_rule_t3_suppressed,
  (if_flagged OR gru_flagged OR mahalanobis_flagged OR buddy_flagged) AND coalesce(NOT isolated_deviation, FALSE) AS hard_rule_suppressed,
  tier_coverage = 'tier1_only' AND NOT tier1_flagged AS insufficient_context,
  CASE WHEN gru_score >= 2.0 THEN 'spike_or_drop' WHEN mahalanobis_flagged THEN 'cross_sensor_inconsistency' WHEN if_score >= 0.9 THEN 'power_fluctuation_glitch' ELSE 'normal' END AS predicted FROM t4),
t6 AS (SELECT *, CASE WHEN tier_coverage = 'full' THEN fusion_predicted_type <> 'normal' ELSE tier1_flagged END AS fusion_flagged FROM (SELECT *,
  CASE WHEN tier_coverage = 'full' THEN predicted WHEN tier1_flagged THEN CASE tier1_reason WHEN 'communication_dropout' THEN 'communication_dropout' ELSE 'data_corruption' END
       ELSE 'insufficient_context' END AS fusion_predicted_type FROM t5) z)
"""

KEYS = ["station_id", "timestamp"]
LEAN = {"mahalanobis": 3.0, "buddy": 2.0, "peer": 2.0}


def telemetry(spark, d):
    return tel.telemetry(spark, d)


def kept(spark, d):
    return features.with_segments(telemetry(spark, d).where(~qc.exclusion()), tel.CADENCE_S)


def graph(spark, k=2):
    return spatial.nearest_stations(tel.stations(spark), k)


def deltas(spark, d):
    rows = kept(spark, d)
    return rows.withColumns({f"delta_{s}": F.col(c) - F.lag(c).over(features.per_segment()) for c, s in features.SHORT.items()})


def buddies(spark, d):
    return spatial.buddy_features(deltas(spark, d), telemetry(spark, d).where(qc.clean_reference()), graph(spark))


def distances(spark, d):
    """Distances from the (station, hour) with five normal rows or more, else the hour over all stations, else all rows."""
    normal = telemetry(spark, d).where(qc.normal_training()).withColumn("hr", F.hour("timestamp"))
    levels = [(stats.covariance_model(normal, keys, least=least), keys) for keys, least in ((["station_id", "hr"], 5), (["hr"], 2), ([], 2))]
    return stats.mahalanobis(buddies(spark, d).withColumn("hr", F.hour("timestamp")), levels)


def tier3(spark, d):
    scaled = distances(spark, d).withColumns({
        "delta_T_scaled": F.col("delta_T") / 15, "delta_P_scaled": F.col("delta_P") / 12,
        "delta_T_buddy_scaled": (F.col("delta_T_buddy") - 20) / 20, "delta_P_cluster_scaled": F.col("delta_P_cluster") / 15,
    })
    return fusion.pseudo_scores(fusion.consistency_flags(scaled, LEAN, check_dew_point=False))


def tier4(spark, d, scores=None):
    """scores: if_score and gru_score of fitted models by station and time, in place of the stand-ins that SQL can check."""
    t1 = qc.rule_qc(telemetry(spark, d)).select(*KEYS, "anomaly_type", "is_anomaly", "is_flagged", "flag_reason")
    t3 = tier3(spark, d)
    tier2 = t3 if scores is None else scores
    t2 = fusion.ensemble_flags(tier2, 0.9, 1.2).select(*KEYS, "if_score", "gru_score", "if_flagged", "gru_flagged")
    both = t3.select(*KEYS, "mahalanobis_dist", "mahalanobis_flagged", "buddy_flagged", "isolated_deviation")
    return fusion.gated_rule(fusion.reconcile(t1, t2, both))


def predicted():
    return F.when(F.col("gru_score") >= 2.0, "spike_or_drop").when(F.col("mahalanobis_flagged"), "cross_sensor_inconsistency").when(F.col("if_score") >= 0.9, "power_fluctuation_glitch").otherwise("normal")


def tier4_typed(spark, d):
    return fusion.fused_type(tier4(spark, d).withColumn("predicted", predicted()), F.col("predicted"))
