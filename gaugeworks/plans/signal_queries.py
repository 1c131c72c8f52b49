"""Sessions, windows, neighbours and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features, qc, spatial, stats
from . import fragments as fr
from . import telemetry as tel
from .registry import query

R = lambda c, n=6: F.round(c, n)
count_all = lambda: F.count(F.lit(1))
K = ["station_id", "timestamp"]


@query("win1_segments", fr.KEPT + "SELECT station_id, segment_id, count(*) AS n, min(timestamp) AS t0, max(timestamp) AS t1 FROM seg GROUP BY station_id, segment_id")
def win1(spark, d):
    return fr.kept(spark, d).groupBy("station_id", "segment_id").agg(count_all().alias("n"), F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"))


@query("win2_deltas", fr.FEAT + 'SELECT station_id, timestamp, round("delta_T", 6) AS d_t, round("delta_P", 6) AS d_p, round("delta_RH", 6) AS d_rh FROM feat')
def win2(spark, d):
    return fr.deltas(spark, d).select(*K, R(F.col("delta_T")).alias("d_t"), R(F.col("delta_P")).alias("d_p"), R(F.col("delta_RH")).alias("d_rh"))


ROLL = """, base AS (SELECT station_id, stddev_samp(temperature_c) AS s FROM normal GROUP BY station_id),
roll AS (SELECT seg.*, CASE WHEN count(*) OVER f >= 6 THEN var_samp(temperature_c) OVER f END AS v6, CASE WHEN count(*) OVER g >= 36 THEN var_samp(temperature_c) OVER g END AS v36,
  CASE WHEN count(*) OVER f >= 6 THEN stddev_samp(temperature_c) OVER f END AS s6 FROM seg
  WINDOW f AS (PARTITION BY station_id, segment_id ORDER BY timestamp ROWS BETWEEN 5 PRECEDING AND CURRENT ROW),
         g AS (PARTITION BY station_id, segment_id ORDER BY timestamp ROWS BETWEEN 35 PRECEDING AND CURRENT ROW))
"""


def _rolled(spark, d):
    normal = fr.telemetry(spark, d).where(qc.normal_training())
    return features.rolling_features(fr.kept(spark, d), stats.volatility_baselines(normal))


@query("win3_rolling_variance", fr.KEPT + ROLL + "SELECT station_id, timestamp, round(v6, 4) AS var_1h, round(v36, 4) AS var_6h FROM roll")
def win3(spark, d):
    return _rolled(spark, d).select(*K, R(F.col("var_T_1h"), 4).alias("var_1h"), R(F.col("var_T_6h"), 4).alias("var_6h"))


@query("win4_volatility_ratio", fr.KEPT + ROLL + "SELECT roll.station_id, timestamp, round(s6 / (s + 1e-4), 5) AS ratio FROM roll JOIN base USING (station_id)")
def win4(spark, d):
    return _rolled(spark, d).select(*K, R(F.col("vol_ratio_T"), 5).alias("ratio"))


@query("win5_stream_variance", fr.KEPT + """, o AS (SELECT *, CASE WHEN count(*) OVER f >= 6 THEN var_pop(temperature_c) OVER f ELSE 0.1 END AS v1,
  count(*) OVER g AS n, var_pop(temperature_c) OVER g AS v FROM kept WINDOW f AS (PARTITION BY station_id ORDER BY timestamp ROWS BETWEEN 5 PRECEDING AND CURRENT ROW),
  g AS (PARTITION BY station_id ORDER BY timestamp ROWS BETWEEN 36 PRECEDING AND CURRENT ROW))
  SELECT station_id, timestamp, round(v1, 4) AS var_1h, round(CASE WHEN n >= 12 THEN v ELSE 2 * v1 END, 4) AS var_6h, round(sqrt(v1) / (4 + 1e-4), 5) AS ratio FROM o""")
def win5(spark, d):
    return features.stream_rolling(fr.telemetry(spark, d).where(~qc.exclusion())).select(
        *K, R(F.col("var_T_1h"), 4).alias("var_1h"), R(F.col("var_T_6h"), 4).alias("var_6h"), R(F.col("vol_ratio_T"), 5).alias("ratio"))


@query("win6_partial_std", fr.KEPT + """SELECT station_id, timestamp, round(CASE WHEN count(*) OVER f >= 3 THEN stddev_samp(temperature_c) OVER f END, 5) AS std6
  FROM kept WINDOW f AS (PARTITION BY station_id ORDER BY timestamp ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def win6(spark, d):
    rows = fr.telemetry(spark, d).where(~qc.exclusion())
    return rows.select(*K, R(features.full_window(F.stddev_samp, "temperature_c", 6, 3, features.per_station()), 5).alias("std6"))


@query("win7_gap_blind_delta", fr.KEPT + "SELECT station_id, timestamp, round(abs(temperature_c - lag(temperature_c) OVER (PARTITION BY station_id ORDER BY timestamp)), 6) AS d FROM kept")
def win7(spark, d):
    rows = fr.telemetry(spark, d).where(~qc.exclusion())
    return rows.select(*K, R(F.abs(F.col("temperature_c") - F.lag("temperature_c").over(features.per_station()))).alias("d"))


@query("win8_episodes", fr.TEL + """, e AS (SELECT *, CASE WHEN coalesce(date_diff('second', lag(timestamp) OVER (PARTITION BY station_id, anomaly_type ORDER BY timestamp), timestamp), -1) <> 3600 THEN 1 ELSE 0 END AS fresh
  FROM tel WHERE anomaly_type IS NOT NULL) SELECT anomaly_type, CAST(sum(fresh) AS BIGINT) AS n_episodes, count(DISTINCT station_id) AS n_stations FROM e GROUP BY anomaly_type""")
def win8(spark, d):
    return features.episodes(fr.telemetry(spark, d), F.col("anomaly_type"), tel.CADENCE_S)


@query("win9_training_windows", fr.KEPT + """, w AS (SELECT *, count(*) OVER a AS n, max(CAST(is_anomaly AS INT)) OVER a AS bad, row_number() OVER (PARTITION BY station_id, segment_id ORDER BY timestamp) AS i FROM seg
  WINDOW a AS (PARTITION BY station_id, segment_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) SELECT station_id, segment_id, timestamp AS start FROM w WHERE n = 8 AND bad = 0 AND (i - 1) % 2 = 0""")
def win9(spark, d):
    return features.training_windows(fr.kept(spark, d), size=8, stride=2)


@query("win11_flatline", fr.TEL + """SELECT station_id, count(*) AS n FROM (SELECT station_id, pressure_hpa AS p, lag(pressure_hpa) OVER w AS a, lag(pressure_hpa, 2) OVER w AS b FROM
  (SELECT station_id, timestamp, floor(pressure_hpa / 20) AS pressure_hpa FROM tel) WINDOW w AS (PARTITION BY station_id ORDER BY timestamp)) WHERE p = a AND p = b GROUP BY station_id""")
def win11(spark, d):
    order = features.per_station()
    rows = fr.telemetry(spark, d).withColumn("p", F.floor(F.col("pressure_hpa") / 20))
    return rows.withColumns({"a": F.lag("p").over(order), "b": F.lag("p", 2).over(order)}).where("p = a and p = b").groupBy("station_id").agg(count_all().alias("n"))


@query("win14_cold_start", fr.TEL + "SELECT station_id, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY timestamp) AS i FROM tel) WHERE i <= 24")
def win14(spark, d):
    return fr.telemetry(spark, d).withColumn("i", F.row_number().over(features.per_station())).where("i <= 24").select(*K)


@query("win15_last_value", fr.KEPT + "SELECT station_id, arg_max(temperature_c, timestamp) AS last_t FROM kept GROUP BY station_id")
def win15(spark, d):
    return fr.telemetry(spark, d).where(~qc.exclusion()).groupBy("station_id").agg(F.max_by("temperature_c", "timestamp").alias("last_t"))


@query("win16_interpolate", fr.TEL + """, i AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY timestamp) AS i FROM tel),
  j AS (SELECT *, last_value(pressure_hpa IGNORE NULLS) OVER p AS pv, first_value(pressure_hpa IGNORE NULLS) OVER n AS nv,
    last_value(CASE WHEN pressure_hpa IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi, first_value(CASE WHEN pressure_hpa IS NOT NULL THEN i END IGNORE NULLS) OVER n AS ni FROM i
    WINDOW p AS (PARTITION BY station_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY station_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT station_id, timestamp, round(CASE WHEN pressure_hpa IS NOT NULL THEN pressure_hpa WHEN pi IS NULL THEN nv WHEN ni IS NULL THEN pv ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END, 5) AS filled FROM j""")
def win16(spark, d):
    return features.interpolate(fr.telemetry(spark, d), "pressure_hpa", "filled").select(*K, R(F.col("filled"), 5).alias("filled"))


@query("win17_centred_average", fr.KEPT + """SELECT station_id, timestamp, round((sum(temperature_c) OVER (PARTITION BY station_id ORDER BY timestamp ROWS BETWEEN 11 PRECEDING AND 11 FOLLOWING)
  + (lag(temperature_c, 12) OVER w + lead(temperature_c, 12) OVER w) / 2) / 24, 5) AS trend FROM kept WINDOW w AS (PARTITION BY station_id ORDER BY timestamp)""")
def win17(spark, d):
    return fr.telemetry(spark, d).where(~qc.exclusion()).select(*K, R(features.centred_average("temperature_c", 24), 5).alias("trend"))


@query("fn8_jn16_haversine", fr.TEL + fr.GRAPH + "SELECT station_id, neighbor_id, round(km, 6) AS km FROM km")
def fn8(spark, d):
    return spatial.station_pairs(tel.stations(spark)).select("station_id", "neighbor_id", R(F.col("km")).alias("km"))


@query("jn17_nearest_stations", fr.TEL + fr.GRAPH + "SELECT station_id, neighbor_id, rank FROM graph")
def jn17(spark, d):
    return fr.graph(spark).select("station_id", "neighbor_id", F.col("rank").cast("long").alias("rank"))


@query("jn3_nearest_buddy", fr.BUDDY + 'SELECT station_id, timestamp, round("delta_T_buddy", 6) AS d FROM buddy')
def jn3(spark, d):
    return fr.buddies(spark, d).select(*K, R(F.col("delta_T_buddy")).alias("d"))


@query("jn4_cluster_median", fr.BUDDY + 'SELECT station_id, timestamp, round("delta_P_cluster", 6) AS d FROM buddy')
def jn4(spark, d):
    return fr.buddies(spark, d).select(*K, R(F.col("delta_P_cluster")).alias("d"))


@query("jn6_sea_level_buddies", fr.BUDDY + """, msl AS (SELECT station_id, timestamp, CASE WHEN altitude_m <= 0 THEN pressure_hpa ELSE pressure_hpa * exp(9.80665 * altitude_m / (287.05 * (temperature_c + 273.15) *
    (1 + 0.61 * least(greatest(0.622 * e / greatest(greatest(pressure_hpa, 300) - 0.378 * e, 100), 0), 0.1)))) END AS m
  FROM (SELECT *, 6.112 * exp(17.67 * temperature_c / (temperature_c + 243.5)) * humidity_pct / 100 AS e FROM ref)),
  md AS (SELECT a.station_id, a.timestamp, a.m, quantile_cont(b.m, 0.5) AS q FROM msl a LEFT JOIN graph g ON a.station_id = g.station_id LEFT JOIN msl b ON b.station_id = g.neighbor_id AND b.timestamp = a.timestamp GROUP BY ALL)
  SELECT station_id, timestamp, round(coalesce(m - q, 0), 4) AS residual, round(coalesce(m - q, 0) / 6.437047, 4) AS scaled FROM md""")
def jn6(spark, d):
    ref = fr.telemetry(spark, d).where(qc.clean_reference())
    return spatial.sea_level_buddies(ref, ref, fr.graph(spark)).select(*K, R(F.col("delta_P_cluster_msl"), 4).alias("residual"), R(F.col("delta_P_cluster_msl_scaled"), 4).alias("scaled"))


@query("jn7_near_gap", fr.TEL + """, ex AS (SELECT * FROM tel WHERE anomaly_type IN ('communication_dropout', 'data_corruption') OR temperature_c IS NULL OR pressure_hpa IS NULL OR humidity_pct IS NULL)
  SELECT t.station_id, t.timestamp, EXISTS (SELECT 1 FROM ex WHERE ex.station_id = t.station_id AND abs(date_diff('second', ex.timestamp, t.timestamp)) <= 3600) AS near_excluded_gap FROM tel t""")
def jn7(spark, d):
    return features.near_exclusion(fr.telemetry(spark, d), qc.exclusion()).select(*K, "near_excluded_gap")


EVENTS = [("EV1", "ST_0", "2024-01-05 00:00:00", "2024-01-07 12:00:00"), ("EV2", "ST_2", "2024-01-06 00:00:00", "2024-01-08 00:00:00"), ("EV3", "ST_2", "2024-01-20 06:00:00", "2024-01-21 00:00:00")]
EVENT_SQL = """, evt(event_id, es, t_start, t_end) AS (VALUES ('EV1', 'ST_0', TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-07 12:00:00'),
  ('EV2', 'ST_2', TIMESTAMP '2024-01-06 00:00:00', TIMESTAMP '2024-01-08 00:00:00'), ('EV3', 'ST_2', TIMESTAMP '2024-01-20 06:00:00', TIMESTAMP '2024-01-21 00:00:00'))
"""


def events(spark):
    return spark.createDataFrame(EVENTS, "event_id string, station_id string, a string, b string").select("event_id", "station_id", F.col("a").cast("timestamp_ntz").alias("t_start"), F.col("b").cast("timestamp_ntz").alias("t_end"))


@query("jn13_event_window", fr.QC + EVENT_SQL + """SELECT event_id, count(*) AS n, count(*) FILTER (WHERE is_flagged) AS flagged, round(count(*) FILTER (WHERE is_flagged) / count(*)::DOUBLE, 6) AS rate,
  round(min(pressure_hpa), 4) AS p_min, round(max(pressure_hpa), 4) AS p_max FROM qc JOIN evt ON station_id = es AND timestamp BETWEEN t_start AND t_end GROUP BY event_id""")
def jn13(spark, d):
    rows = spatial.event_rows(qc.rule_qc(fr.telemetry(spark, d)), events(spark))
    return rows.groupBy("event_id").agg(count_all().alias("n"), F.count_if("is_flagged").alias("flagged"), R(stats.ratio(F.count_if("is_flagged"), count_all())).alias("rate"), R(F.min("pressure_hpa"), 4).alias("p_min"), R(F.max("pressure_hpa"), 4).alias("p_max"))


@query("jn14_semi_anti", fr.QC + """, f AS (SELECT station_id, timestamp FROM qc WHERE is_flagged), r AS (SELECT station_id, timestamp FROM tel WHERE anomaly_type IN ('communication_dropout', 'data_corruption'))
  SELECT (SELECT count(*) FROM f SEMI JOIN r USING (station_id, timestamp)) AS n_both, (SELECT count(*) FROM f ANTI JOIN r USING (station_id, timestamp)) AS left_only, (SELECT count(*) FROM r ANTI JOIN f USING (station_id, timestamp)) AS right_only""")
def jn14(spark, d):
    t = qc.rule_qc(fr.telemetry(spark, d))
    f, r = t.where("is_flagged").select(*K), t.where(qc.excluded_type()).select(*K)
    one = lambda df, name: df.agg(count_all().alias(name))
    return one(f.join(r, K, "left_semi"), "n_both").crossJoin(one(f.join(r, K, "left_anti"), "left_only")).crossJoin(one(r.join(f, K, "left_anti"), "right_only"))


@query("jn15_buddy_residual", fr.KEPT + fr.GRAPH + """SELECT k.station_id, k.timestamp, round(k.pressure_hpa - o.pressure_hpa, 6) AS residual FROM kept k JOIN graph g ON g.station_id = k.station_id AND rank = 1
  JOIN kept o ON o.station_id = g.neighbor_id AND o.timestamp = k.timestamp""")
def jn15(spark, d):
    rows = fr.telemetry(spark, d).where(~qc.exclusion())
    near = spatial.peers(rows, rows, fr.graph(spark, 1), ["pressure_hpa"])
    return near.join(rows, K).select(*K, R(F.col("pressure_hpa") - F.col("n_pressure_hpa")).alias("residual"))


@query("jn16_pair_correlation", fr.KEPT + fr.GRAPH + """SELECT a.station_id, b.station_id AS neighbor_id, round(corr(a.pressure_hpa, b.pressure_hpa), 6) AS r, count(*) AS n FROM kept a JOIN kept b ON a.timestamp = b.timestamp AND a.station_id <> b.station_id GROUP BY ALL""")
def jn16(spark, d):
    rows = fr.telemetry(spark, d).where(~qc.exclusion())
    return spatial.pair_correlation(rows, fr.graph(spark, 3), "pressure_hpa").select("station_id", "neighbor_id", R(F.col("r")).alias("r"), "n")


@query("jn18_asof_latest", fr.KEPT + fr.GRAPH + """SELECT t.station_id, g.neighbor_id, t.timestamp,
  (SELECT arg_max(k.temperature_c, k.timestamp) FROM kept k WHERE k.station_id = g.neighbor_id AND (k.timestamp < t.timestamp OR (k.timestamp = t.timestamp AND k.station_id < t.station_id))) AS latest
  FROM tel t JOIN graph g ON t.station_id = g.station_id""")
def jn18(spark, d):
    return spatial.latest_known(fr.telemetry(spark, d), fr.graph(spark), ~qc.exclusion(), "temperature_c", "latest").select("station_id", "neighbor_id", "timestamp", "latest")


@query("jn19_concurrent_peers", fr.TEL + "SELECT a.station_id, a.timestamp, count(b.station_id) AS n_peers FROM tel a JOIN tel b ON a.timestamp = b.timestamp AND a.station_id <> b.station_id AND b.temperature_c IS NOT NULL GROUP BY a.station_id, a.timestamp")
def jn19(spark, d):
    t = fr.telemetry(spark, d)
    near = spatial.peers(t, t.where("temperature_c is not null"), fr.graph(spark, 3), ["temperature_c"])
    return near.groupBy(*K).agg(count_all().alias("n_peers"))


@query("jn20_corrections", fr.QC + fr.GRAPH + """SELECT q.station_id, q.timestamp, round(quantile_cont(t.temperature_c, 0.5), 2) AS t, round(quantile_cont(t.pressure_hpa, 0.5), 2) AS p, round(quantile_cont(t.humidity_pct, 0.5), 2) AS rh
  FROM qc q JOIN graph g ON q.station_id = g.station_id JOIN tel t ON t.station_id = g.neighbor_id AND t.timestamp = q.timestamp WHERE q.is_flagged GROUP BY q.station_id, q.timestamp""")
def jn20(spark, d):
    t = qc.rule_qc(fr.telemetry(spark, d))
    made = spatial.corrections(t, t, fr.graph(spark), F.col("is_flagged"))
    x = F.from_json("corrected_value_suggestion", "temperature_c double, pressure_hpa double, humidity_pct double")
    return made.select(*K, x["temperature_c"].alias("t"), x["pressure_hpa"].alias("p"), x["humidity_pct"].alias("rh"))


@query("set1_union_all", fr.TEL + "SELECT station_id, count(*) AS n FROM (SELECT station_id FROM tel UNION ALL SELECT station_id FROM tel WHERE is_anomaly) GROUP BY station_id")
def set1(spark, d):
    t = fr.telemetry(spark, d)
    return t.select("station_id").unionByName(t.where("is_anomaly").select("station_id")).groupBy("station_id").agg(count_all().alias("n"))


@query("set2_key_diff", fr.QC + """, f AS (SELECT station_id, timestamp FROM qc WHERE is_flagged), r AS (SELECT station_id, timestamp FROM tel WHERE is_anomaly)
  SELECT 'both' AS side, count(*) AS n FROM (SELECT * FROM f INTERSECT SELECT * FROM r) UNION ALL SELECT 'flag_only', count(*) FROM (SELECT * FROM f EXCEPT SELECT * FROM r)""")
def set2(spark, d):
    t = qc.rule_qc(fr.telemetry(spark, d))
    f, r = t.where("is_flagged").select(*K), t.where("is_anomaly").select(*K)
    return f.intersect(r).agg(F.lit("both").alias("side"), count_all().alias("n")).unionByName(f.subtract(r).agg(F.lit("flag_only").alias("side"), count_all().alias("n")))


@query("set3_dedup_keys", fr.TEL + "SELECT station_id, timestamp, max(pressure_hpa) AS p FROM (SELECT * FROM tel UNION ALL SELECT * FROM tel) GROUP BY station_id, timestamp")
def set3(spark, d):
    t = fr.telemetry(spark, d)
    return t.unionByName(t).groupBy(*K).agg(F.max("pressure_hpa").alias("p"))


@query("srt3_largest_drops", fr.FEAT + 'SELECT station_id, timestamp, round("delta_T", 6) AS drop_t FROM feat WHERE "delta_T" IS NOT NULL ORDER BY "delta_T", station_id, timestamp LIMIT 5')
def srt3(spark, d):
    return fr.deltas(spark, d).where("delta_T is not null").orderBy("delta_T", *K).limit(5).select(*K, R(F.col("delta_T")).alias("drop_t"))


@query("srt6_argmax_rows", fr.KEPT + "SELECT station_id, arg_max(timestamp, temperature_c) AS hottest, arg_min(timestamp, pressure_hpa) AS deepest FROM kept GROUP BY station_id")
def srt6(spark, d):
    return fr.telemetry(spark, d).where(~qc.exclusion()).groupBy("station_id").agg(F.max_by("timestamp", "temperature_c").alias("hottest"), F.min_by("timestamp", "pressure_hpa").alias("deepest"))


@query("prj9_row_slice", fr.TEL + "SELECT station_id, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY timestamp) - 1 AS i FROM tel) WHERE i >= 100 AND i < 150")
def prj9(spark, d):
    i = F.row_number().over(Window.partitionBy("station_id").orderBy("timestamp")) - 1
    return fr.telemetry(spark, d).withColumn("i", i).where("i >= 100 and i < 150").select(*K)
