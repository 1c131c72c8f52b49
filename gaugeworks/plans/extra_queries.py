"""Variants of lookups, samples, sorts and model audits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features, fusion, ml, qc, spatial, stats
from . import fragments as fr
from . import telemetry as tel
from .model_queries import CLASS_WEIGHTS, CLASSIFIER, _classified
from .registry import query

R = lambda c, n=6: F.round(c, n)
count_all = lambda: F.count(F.lit(1))
K = ["station_id", "timestamp"]

#: Oracle text of a distance by one (key, hour) level.
LEVEL = """, cv AS (SELECT {key} AS key, hour(timestamp) AS hr, avg(temperature_c) AS m0, avg(pressure_hpa) AS m1, avg(humidity_pct) AS m2,
  covar_samp(temperature_c, temperature_c) + 1e-4::DOUBLE AS a, covar_samp(temperature_c, pressure_hpa) AS b, covar_samp(temperature_c, humidity_pct) AS d,
  covar_samp(pressure_hpa, pressure_hpa) + 1e-4::DOUBLE AS e, covar_samp(pressure_hpa, humidity_pct) AS f, covar_samp(humidity_pct, humidity_pct) + 1e-4::DOUBLE AS i FROM normal GROUP BY ALL HAVING count(*) >= 5),
dz AS (SELECT t.station_id, t.timestamp, CASE WHEN temperature_c IS NULL OR pressure_hpa IS NULL OR humidity_pct IS NULL THEN 0 WHEN a IS NULL THEN {default} ELSE sqrt(greatest(0.0::DOUBLE,
  ((e * i - f * f) * pow(temperature_c - m0, 2) + (a * i - d * d) * pow(pressure_hpa - m1, 2) + (a * e - b * b) * pow(humidity_pct - m2, 2) + 2 * (d * f - b * i) * (temperature_c - m0) * (pressure_hpa - m1)
   + 2 * (b * f - d * e) * (temperature_c - m0) * (humidity_pct - m2) + 2 * (b * d - a * f) * (pressure_hpa - m1) * (humidity_pct - m2)) / (a * (e * i - f * f) + b * (d * f - b * i) + d * (b * f - d * e)))) END AS dist
  FROM tel t LEFT JOIN cv ON cv.key = t.{key} AND cv.hr = hour(t.timestamp){only})
"""


def _level(spark, d, key, default=None, where="true"):
    t = fr.telemetry(spark, d).withColumn("hr", F.hour("timestamp"))
    model = stats.covariance_model(t.where(qc.normal_training()), [key, "hr"])
    return stats.mahalanobis(t.where(where), [(model, [key, "hr"])], default).select(*K, R(F.col("mahalanobis_dist"), 4).alias("dist"))


@query("jn9_stream_lookup", fr.KEPT + LEVEL.format(key="station_id", default="1.5", only="") + "SELECT station_id, timestamp, round(dist, 4) AS dist FROM dz")
def jn9(spark, d):
    return _level(spark, d, "station_id", 1.5)


@query("jn10_zone_lookup", fr.KEPT + LEVEL.format(key="climate_zone", default="NULL", only=" WHERE t.station_id = 'ST_3'") + "SELECT station_id, timestamp, round(dist, 4) AS dist FROM dz")
def jn10(spark, d):
    return _level(spark, d, "climate_zone", None, "station_id = 'ST_3'")


@query("jn5_reference_choice", fr.TEL + """, u AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT timestamp FROM tel WHERE station_id <> 'ST_3')),
  s AS (SELECT t.*, CASE WHEN t.station_id = 'ST_3' THEN 'spatial_holdout' WHEN u.i < floor(u.n * 0.7) THEN 'train' WHEN u.i < floor(u.n * 0.85) THEN 'val' ELSE 'test' END AS split FROM tel t LEFT JOIN u USING (timestamp))
  SELECT a.split, count(*) AS n FROM s a JOIN s b ON a.timestamp = b.timestamp AND a.station_id <> b.station_id AND b.split <> 'spatial_holdout' AND b.temperature_c IS NOT NULL GROUP BY a.split""")
def jn5(spark, d):
    from ..sources import payloads

    s = payloads.split_rows(fr.telemetry(spark, d), ["ST_3"])
    near = spatial.peers(s, s.where("split <> 'spatial_holdout' and temperature_c is not null"), fr.graph(spark, 3), ["temperature_c"])
    return near.join(s.select(*K, "split"), K).groupBy("split").agg(count_all().alias("n"))


@query("jn21_aligned_flags", fr.TIER3 + "SELECT a.station_id, count(*) FILTER (WHERE a.if_flagged AND b.mahalanobis_flagged) AS n_both FROM t4 a JOIN t3 b ON a.station_id = b.station_id AND a.timestamp = b.timestamp GROUP BY a.station_id")
def jn21(spark, d):
    t3 = fr.tier3(spark, d)
    t2 = fusion.ensemble_flags(t3, 0.9, 1.2).select(*K, "if_flagged")
    return t2.join(t3.select(*K, "mahalanobis_flagged"), K).groupBy("station_id").agg(F.count_if(F.col("if_flagged") & F.col("mahalanobis_flagged")).alias("n_both"))


@query("prj5_rename_subset", fr.QC + "SELECT station_id, timestamp, is_flagged AS tier1_flagged, flag_reason AS tier1_reason FROM qc")
def prj5(spark, d):
    return qc.rule_qc(fr.telemetry(spark, d)).withColumnsRenamed({"is_flagged": "tier1_flagged", "flag_reason": "tier1_reason"}).select(*K, "tier1_flagged", "tier1_reason")


@query("prj10_metadata_labels", fr.TEL + "SELECT e.event_id, st.station_id, st.climate_zone, st.altitude_m FROM events e JOIN st ON st.station_id = 'ST_' || CAST(e.user_id % 4 AS VARCHAR) WHERE e.event_type = 'error'")
def prj10(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'error'").select("event_id", F.concat(F.lit("ST_"), (F.col("user_id") % 4).cast("string")).alias("station_id"))
    return e.join(F.broadcast(tel.stations(spark).select("station_id", "climate_zone", "altitude_m")), "station_id")


@query("srt1_station_time_sort", fr.TEL + "SELECT station_id, timestamp, row_number() OVER (PARTITION BY station_id ORDER BY timestamp) AS place FROM tel")
def srt1(spark, d):
    return fr.telemetry(spark, d).select(*K, F.row_number().over(features.per_station()).cast("long").alias("place"))


@query("srt5_tail_rows", fr.TEL + "SELECT station_id, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY timestamp DESC) AS b FROM tel) WHERE b <= 10")
def srt5(spark, d):
    back = Window.partitionBy("station_id").orderBy(F.col("timestamp").desc())
    return fr.telemetry(spark, d).withColumn("b", F.row_number().over(back)).where("b <= 10").select(*K)


@query("str4_full_path_latest", fr.KEPT + fr.GRAPH + """, seen AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY timestamp) AS i FROM tel),
  src AS (SELECT s.* FROM seen s JOIN kept k USING (station_id, timestamp) WHERE i > 24)
  SELECT t.station_id, t.timestamp, (SELECT arg_max(s.temperature_c, s.timestamp) FROM src s JOIN graph g ON g.station_id = t.station_id AND g.rank = 1 AND s.station_id = g.neighbor_id
    WHERE s.timestamp < t.timestamp OR (s.timestamp = t.timestamp AND s.station_id < t.station_id)) AS latest FROM tel t""")
def str4(spark, d):
    t = fr.telemetry(spark, d).withColumn("i", F.row_number().over(features.per_station()))
    return spatial.latest_known(t, fr.graph(spark, 1), (F.col("i") > 24) & ~qc.exclusion(), "temperature_c", "latest").select(*K, "latest")


@query("str6_neighbour_fallback", fr.BUDDY + "SELECT f.station_id, count(*) AS n, count(*) FILTER (WHERE nt IS NULL) AS fallback FROM feat f LEFT JOIN near USING (station_id, timestamp) GROUP BY f.station_id")
def str6(spark, d):
    rows = fr.deltas(spark, d)
    near = spatial.peers(rows, fr.telemetry(spark, d).where(qc.clean_reference()), fr.graph(spark), ["temperature_c"]).select(*K).distinct().withColumn("have", F.lit(True))
    return rows.join(near, K, "left").groupBy("station_id").agg(count_all().alias("n"), F.count_if(F.col("have").isNull()).alias("fallback"))


@query("agg27_mean_attribution")
def agg27(spark, d):
    typed, model, base = _classified(spark, d)

    def run(batches):
        for b in batches:
            x = b[CLASSIFIER].to_numpy(float)
            phi = ml.shapley(lambda z: model.margin(z)[:, model.classes.index("normal")], x, base)
            yield b[["zone"]].assign(**{f"phi_{c}": phi[:, i] for i, c in enumerate(CLASSIFIER)})

    zones = typed.join(F.broadcast(tel.stations(spark).select("station_id", F.col("climate_zone").alias("zone"))), "station_id")
    made = zones.select("zone", *CLASSIFIER).mapInPandas(run, "zone string, " + ", ".join(f"phi_{c} double" for c in CLASSIFIER))
    return made.groupBy("zone").agg(*[R(F.avg(f"phi_{c}"), 5).alias(f"phi_{c}") for c in CLASSIFIER])


@query("ml6_upweighting")
def ml6(spark, d):
    """False alarms and misses of the classifier as the weight of rare classes grows."""
    typed, _, _ = _classified(spark, d)
    rows = ml.bounded_sample(typed, [*CLASSIFIER, "truth"], K, 3000)
    x, truth = rows[CLASSIFIER].to_numpy(float), rows["truth"].to_numpy()
    models = {w: ml.MetaClassifier(x, truth.tolist(), {k: v * w if k != "normal" else v for k, v in CLASS_WEIGHTS.items()}, rounds=100) for w in (1, 5, 20, 50, 100)}

    def run(batches):
        import pandas as pd

        for b in batches:
            z = b[CLASSIFIER].to_numpy(float)
            for w, m in models.items():
                guess = np.array(m.classes)[m.probabilities(z).argmax(1)]
                yield pd.DataFrame({"weight": w, "false_alarm": ((guess != "normal") & (b["truth"] == "normal")).astype(int), "missed": ((guess == "normal") & (b["truth"] != "normal")).astype(int)})

    made = typed.select(*CLASSIFIER, "truth").mapInPandas(run, "weight int, false_alarm int, missed int")
    return made.groupBy("weight").agg(F.sum("false_alarm").alias("false_alarms"), F.sum("missed").alias("missed"), count_all().alias("n"))


@query("ml9_middle_samples", fr.TIER3 + """SELECT kind, station_id, timestamp FROM (SELECT anomaly_type AS kind, station_id, timestamp, row_number() OVER w AS i, count(*) OVER (PARTITION BY anomaly_type) AS n FROM t6 WHERE fusion_flagged AND anomaly_type IS NOT NULL
  WINDOW w AS (PARTITION BY anomaly_type ORDER BY station_id, timestamp)) WHERE i = n // 2 + 1""")
def ml9(spark, d):
    rows = fr.tier4_typed(spark, d).where("fusion_flagged and anomaly_type is not null")
    # Counts by type come from an aggregate; the rank needs the type's rows in order.
    sizes = rows.groupBy("anomaly_type").agg(count_all().alias("n"))
    order = Window.partitionBy("anomaly_type").orderBy(*K)
    ranked = rows.withColumn("i", F.row_number().over(order)).join(F.broadcast(sizes), "anomaly_type")
    return ranked.where("i = int(n / 2) + 1").select(F.col("anomaly_type").alias("kind"), *K)
