"""Exploratory statistics."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features, qc, spatial, stats
from . import fragments as fr
from . import telemetry as tel
from .registry import query
from .signal_queries import EVENT_SQL, events

R = lambda c, n=6: F.round(c, n)
count_all = lambda: F.count(F.lit(1))
K = ["station_id", "timestamp"]


def _kept(spark, d):
    return fr.telemetry(spark, d).where(~qc.exclusion())


@query("agg1_volatility_baseline", fr.KEPT + "SELECT station_id, round(stddev_samp(temperature_c), 6) AS t, round(stddev_samp(pressure_hpa), 6) AS p, round(stddev_samp(humidity_pct), 6) AS rh FROM normal GROUP BY station_id")
def agg1(spark, d):
    b = stats.volatility_baselines(fr.telemetry(spark, d).where(qc.normal_training()))
    return b.select("station_id", R(F.col("base_T")).alias("t"), R(F.col("base_P")).alias("p"), R(F.col("base_RH")).alias("rh"))


@query("agg3_zone_covariance", fr.KEPT + "SELECT climate_zone, hour(timestamp) AS hr, count(*) AS n, round(avg(temperature_c), 5) AS m0, round(avg(humidity_pct), 5) AS m2 FROM normal GROUP BY ALL HAVING count(*) >= 5")
def agg3(spark, d):
    m = stats.covariance_model(fr.telemetry(spark, d).where(qc.normal_training()).withColumn("hr", F.hour("timestamp").cast("long")), ["climate_zone", "hr"])
    return m.select("climate_zone", "hr", "n", R(F.col("mu")[0], 5).alias("m0"), R(F.col("mu")[2], 5).alias("m2"))


@query("agg4_station_distance", fr.KEPT + """, cov AS (SELECT station_id, avg(temperature_c) AS m0, avg(pressure_hpa) AS m1, avg(humidity_pct) AS m2,
  covar_samp(temperature_c, temperature_c) + 1e-6::DOUBLE AS a, covar_samp(temperature_c, pressure_hpa) AS b, covar_samp(temperature_c, humidity_pct) AS d,
  covar_samp(pressure_hpa, pressure_hpa) + 1e-6::DOUBLE AS e, covar_samp(pressure_hpa, humidity_pct) AS f, covar_samp(humidity_pct, humidity_pct) + 1e-6::DOUBLE AS i FROM normal GROUP BY station_id),
  x AS (SELECT k.station_id, coalesce(anomaly_type, 'normal') AS kind, sqrt(greatest(0.0::DOUBLE, ((e * i - f * f) * u * u + (a * i - d * d) * v * v + (a * e - b * b) * z * z + 2 * (d * f - b * i) * u * v + 2 * (b * f - d * e) * u * z + 2 * (b * d - a * f) * v * z)
    / (a * (e * i - f * f) + b * (d * f - b * i) + d * (b * f - d * e)))) AS dist FROM (SELECT k.*, c.* EXCLUDE (station_id), temperature_c - m0 AS u, pressure_hpa - m1 AS v, humidity_pct - m2 AS z FROM kept k JOIN cov c ON c.station_id = k.station_id) k)
  SELECT kind, count(*) AS n, round(avg(dist), 4) AS mean_dist, round(quantile_cont(dist, 0.95), 4) AS p95 FROM x GROUP BY kind""")
def agg4(spark, d):
    model = stats.covariance_model(fr.telemetry(spark, d).where(qc.normal_training()), ["station_id"], ridge=1e-6, least=10)
    x = stats.mahalanobis(_kept(spark, d), [(model, ["station_id"])]).groupBy(F.coalesce("anomaly_type", F.lit("normal")).alias("kind"))
    return x.agg(count_all().alias("n"), R(F.avg("mahalanobis_dist"), 4).alias("mean_dist"), R(F.percentile("mahalanobis_dist", F.lit(0.95)), 4).alias("p95"))


SCALED = ["temperature_c", "pressure_hpa", "humidity_pct"]


@query("agg5_scaler", fr.KEPT + "SELECT 'temperature_c' AS feature, round(avg(temperature_c), 6) AS mean, round(stddev_pop(temperature_c), 6) AS std FROM normal UNION ALL SELECT 'pressure_hpa', round(avg(pressure_hpa), 6), round(stddev_pop(pressure_hpa), 6) FROM normal UNION ALL SELECT 'humidity_pct', round(avg(humidity_pct), 6), round(stddev_pop(humidity_pct), 6) FROM normal")
def agg5(spark, d):
    return stats.scaler(fr.telemetry(spark, d).where(qc.normal_training()), SCALED).select("feature", R(F.col("mean")).alias("mean"), R(F.col("std")).alias("std"))


@query("prj3_scale_apply", fr.KEPT + ", s AS (SELECT avg(temperature_c) AS m, stddev_pop(temperature_c) AS s FROM normal) SELECT station_id, timestamp, round((temperature_c - m) / s, 5) AS scaled FROM kept, s")
def prj3(spark, d):
    fitted = stats.scaler(fr.telemetry(spark, d).where(qc.normal_training()), ["temperature_c"])
    return stats.scale(_kept(spark, d), fitted).select(*K, R(F.col("temperature_c_scaled"), 5).alias("scaled"))


@query("prj4_fixed_rescale", fr.DIST + "SELECT station_id, timestamp, round((mahalanobis_dist - 1.5606) / 0.7397, 4) AS rescaled FROM dist WHERE station_id = 'ST_3'")
def prj4(spark, d):
    return fr.distances(spark, d).where("station_id = 'ST_3'").select(*K, R((F.col("mahalanobis_dist") - 1.5606) / 0.7397, 4).alias("rescaled"))


@query("prj6_coverage", fr.TIER3 + "SELECT tier_coverage, count(*) AS n FROM t4 GROUP BY tier_coverage")
def prj6(spark, d):
    return fr.tier4(spark, d).groupBy("tier_coverage").agg(count_all().alias("n"))


@query("agg10_class_balance", fr.TEL + "SELECT anomaly_type, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM tel)::DOUBLE, 6) AS pct FROM tel GROUP BY anomaly_type")
def agg10(spark, d):
    t = fr.telemetry(spark, d)
    total = t.agg(count_all().alias("_n"))
    return t.groupBy("anomaly_type").agg(count_all().alias("n")).crossJoin(F.broadcast(total)).select("anomaly_type", "n", R(100 * F.col("n") / F.col("_n")).alias("pct"))


@query("agg11_missingness", fr.TEL + """SELECT coalesce(anomaly_type, 'normal') AS kind, count(*) FILTER (WHERE temperature_c IS NULL) AS t, count(*) FILTER (WHERE pressure_hpa IS NULL) AS p,
  count(*) FILTER (WHERE temperature_c IS NULL AND pressure_hpa IS NULL AND humidity_pct IS NULL) AS everything FROM tel GROUP BY 1""")
def agg11(spark, d):
    null = lambda c: F.col(c).isNull()
    return fr.telemetry(spark, d).groupBy(F.coalesce("anomaly_type", F.lit("normal")).alias("kind")).agg(
        F.count_if(null("temperature_c")).alias("t"), F.count_if(null("pressure_hpa")).alias("p"), F.count_if(reduce(lambda a, b: a & b, [null(c) for c in SCALED])).alias("everything"))


@query("agg12_describe", fr.KEPT + """, l AS (SELECT unnest(['temperature_c', 'pressure_hpa', 'humidity_pct']) AS sensor, unnest([temperature_c, pressure_hpa, humidity_pct]) AS v FROM kept)
  SELECT sensor, count(v) AS n, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS std, round(min(v), 5) AS min, round(quantile_cont(v, 0.25), 5) AS q25, round(quantile_cont(v, 0.5), 5) AS median, round(quantile_cont(v, 0.75), 5) AS q75,
  round(max(v), 5) AS max, round(skewness(v), 5) AS skew, round(kurtosis(v), 4) AS kurtosis FROM l GROUP BY sensor""")
def agg12(spark, d):
    x = stats.describe(_kept(spark, d), SCALED)
    return x.select("sensor", "n", *[R(F.col(c), 4 if c == "kurtosis" else 5).alias(c) for c in ("mean", "std", "min", "q25", "median", "q75", "max", "skew", "kurtosis")])


@query("agg13_correlations", fr.KEPT + "SELECT is_anomaly, round(corr(temperature_c, pressure_hpa), 6) AS tp, round(corr(temperature_c, humidity_pct), 6) AS trh, round(corr(pressure_hpa, humidity_pct), 6) AS prh FROM kept GROUP BY is_anomaly")
def agg13(spark, d):
    return _kept(spark, d).groupBy("is_anomaly").agg(R(F.corr("temperature_c", "pressure_hpa")).alias("tp"), R(F.corr("temperature_c", "humidity_pct")).alias("trh"), R(F.corr("pressure_hpa", "humidity_pct")).alias("prh"))


@query("agg15_zscore_global", fr.KEPT + """, s AS (SELECT avg(temperature_c) AS mt, stddev_pop(temperature_c) AS st_, avg(pressure_hpa) AS mp, stddev_pop(pressure_hpa) AS sp FROM kept)
  SELECT station_id, count(*) AS n FROM kept, s WHERE abs((temperature_c - mt) / st_) > 3 OR abs((pressure_hpa - mp) / sp) > 3 GROUP BY station_id""")
def agg15(spark, d):
    return stats.outliers_by_z(_kept(spark, d), SCALED[:2], by_station=False).where("z_outlier").groupBy("station_id").agg(count_all().alias("n"))


@query("agg15_zscore_station", fr.KEPT + """, s AS (SELECT station_id AS sid, avg(temperature_c) AS mt, stddev_samp(temperature_c) AS st_ FROM kept GROUP BY station_id)
  SELECT station_id, count(*) AS n FROM kept JOIN s ON sid = station_id WHERE abs((temperature_c - mt) / st_) > 3 GROUP BY station_id""")
def agg15b(spark, d):
    return stats.outliers_by_z(_kept(spark, d), SCALED[:1], by_station=True).where("z_outlier").groupBy("station_id").agg(count_all().alias("n"))


@query("agg16_iqr", fr.KEPT + """, q AS (SELECT station_id AS sid, quantile_cont(pressure_hpa, 0.25) AS lo, quantile_cont(pressure_hpa, 0.75) AS hi FROM kept GROUP BY station_id)
  SELECT station_id, count(*) AS n FROM kept JOIN q ON sid = station_id WHERE pressure_hpa < lo - 1.5 * (hi - lo) OR pressure_hpa > hi + 1.5 * (hi - lo) GROUP BY station_id""")
def agg16(spark, d):
    return stats.outliers_by_iqr(_kept(spark, d), ["pressure_hpa"]).where("iqr_outlier").groupBy("station_id").agg(count_all().alias("n"))


@query("agg17_footprints", fr.FEAT + """SELECT coalesce(anomaly_type, 'normal') AS kind, count(*) AS n, round(avg(abs("delta_T")), 5) AS mean_step, round(CASE WHEN anomaly_type IS NULL THEN quantile_cont(abs("delta_T"), 0.999) ELSE max(abs("delta_T")) END, 5) AS top_step FROM feat GROUP BY anomaly_type""")
def agg17(spark, d):
    step = F.abs("delta_T")
    x = fr.deltas(spark, d).groupBy("anomaly_type").agg(count_all().alias("n"), R(F.avg(step), 5).alias("mean_step"), F.percentile(step, F.lit(0.999)).alias("_p"), F.max(step).alias("_m"))
    return x.select(F.coalesce("anomaly_type", F.lit("normal")).alias("kind"), "n", "mean_step", R(F.when(F.col("anomaly_type").isNull(), F.col("_p")).otherwise(F.col("_m")), 5).alias("top_step"))


@query("agg19_monthly_rates", fr.QC + "SELECT station_id, month(timestamp) AS mo, round(avg(CAST(is_flagged AS INT)), 6) AS rate FROM qc GROUP BY ALL")
def agg19(spark, d):
    return qc.rule_qc(fr.telemetry(spark, d)).groupBy("station_id", F.month("timestamp").cast("long").alias("mo")).agg(R(F.avg(F.col("is_flagged").cast("int"))).alias("rate"))


@query("agg21_network_audit", fr.TEL + "SELECT n_faulty, count(*) AS n FROM (SELECT timestamp, count(DISTINCT station_id) FILTER (WHERE is_anomaly) AS n_faulty FROM tel GROUP BY timestamp) GROUP BY n_faulty")
def agg21(spark, d):
    x = fr.telemetry(spark, d).groupBy("timestamp").agg(F.countDistinct(F.when(F.col("is_anomaly"), F.col("station_id"))).alias("n_faulty"))
    return x.groupBy("n_faulty").agg(count_all().alias("n"))


@query("agg24_event_ranges", fr.KEPT + EVENT_SQL + "SELECT event_id, round(min(temperature_c), 5) AS lo, round(max(temperature_c), 5) AS hi, count(*) AS n FROM kept JOIN evt ON station_id = es AND timestamp BETWEEN t_start AND t_end GROUP BY event_id")
def agg24(spark, d):
    return spatial.event_rows(_kept(spark, d), events(spark)).groupBy("event_id").agg(R(F.min("temperature_c"), 5).alias("lo"), R(F.max("temperature_c"), 5).alias("hi"), count_all().alias("n"))


@query("agg29_holdout_mismatch", fr.KEPT + """SELECT hour(timestamp) AS hr, round(avg(temperature_c) FILTER (WHERE station_id = 'ST_3') - avg(temperature_c) FILTER (WHERE station_id <> 'ST_3'), 5) AS shift,
  round(covar_samp(CASE WHEN station_id = 'ST_3' THEN temperature_c END, CASE WHEN station_id = 'ST_3' THEN humidity_pct END), 4) AS cov FROM normal GROUP BY 1""")
def agg29(spark, d):
    held = F.col("station_id") == "ST_3"
    own = lambda c: F.when(held, F.col(c))
    x = fr.telemetry(spark, d).where(qc.normal_training()).groupBy(F.hour("timestamp").cast("long").alias("hr"))
    return x.agg(R(F.avg(own("temperature_c")) - F.avg(F.when(~held, F.col("temperature_c"))), 5).alias("shift"), R(F.covar_samp(own("temperature_c"), own("humidity_pct")), 4).alias("cov"))


@query("agg30_neighbour_agreement", fr.KEPT + fr.GRAPH + """, m AS (SELECT k.station_id, k.timestamp, k.pressure_hpa AS p, quantile_cont(r.pressure_hpa, 0.5) AS q FROM kept k JOIN graph g ON g.station_id = k.station_id JOIN ref r ON r.station_id = g.neighbor_id AND r.timestamp = k.timestamp GROUP BY ALL)
  SELECT station_id, round(corr(p, q), 6) AS r FROM m GROUP BY station_id""")
def agg30(spark, d):
    t = fr.telemetry(spark, d)
    near = spatial.peers(t, t.where(qc.clean_reference()), fr.graph(spark), ["pressure_hpa"]).groupBy(*K).agg(F.median("n_pressure_hpa").alias("q"))
    return _kept(spark, d).join(near, K).groupBy("station_id").agg(R(F.corr("pressure_hpa", "q")).alias("r"))


LAGS = 24


def autocorrelation(df, col: str, lags: int):
    """acf per station and lag, over positions; the denominator is the whole series', as usual for ACF estimates.

    One row explodes into `lags` + 1 keys of an equi-join.
    """
    order = Window.partitionBy("station_id").orderBy("timestamp")
    mean = F.avg(col).over(Window.partitionBy("station_id"))
    x = df.select("station_id", F.row_number().over(order).alias("i"), (F.col(col) - mean).alias("x"))
    ahead = x.select("station_id", "x", F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"), "i").withColumn("i", F.col("i") + F.col("lag"))
    prod = ahead.join(x.withColumnRenamed("x", "y"), ["station_id", "i"]).groupBy("station_id", "lag").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    base = prod.where("lag = 0").select("station_id", F.col("s").alias("b"))
    return prod.join(F.broadcast(base), "station_id").select("station_id", F.col("lag").cast("long").alias("lag"), (F.col("s") / F.col("b")).alias("acf"))


@query("agg31_acf", fr.KEPT + f""", c AS (SELECT station_id, row_number() OVER (PARTITION BY station_id ORDER BY timestamp) AS i, temperature_c - avg(temperature_c) OVER (PARTITION BY station_id) AS x FROM kept),
  s AS (SELECT a.station_id, b.i - a.i AS lag, sum(a.x * b.x) AS s FROM c a JOIN c b ON a.station_id = b.station_id AND b.i - a.i BETWEEN 0 AND {LAGS} GROUP BY ALL)
  SELECT s.station_id, s.lag, round(s.s / z.s, 6) AS acf FROM s JOIN s z ON z.station_id = s.station_id AND z.lag = 0""")
def agg31(spark, d):
    return autocorrelation(_kept(spark, d), "temperature_c", LAGS).select("station_id", "lag", R(F.col("acf")).alias("acf"))


def partial_autocorrelation(acf: np.ndarray) -> np.ndarray:
    """Levinson-Durbin recursion on acf[0..k]."""
    out, phi = [1.0], np.zeros(0)
    for k in range(1, len(acf)):
        last = (acf[k] - (phi @ acf[k - 1 : 0 : -1] if k > 1 else 0.0)) / (1 - (phi @ acf[1:k] if k > 1 else 0.0))
        phi = np.append(phi - last * phi[::-1], last)
        out.append(last)
    return np.array(out)


@query("agg32_pacf")
def agg32(spark, d):
    def run(pdf):
        pdf = pdf.sort_values("lag")
        return pdf[["station_id", "lag"]].assign(pacf=partial_autocorrelation(pdf["acf"].to_numpy()).round(6))

    return autocorrelation(_kept(spark, d), "temperature_c", LAGS).groupBy("station_id").applyInPandas(run, "station_id string, lag long, pacf double")


@query("agg33_first_attribute", fr.TEL + "SELECT station_id, min(climate_zone) AS zone, min(altitude_m) AS alt FROM tel GROUP BY station_id")
def agg33(spark, d):
    return fr.telemetry(spark, d).groupBy("station_id").agg(F.min_by("climate_zone", "timestamp").alias("zone"), F.min_by("altitude_m", "timestamp").alias("alt"))


@query("agg34_metadata", fr.TEL + """, s AS (SELECT date_diff('second', lag(timestamp) OVER (PARTITION BY station_id ORDER BY timestamp), timestamp) AS step FROM tel)
  SELECT count(*) AS n, min(timestamp) AS t0, max(timestamp) AS t1, count(DISTINCT station_id) AS n_stations, (SELECT quantile_cont(step, 0.5) FROM s) AS cadence_s FROM tel""")
def agg34(spark, d):
    t = fr.telemetry(spark, d)
    step = features.seconds_since(F.lag("timestamp").over(features.per_station()), F.col("timestamp"))
    return t.withColumn("step", step).agg(count_all().alias("n"), F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"), F.countDistinct("station_id").alias("n_stations"), F.median("step").alias("cadence_s"))


@query("gen7_event_reconstruction", fr.TEL + """SELECT station_id, anomaly_type, min(i) AS first_i, max(i) AS last_i FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY timestamp) - 1 AS i FROM tel) WHERE is_anomaly GROUP BY ALL""")
def gen7(spark, d):
    i = F.row_number().over(features.per_station()) - 1
    return fr.telemetry(spark, d).withColumn("i", i.cast("long")).where("is_anomaly").groupBy("station_id", "anomaly_type").agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"))
