"""Fitted statistics and aggregates: baselines, covariances, scalers, descriptions, outliers, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import physics
from .features import SHORT
from .qc import SENSORS

PAIRS = [("xx", 0, 0), ("xy", 0, 1), ("xz", 0, 2), ("yy", 1, 1), ("yz", 1, 2), ("zz", 2, 2)]


def volatility_baselines(normal: DataFrame) -> DataFrame:
    return normal.groupBy("station_id").agg(*[F.stddev_samp(c).alias(f"base_{s}") for c, s in SHORT.items()])


def covariance_model(normal: DataFrame, keys: list[str], ridge: float = 1e-4, least: int = 5) -> DataFrame:
    """Per key: n, mu (3), inv (9, row-major inverse of covariance + ridge). Keys with fewer rows than `least` are left out."""
    sums = normal.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(SENSORS)],
        *[F.covar_samp(SENSORS[i], SENSORS[j]).alias(f"_c{k}") for k, i, j in PAIRS],
    ).where(F.col("n") >= least)
    cov = {k: F.col(f"_c{k}") + (ridge if i == j else 0.0) for k, i, j in PAIRS}
    return sums.select(*keys, "n", F.array(*[F.col(f"_m{i}") for i in range(3)]).alias("mu"), F.array(*physics.inverse3(cov)).alias("inv"))


def distance(mu: Column, inv: Column) -> Column:
    d = [F.col(c) - mu[i] for i, c in enumerate(SENSORS)]
    return F.sqrt(physics.quadratic_form(d, [inv[i] for i in range(9)]))


def mahalanobis(df: DataFrame, models: list[tuple[DataFrame, list[str]]], default: float | None = None) -> DataFrame:
    """Adds mahalanobis_dist by the first of the (model, keys) that has an entry: broadcast joins and a coalesce.

    Rows with a null reading have distance 0; rows without any entry have `default`.
    """
    out = df
    for n, (model, keys) in enumerate(models):
        side = model.select(*[F.col(k).alias(f"_k{n}_{k}") for k in keys], F.struct("mu", "inv").alias(f"_e{n}"))
        test = F.lit(True)
        for k in keys:
            test = test & (F.col(k) == F.col(f"_k{n}_{k}"))
        out = out.join(F.broadcast(side), test, "left")
    e = F.coalesce(*[F.col(f"_e{n}") for n in range(len(models))])
    missing = F.col(SENSORS[0]).isNull() | F.col(SENSORS[1]).isNull() | F.col(SENSORS[2]).isNull()
    d = F.when(missing, 0.0).when(e.isNull(), F.lit(default)).otherwise(distance(e["mu"], e["inv"]))
    return out.withColumn("mahalanobis_dist", d).select(*df.columns, "mahalanobis_dist")


def scaler(normal: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, mean, std): population std, 1 where it is 0."""
    one = normal.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")).alias("std")) for c in cols
    ])).alias("x")).select("x.*")


def scale(df: DataFrame, fitted: DataFrame) -> DataFrame:
    """Adds <feature>_scaled; the fitted table is a few rows and joins as one."""
    names = [r["feature"] for r in fitted.select("feature").collect()]
    wide = fitted.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("_s"))
    return df.crossJoin(F.broadcast(wide)).withColumns({f"{c}_scaled": (F.col(c) - F.col("_s")[c]["mean"]) / F.col("_s")[c]["std"] for c in names}).drop("_s")


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: mean, std, min, quartiles, max, and bias-corrected skewness and kurtosis."""
    parts = None
    long = df.select(F.explode(F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c))])).alias("sensor", "value")).where("value is not null")
    n = F.count("value").cast("double")
    parts = long.groupBy("sensor").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.percentile("value", F.lit(0.25)).alias("q25"), F.percentile("value", F.lit(0.5)).alias("median"), F.percentile("value", F.lit(0.75)).alias("q75"), F.max("value").alias("max"),
        (F.skewness("value") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis("value") + 6)).alias("kurtosis"),
    )
    return parts


def outliers_by_iqr(df: DataFrame, cols: list[str], k: float = 1.5) -> DataFrame:
    """Adds iqr_outlier: any reading beyond k interquartile ranges of its station's quartiles."""
    q = df.groupBy("station_id").agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(f"_q_{c}") for c in cols])
    test = F.lit(False)
    for c in cols:
        lo, hi = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]
        test = test | F.coalesce((F.col(c) < lo - k * (hi - lo)) | (F.col(c) > hi + k * (hi - lo)), F.lit(False))
    return df.join(F.broadcast(q), "station_id").withColumn("iqr_outlier", test).select(*df.columns, "iqr_outlier")


def outliers_by_z(df: DataFrame, cols: list[str], by_station: bool, bound: float = 3.0) -> DataFrame:
    """Adds z_outlier. Over all rows the population std counts, by station the sample's."""
    std = F.stddev_samp if by_station else F.stddev_pop
    aggs = [F.avg(c).alias(f"_m_{c}") for c in cols] + [std(c).alias(f"_s_{c}") for c in cols]
    fitted = df.groupBy("station_id").agg(*aggs) if by_station else df.agg(*aggs)
    joined = df.join(F.broadcast(fitted), "station_id") if by_station else df.crossJoin(F.broadcast(fitted))
    test = F.lit(False)
    for c in cols:
        test = test | F.coalesce(F.abs((F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0))) > bound, F.lit(False))
    return joined.withColumn("z_outlier", test).select(*df.columns, "z_outlier")


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def confusion(df: DataFrame, truth: Column, guess: Column, keys: list[str] = ()) -> DataFrame:
    rows = df.select(*keys, truth.alias("_t"), guess.alias("_g"))
    c = rows.groupBy(*keys).agg(
        F.count_if(F.col("_t") & F.col("_g")).alias("tp"), F.count_if(~F.col("_t") & F.col("_g")).alias("fp"),
        F.count_if(F.col("_t") & ~F.col("_g")).alias("fn"), F.count_if(~F.col("_t") & ~F.col("_g")).alias("tn"),
    )
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumns({"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)})


def threshold_sweep(df: DataFrame, score: str, truth: str, steps: int = 100, lo: float = 0.95, hi: float = 0.999) -> DataFrame:
    """Candidate thresholds at equally spaced percentiles with their F1: one pass over the scores for each table.

    The candidates are few; each row is counted at the highest one it reaches, and running sums over the few
    candidates give the counts at or above each.
    """
    p = [lo + (hi - lo) * i / (steps - 1) for i in range(steps)]
    cuts = df.agg(F.percentile(score, F.array(*[F.lit(x) for x in p])).alias("c"))
    cand = cuts.select(F.posexplode("c").alias("step", "threshold"))
    hit = df.crossJoin(F.broadcast(cuts)).where(F.col(score).isNotNull()).select(F.col(truth).alias("_t"), F.size(F.filter("c", lambda x: x <= F.col(score))).alias("_k"))
    counts = hit.groupBy("_k").agg(F.count_if("_t").alias("_p"), F.count_if(~F.col("_t")).alias("_q"))
    all_ = counts.agg(F.sum("_p").alias("n_true"))
    sums = cand.join(F.broadcast(counts), F.col("_k") > F.col("step")).groupBy("step", "threshold").agg(F.sum("_p").alias("tp"), F.sum("_q").alias("fp"))
    return sums.crossJoin(F.broadcast(all_)).withColumn("f1", ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("n_true")))
