"""Neighbours: nearest stations, peers at the same time, latest known values, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics
from .features import per_station, seconds_since
from .qc import SENSORS


def station_pairs(stations: DataFrame) -> DataFrame:
    """Distances of all ordered pairs of the (small) station table."""
    a = stations.select("station_id", F.col("latitude").alias("_la"), F.col("longitude").alias("_lo"))
    b = stations.select(F.col("station_id").alias("neighbor_id"), F.col("latitude").alias("_lb"), F.col("longitude").alias("_lp"))
    return a.crossJoin(F.broadcast(b)).where("station_id <> neighbor_id").select(
        "station_id", "neighbor_id", physics.haversine_km(F.col("_la"), F.col("_lo"), F.col("_lb"), F.col("_lp")).alias("km")
    )


def nearest_stations(stations: DataFrame, k: int = 3, references: list[str] | None = None) -> DataFrame:
    pairs = station_pairs(stations)
    if references is not None:
        pairs = pairs.where(F.col("neighbor_id").isin(references))
    order = Window.partitionBy("station_id").orderBy("km", "neighbor_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def peers(df: DataFrame, reference: DataFrame, graph: DataFrame, cols: list[str]) -> DataFrame:
    """(station_id, timestamp, rank, n_<col>...): the neighbours' rows at the same time. Equi-joins only."""
    keys = df.select("station_id", "timestamp").join(F.broadcast(graph.select("station_id", "neighbor_id", "rank")), "station_id")
    ref = reference.select(F.col("station_id").alias("neighbor_id"), "timestamp", *[F.col(c).alias(f"n_{c}") for c in cols])
    return keys.join(ref, ["neighbor_id", "timestamp"])


def buddy_features(df: DataFrame, reference: DataFrame, graph: DataFrame) -> DataFrame:
    """delta_T_buddy: distance to the nearest neighbour that has a reading; delta_P_cluster: to the neighbours' median; 0 without."""
    near = peers(df, reference, graph, ["temperature_c", "pressure_hpa"]).groupBy("station_id", "timestamp").agg(
        F.min_by("n_temperature_c", F.when(F.col("n_temperature_c").isNotNull(), F.col("rank"))).alias("_t"), F.median("n_pressure_hpa").alias("_p")
    )
    return df.join(near, ["station_id", "timestamp"], "left").withColumns({
        "delta_T_buddy": F.coalesce(F.abs(F.col("temperature_c") - F.col("_t")), F.lit(0.0)),
        "delta_P_cluster": F.coalesce(F.col("pressure_hpa") - F.col("_p"), F.lit(0.0)),
    }).drop("_t", "_p")


def sea_level_buddies(df: DataFrame, reference: DataFrame, graph: DataFrame, std: float = 6.437047) -> DataFrame:
    """Residual of sea-level pressure against the neighbours' median, raw and scaled (not centred)."""
    msl = lambda d: d.withColumn("pressure_msl", physics.sea_level_pressure(F.col("pressure_hpa"), F.col("temperature_c"), F.col("humidity_pct"), F.coalesce("altitude_m", F.lit(100.0))))
    own = msl(df)
    near = peers(own, msl(reference), graph, ["pressure_msl"]).groupBy("station_id", "timestamp").agg(F.median("n_pressure_msl").alias("_p"))
    residual = F.coalesce(F.col("pressure_msl") - F.col("_p"), F.lit(0.0))
    return own.join(near, ["station_id", "timestamp"], "left").withColumns({"delta_P_cluster_msl": residual, "delta_P_cluster_msl_scaled": residual / std}).drop("_p")


def latest_known(df: DataFrame, graph: DataFrame, source: Column, col: str, out: str) -> DataFrame:
    """As-of join: each neighbour's latest reading among `source` rows before this row in (timestamp, station_id) order.

    Union and one window per (station, neighbour) pair; a row never meets more than its few neighbours.
    """
    ask = df.select("station_id", "timestamp").join(F.broadcast(graph.select("station_id", "neighbor_id", "rank")), "station_id").select(
        "station_id", "neighbor_id", "rank", "timestamp", F.col("station_id").alias("_who"), F.lit(None).cast("double").alias("_v"), F.lit(True).alias("_ask")
    )
    tell = df.where(source).join(F.broadcast(graph.select(F.col("station_id").alias("_to"), F.col("neighbor_id").alias("_from"), "rank")), F.col("station_id") == F.col("_from")).select(
        F.col("_to").alias("station_id"), F.col("_from").alias("neighbor_id"), "rank", "timestamp", F.col("_from").alias("_who"), F.col(col).alias("_v"), F.lit(False).alias("_ask")
    )
    order = Window.partitionBy("station_id", "neighbor_id").orderBy("timestamp", "_who").rowsBetween(Window.unboundedPreceding, -1)
    seen = ask.unionByName(tell).withColumn(out, F.last("_v", ignorenulls=True).over(order))
    return seen.where("_ask").select("station_id", "neighbor_id", "rank", "timestamp", out)


def corrections(df: DataFrame, reference: DataFrame, graph: DataFrame, wanted: Column) -> DataFrame:
    """corrected_value_suggestion: the neighbours' medians, rounded, as JSON with nulls, for wanted rows."""
    near = peers(df.where(wanted), reference, graph, SENSORS).groupBy("station_id", "timestamp").agg(*[F.round(F.median(f"n_{c}"), 2).alias(c) for c in SENSORS])
    return near.select("station_id", "timestamp", F.to_json(F.struct(*SENSORS), {"ignoreNullFields": "false"}).alias("corrected_value_suggestion"))


def event_rows(df: DataFrame, events: DataFrame) -> DataFrame:
    """Interval join with a small table (event_id, station_id, t_start, t_end)."""
    e = F.broadcast(events.withColumnRenamed("station_id", "_es"))
    return df.join(e, (F.col("station_id") == F.col("_es")) & F.col("timestamp").between(F.col("t_start"), F.col("t_end"))).drop("_es")


def pair_correlation(df: DataFrame, graph: DataFrame, col: str) -> DataFrame:
    rows = peers(df, df, graph, [col]).join(df.select("station_id", "timestamp", F.col(col).alias("_own")), ["station_id", "timestamp"])
    return rows.groupBy("station_id", "neighbor_id").agg(F.corr("_own", f"n_{col}").alias("r"), F.count(F.when(F.col("_own").isNotNull() & F.col(f"n_{col}").isNotNull(), 1)).alias("n"))


__all__ = ["buddy_features", "corrections", "event_rows", "latest_known", "nearest_stations", "pair_correlation", "peers", "per_station", "sea_level_buddies", "seconds_since", "station_pairs"]
