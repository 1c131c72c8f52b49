"""The row-at-a-time pipeline as keyed state, in Structured Streaming and as a batch replay with the same code.

Per station the state is the last `HISTORY` readings, the health index and the last time seen. Rows of a micro-batch are
taken in time order; rows older than the state are late: they are marked, and don't change it.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.health import health_step
from ..operators.qc import RANGES, SENSORS, STREAM_SENTINELS

HISTORY = 144
WARM_UP = 24
PENALTY = {"sentinel_value": 40.0, "range_violation": 40.0, "communication_dropout": 40.0}
OUT = "station_id string, timestamp timestamp_ntz, flag_reason string, coverage string, sensor_health_index double"


def fresh() -> dict:
    return {"history": [], "shi": 100.0, "last": None}


def check(reading: list[float], history: list[list[float | None]]) -> str | None:
    """The streaming rules on one reading and the readings before it."""
    for c, x in zip(SENSORS, reading):
        if x is None or np.isnan(x) or any(abs(x - s) < 0.01 for s in STREAM_SENTINELS[c]):
            return "sentinel_value"
    for c, x in zip(SENSORS, reading):
        low, high = RANGES[c]
        if not (-40.0 if c == "temperature_c" else low) <= x <= high:
            return "range_violation"
    if len(history) >= 2 and history[-1] == reading and history[-2] == reading:
        return "communication_dropout"
    return None


def process(state: dict, when: str, reading: list[float]) -> tuple[str | None, str, float]:
    """(reason, coverage, health) of one row; changes the state."""
    if state["last"] is not None and when <= state["last"]:
        return None, "late", state["shi"]
    reason = check(reading, state["history"])
    coverage = "tier1_only" if reason else "insufficient_context" if len(state["history"]) < WARM_UP else "full"
    state["shi"] = health_step(state["shi"], PENALTY.get(reason, 0.0))
    # Readings that aren't numbers are kept as unknown, so the next rows never compare with a sentinel.
    state["history"] = (state["history"] + [[None if reason == "sentinel_value" else x for x in reading]])[-HISTORY:]
    state["last"] = when
    return reason, coverage, state["shi"]


def _rows(state: dict, station: str, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("timestamp", kind="stable")
    out = [process(state, t.isoformat(), list(r)) for t, r in zip(pdf["timestamp"], pdf[SENSORS].to_numpy(float).tolist())]
    return pd.DataFrame({"station_id": station, "timestamp": pdf["timestamp"].to_numpy(), "flag_reason": [o[0] for o in out], "coverage": [o[1] for o in out], "sensor_health_index": [o[2] for o in out]})


def replay(df: DataFrame) -> DataFrame:
    """Batch equivalent: rows sorted by station and time, only the running station's state held."""

    def run(batches):
        station, state = None, fresh()
        for b in batches:
            parts = []
            for key, own in b.groupby("station_id", sort=False):
                if key != station:
                    station, state = key, fresh()
                parts.append(_rows(state, key, own))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    cols = ["station_id", "timestamp", *SENSORS]
    return df.select(*cols).repartition("station_id").sortWithinPartitions("station_id", "timestamp").mapInPandas(run, OUT)


def stateful(stream: DataFrame) -> DataFrame:
    """The same on a stream, with one JSON state a station."""

    def run(key, parts, state):
        held = json.loads(state.get[0]) if state.exists else fresh()
        pdf = pd.concat(list(parts), ignore_index=True)
        out = _rows(held, key[0], pdf)
        state.update((json.dumps(held),))
        yield out

    return stream.select("station_id", "timestamp", *SENSORS).groupBy("station_id").applyInPandasWithState(run, OUT, "body string", "append", "NoTimeout")


def deduplicated(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Watermark, and one row a station and time within it. Zoneless times are taken as the session zone's."""
    return stream.withColumn("_event", F.col("timestamp").cast("timestamp")).withWatermark("_event", late).dropDuplicatesWithinWatermark(["station_id", "_event"]).drop("_event")


def hourly_counts(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Readings and nulls per station in tumbling hours."""
    rows = stream.withColumn("_event", F.col("timestamp").cast("timestamp")).withWatermark("_event", late)
    return rows.groupBy("station_id", F.window("_event", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("temperature_c").isNull()).alias("n_null"))


def with_latest_neighbours(batch: DataFrame, known: DataFrame, graph: DataFrame) -> DataFrame:
    """For foreachBatch: each row with its nearest neighbour's latest known temperature.

    known: one row a station (station_id, timestamp, temperature_c), as of before this micro-batch.
    """
    out = batch.join(F.broadcast(graph.select("station_id", "neighbor_id", "rank")), "station_id").join(
        known.select(F.col("station_id").alias("neighbor_id"), F.col("temperature_c").alias("n_temperature_c")), "neighbor_id", "left"
    )
    return out.groupBy("station_id", "timestamp").agg(F.min_by("n_temperature_c", F.when(F.col("n_temperature_c").isNotNull(), F.col("rank"))).alias("neighbour_temperature_c"))


def latest_after(known: DataFrame, batch: DataFrame) -> DataFrame:
    """The next micro-batch's `known`: each station's latest non-null reading."""
    cols = ["station_id", "timestamp", "temperature_c"]
    rows = known.select(*cols).unionByName(batch.select(*cols)).where("temperature_c is not null")
    return rows.groupBy("station_id").agg(F.max("timestamp").alias("timestamp"), F.max_by("temperature_c", "timestamp").alias("temperature_c"))
