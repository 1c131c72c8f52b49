"""Consistency flags, reconciliation of tiers, the gated rule and routing. Unknown flags count as false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .qc import flag

# Thresholds, and the types that reasons and routes stand for.
THRESHOLDS = {"mahalanobis": 6.5, "buddy": 2.0, "peer": 2.0}
REASON_TYPE = {"sentinel_value": "data_corruption", "communication_dropout": "communication_dropout", "range_violation": "data_corruption"}
SECOND_TRACK = ["calibration_drift", "cross_sensor_inconsistency", "frozen_sensor"]
GLITCHES = ["power_fluctuation_glitch", "spike_or_drop"]


def consistency_flags(df: DataFrame, thresholds: dict = THRESHOLDS, check_dew_point: bool = True, tolerance: float = 0.5) -> DataFrame:
    """Distance, dew point, neighbour and isolation flags; the temperature test against the neighbour has no absolute value."""
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
    out = df.withColumn("mahalanobis_flagged", flag(have("mahalanobis_dist") > thresholds["mahalanobis"]))
    dew = flag(have("dew_point_margin") < -tolerance) if check_dew_point else F.lit(False)
    out = out.withColumn("dew_point_flagged", dew).withColumn("tier3_multivariate_flagged", F.col("mahalanobis_flagged") | F.col("dew_point_flagged"))
    buddy = flag(have("delta_T_buddy_scaled") > thresholds["peer"]) | flag(F.abs(have("delta_P_cluster_scaled")) > thresholds["peer"])
    own = flag(F.abs(have("delta_T_scaled")) > thresholds["buddy"]) | flag(F.abs(have("delta_P_scaled")) > thresholds["buddy"])
    return out.withColumn("buddy_flagged", buddy).withColumn("isolated_deviation", own & F.col("buddy_flagged"))


def ensemble_flags(df: DataFrame, if_threshold: float, gru_threshold: float) -> DataFrame:
    out = df.withColumns({"if_flagged": flag(F.col("if_score") >= if_threshold), "gru_flagged": flag(F.col("gru_score") >= gru_threshold)})
    return out.withColumn("ensemble_flagged", F.col("if_flagged") | F.col("gru_flagged"))


def reconcile(tier1: DataFrame, tier2: DataFrame, tier3: DataFrame) -> DataFrame:
    """Every tier 1 row, with what tiers 2 and 3 (full outer) say of it."""
    keys = ["station_id", "timestamp"]
    both = tier2.join(tier3, keys, "full_outer")
    named = tier1.withColumnsRenamed({"is_flagged": "tier1_flagged", "flag_reason": "tier1_reason"})
    return named.join(both, keys, "left").withColumn("tier_coverage", F.when(F.col("gru_score").isNotNull(), "full").otherwise("tier1_only"))


def gated_rule(df: DataFrame) -> DataFrame:
    """Tier 1 always confirms; tiers 2 and 3 only where the deviation is isolated, and are suppressed where it is known not to be."""
    t1 = flag(F.col("tier1_flagged"))
    t2, t3 = flag(F.col("if_flagged")) | flag(F.col("gru_flagged")), flag(F.col("mahalanobis_flagged")) | flag(F.col("buddy_flagged"))
    isolated, shared = flag(F.col("isolated_deviation")), flag(~F.col("isolated_deviation"))
    return df.withColumns({
        "hard_rule_flagged": t1 | ((t2 | t3) & isolated), "hard_rule_t2_suppressed": t2 & shared, "hard_rule_t3_suppressed": t3 & shared,
        "hard_rule_suppressed": (t2 | t3) & shared, "insufficient_context": flag(F.col("tier_coverage") == "tier1_only") & ~t1,
    })


def upstream_fired() -> Column:
    return flag(F.col("tier1_flagged")) | flag(F.col("if_flagged")) | flag(F.col("gru_flagged")) | flag(F.col("mahalanobis_flagged")) | flag(F.col("buddy_flagged"))


def fused_type(df: DataFrame, predicted: Column) -> DataFrame:
    """fusion_predicted_type: the classifier's where coverage is full, else the tier 1 reason's type, else insufficient_context."""
    mapping = F.create_map(*[F.lit(x) for kv in REASON_TYPE.items() for x in kv])
    t1 = flag(F.col("tier1_flagged"))
    kind = F.when(F.col("tier_coverage") == "full", predicted).when(t1, F.coalesce(F.try_element_at(mapping, F.col("tier1_reason")), F.lit("data_corruption"))).otherwise("insufficient_context")
    return df.withColumn("fusion_predicted_type", kind).withColumn(
        "fusion_flagged", F.when(F.col("tier_coverage") == "full", F.col("fusion_predicted_type") != "normal").otherwise(t1)
    )


def route(df: DataFrame) -> DataFrame:
    """Two-track decision from hard_rule_flagged, hard_rule_suppressed, predicted, confidence, p_normal and gru_score."""
    kind, sure = F.col("predicted"), F.col("confidence")
    hard, free = F.col("hard_rule_flagged"), ~F.col("hard_rule_suppressed")
    second, glitch = kind.isin(SECOND_TRACK) & free, kind.isin(GLITCHES) & free
    pick = lambda anomaly, track, name, p, penalty: F.struct(F.lit(anomaly).alias("is_anomaly_out"), F.lit(track).alias("which_track"), name.alias("predicted_type"), p.alias("route_confidence"), F.lit(penalty).alias("penalty"))
    named = F.when(kind.isin(GLITCHES), kind).when(F.col("gru_score") > 5.0, "spike_or_drop").otherwise("power_fluctuation_glitch")
    first = pick(True, "1", named, F.when(kind.isin(GLITCHES), sure).otherwise(0.95), 25.0)
    out = F.when(hard, first).when(second, pick(True, "2", kind, sure, 15.0)).when(glitch, pick(True, "2", kind, sure, 10.0)).otherwise(pick(False, "1", F.lit("normal"), F.col("p_normal"), 0.0))
    return df.withColumn("_r", out).select(*df.columns, "_r.*")


def pseudo_scores(df: DataFrame) -> DataFrame:
    """Stand-in tier 2 scores from the deltas, for plans that run without fitted models."""
    return df.withColumns({"if_score": F.round(F.abs("delta_T") / 40, 6), "gru_score": F.round(F.abs("delta_P") / 20, 6)})
