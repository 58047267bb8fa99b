"""Scored transactions and user risk profiles (reference step 7): P13, P15-P18, A6-A9, A21, W11, J1, J8."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import cut_lineage
from .ranks import percentile_scores


def score_transactions(eng: DataFrame, threshold: float = C.IMPULSE_THRESHOLD,
                       half_life: float = C.HALF_LIFE_DAYS, prob: str = "impulse_prob",
                       as_of=None) -> DataFrame:
    """P13 + P15: predicted flag, whole days before the reference time, recency weight.

    The reference time is the latest timestamp of the table (a one-row aggregate broadcast to every
    row, J8), or ``as_of`` (a naive datetime) when the caller knows it, which saves that scan."""
    if as_of is None:
        ref = eng.agg(F.max("timestamp").alias("_ref"))
    else:
        ref = eng.sparkSession.range(1).select(F.lit(as_of).cast("timestamp_ntz").alias("_ref"))
    out = eng.crossJoin(F.broadcast(ref)).withColumns({
        "impulse_pred": C.classify(F.col(prob), threshold),
        "days_ago": C.whole_days_between(F.col("_ref"), F.col("timestamp")),
    })
    return out.withColumn("decay_weight", C.decay_weight(F.col("days_ago"), half_life)).drop("_ref")


PROFILE_AGGS = [
    ("total_transactions", lambda: F.count("impulse_prob")),
    ("impulse_txn_count", lambda: F.sum("impulse_pred").cast("long")),
    ("raw_impulse_rate", lambda: F.avg("impulse_label")),
    ("pred_impulse_rate", lambda: F.avg("impulse_pred")),
    ("mean_impulse_prob", lambda: F.avg("impulse_prob")),
    ("max_impulse_prob", lambda: F.max("impulse_prob")),
    ("impulse_prob_std", lambda: F.stddev_samp("impulse_prob")),
    ("mean_spend_zscore", lambda: F.avg("spend_zscore")),
    ("mean_salary_ratio", lambda: F.avg("spend_to_salary_ratio")),
    ("late_night_rate", lambda: F.avg("is_late_night")),
    ("weekend_rate", lambda: F.avg("is_weekend")),
    ("mean_category_risk", lambda: F.avg("category_impulse_risk")),
    ("mean_drawdown", lambda: F.avg("drawdown_ratio")),
    ("balance_stress_rate", lambda: F.avg("balance_stress")),
    # A14 folded into the same aggregate: spend on transactions predicted impulsive
    ("potential_savings", lambda: F.sum(F.col("transaction_amount") * F.col("impulse_pred"))),
]


def user_profile(scored: DataFrame) -> DataFrame:
    """A6 + A7 (+ J1 folded in): one partial/final aggregate per user, recency-weighted mean included."""
    aggs = [f().alias(n) for n, f in PROFILE_AGGS]
    aggs.append(F.try_divide(F.sum(F.col("impulse_prob") * F.col("decay_weight")), F.sum("decay_weight"))
                .alias("recency_weighted_prob"))
    return scored.groupBy("user_id").agg(*aggs)


COMPONENTS = [
    ("score_recency", "recency_weighted_prob"),
    ("score_frequency", "pred_impulse_rate"),
    ("score_magnitude", "mean_spend_zscore"),
    ("score_context", "context_index"),
    ("score_category", "mean_category_risk"),
]


def risk_scores(profile: DataFrame, weights=None) -> DataFrame:
    """P16-P18 + W11: percentile component scores, composite risk score and tier."""
    df = profile.withColumn("context_index", C.context_index(
        F.col("late_night_rate"), F.col("weekend_rate"), F.col("balance_stress_rate")))
    # user grain: written once to the checkpoint folder, then ranked five times from that copy
    df = cut_lineage(df)
    df = percentile_scores(df, dict(COMPONENTS), key="user_id")
    df = df.withColumn("risk_score", C.composite_score(weights))
    return df.withColumn("risk_tier", C.user_tier(F.col("risk_score")))


def user_risk(scored: DataFrame) -> DataFrame:
    return risk_scores(user_profile(scored))


def tier_summary(profile: DataFrame) -> DataFrame:
    """Users and five means per tier, Critical -> Low order column."""
    return (profile.groupBy("risk_tier").agg(
        F.count("user_id").alias("user_count"),
        F.avg("risk_score").alias("avg_risk_score"),
        F.avg("raw_impulse_rate").alias("avg_impulse_rate"),
        F.avg("late_night_rate").alias("avg_late_night_rate"),
        F.avg("mean_salary_ratio").alias("avg_salary_ratio"),
        F.avg("balance_stress_rate").alias("avg_balance_stress"))
        .withColumn("tier_order", C.level_order(F.col("risk_tier"), C.TIER_ORDER))
        .orderBy("tier_order"))


def tier_components(profile: DataFrame) -> DataFrame:
    """Mean component score per tier."""
    return profile.groupBy("risk_tier").agg(*[F.avg(c).alias(f"avg_{c}") for c, _ in COMPONENTS])


def scoring_volume(scored: DataFrame) -> DataFrame:
    """Scored rows, predicted impulses and their share."""
    return scored.agg(F.count(F.lit(1)).alias("scored_rows"),
                      F.sum("impulse_pred").cast("long").alias("predicted_impulse"),
                      F.avg("impulse_pred").alias("predicted_share"))
