"""Queries for the transaction table, engineered features, scoring and user risk (milestones 0-2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import features as FE
from ..operators import risk as R
from ..sources.transactions import ADAPTER_CATEGORIES
from . import inputs as I
from .catalog import register, rsql

ENG = ("eng",)
SC = ("scored",)
PR = ("prof",)

ROLL = [f"{c}_rolling{w}_{s}" for c in ("transaction_amount", "spend_to_salary_ratio") for w in (3, 7)
        for s in ("mean", "std")]
CAT_COLS = [f"merchant_category_{c}" for c in sorted(ADAPTER_CATEGORIES)]
BIN_COLS = [f"time_bin_{b}" for b in C.TIME_BINS]
PROFILE_COLS = [n for n, _ in R.PROFILE_AGGS] + ["recency_weighted_prob"]
PROFILE_DOUBLES = [c for c in PROFILE_COLS if c not in ("total_transactions", "impulse_txn_count")]
SCORE_COLS = [c for c, _ in R.COMPONENTS]


def q(cols):
    return ", ".join(f'"{c}"' if c[0].isupper() or "-" in c else c for c in cols)


@register("s01_read_transactions", rsql("SELECT * FROM txn", (), [
    "transaction_amount", "balance_after", "monthly_salary", "impulse_prob"]))
def s01(spark, sf):
    """The transaction table with its deterministic score."""
    return I.txn(spark, sf)


@register("p01_time_bin", rsql("SELECT transaction_id, hour, time_bin FROM eng0", ENG))
def p01(spark, sf):
    return FE.row_features(I.txn(spark, sf)).select("transaction_id", "hour", "time_bin")


@register("p02_time_flags", rsql("SELECT transaction_id, is_late_night, is_evening FROM eng", ENG))
def p02(spark, sf):
    return I.eng(spark, sf).select("transaction_id", "is_late_night", "is_evening")


_p03 = ["spend_to_salary_ratio", "balance_to_salary_ratio"]


@register("p03_salary_ratios", rsql(f"SELECT transaction_id, {q(_p03)} FROM eng", ENG, _p03))
def p03(spark, sf):
    return I.eng(spark, sf).select("transaction_id", *_p03)


@register("p04_balance_stress", rsql("SELECT transaction_id, balance_after, monthly_salary, balance_stress FROM eng",
                                     ENG, ["balance_after", "monthly_salary"]))
def p04(spark, sf):
    return I.eng(spark, sf).select("transaction_id", "balance_after", "monthly_salary", "balance_stress")


_p05 = ["user_mean_spend", "user_std_spend", "spend_zscore"]


@register("p05_spend_zscore", rsql(f"SELECT transaction_id, {q(_p05)}, is_spend_burst FROM eng", ENG, _p05))
def p05(spark, sf):
    return I.eng(spark, sf).select("transaction_id", *_p05, "is_spend_burst")


@register("p06_category_risk", rsql("SELECT transaction_id, merchant_category, category_impulse_risk FROM eng0",
                                    ENG, ["category_impulse_risk"]))
def p06(spark, sf):
    return FE.row_features(I.txn(spark, sf)).select("transaction_id", "merchant_category", "category_impulse_risk")


@register("p07_one_hot", rsql(f"SELECT transaction_id, {q(CAT_COLS + BIN_COLS)} FROM eng", ENG))
def p07(spark, sf):
    return I.eng(spark, sf).select("transaction_id", *CAT_COLS, *BIN_COLS)


@register("p08_interactions", rsql("SELECT transaction_id, weekend_x_evening, weekend_x_latenight FROM eng", ENG))
def p08(spark, sf):
    return I.eng(spark, sf).select("transaction_id", "weekend_x_evening", "weekend_x_latenight")


_p09 = ["balance_before_approx", "drawdown_ratio"]


@register("p09_drawdown", rsql(f"SELECT transaction_id, {q(_p09)} FROM eng", ENG, _p09))
def p09(spark, sf):
    return I.eng(spark, sf).select("transaction_id", *_p09)


_ENG_DOUBLES = (["transaction_amount", "balance_after", "monthly_salary", "impulse_prob", "spend_to_salary_ratio",
                 "balance_to_salary_ratio"] + ROLL + _p05 + ["category_impulse_risk"] + _p09 + ["user_impulse_rate"])


@register("p10_engineered_table", rsql("SELECT * FROM eng", ENG, _ENG_DOUBLES))
def p10(spark, sf):
    """P10 (+ S2 shape): the whole engineered table with the reference's NULL fills."""
    return I.eng(spark, sf)


_FEATS = [c for c in [
    "hour", "is_weekend", "is_late_night", "is_evening", "spend_to_salary_ratio",
    "balance_to_salary_ratio", "balance_stress"] + ROLL + ["spend_zscore", "is_spend_burst", "txn_count_last3",
                                                           "txn_count_last7", "category_impulse_risk",
                                                           "weekend_x_evening", "weekend_x_latenight",
                                                           "drawdown_ratio", "user_impulse_rate"]
    + CAT_COLS + BIN_COLS]


@register("p11_feature_matrix", rsql(f"SELECT transaction_id, {q(_FEATS)} FROM eng", ENG,
                                     [c for c in _FEATS if c in _ENG_DOUBLES]))
def p11(spark, sf):
    """Key + all columns minus the exclusion list (numeric only)."""
    e = I.eng(spark, sf)
    return e.select("transaction_id", *FE.feature_columns(e))


_ALIGN = ["spend_zscore", "hour", "salary_day_effect", "drawdown_ratio"]


@register("p12_align_columns", rsql(
    "SELECT transaction_id, CAST(spend_zscore AS DOUBLE) AS spend_zscore, CAST(hour AS DOUBLE) AS hour, "
    "0.0::DOUBLE AS salary_day_effect, CAST(drawdown_ratio AS DOUBLE) AS drawdown_ratio FROM eng", ENG,
    ["spend_zscore", "hour", "salary_day_effect", "drawdown_ratio"]))
def p12(spark, sf):
    """Align to a model's column list; a column missing from the table becomes 0.0."""
    return FE.align_columns(I.eng(spark, sf), _ALIGN, keep=["transaction_id"])


@register("p13_classify", rsql(
    "SELECT transaction_id, impulse_prob, CASE WHEN impulse_prob >= 0.7 THEN 1 ELSE 0 END AS impulse_pred, "
    "CASE WHEN impulse_prob >= 0.81 THEN 1 ELSE 0 END AS pred_at_081, "
    "CASE WHEN impulse_prob > 0.5 THEN 1 ELSE 0 END AS pred_above_05 FROM txn", (), ["impulse_prob"]))
def p13(spark, sf):
    """Probability -> class at 0.70 and 0.81 (inclusive) and 0.5 (strict)."""
    t = I.txn(spark, sf)
    p = F.col("impulse_prob")
    return t.select("transaction_id", "impulse_prob",
                    C.classify(p, C.IMPULSE_THRESHOLD).alias("impulse_pred"),
                    C.classify(p, C.LOGISTIC_THRESHOLD).alias("pred_at_081"),
                    C.classify(p, 0.5, strict=True).alias("pred_above_05"))


@register("p14_clip", rsql("SELECT transaction_id, greatest(least(spend_zscore, 5), -3) AS zscore_clipped FROM eng",
                           ENG, ["zscore_clipped"]))
def p14(spark, sf):
    return I.eng(spark, sf).select("transaction_id", C.clip(F.col("spend_zscore"), -3, 5).alias("zscore_clipped"))


@register("p15_decay_weight", rsql("SELECT transaction_id, days_ago, decay_weight FROM scored", SC, ["decay_weight"]))
def p15(spark, sf):
    return I.scored(spark, sf).select("transaction_id", "days_ago", "decay_weight")


_W1 = [c for c in ROLL if c.endswith("mean")]
_W2 = [c for c in ROLL if c.endswith("std")]


@register("w01_rolling_mean", rsql(f"SELECT transaction_id, {q(_W1)} FROM eng", ENG, _W1))
def w01(spark, sf):
    return I.eng(spark, sf).select("transaction_id", *_W1)


@register("w02_rolling_std", rsql(f"SELECT transaction_id, {q(_W2)} FROM eng", ENG, _W2))
def w02(spark, sf):
    return I.eng(spark, sf).select("transaction_id", *_W2)


@register("w03_rolling_count", rsql("SELECT transaction_id, txn_count_last3, txn_count_last7 FROM eng", ENG))
def w03(spark, sf):
    return I.eng(spark, sf).select("transaction_id", "txn_count_last3", "txn_count_last7")


@register("w04_prior_rate", rsql("SELECT transaction_id, user_impulse_rate FROM eng", ENG, ["user_impulse_rate"]))
def w04(spark, sf):
    return I.eng(spark, sf).select("transaction_id", "user_impulse_rate")


@register("w05_user_baseline", rsql("SELECT transaction_id, user_mean_spend, user_std_spend FROM eng", ENG,
                                    ["user_mean_spend", "user_std_spend"]))
def w05(spark, sf):
    return I.eng(spark, sf).select("transaction_id", "user_mean_spend", "user_std_spend")


W_ORDER = 'PARTITION BY user_id ORDER BY "timestamp", transaction_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING'


@register("w14_recent_rate", rsql(
    f"SELECT transaction_id, coalesce(sum(impulse_label) OVER w / NULLIF(count(impulse_label) OVER w, 0), 0.0) "
    f"AS recent_impulse_rate, CAST(coalesce(sum(impulse_label) OVER w, 0) AS BIGINT) AS recent_impulse_count "
    f"FROM txn WINDOW w AS ({W_ORDER})", (), ["recent_impulse_rate"]))
def w14(spark, sf):
    """Impulse rate over the previous 7 transactions (the request form's "last 7")."""
    return FE.recent_rate(I.txn(spark, sf)).select("transaction_id", "recent_impulse_rate", "recent_impulse_count")


@register("a06_user_profile", rsql(f"SELECT user_id, {q(PROFILE_COLS)} FROM agg", PR, PROFILE_DOUBLES))
def a06(spark, sf):
    """One aggregate per user (14 outputs + recency-weighted mean)."""
    return R.user_profile(I.scored(spark, sf))


@register("a07_weighted_mean", rsql("SELECT user_id, recency_weighted_prob FROM agg", PR, ["recency_weighted_prob"]))
def a07(spark, sf):
    return R.user_profile(I.scored(spark, sf)).select("user_id", "recency_weighted_prob")


@register("j01_attach_recency", rsql(
    "SELECT user_id, total_transactions, raw_impulse_rate, recency_weighted_prob FROM agg", PR,
    ["raw_impulse_rate", "recency_weighted_prob"]))
def j01(spark, sf):
    """Profile and recency score per user (folded into the same aggregate, no join needed)."""
    return R.user_profile(I.scored(spark, sf)).select(
        "user_id", "total_transactions", "raw_impulse_rate", "recency_weighted_prob")


@register("w11_percentile_score", rsql(f"SELECT user_id, {q(SCORE_COLS)} FROM prof", PR, SCORE_COLS))
def w11(spark, sf):
    """Average-rank percentile x100 of five user metrics, without a single-partition window."""
    return I.profile(spark, sf).select("user_id", *SCORE_COLS)


@register("p16_context_index", rsql("SELECT user_id, context_index FROM prof", PR, ["context_index"]))
def p16(spark, sf):
    return I.profile(spark, sf).select("user_id", "context_index")


@register("p17_composite_score", rsql("SELECT user_id, risk_score FROM prof", PR, ["risk_score"]))
def p17(spark, sf):
    return I.profile(spark, sf).select("user_id", "risk_score")


@register("p18_user_tier", rsql("SELECT user_id, risk_score, risk_tier FROM prof", PR, ["risk_score"]))
def p18(spark, sf):
    return I.profile(spark, sf).select("user_id", "risk_score", "risk_tier")


_PROF_ALL = PROFILE_COLS + ["context_index"] + SCORE_COLS + ["risk_score", "risk_tier"]


@register("a06_user_risk_profile", rsql(f"SELECT user_id, {q(_PROF_ALL)} FROM prof", PR,
                                         PROFILE_DOUBLES + ["context_index"] + SCORE_COLS + ["risk_score"]))
def user_risk_profile(spark, sf):
    """Flagship: user risk profiles with component scores, composite score and tier (reference step 7)."""
    return I.profile(spark, sf).select("user_id", *_PROF_ALL)


_A8 = ["avg_risk_score", "avg_impulse_rate", "avg_late_night_rate", "avg_salary_ratio", "avg_balance_stress"]


@register("a08_tier_summary", rsql(
    "SELECT risk_tier, count(user_id) AS user_count, avg(risk_score) AS avg_risk_score, "
    "avg(raw_impulse_rate) AS avg_impulse_rate, avg(late_night_rate) AS avg_late_night_rate, "
    "avg(mean_salary_ratio) AS avg_salary_ratio, avg(balance_stress_rate) AS avg_balance_stress, "
    "CASE risk_tier WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Moderate' THEN 2 WHEN 'Low' THEN 3 ELSE 4 END "
    "AS tier_order FROM prof GROUP BY risk_tier", PR, _A8))
def a08(spark, sf):
    return R.tier_summary(I.profile(spark, sf))


_A9 = [f"avg_{c}" for c in SCORE_COLS]


@register("a09_tier_components", rsql(
    "SELECT risk_tier, " + ", ".join(f"avg({c}) AS avg_{c}" for c in SCORE_COLS) + " FROM prof GROUP BY risk_tier",
    PR, _A9))
def a09(spark, sf):
    return R.tier_components(I.profile(spark, sf))


@register("a21_scoring_volume", rsql(
    "SELECT count(*) AS scored_rows, CAST(sum(impulse_pred) AS BIGINT) AS predicted_impulse, "
    "avg(impulse_pred) AS predicted_share FROM scored", SC, ["predicted_share"]))
def a21(spark, sf):
    return R.scoring_volume(I.scored(spark, sf))
