"""DuckDB statements that recompute each registered query independently (the correctness oracle).

They share common table expressions: ``txn`` (the adapter), ``eng`` (engineered table),
``scored`` (engineered + deterministic score), ``prof`` (user profile with risk scores).
"""

from __future__ import annotations

from ..functions.columns import IMPULSE_RISK_MAP
from ..sources.transactions import ADAPTER_CATEGORIES, TXN_CTE

W_ORDER = 'PARTITION BY user_id ORDER BY "timestamp", transaction_id'


def _risk_case(col: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in IMPULSE_RISK_MAP.items())
    return f"CAST(coalesce(CASE {col} {arms} END, 1) AS DOUBLE)"


def _rolling(col: str) -> list[str]:
    out = []
    for w in (3, 7):
        fr = f"({W_ORDER} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        out.append(f"coalesce(avg({col}) OVER {fr}, 0) AS {col}_rolling{w}_mean")
        out.append(f"coalesce(stddev_samp({col}) OVER {fr}, 0) AS {col}_rolling{w}_std")
    return out


_cat_cols = ",\n  ".join(f"CASE WHEN merchant_category = '{c}' THEN 1 ELSE 0 END AS \"merchant_category_{c}\""
                         for c in sorted(ADAPTER_CATEGORIES))
_bin_cols = ",\n  ".join(f"CASE WHEN time_bin = '{b}' THEN 1 ELSE 0 END AS time_bin_{b}"
                         for b in ["afternoon", "evening", "late_night", "morning"])

ENG_CTE = f"""eng0 AS (
 SELECT *,
  CASE WHEN hour >= 5 AND hour < 12 THEN 'morning' WHEN hour >= 12 AND hour < 17 THEN 'afternoon'
       WHEN hour >= 17 AND hour < 21 THEN 'evening' ELSE 'late_night' END AS time_bin,
  transaction_amount / NULLIF(monthly_salary, 0) AS spend_to_salary_ratio,
  balance_after / NULLIF(monthly_salary, 0) AS balance_to_salary_ratio,
  CASE WHEN balance_after < 0.1 * monthly_salary THEN 1 ELSE 0 END AS balance_stress,
  {_risk_case('merchant_category')} AS category_impulse_risk,
  balance_after + transaction_amount AS balance_before_approx,
  transaction_amount / (balance_after + transaction_amount + 1e-6) AS drawdown_ratio
 FROM txn),
eng1 AS (
 SELECT *,
  CASE WHEN time_bin = 'late_night' THEN 1 ELSE 0 END AS is_late_night,
  CASE WHEN time_bin = 'evening' THEN 1 ELSE 0 END AS is_evening,
  {", ".join(_rolling("transaction_amount") + _rolling("spend_to_salary_ratio"))},
  avg(transaction_amount) OVER (PARTITION BY user_id) AS user_mean_spend,
  stddev_samp(transaction_amount) OVER (PARTITION BY user_id) AS _sd,
  count(transaction_amount) OVER ({W_ORDER} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS txn_count_last3,
  count(transaction_amount) OVER ({W_ORDER} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS txn_count_last7,
  sum(impulse_label) OVER ({W_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    / NULLIF(count(impulse_label) OVER ({W_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _prior
 FROM eng0),
eng AS (
 SELECT transaction_id, user_id, "timestamp", hour, is_weekend, transaction_amount, balance_after,
  monthly_salary, impulse_label, impulse_prob, is_late_night, is_evening,
  coalesce(spend_to_salary_ratio, 0) AS spend_to_salary_ratio,
  coalesce(balance_to_salary_ratio, 0) AS balance_to_salary_ratio, balance_stress,
  transaction_amount_rolling3_mean, transaction_amount_rolling3_std,
  transaction_amount_rolling7_mean, transaction_amount_rolling7_std,
  spend_to_salary_ratio_rolling3_mean, spend_to_salary_ratio_rolling3_std,
  spend_to_salary_ratio_rolling7_mean, spend_to_salary_ratio_rolling7_std,
  user_mean_spend,
  coalesce(CASE WHEN _sd = 0 THEN 1.0 ELSE _sd END, 0) AS user_std_spend,
  coalesce((transaction_amount - user_mean_spend) / CASE WHEN _sd = 0 THEN 1.0 ELSE _sd END, 0) AS spend_zscore,
  CASE WHEN (transaction_amount - user_mean_spend) / CASE WHEN _sd = 0 THEN 1.0 ELSE _sd END > 1.5
       THEN 1 ELSE 0 END AS is_spend_burst,
  txn_count_last3, txn_count_last7, category_impulse_risk,
  is_weekend * is_evening AS weekend_x_evening, is_weekend * is_late_night AS weekend_x_latenight,
  balance_before_approx, drawdown_ratio,
  coalesce(_prior, 0.5) AS user_impulse_rate,
  {_cat_cols},
  {_bin_cols}
 FROM eng1)"""


def with_ctes(*names: str) -> str:
    """``WITH`` clause holding the named shared CTEs (in dependency order)."""
    parts = [TXN_CTE]
    if {"eng", "scored", "prof"} & set(names):
        parts.append(ENG_CTE)
    if {"scored", "prof"} & set(names):
        parts.append(SCORED_CTE)
    if "prof" in names:
        parts.append(PROF_CTE)
    return "WITH " + ",\n".join(parts) + "\n"


SCORED_CTE = """scored AS (
 SELECT *, CASE WHEN impulse_prob >= 0.7 THEN 1 ELSE 0 END AS impulse_pred,
  CAST(floor((epoch_us(max("timestamp") OVER ()) - epoch_us("timestamp")) / 86400000000) AS BIGINT) AS days_ago,
  exp(-ln(2) * CAST(floor((epoch_us(max("timestamp") OVER ()) - epoch_us("timestamp")) / 86400000000) AS BIGINT) / 15.0)
    AS decay_weight
 FROM eng)"""


def pct_rank(col: str, src: str = "", places: int = 9) -> str:
    """Average-rank percentile x100 (pandas ``rank(pct=True)``) over a whole table; values equal to
    ``places`` decimals are ties."""
    k = f"round({col}, {places})"
    return (f"(rank() OVER (ORDER BY {k}) + (count(*) OVER (PARTITION BY {k}) - 1) / 2.0)"
            f" / count({col}) OVER () * 100")


PROF_CTE = f"""agg AS (
 SELECT user_id,
  count(impulse_prob) AS total_transactions,
  CAST(sum(impulse_pred) AS BIGINT) AS impulse_txn_count,
  avg(impulse_label) AS raw_impulse_rate,
  avg(impulse_pred) AS pred_impulse_rate,
  avg(impulse_prob) AS mean_impulse_prob,
  max(impulse_prob) AS max_impulse_prob,
  stddev_samp(impulse_prob) AS impulse_prob_std,
  avg(spend_zscore) AS mean_spend_zscore,
  avg(spend_to_salary_ratio) AS mean_salary_ratio,
  avg(is_late_night) AS late_night_rate,
  avg(is_weekend) AS weekend_rate,
  avg(category_impulse_risk) AS mean_category_risk,
  avg(drawdown_ratio) AS mean_drawdown,
  avg(balance_stress) AS balance_stress_rate,
  sum(transaction_amount * impulse_pred) AS potential_savings,
  sum(impulse_prob * decay_weight) / sum(decay_weight) AS recency_weighted_prob
 FROM scored GROUP BY user_id),
comp AS (
 SELECT *, late_night_rate * 0.5 + weekend_rate * 0.3 + balance_stress_rate * 0.2 AS context_index FROM agg),
ranked AS (
 SELECT *,
  {pct_rank('recency_weighted_prob', 'comp')} AS score_recency,
  {pct_rank('pred_impulse_rate', 'comp')} AS score_frequency,
  {pct_rank('mean_spend_zscore', 'comp')} AS score_magnitude,
  {pct_rank('context_index', 'comp')} AS score_context,
  {pct_rank('mean_category_risk', 'comp')} AS score_category
 FROM comp),
prof AS (
 SELECT *, CASE WHEN risk_score >= 75 THEN 'Critical' WHEN risk_score >= 55 THEN 'High'
                WHEN risk_score >= 35 THEN 'Moderate' ELSE 'Low' END AS risk_tier
 FROM (SELECT *, score_recency * 0.35 + score_frequency * 0.25 + score_magnitude * 0.2
                 + score_context * 0.1 + score_category * 0.1 AS risk_score FROM ranked))"""
