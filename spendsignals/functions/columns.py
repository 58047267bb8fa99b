"""Column expressions for the reference's row-level rules (projections P1-P31).

All of them are JVM-side Catalyst expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Fixed values that must equal the reference for equal results.
# Category risk map (unknown categories get DEFAULT_CATEGORY_RISK).
IMPULSE_RISK_MAP = {
    "Entertainment": 3,
    "Fashion": 3,
    "Food": 2,
    "Electronics": 2,
    "Travel": 2,
    "Utilities": 0,
    "Healthcare": 0,
    "Education": 0,
    "Groceries": 1,
    "Others": 1,
}
DEFAULT_CATEGORY_RISK = 1
# Time-of-day bins: [5,12) morning, [12,17) afternoon, [17,21) evening, otherwise late_night.
TIME_BINS = ["afternoon", "evening", "late_night", "morning"]
# Composite risk weights of the five component scores.
RISK_WEIGHTS = {
    "score_recency": 0.35,
    "score_frequency": 0.25,
    "score_magnitude": 0.20,
    "score_context": 0.10,
    "score_category": 0.10,
}
# Context blend: late-night rate, weekend rate, balance-stress rate.
CONTEXT_WEIGHTS = (0.5, 0.3, 0.2)
# User risk tiers (inclusive lower edges), transaction tiers (strict), alert levels (inclusive).
USER_TIERS = [(75, "Critical"), (55, "High"), (35, "Moderate")]
USER_TIER_DEFAULT = "Low"
TIER_ORDER = ["Critical", "High", "Moderate", "Low"]
TXN_TIERS = [(75, "Critical"), (60, "High"), (40, "Moderate")]
TXN_TIER_DEFAULT = "Low"
ALERT_LEVELS = [(0.75, "Immediate Alert"), (0.55, "Warning"), (0.35, "Watch")]
ALERT_DEFAULT = "Safe"
ALERT_ORDER = ["Immediate Alert", "Warning", "Watch", "Safe"]
# Thresholds and constants.
IMPULSE_THRESHOLD = 0.70
LOGISTIC_THRESHOLD = 0.81
HALF_LIFE_DAYS = 15
BURST_Z = 1.5
STRESS_SHARE = 0.1
DRAWDOWN_EPS = 1e-6
COLD_START_RATE = 0.5
# ---------------------------------------------------------------------------------------------


def time_bin(hour: Column) -> Column:
    """P1."""
    return (F.when((hour >= 5) & (hour < 12), "morning")
            .when((hour >= 12) & (hour < 17), "afternoon")
            .when((hour >= 17) & (hour < 21), "evening")
            .otherwise("late_night"))


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 int; NULL comparisons count as 0 (pandas compares NaN as False)."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def safe_div(a: Column, b: Column) -> Column:
    """ANSI-safe division: NULL where the divisor is 0 or NULL."""
    return F.try_divide(a, b)


def category_risk(cat: Column, mapping: dict | None = None, default: int = DEFAULT_CATEGORY_RISK) -> Column:
    """P6 as a literal map lookup (no join needed for a fixed 10-entry map)."""
    mapping = mapping or IMPULSE_RISK_MAP
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    return F.coalesce(m[cat], F.lit(default)).cast("double")


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clip keeping NULL as NULL (least/greatest skip NULLs)."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(hi)), F.lit(lo)))


def classify(p: Column, threshold: float, strict: bool = False) -> Column:
    """P13."""
    return flag(p > threshold if strict else p >= threshold)


def decay_weight(days_ago: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    """P15 weight exp(-ln2 * d / half_life)."""
    return F.exp(-math.log(2) * days_ago / F.lit(float(half_life)))


NAIVE_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def naive_micros(ts: Column) -> Column:
    """Microseconds of a naive (NTZ) timestamp since the naive epoch; no session time zone involved."""
    return F.timestamp_diff("MICROSECOND", F.expr(NAIVE_EPOCH), ts.cast("timestamp_ntz"))


def from_naive_micros(m: Column) -> Column:
    """Inverse of ``naive_micros``."""
    return F.timestamp_add("MICROSECOND", m.cast("long"), F.expr(NAIVE_EPOCH))


def whole_days_between(later: Column, earlier: Column) -> Column:
    """Whole days of a non-negative time difference (pandas ``.dt.days``)."""
    micros = naive_micros(later) - naive_micros(earlier)
    return F.floor(micros / F.lit(86_400_000_000)).cast("long")


def context_index(late: Column, weekend: Column, stress: Column) -> Column:
    """P16."""
    a, b, c = CONTEXT_WEIGHTS
    return late * a + weekend * b + stress * c


def composite_score(weights: dict | None = None) -> Column:
    """Weighted sum of the component score columns."""
    weights = weights or RISK_WEIGHTS
    out = None
    for col, w in weights.items():
        term = F.col(col) * w
        out = term if out is None else out + term
    return out


def _chain(value: Column, edges, default: str, strict: bool) -> Column:
    expr = None
    for edge, label in edges:
        cond = value > edge if strict else value >= edge
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(default)


def user_tier(score: Column) -> Column:
    """P18."""
    return _chain(score, USER_TIERS, USER_TIER_DEFAULT, strict=False)


def txn_tier(score: Column) -> Column:
    """P19 tier of a 0-100 transaction score (strict edges)."""
    return _chain(score, TXN_TIERS, TXN_TIER_DEFAULT, strict=True)


def alert_level(p: Column) -> Column:
    """P20."""
    return _chain(p, ALERT_LEVELS, ALERT_DEFAULT, strict=False)


def level_order(c: Column, levels) -> Column:
    """Position of a categorical value in a fixed order (unknown last)."""
    m = F.create_map(*chain.from_iterable((F.lit(v), F.lit(i)) for i, v in enumerate(levels)))
    return F.coalesce(m[c], F.lit(len(levels)))


def pct_diff(m1: Column, m0: Column) -> Column:
    """P30."""
    return (m1 - m0) / (m0 + 1e-9) * 100


def odds_ratio(coef: Column) -> Column:
    """P29."""
    return F.exp(coef)


def round_doubles(df, places: int = 6):
    """Round every double column at the output edge (for comparing against another engine)."""
    return df.select(*[F.round(F.col(f.name), places).alias(f.name) if f.dataType.typeName() == "double"
                       else F.col(f.name) for f in df.schema.fields])
