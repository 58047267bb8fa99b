"""Engineered transaction table (reference step 1): P1-P12, P14, W1-W5, W14.

All per-user windows go through one ``with_timeline`` call, so they share one partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .timeline import DEFAULT_ROWS_PER_CHUNK, KeyStat, Rolling, Running, with_timeline

# Columns that are never model features.
EXCLUDE = ["transaction_id", "user_id", "timestamp", "impulse_label", "balance_before_approx",
           "user_mean_spend", "user_std_spend", "balance_after", "transaction_amount", "monthly_salary",
           "impulse_prob"]
WINDOWS = (3, 7)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Never let NaN reach a comparison: NaN doubles become NULL at ingest."""
    return df.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
                       if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


def row_features(df: DataFrame) -> DataFrame:
    """Row-level columns: P1-P4, P6, P8, P9."""
    amount, salary, bal = F.col("transaction_amount"), F.col("monthly_salary"), F.col("balance_after")
    df = df.withColumn("time_bin", C.time_bin(F.col("hour")))
    return df.withColumns({
        "is_late_night": C.flag(F.col("time_bin") == "late_night"),
        "is_evening": C.flag(F.col("time_bin") == "evening"),
        "spend_to_salary_ratio": C.safe_div(amount, salary),
        "balance_to_salary_ratio": C.safe_div(bal, salary),
        "balance_stress": C.flag(bal < C.STRESS_SHARE * salary),
        "category_impulse_risk": C.category_risk(F.col("merchant_category")),
        "balance_before_approx": bal + amount,
    }).withColumns({
        "weekend_x_evening": F.col("is_weekend") * F.col("is_evening"),
        "weekend_x_latenight": F.col("is_weekend") * F.col("is_late_night"),
        "drawdown_ratio": amount / (F.col("balance_before_approx") + C.DRAWDOWN_EPS),
    })


def rolling_specs(col: str, windows=WINDOWS):
    """Mean and sample std of the previous n rows."""
    specs = []
    for w in windows:
        specs.append(Rolling(f"{col}_rolling{w}_mean", "avg", F.col(col), -w, -1))
        specs.append(Rolling(f"{col}_rolling{w}_std", "stddev_samp", F.col(col), -w, -1))
    return specs


def window_specs(baseline: str = "user"):
    specs = rolling_specs("transaction_amount") + rolling_specs("spend_to_salary_ratio")
    amt = F.col("transaction_amount")
    if baseline == "prior":
        # leakage-free option: mean / sample std of the user's earlier rows only
        has = F.when(amt.isNotNull(), 1).otherwise(0)
        specs += [Running("_b_n", has), Running("_b_s1", F.coalesce(amt, F.lit(0.0))),
                  Running("_b_s2", F.coalesce(amt * amt, F.lit(0.0)))]
    else:
        specs += [KeyStat("user_mean_spend", "avg", amt),                        # W5
                  KeyStat("_user_std", "stddev_samp", amt)]
    specs += [
        Rolling("txn_count_last3", "count", F.col("transaction_amount"), -3, -1),  # W3
        Rolling("txn_count_last7", "count", F.col("transaction_amount"), -7, -1),
        Running("_prior_pos", F.col("impulse_label")),                              # W4
        Running("_prior_n", F.when(F.col("impulse_label").isNotNull(), 1).otherwise(0)),
    ]
    return specs


MAX_LEVELS = 1000


def one_hot(df: DataFrame, col: str, levels) -> DataFrame:
    """One 0/1 column per level, named ``{col}_{level}``; the source column is dropped."""
    return df.withColumns({f"{col}_{lv}": C.flag(F.col(col) == lv) for lv in sorted(levels)}).drop(col)


def category_levels(df: DataFrame, col: str = "merchant_category") -> list[str]:
    """Levels of a categorical column from one distinct job. Each becomes a column of the result, so more than
    ``MAX_LEVELS`` are an error, not a wider table; pass ``categories`` to ``engineer`` to skip the job."""
    levels = df.select(col).where(F.col(col).isNotNull()).distinct().limit(MAX_LEVELS + 1).collect()
    if len(levels) > MAX_LEVELS:
        raise ValueError(f"{col} has more than {MAX_LEVELS} levels; name the wanted ones in `categories`")
    return sorted(r[0] for r in levels)


def engineer(txn: DataFrame, categories=None, extra_window_specs=(),
             rows_per_chunk: int = DEFAULT_ROWS_PER_CHUNK, hot=None, baseline: str = "user") -> DataFrame:
    """Reference step 1: the engineered transaction table, NULLs filled as the reference does.

    ``baseline='user'`` (parity) standardises spend against all of the user's rows, future ones
    included; ``baseline='prior'`` uses only the user's earlier rows."""
    base = row_features(nan_to_null(txn))
    levels = categories if categories is not None else category_levels(base)
    specs = window_specs(baseline) + list(extra_window_specs)
    w = with_timeline(base, specs, rows_per_chunk=rows_per_chunk, hot=hot)
    if baseline == "prior":
        n, s1, s2 = F.col("_b_n"), F.col("_b_s1"), F.col("_b_s2")
        var = F.try_divide(s2 - s1 * s1 / n, n - 1)
        w = w.withColumns({"user_mean_spend": F.try_divide(s1, n),
                           "_user_std": F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0))))}).drop("_b_n", "_b_s1", "_b_s2")
    std = F.col("_user_std")
    std_spend = F.when(std == 0, F.lit(1.0)).otherwise(std)
    z = (F.col("transaction_amount") - F.col("user_mean_spend")) / std_spend
    w = w.withColumns({
        "user_std_spend": std_spend,
        "spend_zscore": z,
        "is_spend_burst": C.flag(z > C.BURST_Z),
        "user_impulse_rate": F.coalesce(F.try_divide(F.col("_prior_pos"), F.col("_prior_n")),
                                        F.lit(C.COLD_START_RATE)),
    }).drop("_user_std", "_prior_pos", "_prior_n")
    w = one_hot(one_hot(w, "merchant_category", levels), "time_bin", C.TIME_BINS)
    return fill_missing(w)


def fill_missing(df: DataFrame, value: float = 0.0, skip=("transaction_id", "user_id")) -> DataFrame:
    """P10: NULL -> 0 on every numeric column."""
    num = [f.name for f in df.schema.fields
           if f.dataType.typeName() in ("double", "float", "integer", "long") and f.name not in skip]
    return df.na.fill(value, subset=[c for c in num if dict(df.dtypes)[c] in ("double", "float")]).na.fill(
        int(value), subset=[c for c in num if dict(df.dtypes)[c] in ("int", "bigint")])


def feature_columns(df: DataFrame, exclude=EXCLUDE) -> list[str]:
    """All columns minus the exclusions, keeping only numeric ones that are present."""
    return [f.name for f in df.schema.fields if f.name not in exclude
            and f.dataType.typeName() in ("double", "float", "integer", "long", "short", "boolean")]


def align_columns(df: DataFrame, names, keep=()) -> DataFrame:
    """Select a model's columns (after ``keep``); missing or non-numeric become 0.0, all cast to double."""
    have = set(df.columns)
    return df.select(*keep, *[F.coalesce(F.col(n).try_cast("double"), F.lit(0.0)).alias(n) if n in have
                       else F.lit(0.0).alias(n) for n in names])


def recent_rate(df: DataFrame, n: int = 7, label: str = "impulse_label", out: str = "recent_impulse_rate",
                rows_per_chunk: int = DEFAULT_ROWS_PER_CHUNK) -> DataFrame:
    """Impulse count and rate over the previous n transactions of the user."""
    specs = [Rolling("_recent_pos", "sum", F.col(label), -n, -1),
             Rolling("_recent_n", "count", F.col(label), -n, -1)]
    w = with_timeline(df, specs, rows_per_chunk=rows_per_chunk)
    return w.withColumn(out, F.coalesce(F.try_divide(F.col("_recent_pos"), F.col("_recent_n")), F.lit(0.0))) \
            .withColumn("recent_impulse_count", F.coalesce(F.col("_recent_pos"), F.lit(0)).cast("long")) \
            .drop("_recent_pos", "_recent_n")

