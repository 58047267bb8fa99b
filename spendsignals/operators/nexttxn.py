"""Next-transaction dataset and at-risk list (reference step 9): W6-W10, W13, M13, M15-M17, J3, J4, F2, F3.

All sequence features come from one ``with_timeline`` call (one partitioning of the scored table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .select import interpolated_quantile, order_rows, part_of
from .stats import drop_missing, split_by_time
from .timeline import DEFAULT_ROWS_PER_CHUNK, Rolling, Shift, Streak, with_timeline

# The user columns joined onto transactions and the next-transaction model features.
USER_FEATURES = ["risk_score", "recency_weighted_prob", "impulse_prob_std", "cluster"]
NEXT_FEATURES = [
    "lag1_impulse_prob", "lag2_impulse_prob", "lag3_impulse_prob",
    "lag1_impulse_label", "lag2_impulse_label", "lag3_impulse_label",
    "lag1_spend_zscore",
    "roll5_impulse_prob_mean", "roll5_impulse_prob_max", "roll5_impulse_rate",
    "hour", "is_weekend", "is_late_night", "is_evening",
    "impulse_streak", "hours_since_last_txn",
    "spend_zscore", "spend_to_salary_ratio", "balance_stress",
    "category_impulse_risk", "drawdown_ratio",
    "risk_score", "recency_weighted_prob", "impulse_prob_std", "cluster",
    "user_impulse_rate",
]


def sequence_specs():
    specs = []
    for k in (1, 2, 3):                                                             # W6
        specs += [Shift(f"lag{k}_impulse_prob", F.col("impulse_prob"), k),
                  Shift(f"lag{k}_impulse_label", F.col("impulse_label"), k),
                  Shift(f"lag{k}_spend_zscore", F.col("spend_zscore"), k)]
    specs += [
        Rolling("_r5_micros", "sum", F.round(F.col("impulse_prob") * 1_000_000).cast("long"), -5, -1),   # W8
        Rolling("_r5_n", "count", F.col("impulse_prob"), -5, -1),
        Rolling("roll5_impulse_prob_max", "max", F.col("impulse_prob"), -5, -1),
        Rolling("roll5_impulse_rate", "avg", F.col("impulse_label"), -5, -1),
        Shift("_prev_ts", F.col("timestamp"), 1),                                  # W9
        Streak("impulse_streak", F.col("impulse_label")),                          # W10
        Shift("next_impulse", F.col("impulse_label"), -1),                         # W7
    ]
    return specs


def next_txn_features(scored: DataFrame, rows_per_chunk: int = DEFAULT_ROWS_PER_CHUNK, hot=None) -> DataFrame:
    """W6-W10 on every row (the newest row of a user has a NULL target). The rolling mean is taken in
    whole millionths and rounded half up, so it does not hang on the last bit of a sum."""
    w = with_timeline(scored, sequence_specs(), rows_per_chunk=rows_per_chunk, hot=hot)
    gap = (C.naive_micros(F.col("timestamp")) - C.naive_micros(F.col("_prev_ts"))) / 3.6e9
    mean = F.expr("(2 * _r5_micros + _r5_n) div (2 * nullif(_r5_n, 0))") / 1_000_000
    return w.withColumns({"hours_since_last_txn": F.coalesce(gap, F.lit(0.0)),
                          "roll5_impulse_prob_mean": mean}).drop("_prev_ts", "_r5_micros", "_r5_n")


def attach_user(df: DataFrame, profile: DataFrame, cols=None) -> DataFrame:
    """User columns onto transactions (left join; AQE splits a heavy user's partition)."""
    cols = [c for c in (cols or USER_FEATURES) if c in profile.columns]
    return df.join(profile.select("user_id", *cols), "user_id", "left")


def labelled(features: DataFrame) -> DataFrame:
    """rows that have a next transaction."""
    return drop_missing(features, ["next_impulse"]).withColumn("next_impulse", F.col("next_impulse").cast("int"))


def next_txn_dataset(features: DataFrame, profile: DataFrame) -> DataFrame:
    """Sequence features + user columns, rows without a next transaction dropped (F2)."""
    return labelled(attach_user(features, profile))


def time_split(df: DataFrame, q: float = 0.8, ts: str = "timestamp") -> tuple[DataFrame, DataFrame, DataFrame]:
    """M13 + F3: exact interpolated ``q`` quantile of time as the cutoff; rows <= cutoff train, > test.
    Returns (train, test, cutoff one-row table). Only the time column is read for the cutoff; the split is a filter."""
    value = interpolated_quantile(df, C.naive_micros(F.col(ts)), q)
    rows = [] if value is None else [(value,)]
    cut = df.sparkSession.createDataFrame(rows, "quantile_micros double").select(
        C.from_naive_micros(F.floor("quantile_micros")).alias("cutoff"), "quantile_micros")
    train, test = split_by_time(df, F.lit(value).cast("double"), C.naive_micros(F.col(ts)))
    return train, test, cut


def block_folds(df: DataFrame, label: str = "next_impulse", n_splits: int = 5,
                order=("user_id", "timestamp", "transaction_id")) -> DataFrame:
    """Unshuffled stratified k-fold assignment (``fold`` column). Within each class, rows in
    table order fill fold 0, then fold 1, ...; fold sizes per class follow the round-robin
    allocation of the sorted labels. The last row of each fold and class is found by radix selection over
    (user, time, id); the folds are literal cutoffs, so the table is neither joined nor sorted."""
    key, ts, tid = order
    y = F.col(label)
    keys = [F.col(key), C.naive_micros(F.col(ts)), F.col(tid)]

    def ranks(value, counts: dict) -> list[int]:
        """Last position of each fold but the last in its class: class 0 fills the first positions of the sorted labels,
        which are dealt round-robin."""
        first, n = (0 if value == 0 else counts.get(0, 0)), counts[value]
        sizes = [len(range(first + (i - first) % n_splits, first + n, n_splits)) for i in range(n_splits)]
        return [sum(sizes[:i + 1]) - 1 for i in range(n_splits - 1)]

    return df.withColumn("fold", part_of(keys, order_rows(df, keys, ranks, y), y))


def latest_per_user(df: DataFrame, key: str = "user_id", order=("timestamp", "transaction_id")) -> DataFrame:
    """The newest row of every user as one partial/final aggregate (``max_by`` on a struct key)."""
    cols = [c for c in df.columns if c != key]
    pick = F.max_by(F.struct(*cols), F.struct(*order))
    return df.groupBy(key).agg(pick.alias("_r")).select(key, "_r.*")


def at_risk_users(latest: DataFrame, profile: DataFrame, prob: str = "next_impulse_prob") -> DataFrame:
    """M17 + J4 + P20: latest prediction per user, profile columns, alert level, highest first."""
    cols = [c for c in ["risk_score", "risk_tier", "raw_impulse_rate", "persona", "cluster"] if c in profile.columns]
    out = latest.select("user_id", prob).join(profile.select("user_id", *cols), "user_id", "left")
    return out.withColumn("alert_level", C.alert_level(F.col(prob))).orderBy(F.col(prob).desc(), "user_id")

