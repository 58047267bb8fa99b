"""Profiling and statistics (reference step 2): A1-A5, A17-A20, T1-T5, P30, F1.

Every test statistic is a handful of aggregates; only the final p-value of a one-row result goes
through a small Arrow-batched Python function (Spark SQL has no ``erfc`` or t distribution).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from .select import interpolated_quantile
from .ranks import prefix_sums

LABEL = "impulse_label"

# Features of the reference's significance table (T5) and correlation matrix.
SIGNIFICANCE_FEATURES = ["spend_to_salary_ratio", "spend_zscore", "drawdown_ratio", "balance_stress",
                         "is_late_night", "is_weekend", "category_impulse_risk", "user_impulse_rate",
                         "txn_count_last3"]
CORRELATION_FEATURES = ["impulse_label", "spend_to_salary_ratio", "spend_zscore", "is_spend_burst",
                        "drawdown_ratio", "balance_stress", "is_late_night", "is_evening", "is_weekend",
                        "category_impulse_risk", "weekend_x_latenight", "txn_count_last3",
                        "user_impulse_rate", "balance_to_salary_ratio"]
Z_05 = 1.959963984540054   # two-sided p < 0.05  <=>  |z| > Z_05


# ----------------------------------------------------------------------------- small p-value helpers
def _betacf(a: float, b: float, x: float) -> float:
    tiny, eps = 1e-300, 1e-16
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((a + m2 - 1.0) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (a + b + m) * x / ((a + m2) * (a + m2 + 1.0))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def _betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbeta) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbeta) * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, dof: float) -> float:
    if t is None or dof is None or math.isnan(t) or dof <= 0:
        return float("nan")
    return _betainc(dof / 2.0, 0.5, dof / (dof + t * t))


def normal_two_sided_p(z: float) -> float:
    if z is None or math.isnan(z):
        return float("nan")
    return math.erfc(abs(z) / math.sqrt(2.0))


#: Up to this many pairs the exact distribution of U is counted; beyond it one group of eight is long past asymptotic.
EXACT_GROUP, EXACT_PAIRS = 8, 200_000


def exact_u_two_sided_p(n0: int, n1: int, u: float) -> float:
    """Two-sided p-value of U without ties: twice the share of the arrangements with a U at least as far out. The counts
    are the coefficients of the Gaussian binomial: one factor 1 - q^(n + i) and one division by 1 - q^i per member of the
    smaller group, in whole numbers."""
    m, n = sorted((int(n0), int(n1)))
    size = m * n + 1
    ways = [1] + [0] * (size - 1)
    for i in range(1, m + 1):
        for k in range(size - 1, n + i - 1, -1):
            ways[k] -= ways[k - n - i]
        for k in range(i, size):
            ways[k] += ways[k - i]
    far = math.ceil(max(u, m * n - u))
    return min(1.0, 2 * sum(ways[far:]) / math.comb(m + n, m))


def u_two_sided_p(n0: int, n1: int, u: float, ties: float, z: float) -> float:
    """Exact where one group has at most eight members and no two values are equal, else by the normal tail of z (which
    carries the tie and the continuity correction)."""
    if n0 and n1 and min(n0, n1) <= EXACT_GROUP and ties == 0 and n0 * n1 <= EXACT_PAIRS:
        return exact_u_two_sided_p(n0, n1, u)
    if z is None or math.isnan(z):
        return float("nan")
    return min(1.0, math.erfc(z / math.sqrt(2.0)))


@F.pandas_udf(T.DoubleType())
def _u_p(n0: pd.Series, n1: pd.Series, u: pd.Series, ties: pd.Series, z: pd.Series) -> pd.Series:
    return pd.Series([u_two_sided_p(*row) for row in zip(n0, n1, u, ties, z)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _t_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(a, b) for a, b in zip(t, dof)], dtype="float64")


# ----------------------------------------------------------------------------- aggregates
def class_balance(df: DataFrame, label: str = LABEL) -> DataFrame:
    """A1: rows per class, share of all rows, overall positive rate."""
    tot = df.agg(F.count(F.lit(1)).alias("_n"), F.avg(label).alias("positive_rate"))
    return (df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
            .crossJoin(F.broadcast(tot))
            .select(label, "n", (F.col("n") / F.col("_n")).alias("share"), "positive_rate"))


def rate_by(df: DataFrame, col: str, label: str = LABEL, flag_above: float | None = None) -> DataFrame:
    """A2-A5: impulse rate per group with the overall rate (and a flag above a rate)."""
    overall = df.agg(F.avg(label).alias("overall_rate"))
    out = (df.groupBy(col).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("impulse_rate"))
           .crossJoin(F.broadcast(overall)))
    if flag_above is not None:
        out = out.withColumn("above_threshold", C.flag(F.col("impulse_rate") > flag_above))
    return out


def t_test(df: DataFrame, value: str = LABEL, group: str = "is_weekend") -> DataFrame:
    """Two-sample equal-variance t-test of ``value`` between group 0 and group 1."""
    g = lambda k, f: f(F.when(F.col(group) == k, F.col(value)))
    s = df.agg(g(0, F.count).alias("n0"), g(1, F.count).alias("n1"),
               g(0, F.avg).alias("mean0"), g(1, F.avg).alias("mean1"),
               g(0, F.var_samp).alias("var0"), g(1, F.var_samp).alias("var1"))
    dof = F.col("n0") + F.col("n1") - 2
    sp2 = ((F.col("n0") - 1) * F.col("var0") + (F.col("n1") - 1) * F.col("var1")) / dof
    t = (F.col("mean0") - F.col("mean1")) / F.sqrt(sp2 * (1.0 / F.col("n0") + 1.0 / F.col("n1")))
    return s.select("n0", "n1", "mean0", "mean1", t.alias("t_stat"), dof.cast("double").alias("dof"))


def with_t_p(res: DataFrame) -> DataFrame:
    return res.withColumn("p_value", _t_p(F.col("t_stat"), F.col("dof")))


def unpivot(df: DataFrame, cols, keep=(), name: str = "feature", value: str = "value") -> DataFrame:
    """Wide -> long (feature, value) without a shuffle."""
    return df.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols])).alias("_kv")
    ).select(*keep, f"_kv.{name}", f"_kv.{value}")


def mann_whitney(df: DataFrame, features, group: str = LABEL, p_values: bool = False) -> DataFrame:
    """Two-sided Mann-Whitney U of group 0 against group 1, per feature, from pooled average
    ranks (one prefix-sum pass for all features); asymptotic z with tie and continuity correction. With
    ``p_values`` also ``p_value``: exact for a group of at most eight without ties, else asymptotic."""
    long = unpivot(df.where(F.col(group).isin(0, 1)), features, keep=[group]).where(F.col("value").isNotNull())
    ps = prefix_sums(long, "value", {"c": F.lit(1), "c0": (F.col(group) == 0).cast("long")}, by=["feature"])
    rank = F.col("c_before") + (F.col("c") + 1) / 2.0
    s = ps.groupBy("feature").agg(
        F.sum("c0").alias("n0"), (F.sum("c") - F.sum("c0")).alias("n1"),
        F.sum(rank * F.col("c0")).alias("r0"),
        F.sum(F.pow(F.col("c"), 3) - F.col("c")).alias("ties"))
    n0, n1 = F.col("n0"), F.col("n1")
    n = n0 + n1
    u0 = F.col("r0") - n0 * (n0 + 1) / 2.0
    mu = n0 * n1 / 2.0
    sigma = F.sqrt(n0 * n1 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    u_big = F.greatest(u0, n0 * n1 - u0)
    z = (u_big - mu - 0.5) / sigma
    out = s.select("feature", "n0", "n1", u0.alias("u_stat"), z.alias("z"), F.col("ties").cast("double").alias("_ties"))
    # one row per feature
    return (out.withColumn("p_value", _u_p("n0", "n1", "u_stat", "_ties", "z")) if p_values else out).drop("_ties")


def significance_table(df: DataFrame, features=None, label: str = LABEL, p_values: bool = False) -> DataFrame:
    """T5 (+ P30): class means, percent difference and Mann-Whitney significance per feature, with ``p_values`` also the
    p-value."""
    features = features or SIGNIFICANCE_FEATURES
    long = unpivot(df, features, keep=[label])
    means = long.groupBy("feature").agg(
        F.avg(F.when(F.col(label) == 0, F.col("value"))).alias("mean_non_impulse"),
        F.avg(F.when(F.col(label) == 1, F.col("value"))).alias("mean_impulse"))
    mw = mann_whitney(df, features, label, p_values)
    out = means.join(mw, "feature")
    return out.select("feature", "mean_non_impulse", "mean_impulse",
                      C.pct_diff(F.col("mean_impulse"), F.col("mean_non_impulse")).alias("diff_pct"),
                      "u_stat", "z", C.flag(F.abs("z") > Z_05).alias("significant"), *["p_value"] * p_values)


def correlation_table(df: DataFrame, cols=None) -> DataFrame:
    """Pearson r of every pair below the diagonal, one aggregate pass, as a long table."""
    cols = cols or CORRELATION_FEATURES
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[:i]]
    r = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs])
    return r.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"{a}__{b}").alias("r"))
        for a, b in pairs])).alias("_p")).select("_p.*")


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """T4."""
    return df.agg(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("pearson_r"))


def histogram(df: DataFrame, col: str, bins: int, lo: float | None = None, hi: float | None = None,
              by: str | None = None, density: bool = False) -> DataFrame:
    """Fixed-width bins over [lo, hi] (min/max when not given), last edge closed, every bin
    listed (empty ones with 0); optional group column; counts or densities (per group)."""
    x = F.col(col).cast("double")
    keys0 = [by] if by else []
    base = df.select(*keys0, x.alias("_x")).where(F.col("_x").isNotNull())
    if lo is None or hi is None:
        # data range (per group when grouped, as a separate histogram per group would use);
        # a constant column gets the range [v - 0.5, v + 0.5]
        rng = base.groupBy(*keys0).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        same = F.col("_hi") == F.col("_lo")
        rng = rng.select(*keys0, F.when(same, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
                         F.when(same, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    else:
        rng = base.select(*keys0).distinct() if by else base.sparkSession.range(1).select()
        rng = rng.select(*keys0, F.lit(float(lo)).alias("_lo"), F.lit(float(hi)).alias("_hi"))
    rng = rng.withColumn("_step", (F.col("_hi") - F.col("_lo")) / bins)
    # one range row per group (a label / model column, never a key column): broadcast
    inb = (base.join(F.broadcast(rng), keys0) if by else base.crossJoin(F.broadcast(rng)))
    inb = inb.where((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))
    inb = inb.withColumn("bin", F.least(F.floor((F.col("_x") - F.col("_lo")) / F.col("_step")).cast("int"),
                                        F.lit(bins - 1)))
    keys = keys0 + ["bin"]
    counts = inb.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select(*keys0, "_lo", "_step", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, keys, "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))
    out = out.withColumns({"bin_lo": F.col("_lo") + F.col("bin") * F.col("_step"),
                           "bin_hi": F.col("_lo") + (F.col("bin") + 1) * F.col("_step")})
    if density:
        tot = F.sum("count").over(Window.partitionBy(*keys0))
        out = out.withColumn("density", F.col("count") / (tot * F.col("_step")))
    return out.drop("_lo", "_step")


def time_max(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Latest timestamp."""
    return df.agg(F.max(ts).alias("max_timestamp"))


def exact_quantile_micros(df: DataFrame, ts: str, q: float) -> DataFrame:
    """Exact linearly interpolated quantile of a timestamp (pandas ``quantile``): the two order statistics around
    ``q * (n - 1)`` by radix selection. One row, none for an empty table."""
    value = interpolated_quantile(df, C.naive_micros(F.col(ts)), q)
    return df.sparkSession.createDataFrame([] if value is None else [(value,)], "quantile_micros double")


def time_quantile(df: DataFrame, q: float = 0.8, ts: str = "timestamp", exact: bool = True) -> DataFrame:
    if exact:
        mic = exact_quantile_micros(df, ts, q)
    else:
        mic = df.agg(F.percentile_approx(C.naive_micros(F.col(ts)), q, 100_000)
                     .cast("double").alias("quantile_micros"))
    return mic.select(C.from_naive_micros(F.floor("quantile_micros"))
                      .alias("quantile_ts"), "quantile_micros")


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Class counts, negative/positive ratio and balanced class weights n / (2 n_c)."""
    s = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("n_pos"),
               F.count_if(F.col(label) == 0).alias("n_neg"))
    return s.select("n", "n_pos", "n_neg",
                    F.try_divide(F.col("n_neg"), F.col("n_pos")).alias("neg_pos_ratio"),
                    F.try_divide(F.col("n"), 2 * F.col("n_neg")).alias("weight_neg"),
                    F.try_divide(F.col("n"), 2 * F.col("n_pos")).alias("weight_pos"))


ZERO_STD = 1e-12


def population_stats(df: DataFrame, cols) -> DataFrame:
    """Population mean and sample std per column, one row. A std of zero becomes 1; so does a
    std below ``ZERO_STD``, which only floating-point noise produces (a user's mean z-score is 0 in
    exact arithmetic), so z-scores of such a column are ~0 instead of noise divided by noise."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std")]
    s = df.agg(*aggs)
    return s.select(*[F.col(f"{c}__mean") for c in cols],
                    *[F.when(F.col(f"{c}__std") <= ZERO_STD, F.lit(1.0)).otherwise(F.col(f"{c}__std")).alias(f"{c}__std")
                      for c in cols])


def filter_eq(df: DataFrame, col: str, value) -> DataFrame:
    """F1."""
    return df.where(F.col(col) == F.lit(value))


def drop_missing(df: DataFrame, cols) -> DataFrame:
    """F2."""
    return df.na.drop(subset=list(cols))


def split_by_time(df: DataFrame, cutoff: Column, ts: Column | str = "timestamp"):
    """rows at or before the cutoff, rows after it. A literal cutoff reaches the scan."""
    at = F.col(ts) if isinstance(ts, str) else ts
    return df.where(at <= cutoff), df.where(at > cutoff)
