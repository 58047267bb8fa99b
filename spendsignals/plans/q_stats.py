"""Queries for profiling and statistics (milestone 3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import stats as S
from . import inputs as I
from .catalog import register, rsql
from .oracle_sql import with_ctes

ENG = ("eng",)
PR = ("prof",)


@register("a01_class_balance", rsql(
    "SELECT impulse_label, count(*) AS n, count(*) / (SELECT count(*) FROM txn) AS share, "
    "(SELECT avg(impulse_label) FROM txn) AS positive_rate FROM txn GROUP BY impulse_label", (),
    ["share", "positive_rate"]))
def a01(spark, sf):
    return S.class_balance(I.txn(spark, sf))


def _rate_sql(col, src, flag=False, ctes=()):
    extra = ", CASE WHEN avg(impulse_label) > 0.4 THEN 1 ELSE 0 END AS above_threshold" if flag else ""
    return rsql(f"SELECT {col}, count(*) AS n, avg(impulse_label) AS impulse_rate, "
                f"(SELECT avg(impulse_label) FROM {src}) AS overall_rate{extra} FROM {src} GROUP BY {col}",
                ctes, ["impulse_rate", "overall_rate"])


@register("a02_rate_by_category", _rate_sql("merchant_category", "txn", flag=True))
def a02(spark, sf):
    """A2: impulse rate per merchant category with the overall rate and a > 40 % flag."""
    return S.rate_by(I.txn(spark, sf), "merchant_category", flag_above=0.4)


@register("a03_rate_by_hour", _rate_sql("hour", "txn"))
def a03(spark, sf):
    return S.rate_by(I.txn(spark, sf), "hour")


@register("a04_rate_by_weekend", _rate_sql("is_weekend", "txn"))
def a04(spark, sf):
    return S.rate_by(I.txn(spark, sf), "is_weekend")


@register("a05_rate_by_time_bin", _rate_sql("time_bin", "eng0", ctes=ENG))
def a05(spark, sf):
    return S.rate_by(FE.row_features(I.txn(spark, sf)), "time_bin")


@register("t01_t_test", rsql(
    "SELECT n0, n1, mean0, mean1, (mean0 - mean1) / sqrt(((n0 - 1) * var0 + (n1 - 1) * var1) / (n0 + n1 - 2)"
    " * (1.0 / n0 + 1.0 / n1)) AS t_stat, CAST(n0 + n1 - 2 AS DOUBLE) AS dof FROM ("
    "SELECT count(impulse_label) FILTER (WHERE is_weekend = 0) AS n0, "
    "count(impulse_label) FILTER (WHERE is_weekend = 1) AS n1, "
    "avg(impulse_label) FILTER (WHERE is_weekend = 0) AS mean0, avg(impulse_label) FILTER (WHERE is_weekend = 1) AS mean1, "
    "var_samp(impulse_label) FILTER (WHERE is_weekend = 0) AS var0, "
    "var_samp(impulse_label) FILTER (WHERE is_weekend = 1) AS var1 FROM txn)", (),
    ["mean0", "mean1", "t_stat", "dof"]))
def t01(spark, sf):
    """Equal-variance t-test of the label, weekday against weekend."""
    return S.t_test(I.txn(spark, sf), "impulse_label", "is_weekend")


#: Two-sided tails by Simpson's rule over u in [0, 1), x = edge + u / (1 - u).
_GRID = "(SELECT i / 4000.0 AS u, CASE WHEN i = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS weight FROM range(4000) r(i))"
_NORMAL_P = f"least(1.0, (SELECT 2 * sum(weight * exp(-power(z + u / (1 - u), 2) / 2) / power(1 - u, 2)) / 12000.0 / sqrt(2 * pi()) FROM {_GRID}))"
_T_P = f"""(SELECT 2 * sum(weight * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2) - ln(dof * pi()) / 2
  - (dof + 1) / 2 * ln(1 + power(abs(t_stat) + u / (1 - u), 2) / dof)) / power(1 - u, 2)) / 12000.0 FROM {_GRID})"""


@register("t01_t_test_p", rsql(
    f"SELECT *, {_T_P} AS p_value FROM (SELECT n0, n1, mean0, mean1, (mean0 - mean1) / sqrt(((n0 - 1) * var0 + (n1 - 1) * var1) / (n0 + n1 - 2)"
    " * (1.0 / n0 + 1.0 / n1)) AS t_stat, CAST(n0 + n1 - 2 AS DOUBLE) AS dof FROM ("
    "SELECT count(impulse_label) FILTER (WHERE is_weekend = 0) AS n0, "
    "count(impulse_label) FILTER (WHERE is_weekend = 1) AS n1, "
    "avg(impulse_label) FILTER (WHERE is_weekend = 0) AS mean0, avg(impulse_label) FILTER (WHERE is_weekend = 1) AS mean1, "
    "var_samp(impulse_label) FILTER (WHERE is_weekend = 0) AS var0, "
    "var_samp(impulse_label) FILTER (WHERE is_weekend = 1) AS var1 FROM txn))", (),
    ["mean0", "mean1", "t_stat", "dof", "p_value"]))
def t01p(spark, sf):
    """T1 with its two-sided p-value (t distribution on the one-row result)."""
    return S.with_t_p(S.t_test(I.txn(spark, sf), "impulse_label", "is_weekend"))


_MW_COLS = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in S.SIGNIFICANCE_FEATURES)
MW_CTE = f""", mw_long AS (
 SELECT impulse_label, feature, value FROM (SELECT impulse_label, {_MW_COLS} FROM eng)
 UNPIVOT (value FOR feature IN ({", ".join(S.SIGNIFICANCE_FEATURES)})) WHERE value IS NOT NULL),
mw_rank AS (
 SELECT feature, impulse_label, value,
  rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r
 FROM mw_long),
mw_ties AS (SELECT feature, sum(power(c, 3) - c) AS ties FROM
 (SELECT feature, value, count(*) AS c FROM mw_long GROUP BY feature, value) GROUP BY feature),
mw_sum AS (
 SELECT feature, count(*) FILTER (WHERE impulse_label = 0) AS n0, count(*) FILTER (WHERE impulse_label = 1) AS n1,
  sum(r) FILTER (WHERE impulse_label = 0) AS r0 FROM mw_rank GROUP BY feature),
mw AS (
 SELECT s.feature, n0, n1, r0 - n0 * (n0 + 1) / 2.0 AS u_stat,
  (greatest(r0 - n0 * (n0 + 1) / 2.0, n0 * n1 - (r0 - n0 * (n0 + 1) / 2.0)) - n0 * n1 / 2.0 - 0.5)
   / sqrt(n0 * n1 / 12.0 * ((n0 + n1 + 1) - ties / ((n0 + n1) * (n0 + n1 - 1.0)))) AS z
 FROM mw_sum s JOIN mw_ties t USING (feature))
"""


def _mw_sql(select, doubles):
    return rsql("", ENG).rstrip("\n") + MW_CTE + _wrap(select, doubles)


def _wrap(select, doubles):
    return "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in doubles) + f") FROM ({select}) q"


@register("t02_mann_whitney", _mw_sql("SELECT feature, n0, n1, u_stat, z FROM mw", ["u_stat", "z"]))
def t02(spark, sf):
    """Mann-Whitney U per feature (pooled average ranks via one prefix-sum pass)."""
    return S.mann_whitney(I.eng(spark, sf), S.SIGNIFICANCE_FEATURES)


@register("t02_mann_whitney_p", _mw_sql(f"SELECT feature, n0, n1, u_stat, z, {_NORMAL_P} AS p_value FROM mw", ["u_stat", "z", "p_value"]))
def t02p(spark, sf):
    """T2 with two-sided p-values (one row per feature; both groups are far over eight here, so asymptotic)."""
    return S.mann_whitney(I.eng(spark, sf), S.SIGNIFICANCE_FEATURES, p_values=True)


_T5 = ["mean_non_impulse", "mean_impulse", "diff_pct", "u_stat", "z"]


@register("t05_significance_table", _mw_sql(
    "SELECT m.feature, mean_non_impulse, mean_impulse, (mean_impulse - mean_non_impulse) / (mean_non_impulse + 1e-9)"
    " * 100 AS diff_pct, u_stat, z, CASE WHEN abs(z) > 1.959963984540054 THEN 1 ELSE 0 END AS significant "
    "FROM (SELECT feature, avg(value) FILTER (WHERE impulse_label = 0) AS mean_non_impulse, "
    "avg(value) FILTER (WHERE impulse_label = 1) AS mean_impulse FROM mw_long GROUP BY feature) m "
    "JOIN mw USING (feature)", _T5))
def t05(spark, sf):
    """T5 + P30: class means, percent difference, Mann-Whitney z and a p < 0.05 flag per feature."""
    return S.significance_table(I.eng(spark, sf))


@register("t05_significance_p", _mw_sql(
    "SELECT m.feature, mean_non_impulse, mean_impulse, (mean_impulse - mean_non_impulse) / (mean_non_impulse + 1e-9)"
    f" * 100 AS diff_pct, u_stat, z, CASE WHEN abs(z) > 1.959963984540054 THEN 1 ELSE 0 END AS significant, {_NORMAL_P} AS p_value "
    "FROM (SELECT feature, avg(value) FILTER (WHERE impulse_label = 0) AS mean_non_impulse, "
    "avg(value) FILTER (WHERE impulse_label = 1) AS mean_impulse FROM mw_long GROUP BY feature) m "
    "JOIN mw USING (feature)", _T5 + ["p_value"]))
def t05p(spark, sf):
    """T5 with the p-value beside the flag."""
    return S.significance_table(I.eng(spark, sf), p_values=True)


_PAIRS = [(a, b) for i, a in enumerate(S.CORRELATION_FEATURES) for b in S.CORRELATION_FEATURES[:i]]
_CORR_SQL = rsql(
    "SELECT split_part(pair, '__', 1) AS feature_a, split_part(pair, '__', 2) AS feature_b, r FROM (SELECT "
    + ", ".join(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS "{a}__{b}"' for a, b in _PAIRS)
    + " FROM eng) UNPIVOT INCLUDE NULLS (r FOR pair IN (" + ", ".join(f'"{a}__{b}"' for a, b in _PAIRS) + "))",
    ENG, ["r"])


@register("t03_correlation_table", _CORR_SQL)
def t03(spark, sf):
    """Pearson matrix of 14 columns, lower triangle, one aggregate pass."""
    return S.correlation_table(I.eng(spark, sf))


@register("t04_pearson", rsql("SELECT corr(risk_score, raw_impulse_rate) AS pearson_r FROM prof", PR, ["pearson_r"]))
def t04(spark, sf):
    """T4: Pearson r of the user risk score with the true impulse rate."""
    return S.pearson(I.profile(spark, sf), "risk_score", "raw_impulse_rate")


def hist_sql(src: str, bins: int, by: str | None, density: bool, ctes=("eng",), extra_cte: str = "") -> str:
    """Oracle for A18: ``src`` is a SELECT giving columns (g, x); equal-width bins over each group's
    own [min, max] (a constant group gets [v - 0.5, v + 0.5]), last edge closed, every bin listed."""
    g_sel = by if by else "0"
    dens = (f", coalesce(c.cnt, 0) / (sum(coalesce(c.cnt, 0)) OVER (PARTITION BY g.g) * g.step) AS density"
            if density else "")
    body = f"""SELECT {"g.g AS " + by + ", " if by else ""}g.bin, CAST(coalesce(c.cnt, 0) AS BIGINT) AS count,
  g.lo + g.bin * g.step AS bin_lo, g.lo + (g.bin + 1) * g.step AS bin_hi{dens}
 FROM (SELECT r.*, CAST(b.bin AS INT) AS bin FROM rng r, range(0, {bins}) b(bin)) g
 LEFT JOIN (SELECT z.g, CAST(least(floor((z.x - r.lo) / r.step), {bins - 1}) AS INT) AS bin, count(*) AS cnt
            FROM hsrc z JOIN rng r USING (g) GROUP BY ALL) c ON g.g = c.g AND g.bin = c.bin"""
    cte = f""", hsrc AS (SELECT * FROM ({src.replace("{g}", g_sel)}) WHERE x IS NOT NULL),
rng AS (SELECT g, lo, hi, (hi - lo) / {bins} AS step FROM (
  SELECT g, CASE WHEN max(x) = min(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
         CASE WHEN max(x) = min(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM hsrc GROUP BY g))
"""
    doubles = ["bin_lo", "bin_hi"] + (["density"] if density else [])
    return (with_ctes(*ctes).rstrip("\n") + extra_cte.rstrip("\n") + cte + "SELECT * REPLACE ("
            + ", ".join(f"round({c}, 6) AS {c}" for c in doubles) + f") FROM ({body}) q")


@register("a18_histogram", hist_sql(
    "SELECT impulse_label AS g, greatest(least(spend_zscore, 5.0), -3.0) AS x FROM eng", 50, "impulse_label", True))
def a18(spark, sf):
    """Spend z-score clipped to [-3, 5] (P14), then a 50-bin density histogram per class over
    each class's own range, every bin listed."""
    from ..functions.columns import clip
    e = I.eng(spark, sf).withColumn("_x", clip(F.col("spend_zscore"), -3, 5))
    h = S.histogram(e, "_x", 50, by="impulse_label", density=True)
    return h.select("impulse_label", "bin", "count", "bin_lo", "bin_hi", "density")


@register("a18_risk_score_histogram", hist_sql("SELECT 0 AS g, risk_score AS x FROM prof", 40, None, False, ("prof",)))
def a18b(spark, sf):
    """40-bin count histogram of user risk scores over their range."""
    return S.histogram(I.profile(spark, sf), "risk_score", 40).select("bin", "count", "bin_lo", "bin_hi")


@register("o05_report_score_bins", hist_sql("SELECT 0 AS g, risk_score AS x FROM prof", 30, None, False, ("prof",)))
def o05(spark, sf):
    """The report's 30 score bins, computed by Spark instead of a sorted list sent to the page."""
    return S.histogram(I.profile(spark, sf), "risk_score", 30).select("bin", "count", "bin_lo", "bin_hi")


@register("a19_time_quantile", rsql(
    "SELECT make_timestamp(CAST(floor(qm) AS BIGINT)) AS quantile_ts, qm AS quantile_micros, mx AS max_timestamp "
    "FROM (SELECT quantile_cont(epoch_us(\"timestamp\"), 0.8) AS qm, max(\"timestamp\") AS mx FROM txn)",
    (), ["quantile_micros"]))
def a19(spark, sf):
    """Exact interpolated 0.8 quantile of time (distributed) and the latest timestamp."""
    t = I.txn(spark, sf)
    return S.time_quantile(t, 0.8).crossJoin(S.time_max(t))


@register("a20_class_weights", rsql(
    "SELECT count(*) AS n, count(*) FILTER (WHERE impulse_label = 1) AS n_pos, "
    "count(*) FILTER (WHERE impulse_label = 0) AS n_neg, "
    "count(*) FILTER (WHERE impulse_label = 0) / count(*) FILTER (WHERE impulse_label = 1) AS neg_pos_ratio, "
    "count(*) / (2.0 * count(*) FILTER (WHERE impulse_label = 0)) AS weight_neg, "
    "count(*) / (2.0 * count(*) FILTER (WHERE impulse_label = 1)) AS weight_pos FROM txn", (),
    ["neg_pos_ratio", "weight_neg", "weight_pos"]))
def a20(spark, sf):
    return S.class_weights(I.txn(spark, sf))


@register("f01_filter_eq", rsql(
    "SELECT transaction_id, user_id, transaction_amount FROM txn WHERE impulse_label = 1 AND is_weekend = 1",
    (), ["transaction_amount"]))
def f01(spark, sf):
    """equality filters (label and weekend flag), pushed into the scan where the column is stored."""
    t = I.txn(spark, sf)
    return S.filter_eq(S.filter_eq(t, "impulse_label", 1), "is_weekend", 1).select(
        "transaction_id", "user_id", "transaction_amount")
