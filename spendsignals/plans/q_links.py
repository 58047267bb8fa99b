"""Queries that expose, under their own SURVEY id, operators that other queries compose:
P30, F3, J2, J3, J4, J7, O1."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explain as E
from ..operators import nexttxn as NX
from ..operators import stats as S
from . import inputs as I
from .catalog import register, rsql
from .q_io import _path
from .q_models import asql
from .q_next import nsql
from .q_stats import _mw_sql


@register("p30_pct_diff", _mw_sql(
    "SELECT feature, mean_non_impulse, mean_impulse, (mean_impulse - mean_non_impulse) / (mean_non_impulse + 1e-9)"
    " * 100 AS diff_pct FROM (SELECT feature, avg(value) FILTER (WHERE impulse_label = 0) AS mean_non_impulse, "
    "avg(value) FILTER (WHERE impulse_label = 1) AS mean_impulse FROM mw_long GROUP BY feature)",
    ["mean_non_impulse", "mean_impulse", "diff_pct"]))
def p30(spark, sf):
    """Percent difference of the class means per feature."""
    return S.significance_table(I.eng(spark, sf)).select("feature", "mean_non_impulse", "mean_impulse", "diff_pct")


@register("f03_split_by_time", rsql(
    "SELECT count(*) FILTER (WHERE epoch_us(\"timestamp\") <= q) AS rows_at_or_before, "
    "count(*) FILTER (WHERE epoch_us(\"timestamp\") > q) AS rows_after "
    "FROM txn, (SELECT quantile_cont(epoch_us(\"timestamp\"), 0.8) AS q FROM txn)"))
def f03(spark, sf):
    """transactions at or before / after the exact 0.8 time quantile."""
    train, test, _ = NX.time_split(I.txn(spark, sf).select("timestamp"), 0.8)
    return train.agg(F.count(F.lit(1)).alias("rows_at_or_before")).crossJoin(
        test.agg(F.count(F.lit(1)).alias("rows_after")))


@register("j02_join_ranks", asql(
    "SELECT feature, rank_a, rank_b FROM (SELECT feature, CAST(row_number() OVER (ORDER BY mean_abs_value DESC, "
    "feature) AS INT) AS rank_a FROM mabs) JOIN (SELECT feature, CAST(row_number() OVER (ORDER BY max(abs(value)) "
    "DESC, feature) AS INT) AS rank_b FROM attr GROUP BY feature) USING (feature)"))
def j02(spark, sf):
    """Two rank tables joined on the feature."""
    attr = E.centered_attribution(I.eng(spark, sf))
    a = E.mean_abs_attribution(attr).select("feature", F.col("mean_abs_value").alias("importance"))
    b = attr.groupBy("feature").agg(F.max(F.abs("value")).alias("importance"))
    return E.rank_agreement(a, b, 10).select("feature", "rank_a", "rank_b")


@register("j03_attach_user", nsql(
    "SELECT f.transaction_id, g.risk_score, g.recency_weighted_prob, g.impulse_prob_std, g.cluster "
    "FROM nxf f LEFT JOIN seg g USING (user_id)", ["risk_score", "recency_weighted_prob", "impulse_prob_std"]))
def j03(spark, sf):
    """User columns attached to every transaction (left join)."""
    c = I.Ctx(spark, sf, shared=True)
    return NX.attach_user(c.next_features.select("transaction_id", "user_id"), c.segmented).select(
        "transaction_id", *NX.USER_FEATURES)


@register("j04_attach_profile", nsql("SELECT user_id, next_impulse_prob, risk_tier, persona FROM atrisk",
                                     ["next_impulse_prob"]))
def j04(spark, sf):
    """Latest predictions joined with the profile."""
    return I.at_risk(spark, sf).select("user_id", "next_impulse_prob", "risk_tier", "persona")


@register("j07_with_nudge_columns", nsql("SELECT user_id, alert_level, urgency, savings_line, full_nudge FROM nudges"))
def j07(spark, sf):
    """The seven nudge columns added to each at-risk row (columns, not a positional join)."""
    return I.nudged(spark, sf).select("user_id", "alert_level", "urgency", "savings_line", "full_nudge")


@register("o01_write_sorted", rsql(
    "SELECT transaction_id, user_id, \"timestamp\", impulse_label FROM txn"))
def o01(spark, sf):
    """O1: rows written ordered by (user, time) inside each file, no global sort; read back."""
    from ..sources.transactions import load_table, save_table
    path = _path(spark, "sorted_txn")
    save_table(I.txn(spark, sf).select("transaction_id", "user_id", "timestamp", "impulse_label")
               .repartition("user_id"), path, sort_keys=["user_id", "timestamp", "transaction_id"])
    return load_table(spark, path)
