"""Queries for request features, request scoring and stream scoring (milestone 9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import scoring as ST
from . import inputs as I
from .catalog import register
from .oracle_sql import with_ctes

_W7 = 'PARTITION BY user_id ORDER BY "timestamp", transaction_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING'
REQ_CTE = f""", req AS (
 SELECT *, coalesce(CAST(sum(impulse_label) OVER ({_W7}) AS DOUBLE), 0.0) AS recent_impulse,
        CAST(count(impulse_label) OVER ({_W7}) AS DOUBLE) AS total_txn FROM txn),
feat AS (
 SELECT *, transaction_amount / NULLIF(monthly_salary, 0) AS spend_to_salary_ratio,
  CASE WHEN balance_after < 0.1 * monthly_salary THEN 1 ELSE 0 END AS balance_stress_indicator,
  CASE WHEN total_txn > 0 THEN recent_impulse / total_txn ELSE 0.0 END AS recent_impulse_rate,
  CASE WHEN transaction_amount / NULLIF(monthly_salary, 0) > 0.25 THEN 1 ELSE 0 END AS spend_burst_signal,
  CASE WHEN is_weekend = 1 THEN 1 ELSE 0 END AS weekend_effect FROM req),
tiers AS (
 SELECT *, impulse_prob AS prob, CAST(round(CAST(impulse_prob AS DECIMAL(20,10)), 3) AS DOUBLE) AS prob_rounded,
  CAST(round(CAST(impulse_prob AS DECIMAL(20,10)) * 100, 1) AS DOUBLE) AS risk_score,
  CASE WHEN impulse_prob * 100 > 75 THEN 'Critical' WHEN impulse_prob * 100 > 60 THEN 'High'
       WHEN impulse_prob * 100 > 40 THEN 'Moderate' ELSE 'Low' END AS tier FROM feat)
"""
_FEATS = ST.REQUEST_FEATURES
_OUT = ["transaction_id", "user_id", "balance_after", "recent_impulse", "total_txn"] + _FEATS + \
    ["prob", "prob_rounded", "risk_score", "tier"]
_D = ["balance_after", "recent_impulse", "total_txn", "spend_to_salary_ratio", "recent_impulse_rate", "prob",
      "prob_rounded", "risk_score"]


def ssql(select, doubles=()):
    body = select
    if doubles:
        body = "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in doubles) + f") FROM ({select}) q"
    return with_ctes().rstrip("\n") + REQ_CTE + body


@register("p27_request_features", ssql(
    f"SELECT transaction_id, recent_impulse, total_txn, {', '.join(_FEATS)} FROM feat",
    ["recent_impulse", "total_txn", "spend_to_salary_ratio", "recent_impulse_rate"]))
def p27(spark, sf):
    """The five request features from each transaction and its previous seven."""
    r = ST.request_features(ST.requests_from_transactions(I.txn(spark, sf)))
    return r.select("transaction_id", "recent_impulse", "total_txn", *_FEATS)


@register("p19_txn_tier", ssql("SELECT transaction_id, prob_rounded, risk_score, tier FROM tiers",
                               ["prob_rounded", "risk_score"]))
def p19(spark, sf):
    """Transaction score 100 p (1 place), probability (3 places) and tier on strict edges."""
    return ST.tiered(I.txn(spark, sf).withColumn("prob", F.col("impulse_prob"))).select(
        "transaction_id", "prob_rounded", "risk_score", "tier")


@register("s06_score_requests", ssql(f"SELECT {', '.join(_OUT)} FROM tiers", _D))
def s06(spark, sf):
    """Batch request scoring (features -> probability -> score and tier)."""
    return ST.score_requests(ST.requests_from_transactions(I.txn(spark, sf))).select(*_OUT)


@register("st1_stream_scoring", ssql(f"SELECT {', '.join(_OUT)} FROM tiers", _D))
def st1(spark, sf):
    """ST1: the same scoring as a Structured Streaming job over the events file source with
    per-user state (running balance, last seven labels); availableNow trigger, parquet sink."""
    out, ckpt = ST.stream_paths(spark, "st1")
    return ST.stream_scores(spark, sf, out, ckpt).select(*_OUT)


def request_model(spark, sf):
    """The five-feature request model: balanced logistic regression on the training split's requests."""
    from ..session import cut_lineage
    from . import models as M
    reqs = ST.request_features(ST.requests_from_transactions(I.txn(spark, sf)))
    reqs = cut_lineage(reqs.select("transaction_id", "impulse_label", *_FEATS))     # read by the split and every step of the fit
    split = M.stratified_split(reqs, "impulse_label")
    return M.fit(split.where("split = 'train'"), _FEATS, M.logistic(), scale=True)


@register("s06_score_requests_model")
def s06m(spark, sf):
    """S6 with the trained five-feature model."""
    return ST.score_requests(ST.requests_from_transactions(I.txn(spark, sf)), request_model(spark, sf)).select(*_OUT)


@register("st1_stream_scoring_model")
def st1m(spark, sf):
    """ST1 with the trained five-feature model: the stream's state feeds the same pipeline."""
    out, ckpt = ST.stream_paths(spark, "st1-model")
    return ST.stream_scores(spark, sf, out, ckpt, model=request_model(spark, sf)).select(*_OUT)
