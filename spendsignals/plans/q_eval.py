"""Queries for model evaluation over the long score table (milestone 4)."""

from __future__ import annotations

from ..operators import evaluation as X
from . import inputs as I
from .catalog import register
from .oracle_sql import with_ctes

SCORES_CTE = """, scores AS (
 SELECT transaction_id, 'deterministic' AS model, impulse_label AS label, impulse_prob AS prob,
        CASE WHEN impulse_prob >= 0.7 THEN 1 ELSE 0 END AS pred FROM txn
 UNION ALL
 SELECT transaction_id, 'hashed' AS model, impulse_label AS label,
        round((transaction_id * 37 % 101) / 101.0, 6) AS prob,
        CASE WHEN round((transaction_id * 37 % 101) / 101.0, 6) >= 0.5 THEN 1 ELSE 0 END AS pred FROM txn),
conf AS (
 SELECT model, count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
        count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp
 FROM scores GROUP BY model),
dist AS (
 SELECT model, prob, CAST(sum(label) AS BIGINT) AS pos, CAST(count(*) - sum(label) AS BIGINT) AS neg
 FROM scores GROUP BY model, prob),
cum AS (
 SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY prob DESC) AS ctp,
        sum(neg) OVER (PARTITION BY model ORDER BY prob DESC) AS cfp,
        sum(pos) OVER (PARTITION BY model) AS P, sum(neg) OVER (PARTITION BY model) AS N FROM dist),
auc AS (
 SELECT model, sum((N - cfp) * pos + 0.5 * pos * neg) / (max(P) * max(N)) AS roc_auc FROM cum GROUP BY model),
ap AS (SELECT model, sum(pos * ctp / (ctp + cfp)) / max(P) AS average_precision FROM cum GROUP BY model),
rep AS (
 SELECT model, tn, fp, fn, tp,
  coalesce(tn / NULLIF(tn + fn, 0), 0) AS precision_0, coalesce(tn / NULLIF(tn + fp, 0), 0) AS recall_0,
  coalesce(tp / NULLIF(tp + fp, 0), 0) AS precision_1, coalesce(tp / NULLIF(tp + fn, 0), 0) AS recall_1,
  tn + fp AS support_0, tp + fn AS support_1, tn + fp + fn + tp AS n FROM conf),
rep2 AS (
 SELECT *, coalesce(2 * precision_0 * recall_0 / NULLIF(precision_0 + recall_0, 0), 0) AS f1_0,
        coalesce(2 * precision_1 * recall_1 / NULLIF(precision_1 + recall_1, 0), 0) AS f1_1 FROM rep),
agr AS (
 SELECT model,
  coalesce((1.0 * tp * tn - 1.0 * fp * fn) / NULLIF(sqrt((tp + fp) * 1.0 * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc,
  coalesce(((tp + tn) * 1.0 / n - ((tp + fp) * 1.0 * (tp + fn) + (tn + fn) * 1.0 * (tn + fp)) / (n * 1.0 * n))
   / NULLIF(1 - ((tp + fp) * 1.0 * (tp + fn) + (tn + fn) * 1.0 * (tn + fp)) / (n * 1.0 * n), 0), 0) AS kappa
 FROM rep),
loss AS (
 SELECT model, avg(-(label * ln(greatest(least(prob, 1 - 1e-15), 1e-15))
                     + (1 - label) * ln(1 - greatest(least(prob, 1 - 1e-15), 1e-15)))) AS log_loss,
        avg(power(prob - label, 2)) AS brier FROM scores GROUP BY model)
"""


def esql(select: str, doubles=()) -> str:
    body = select
    if doubles:
        body = "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in doubles) + f") FROM ({select}) q"
    return with_ctes().rstrip("\n") + SCORES_CTE + body


@register("x01_confusion", esql("SELECT model, tn, fp, fn, tp FROM conf"))
def x01(spark, sf):
    return X.confusion(I.model_scores(spark, sf))


_X2 = ["precision_0", "recall_0", "f1_0", "precision_1", "recall_1", "f1_1", "accuracy", "macro_precision",
       "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1"]


@register("x02_class_report", esql(
    "SELECT model, precision_0, recall_0, f1_0, support_0, precision_1, recall_1, f1_1, support_1, "
    "coalesce((tn + tp) / NULLIF(n, 0), 0) AS accuracy, (precision_0 + precision_1) / 2 AS macro_precision, "
    "(recall_0 + recall_1) / 2 AS macro_recall, (f1_0 + f1_1) / 2 AS macro_f1, "
    "(precision_0 * support_0 + precision_1 * support_1) / n AS weighted_precision, "
    "(recall_0 * support_0 + recall_1 * support_1) / n AS weighted_recall, "
    "(f1_0 * support_0 + f1_1 * support_1) / n AS weighted_f1 FROM rep2", _X2))
def x02(spark, sf):
    return X.class_report(I.model_scores(spark, sf))


@register("x03_roc_auc", esql("SELECT model, roc_auc FROM auc", ["roc_auc"]))
def x03(spark, sf):
    """Exact rank ROC-AUC per model from distributed prefix counts."""
    return X.roc_auc(I.model_scores(spark, sf))


@register("x04_average_precision", esql("SELECT model, average_precision FROM ap", ["average_precision"]))
def x04(spark, sf):
    return X.average_precision(I.model_scores(spark, sf))


_X5 = ["threshold", "tpr", "fpr", "precision"]


@register("x05_curve_points", esql(
    "SELECT model, prob AS threshold, CAST(ctp AS BIGINT) AS tp, CAST(cfp AS BIGINT) AS fp, ctp / P AS tpr, cfp / N AS fpr, "
    "ctp / (ctp + cfp) AS precision FROM cum", _X5))
def x05(spark, sf):
    return X.curve_points(I.model_scores(spark, sf))


@register("x05_curve_corners", esql(
    "SELECT model, prob AS threshold, CAST(ctp AS BIGINT) AS tp, CAST(cfp AS BIGINT) AS fp, ctp / P AS tpr, cfp / N AS fpr, "
    "ctp / (ctp + cfp) AS precision FROM (SELECT *, lead(ctp) OVER w - ctp AS up, lead(cfp) OVER w - cfp AS right_, "
    "ctp - coalesce(lag(ctp) OVER w, 0) AS up0, cfp - coalesce(lag(cfp) OVER w, 0) AS right0 FROM cum "
    "WINDOW w AS (PARTITION BY model ORDER BY prob DESC)) WHERE up IS NULL OR up * right0 <> up0 * right_", _X5))
def x05c(spark, sf):
    """The corners of the ROC curve only."""
    return X.curve_corners(I.model_scores(spark, sf))


_TH = "[" + ", ".join(f"CAST({t!r} AS DOUBLE)" for t in X.SWEEP_THRESHOLDS) + "]"
SWEEP_SQL = f"""SELECT model, threshold_index, threshold, tp, fp, fn, tn, precision, recall, f1,
  CASE WHEN row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold_index) = 1 THEN 1 ELSE 0 END AS is_best
 FROM (SELECT *, coalesce(tp / NULLIF(tp + fp, 0), 0) AS precision, coalesce(tp / NULLIF(tp + fn, 0), 0) AS recall,
        coalesce(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0) AS f1
  FROM (SELECT s.model, CAST(t.i - 1 AS INT) AS threshold_index, t.th AS threshold,
          count(*) FILTER (WHERE label = 1 AND prob >= t.th) AS tp, count(*) FILTER (WHERE label = 0 AND prob >= t.th) AS fp,
          count(*) FILTER (WHERE label = 1 AND prob < t.th) AS fn, count(*) FILTER (WHERE label = 0 AND prob < t.th) AS tn
        FROM scores s, (SELECT unnest({_TH}) AS th, unnest(range(1, {len(X.SWEEP_THRESHOLDS) + 1})) AS i) t
        GROUP BY s.model, t.i, t.th))"""


@register("x06_threshold_sweep", esql(SWEEP_SQL, ["threshold", "precision", "recall", "f1"]))
def x06(spark, sf):
    """F1 over the 80-threshold grid in one bucketed pass; first maximum flagged."""
    return X.threshold_sweep(I.model_scores(spark, sf))


@register("x07_errors_by_threshold", esql(
    f"SELECT model, threshold_index, threshold, fp, fn FROM ({SWEEP_SQL})", ["threshold"]))
def x07(spark, sf):
    """False positives and false negatives per threshold."""
    return X.threshold_sweep(I.model_scores(spark, sf)).select("model", "threshold_index", "threshold", "fp", "fn")


@register("x08_agreement", esql("SELECT model, mcc, kappa FROM agr", ["mcc", "kappa"]))
def x08(spark, sf):
    return X.agreement(I.model_scores(spark, sf))


@register("x09_probability_loss", esql("SELECT model, log_loss, brier FROM loss", ["log_loss", "brier"]))
def x09(spark, sf):
    return X.probability_loss(I.model_scores(spark, sf))


@register("x10_error_rates", esql(
    "SELECT model, tn, fp, fn, tp, coalesce(fp / NULLIF(fp + tn, 0), 0) AS false_alarm_rate, "
    "coalesce(fn / NULLIF(fn + tp, 0), 0) AS miss_rate FROM conf", ["false_alarm_rate", "miss_rate"]))
def x10(spark, sf):
    return X.error_rates(I.model_scores(spark, sf))


_ED = "[" + ", ".join(f"CAST({e!r} AS DOUBLE)" for e in X.CALIBRATION_EDGES) + "]"


@register("x11_reliability", esql(
    f"SELECT model, CAST(len(list_filter({_ED}, lambda e: e < prob)) AS INT) AS bin, count(*) AS n, "
    "avg(prob) AS mean_predicted, avg(label) AS fraction_positive FROM scores GROUP BY ALL",
    ["mean_predicted", "fraction_positive"]))
def x11(spark, sf):
    return X.reliability(I.model_scores(spark, sf))


_X12 = ["roc_auc", "average_precision", "f1", "precision", "recall", "accuracy", "mcc", "kappa", "log_loss", "brier"]


@register("x12_compare_models", esql(
    "SELECT auc.model, roc_auc, average_precision, f1_1 AS f1, precision_1 AS precision, recall_1 AS recall, "
    "coalesce((tn + tp) / NULLIF(n, 0), 0) AS accuracy, mcc, kappa, log_loss, brier "
    "FROM auc JOIN ap USING (model) JOIN rep2 USING (model) JOIN agr USING (model) JOIN loss USING (model)", _X12))
def x12(spark, sf):
    """Multi-model comparison table from one long score table."""
    return X.compare_models(I.model_scores(spark, sf))


_X13 = f"""SELECT g.model, g.label, g.bin, CAST(coalesce(c.cnt, 0) AS BIGINT) AS count,
  g.lo + g.bin * g.step AS bin_lo, g.lo + (g.bin + 1) * g.step AS bin_hi,
  coalesce(c.cnt, 0) / (sum(coalesce(c.cnt, 0)) OVER (PARTITION BY g.model, g.label) * g.step) AS density
 FROM (SELECT r.*, CAST(b.bin AS INT) AS bin FROM rng r, range(0, 60) b(bin)) g
 LEFT JOIN (SELECT s.model, s.label, CAST(least(floor((prob - r.lo) / r.step), 59) AS INT) AS bin, count(*) AS cnt
            FROM scores s JOIN rng r ON s.model = r.model AND s.label = r.label GROUP BY ALL) c
 ON g.model = c.model AND g.label = c.label AND g.bin = c.bin"""
_RNG = """, rng AS (SELECT model, label, lo, hi, (hi - lo) / 60 AS step FROM (
  SELECT model, label, CASE WHEN max(prob) = min(prob) THEN min(prob) - 0.5 ELSE min(prob) END AS lo,
         CASE WHEN max(prob) = min(prob) THEN max(prob) + 0.5 ELSE max(prob) END AS hi FROM scores GROUP BY ALL))
"""


@register("x13_score_histogram", with_ctes().rstrip("\n") + SCORES_CTE.rstrip("\n") + _RNG +
          "SELECT * REPLACE (round(bin_lo, 6) AS bin_lo, round(bin_hi, 6) AS bin_hi, round(density, 6) AS density) "
          f"FROM ({_X13}) q")
def x13(spark, sf):
    """60-bin density histogram of scores per model and true class."""
    return X.score_histogram(I.model_scores(spark, sf))


@register("f04_first_match", esql(
    "SELECT model, min(transaction_id) FILTER (WHERE label = 1 AND pred = 1) AS first_hit, "
    "min(transaction_id) FILTER (WHERE label = 1 AND pred = 0) AS first_miss FROM scores GROUP BY model"))
def f04(spark, sf):
    """first true positive and first false negative per model (lowest transaction id)."""
    s = I.model_scores(spark, sf)
    hit = X.first_match(s, 1, 1).withColumnRenamed("transaction_id", "first_hit")
    miss = X.first_match(s, 1, 0).withColumnRenamed("transaction_id", "first_miss")
    return hit.join(miss, "model", "full")
