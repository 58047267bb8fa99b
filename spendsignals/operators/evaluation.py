"""Model evaluation over a long score table ``(transaction_id, model, label, prob, pred)``: X1-X13.

Every metric is grouped by ``model``, so any number of models is evaluated in the same passes.
Rank metrics (AUC, AP, curves) use the distributed prefix sums; the threshold sweep is one
bucketed count plus a suffix sum instead of one pass per threshold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import prefix_sums
from .stats import histogram

# The reference's threshold grid np.arange(0.1, 0.9, 0.01) (80 values) and the inner
# edges of its 12 uniform calibration bins np.linspace(0, 1, 13)[1:-1], taken from numpy itself.
SWEEP_THRESHOLDS = np.arange(0.1, 0.9, 0.01).tolist()
CALIBRATION_EDGES = np.linspace(0.0, 1.0, 13)[1:-1].tolist()
LOGLOSS_EPS = 1e-15

M = ["model"]


def _div(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def summary(scores: DataFrame) -> DataFrame:
    """One aggregate per model holding everything the threshold metrics need: tn, fp, fn, tp and
    the log-loss and Brier sums (X1, X2, X8, X9, X10 all derive from it)."""
    y, p, pr = F.col("label"), F.col("pred"), F.col("prob")
    pc = F.greatest(F.least(pr, F.lit(1 - LOGLOSS_EPS)), F.lit(LOGLOSS_EPS))
    return scores.groupBy(*M).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.avg(-(y * F.ln(pc) + (1 - y) * F.ln(1 - pc))).alias("log_loss"),
        F.avg(F.pow(pr - y, 2)).alias("brier"))


def _summary(df: DataFrame) -> DataFrame:
    return df if "tp" in df.columns else summary(df)


def confusion(scores: DataFrame) -> DataFrame:
    """Tn, fp, fn, tp per model (one aggregate)."""
    y, p = F.col("label"), F.col("pred")
    if "tp" in scores.columns:
        return scores.select("model", "tn", "fp", "fn", "tp")
    return scores.groupBy(*M).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def _f1(p, r):
    return _div(2 * p * r, p + r)


def class_report(scores: DataFrame) -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and weighted averages."""
    c = confusion(scores)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    p0, r0, p1, r1 = _div(tn, tn + fn), _div(tn, tn + fp), _div(tp, tp + fp), _div(tp, tp + fn)
    c = c.withColumns({"precision_0": p0, "recall_0": r0, "precision_1": p1, "recall_1": r1,
                       "support_0": tn + fp, "support_1": tp + fn})
    c = c.withColumns({"f1_0": _f1(F.col("precision_0"), F.col("recall_0")),
                       "f1_1": _f1(F.col("precision_1"), F.col("recall_1"))})
    w0, w1 = F.col("support_0") / n, F.col("support_1") / n
    return c.select(
        "model", "precision_0", "recall_0", "f1_0", "support_0", "precision_1", "recall_1", "f1_1", "support_1",
        _div(tn + tp, n).alias("accuracy"),
        ((F.col("precision_0") + F.col("precision_1")) / 2).alias("macro_precision"),
        ((F.col("recall_0") + F.col("recall_1")) / 2).alias("macro_recall"),
        ((F.col("f1_0") + F.col("f1_1")) / 2).alias("macro_f1"),
        (F.col("precision_0") * w0 + F.col("precision_1") * w1).alias("weighted_precision"),
        (F.col("recall_0") * w0 + F.col("recall_1") * w1).alias("weighted_recall"),
        (F.col("f1_0") * w0 + F.col("f1_1") * w1).alias("weighted_f1"))


def agreement(scores: DataFrame) -> DataFrame:
    """Matthews correlation and Cohen's kappa."""
    c = confusion(scores)
    tn, fp, fn, tp = (F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    mcc = _div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    po = (tp + tn) / n
    pe = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    kappa = _div(po - pe, 1 - pe)
    return c.select("model", mcc.alias("mcc"), kappa.alias("kappa"))


def probability_loss(scores: DataFrame) -> DataFrame:
    """Log loss (p clipped to [1e-15, 1 - 1e-15]) and Brier score."""
    if "log_loss" in scores.columns:
        return scores.select("model", "log_loss", "brier")
    y, p = F.col("label"), F.col("prob")
    pc = F.greatest(F.least(p, F.lit(1 - LOGLOSS_EPS)), F.lit(LOGLOSS_EPS))
    ll = -(y * F.ln(pc) + (1 - y) * F.ln(1 - pc))
    return scores.groupBy(*M).agg(F.avg(ll).alias("log_loss"), F.avg(F.pow(p - y, 2)).alias("brier"))


def error_rates(scores: DataFrame) -> DataFrame:
    """False-alarm rate fp / (fp + tn) and miss rate fn / (fn + tp)."""
    c = confusion(scores)
    return c.select("model", "tn", "fp", "fn", "tp",
                    _div(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_alarm_rate"),
                    _div(F.col("fn"), F.col("fn") + F.col("tp")).alias("miss_rate"))


def _pos_neg(scores: DataFrame, descending: bool) -> DataFrame:
    return prefix_sums(scores, "prob", {"pos": (F.col("label") == 1).cast("long"),
                                        "neg": (F.col("label") == 0).cast("long")},
                       by=M, descending=descending)


def rank_metrics(scores: DataFrame) -> DataFrame:
    """X3 + X4 from one ascending prefix pass: values >= v have tp = P - pos_before, fp = N - neg_before.
    Per-model totals come from a small aggregate of the prefix table (broadcast)."""
    ps = _pos_neg(scores, descending=False)
    tot = ps.groupBy(*M).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    j = ps.join(F.broadcast(tot), M)
    tp = F.col("_P") - F.col("pos_before")
    fp = F.col("_N") - F.col("neg_before")
    return j.groupBy(*M).agg(
        _div(F.sum(F.col("neg_before") * F.col("pos") + 0.5 * F.col("pos") * F.col("neg")),
             F.first("_P") * F.first("_N")).alias("roc_auc"),
        _div(F.sum(F.col("pos") * tp / (tp + fp)), F.first("_P")).alias("average_precision"))


def roc_auc(scores: DataFrame) -> DataFrame:
    """Exact ROC-AUC = P(score_pos > score_neg) + 0.5 P(tie), from prefix counts."""
    ps = _pos_neg(scores, descending=False)
    return ps.groupBy(*M).agg(
        _div(F.sum(F.col("neg_before") * F.col("pos") + 0.5 * F.col("pos") * F.col("neg")),
             F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def average_precision(scores: DataFrame) -> DataFrame:
    """AP = sum over distinct scores (descending) of (R_i - R_{i-1}) * P_i."""
    ps = _pos_neg(scores, descending=True)
    tp = F.col("pos_before") + F.col("pos")
    fp = F.col("neg_before") + F.col("neg")
    return ps.groupBy(*M).agg(_div(F.sum(F.col("pos") * tp / (tp + fp)), F.sum("pos")).alias("average_precision"))


def curve_points(scores: DataFrame) -> DataFrame:
    """One ROC and PR point per distinct score threshold (score >= threshold is positive)."""
    ps = _pos_neg(scores, descending=True)
    tot = ps.groupBy(*M).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    tp = F.col("pos_before") + F.col("pos")
    fp = F.col("neg_before") + F.col("neg")
    return ps.join(F.broadcast(tot), M).select(
        "model", F.col("prob").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
        _div(tp, F.col("_P")).alias("tpr"), _div(fp, F.col("_N")).alias("fpr"),
        _div(tp, tp + fp).alias("precision"))


def curve_corners(scores: DataFrame, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """X5 at a bounded size: the points of ``curve_points`` at which the ROC curve bends, and its last one. A point on the
    straight line between its neighbours is left out, so the curve and its area are the same. Each point is compared with
    the next step inside its bucket of the ranking; the last point of a bucket gets the first step of the next
    bucket as a border row (one row per ``rows_per_bucket`` scores, broadcast)."""
    ps = _pos_neg(scores, descending=True)
    ps = ps.withColumn("_b", F.floor((F.col("pos_before") + F.col("neg_before")) / F.lit(rows_per_bucket)))
    step = F.struct("pos", "neg")
    order = Window.partitionBy(*M, "_b").orderBy(F.col("prob").desc())
    firsts = ps.groupBy(*M, "_b").agg(F.max_by(step, "prob").alias("_first"))
    borders = firsts.select(*M, "_b", F.lead("_first").over(Window.partitionBy(*M).orderBy("_b")).alias("_border"))
    tot = ps.groupBy(*M).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    following = F.coalesce(F.col("_next"), F.col("_border"))
    bends = following.isNull() | (F.col("pos") * following["neg"] != F.col("neg") * following["pos"])
    kept = ps.withColumn("_next", F.lead(step).over(order)).join(F.broadcast(borders), [*M, "_b"]).where(bends)
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    return kept.join(F.broadcast(tot), M).select(
        "model", F.col("prob").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
        _div(tp, F.col("_P")).alias("tpr"), _div(fp, F.col("_N")).alias("fpr"), _div(tp, tp + fp).alias("precision"))


def _thresholds_at_most(thresholds, p: Column) -> Column:
    """How many of the sorted thresholds are <= p (NULL: none). Evenly spaced ones are found by arithmetic and
    one exact comparison, which stays in generated code; others by a filter over the list."""
    t, k = [float(x) for x in thresholds], len(thresholds)
    arr = F.array(*[F.lit(x) for x in t])
    step = (t[-1] - t[0]) / (k - 1) if k > 1 else 0.0
    if step <= 0 or any(abs(x - (t[0] + i * step)) > step / 8 for i, x in enumerate(t)):
        return F.size(F.filter(arr, lambda x: x <= p))
    near = F.least(F.greatest(F.floor((p - t[0]) / step + 0.5), F.lit(0)), F.lit(k - 1)).cast("int")
    return F.coalesce(near + (F.element_at(arr, near + 1) <= p).cast("int"), F.lit(0))


def threshold_sweep(scores: DataFrame, thresholds=None) -> DataFrame:
    """X6 + X7: confusion counts, precision, recall, F1 at every threshold (p >= t), first best F1
    flagged. One count per (model, k = number of thresholds <= p); on that small table suffix sums
    give tp / fp at each existing k, and each k expands to the thresholds it decides
    (threshold i is positive for k >= i + 1, so it takes the sums of the first existing k >= i + 1)."""
    thresholds = thresholds or SWEEP_THRESHOLDS
    K = len(thresholds)
    arr = F.array(*[F.lit(float(t)) for t in thresholds])
    counted = (scores.withColumn("_k", _thresholds_at_most(thresholds, F.col("prob")))
               .groupBy(*M, "_k").agg(F.count_if(F.col("label") == 1).alias("_pos"),
                                      F.count_if(F.col("label") == 0).alias("_neg")))
    w = Window.partitionBy(*M).orderBy("_k")
    suffix = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    tot = Window.partitionBy(*M)
    c = counted.withColumns({
        "_S_pos": F.sum("_pos").over(suffix), "_S_neg": F.sum("_neg").over(suffix),
        "_P": F.sum("_pos").over(tot), "_N": F.sum("_neg").over(tot),
        "_prev": F.coalesce(F.lag("_k").over(w), F.lit(0)), "_last": F.lead("_k").over(w).isNull()})
    cover = F.transform(F.sequence(F.col("_prev"), F.col("_k") - 1),
                        lambda i: F.struct(i.alias("i"), F.col("_S_pos").alias("tp"), F.col("_S_neg").alias("fp")))
    tail = F.transform(F.sequence(F.col("_k"), F.lit(K - 1)),
                       lambda i: F.struct(i.alias("i"), F.lit(0).cast("long").alias("tp"),
                                          F.lit(0).cast("long").alias("fp")))
    cov = F.when(F.col("_prev") <= F.col("_k") - 1, cover).otherwise(
        F.array().cast("array<struct<i:int,tp:bigint,fp:bigint>>"))
    tl = F.when(F.col("_last") & (F.col("_k") <= K - 1), tail).otherwise(
        F.array().cast("array<struct<i:int,tp:bigint,fp:bigint>>"))
    at = c.select("model", "_P", "_N", F.explode(F.concat(cov, tl)).alias("_t")).where(F.col("_t.i") < K)
    th = F.element_at(arr, F.col("_t.i") + 1)
    at = at.select("model", F.col("_t.i").cast("int").alias("threshold_index"), th.alias("threshold"),
                   F.col("_t.tp").alias("tp"), F.col("_t.fp").alias("fp"),
                   (F.col("_P") - F.col("_t.tp")).alias("fn"), (F.col("_N") - F.col("_t.fp")).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    at = at.withColumns({"precision": _div(tp, tp + fp), "recall": _div(tp, tp + fn),
                         "f1": _div(2 * tp, 2 * tp + fp + fn)})
    best = Window.partitionBy(*M).orderBy(F.col("f1").desc(), F.col("threshold_index"))
    return at.withColumn("is_best", (F.row_number().over(best) == 1).cast("int"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    return sweep.where("is_best = 1").select("model", F.col("threshold").alias("best_threshold"),
                                             F.col("f1").alias("best_f1"))


def reliability(scores: DataFrame, edges=None) -> DataFrame:
    """X11: 12 uniform bins, right-closed (a score on an inner edge joins the lower bin), empty bins
    absent; mean score and fraction of positives per bin."""
    edges = edges or CALIBRATION_EDGES
    arr = F.array(*[F.lit(float(e)) for e in edges])
    b = F.size(F.filter(arr, lambda e: e < F.col("prob")))
    return (scores.withColumn("bin", b).groupBy(*M, "bin")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("mean_predicted"),
                 F.avg("label").alias("fraction_positive")))


def compare_models(scores: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """One row per model with AUC, AP, F1, precision, recall, MCC, kappa, log loss, Brier.
    Two passes over the scores: one aggregate (every threshold metric is a projection of it) and
    one prefix pass (rank metrics)."""
    summ = summary(scores)
    tn, fp, fn, tp = (F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    prec, rec = _div(tp, tp + fp), _div(tp, tp + fn)
    po = (tp + tn) / n
    pe = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    thr = summ.select(
        "model", _f1(prec, rec).alias("f1"), prec.alias("precision"), rec.alias("recall"),
        _div(tn + tp, n).alias("accuracy"),
        _div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
        _div(po - pe, 1 - pe).alias("kappa"), "log_loss", "brier")
    out = rank_metrics(scores).join(thr, M)
    if thresholds is not None:
        out = out.join(thresholds, M, "left")
    return out


def score_histogram(scores: DataFrame, bins: int = 60) -> DataFrame:
    """Density histogram of scores per (model, true class), each class over its own range."""
    keyed = scores.withColumn("group", F.concat_ws("|", F.col("model"), F.col("label").cast("string")))
    h = histogram(keyed, "prob", bins, by="group", density=True)
    return h.select(F.split("group", r"\|").getItem(0).alias("model"),
                    F.split("group", r"\|").getItem(1).cast("int").alias("label"),
                    "bin", "count", "bin_lo", "bin_hi", "density")


def first_match(scores: DataFrame, label: int, pred: int) -> DataFrame:
    """first row (lowest transaction id) per model with the given label / prediction pair."""
    return (scores.where((F.col("label") == label) & (F.col("pred") == pred))
            .groupBy(*M).agg(F.min("transaction_id").alias("transaction_id")))
