"""Distributed prefix sums against brute force (property style)."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendsignals.operators.evaluation import average_precision, rank_metrics, roc_auc
from spendsignals.operators.ranks import percentile_scores


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_percentile_rank_equals_pandas(spark, seed):
    rnd = random.Random(seed)
    vals = [rnd.choice([0.1, 0.2, 0.5, 0.7, None]) if rnd.random() < 0.5 else rnd.random() for _ in range(300)]
    pdf = pd.DataFrame({"id": range(len(vals)), "v": vals})
    df = spark.createDataFrame(pdf).repartition(5)
    got = percentile_scores(df, {"p": "v"}).toPandas().sort_values("id")
    want = pdf["v"].rank(pct=True) * 100
    for g, w in zip(got["p"], want):
        assert (pd.isna(g) and pd.isna(w)) or abs(g - w) < 1e-9


def brute_auc(y, p):
    pos = [pi for yi, pi in zip(y, p) if yi == 1]
    neg = [pi for yi, pi in zip(y, p) if yi == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def brute_ap(y, p):
    order = sorted(set(p), reverse=True)
    P = sum(y)
    ap, prev_r = 0.0, 0.0
    for t in order:
        tp = sum(1 for yi, pi in zip(y, p) if pi >= t and yi == 1)
        fp = sum(1 for yi, pi in zip(y, p) if pi >= t and yi == 0)
        r = tp / P
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return ap


@pytest.mark.parametrize("seed", [4, 5])
def test_auc_ap_brute_force(spark, seed):
    rnd = random.Random(seed)
    y = [rnd.randint(0, 1) for _ in range(200)]
    p = [round(rnd.random() * 0.5 + 0.3 * yi, 2) for yi in y]
    df = spark.createDataFrame(pd.DataFrame({"transaction_id": range(200), "label": y, "prob": p, "pred": 0,
                                             "model": "m"})).repartition(4)
    assert abs(roc_auc(df).collect()[0]["roc_auc"] - brute_auc(y, p)) < 1e-12
    assert abs(average_precision(df).collect()[0]["average_precision"] - brute_ap(y, p)) < 1e-12
    both = rank_metrics(df).collect()[0]
    assert abs(both["roc_auc"] - brute_auc(y, p)) < 1e-12 and abs(both["average_precision"] - brute_ap(y, p)) < 1e-12


def test_auc_invariant_under_monotone_map(spark):
    rnd = random.Random(7)
    y = [rnd.randint(0, 1) for _ in range(150)]
    p = [rnd.random() for _ in y]
    base = spark.createDataFrame(pd.DataFrame({"label": y, "prob": p, "model": "m"}))
    a = roc_auc(base).collect()[0][1]
    b = roc_auc(base.withColumn("prob", F.exp(F.col("prob") * 3))).collect()[0][1]
    assert abs(a - b) < 1e-12


def test_threshold_sweep_brute_force(spark):
    from spendsignals.operators.evaluation import SWEEP_THRESHOLDS, threshold_sweep
    rnd = random.Random(11)
    rows = []
    for i in range(300):      # model a: spread scores (some exactly on thresholds)
        y = rnd.randint(0, 1)
        p = rnd.choice([SWEEP_THRESHOLDS[rnd.randrange(80)], round(rnd.random(), 3)])
        rows.append(("a", y, p))
    rows += [("low", rnd.randint(0, 1), 0.01) for _ in range(20)]    # below every threshold
    rows += [("high", rnd.randint(0, 1), 0.95) for _ in range(20)]   # above every threshold
    df = spark.createDataFrame(rows, "model string, label int, prob double")
    got = {(r["model"], r["threshold_index"]): (r["tp"], r["fp"], r["fn"], r["tn"])
           for r in threshold_sweep(df).collect()}
    for m in ("a", "low", "high"):
        sub = [(y, p) for mm, y, p in rows if mm == m]
        for i, t in enumerate(SWEEP_THRESHOLDS):
            tp = sum(1 for y, p in sub if p >= t and y == 1)
            fp = sum(1 for y, p in sub if p >= t and y == 0)
            fn = sum(1 for y, p in sub if p < t and y == 1)
            tn = sum(1 for y, p in sub if p < t and y == 0)
            assert got[(m, i)] == (tp, fp, fn, tn), (m, i)
