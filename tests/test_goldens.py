"""Hand-made edge tables (FIXTURES.md section 4)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from spendsignals.functions import columns as C
from spendsignals.operators.features import engineer
from spendsignals.operators.timeline import Rolling, Streak, with_timeline
from spendsignals.sources.transactions import TXN_SCHEMA

T0 = dt.datetime(2024, 1, 1)


def txn_rows(amounts, labels=None, user=1, hours=None, same_ts=False, salary=1000.0, start_id=1):
    rows = []
    for i, a in enumerate(amounts):
        ts = T0 if same_ts else T0 + dt.timedelta(hours=i)
        h = hours[i] if hours else ts.hour
        lab = labels[i] if labels else 0
        rows.append((start_id + i, user, ts, h, 0, a, 500.0, salary, "Food", lab))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, TXN_SCHEMA)


def by_id(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("transaction_id").collect()]


@pytest.mark.parametrize("rows_per_chunk", [1 << 22, 2])
def test_streak(spark, rows_per_chunk):
    df = frame(spark, txn_rows([1.0] * 6, labels=[0, 1, 1, 1, 0, 1]))
    out = with_timeline(df, [Streak("s", F.col("impulse_label"))], rows_per_chunk=rows_per_chunk)
    assert [r[0] for r in by_id(out, "s")] == [0, 0, 1, 2, 3, 0]


@pytest.mark.parametrize("rows_per_chunk", [1 << 22, 1, 2])
def test_prior_std_and_count(spark, rows_per_chunk):
    df = frame(spark, txn_rows([5.0, 1.0, 9.0, 4.0, 4.0]))
    specs = [Rolling("sd", "stddev_samp", F.col("transaction_amount"), -3, -1),
             Rolling("n", "count", F.col("transaction_amount"), -3, -1)]
    got = by_id(with_timeline(df, specs, rows_per_chunk=rows_per_chunk), "sd", "n")
    want_sd = [None, None, 2.828427, 4.0, 4.041452]
    for (sd, n), w, wn in zip(got, want_sd, [0, 1, 2, 3, 3]):
        assert n == wn
        assert (sd is None and w is None) or abs(sd - w) < 1e-6


def test_one_transaction_and_constant_spender(spark):
    rows = txn_rows([7.0], user=1) + txn_rows([3.0] * 4, user=2, start_id=10)
    e = engineer(frame(spark, rows), categories=["Food"])
    got = {r["transaction_id"]: r for r in e.collect()}
    one = got[1]
    assert one["user_std_spend"] == 0.0 and one["spend_zscore"] == 0.0
    assert one["user_impulse_rate"] == 0.5 and one["txn_count_last3"] == 0
    for i in range(10, 14):
        assert got[i]["user_std_spend"] == 1.0 and got[i]["spend_zscore"] == 0.0


def test_time_bin_edges(spark):
    hours = [4, 5, 11, 12, 16, 17, 20, 21]
    df = spark.createDataFrame([(h,) for h in hours], "hour int")
    got = [r[0] for r in df.select(C.time_bin(F.col("hour"))).collect()]
    assert got == ["late_night", "morning", "morning", "afternoon", "afternoon", "evening", "evening", "late_night"]


def test_tier_edges(spark):
    df = spark.createDataFrame([(s,) for s in [34.9, 35.0, 55.0, 75.0]], "s double")
    assert [r[0] for r in df.select(C.user_tier(F.col("s"))).collect()] == ["Low", "Moderate", "High", "Critical"]
    df = spark.createDataFrame([(s,) for s in [40.0, 60.0, 75.0, 75.1]], "s double")
    assert [r[0] for r in df.select(C.txn_tier(F.col("s"))).collect()] == ["Low", "Moderate", "High", "Critical"]


def test_guarded_division(spark):
    rows = txn_rows([10.0], salary=0.0)
    e = engineer(frame(spark, rows), categories=["Food"]).collect()[0]
    assert e["spend_to_salary_ratio"] == 0.0 and e["balance_to_salary_ratio"] == 0.0


def test_equal_timestamps_tie_break(spark):
    df = frame(spark, txn_rows([1.0, 2.0, 3.0], labels=[1, 1, 0], same_ts=True))
    out = with_timeline(df, [Streak("s", F.col("impulse_label"))])
    assert [r[0] for r in by_id(out, "s")] == [0, 1, 2]


def test_null_and_nan_amounts(spark):
    rows = txn_rows([float("nan"), 5.0, 6.0])
    rows[1] = rows[1][:5] + (None,) + rows[1][6:]
    e = engineer(frame(spark, rows), categories=["Food"])
    got = {r["transaction_id"]: r for r in e.collect()}
    for r in got.values():
        assert r["is_spend_burst"] in (0, 1)
        assert not (isinstance(r["spend_zscore"], float) and math.isnan(r["spend_zscore"]))
    assert got[3]["txn_count_last3"] == 0   # both earlier amounts missing


def test_unknown_category_default(spark):
    df = spark.createDataFrame([("Gifts",), ("Food",)], "c string")
    assert [r[0] for r in df.select(C.category_risk(F.col("c"))).collect()] == [1.0, 2.0]


def test_prior_baseline_uses_only_earlier_rows(spark):
    e = engineer(frame(spark, txn_rows([5.0, 1.0, 9.0, 4.0])), categories=["Food"], baseline="prior")
    got = {r["transaction_id"]: r for r in e.collect()}
    assert got[1]["user_mean_spend"] == 0.0 and got[1]["spend_zscore"] == 0.0     # no history -> filled
    assert got[2]["user_mean_spend"] == 5.0 and got[2]["spend_zscore"] == 0.0     # one earlier row: std NULL
    assert abs(got[3]["user_mean_spend"] - 3.0) < 1e-12
    assert abs(got[3]["user_std_spend"] - 2.8284271247461903) < 1e-9
    assert abs(got[4]["spend_zscore"] - (4.0 - 5.0) / 4.0) < 1e-9


def test_scoring_as_of_equals_data_max(spark):
    from spendsignals.operators.risk import score_transactions
    e = engineer(frame(spark, txn_rows([5.0, 1.0, 9.0, 4.0], hours=None)), categories=["Food"]).withColumn(
        "impulse_prob", F.lit(0.5))
    mx = e.agg(F.max("timestamp")).first()[0]
    a = sorted(score_transactions(e).select("transaction_id", "days_ago", "decay_weight").collect())
    b = sorted(score_transactions(e, as_of=mx).select("transaction_id", "days_ago", "decay_weight").collect())
    assert a == b
