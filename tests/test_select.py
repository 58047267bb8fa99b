"""Radix selection against sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spendsignals.operators import select as S


@pytest.mark.parametrize("buckets", [4, 64, 1 << 14])
def test_order_rows_equal_sorting(spark, monkeypatch, buckets):
    monkeypatch.setattr(S, "BUCKETS", buckets)
    rng = random.Random(buckets)
    rows = [(rng.choice(["a", "b", None]), rng.choice([7, 7, 7, rng.randint(-50, 50)]), rng.choice([0, rng.randint(-2**62, 2**62 - 1)]), k) for k in range(700)]
    rows += [("a", None, 1, 1000), ("one", 5, 5, 5)]
    df = spark.createDataFrame(rows, "g string, x long, y long, id long")
    got = S.order_rows(df, [F.col("x"), F.col("y"), F.col("id")], lambda g, n: [-1, 0, 1, n[g] // 3, n[g] - 1, n[g]], F.col("g"))
    for g in ("a", "b", None, "one"):
        want = sorted(r[1:] for r in rows if r[0] == g and r[1] is not None)
        n = len(want)
        assert got[g][0] == n
        assert got[g][1] == [None, want[0], want[1] if n > 1 else None, want[n // 3], want[-1], None]


def test_parts_are_cut_in_order(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 9), rng.randint(0, 9), k, k % 2) for k in range(300)]
    df = spark.createDataFrame(rows, "x int, y int, id long, g int")
    keys = [F.col("x"), F.col("y"), F.col("id")]
    cuts = S.order_rows(df, keys, lambda g, n: [-1, 19, 70, n[g] - 1], F.col("g"))
    got = {r["id"]: r["p"] for r in df.withColumn("p", S.part_of(keys, cuts, F.col("g"))).collect()}
    for g in (0, 1):
        for place, r in enumerate(sorted(r[:3] for r in rows if r[3] == g)):
            assert got[r[2]] == (1 if place <= 19 else 2 if place <= 70 else 3)


def test_quantile(spark):
    df = spark.createDataFrame([(v,) for v in (10, 10, 40, 100, 7)], "v long")
    assert S.interpolated_quantile(df, F.col("v"), 0.8) == 40 + (100 - 40) * (0.8 * 4 - math.floor(0.8 * 4))
    assert S.interpolated_quantile(df.where("v > 100"), F.col("v"), 0.5) is None
    assert S.interpolated_quantile(df.where("v > 40"), F.col("v"), 0.5) == 100


def test_no_join_in_split_and_folds(spark):
    """The split of a table is a filter: neither a join nor a window in its plan."""
    from spendsignals.operators.nexttxn import block_folds, time_split
    from spendsignals.plans import models as M
    df = spark.createDataFrame([(k, k % 7, k % 3 == 0, k) for k in range(200)], "transaction_id long, user_id long, y boolean, t long").selectExpr(
        "transaction_id", "user_id", "int(y) AS y", "CAST(timestamp_micros(t * 1000) AS TIMESTAMP_NTZ) AS timestamp")
    for out in (M.stratified_split(df, "y"), M.stratified_folds(df, "y"), block_folds(df, "y"), time_split(df)[0]):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Window" not in plan and "Exchange" not in plan
