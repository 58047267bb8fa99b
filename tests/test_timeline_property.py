"""Property: the chunked (hot-key) timeline equals the plain per-user window for random skewed data."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spendsignals.operators.timeline import KeyStat, Rolling, Running, Shift, Streak, with_timeline

T0 = dt.datetime(2024, 1, 1)

def specs():
    return [
    Rolling("r_mean", "avg", F.col("x"), -3, -1), Rolling("r_std", "stddev_samp", F.col("x"), -7, -1),
    Rolling("r_max", "max", F.col("x"), -5, -1), Rolling("r_cnt", "count", F.col("x"), -7, -1),
    Rolling("r_fwd", "sum", F.col("x"), -1, 1),
    Shift("lag3", F.col("x"), 3), Shift("lead1", F.col("y"), -1),
    Running("run_x", F.col("x")), Running("run_y_incl", F.col("y"), inclusive=True),
    Streak("streak", F.col("y")),
    KeyStat("k_mean", "avg", F.col("x")), KeyStat("k_std", "stddev_samp", F.col("x")),
    ]


def rows_strategy():
    user = st.tuples(st.integers(1, 60), st.integers(0, 3))   # (rows, minute spread: 0 = all tied)
    return st.lists(user, min_size=1, max_size=4)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(users=rows_strategy(), chunk=st.integers(1, 9), seed=st.integers(0, 10_000))
def test_chunked_equals_plain(spark, users, chunk, seed):
    import random
    rnd = random.Random(seed)
    rows, tid = [], 0
    for u, (n, spread) in enumerate(users):
        for _ in range(n):
            tid += 1
            ts = T0 + dt.timedelta(minutes=rnd.randint(0, spread * 50))
            x = None if rnd.random() < 0.1 else round(rnd.uniform(0, 100), 2)
            y = None if rnd.random() < 0.1 else rnd.randint(0, 1)
            rows.append((tid, u, ts, x, y))
    df = spark.createDataFrame(rows, "transaction_id long, user_id long, timestamp timestamp_ntz, x double, y int")
    sp = specs()
    names = [s.name for s in sp]

    def collect(d):
        out = []
        for r in d.orderBy("transaction_id").select("transaction_id", *names).collect():
            out.append(tuple(round(v, 9) if isinstance(v, float) else v for v in r))
        return out

    plain = collect(with_timeline(df, sp, rows_per_chunk=10_000))
    chunked = collect(with_timeline(df, sp, rows_per_chunk=chunk))
    assert plain == chunked
