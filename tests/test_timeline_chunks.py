"""The hot-key (chunked) timeline equals the plain per-user window on real fixture data."""

from spendsignals.operators.features import engineer
from spendsignals.operators.nexttxn import next_txn_features
from spendsignals.operators.risk import score_transactions
from spendsignals.sources.transactions import transactions_from_events

from conftest import SF_SMALL


def _rows(df):
    cols = sorted(df.columns)
    out = []
    for r in df.select(*cols).orderBy("transaction_id").collect():
        out.append(tuple(round(v, 9) if isinstance(v, float) else v for v in r))
    return out


def test_chunked_equals_plain(spark):
    plain = transactions_from_events(spark, SF_SMALL)
    hot = transactions_from_events(spark, SF_SMALL, rows_per_chunk=7)
    assert _rows(plain) == _rows(hot)
    e1 = engineer(plain, rows_per_chunk=1 << 22)
    e2 = engineer(plain, rows_per_chunk=5)
    assert _rows(e1) == _rows(e2)
    s = score_transactions(e1)
    n1 = next_txn_features(s, rows_per_chunk=1 << 22)
    n2 = next_txn_features(s, rows_per_chunk=3)
    assert _rows(n1) == _rows(n2)


def _burst(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from spendsignals.operators import timeline as TL

    t0 = dt.datetime(2024, 1, 1)
    # one user holds nearly all rows, 900 of them at the very same time; one light user
    rows = [(i, 1, t0, float(i % 7), i % 2) for i in range(900)]
    rows += [(900 + i, 1, t0 + dt.timedelta(hours=7 * i), float(i % 5), 1) for i in range(100)]
    rows += [(2000 + i, 2, t0 + dt.timedelta(minutes=i), 1.0, 0) for i in range(10)]
    df = spark.createDataFrame(rows, "transaction_id long, user_id long, timestamp timestamp_ntz, x double, y int")
    specs = [TL.Rolling("m3", "avg", F.col("x"), -3, -1), TL.Shift("nxt", F.col("y"), -1), TL.Shift("l2", F.col("x"), 2),
             TL.Running("cum", F.col("x")), TL.Streak("st", F.col("y")), TL.KeyStat("mean", "avg", F.col("x"))]
    return TL, df, specs


def test_burst_of_equal_times_is_split(spark, monkeypatch):
    TL, df, specs = _burst(spark)

    def rows_of(d):
        return [tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                for r in d.orderBy("transaction_id").select("transaction_id", *[s.name for s in specs]).collect()]

    plain = rows_of(TL.with_timeline(df, specs, rows_per_chunk=100_000))
    assert rows_of(TL.with_timeline(df, specs, rows_per_chunk=50)) == plain
    hot = TL.detect_hot_keys(df, rows_per_chunk=50)
    _, rows, chunks = TL._split_rows(df, "user_id", ("timestamp", "transaction_id"), hot.table, hot.keys)
    sizes = [r[1] for r in rows.groupBy("_chunk").count().collect()]
    assert chunks == 20 and max(sizes) < 200
    # the same without broadcasts
    monkeypatch.setattr(TL, "MAX_BROADCAST_ROWS", 0)
    assert rows_of(TL.with_timeline(df, specs, rows_per_chunk=50)) == plain
