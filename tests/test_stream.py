"""ST1: stream scoring over several micro-batches equals batch scoring on the same rows."""

import os
import tempfile

from pyspark.sql import functions as F

from spendsignals.plans.catalog import queries
from spendsignals.streaming import scoring as ST

from conftest import SF_SMALL


def test_stream_equals_batch_across_microbatches(spark):
    work = tempfile.mkdtemp(prefix="st1-", dir=os.environ.get("TMPDIR", "/tmp"))
    src = os.path.join(work, "sf")
    os.makedirs(src)
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    lo, hi = ev.agg(F.min("ts"), F.max("ts")).first()
    span = (hi - lo) / 3
    # three files in time order -> three micro-batches (maxFilesPerTrigger=1); state must carry over
    for i in range(3):
        a, b = lo + span * i, lo + span * (i + 1)
        part = ev.where((F.col("ts") >= a) & ((F.col("ts") < b) if i < 2 else F.lit(True)))
        part.coalesce(1).write.parquet(os.path.join(work, f"p{i}"))
        f = [x for x in os.listdir(os.path.join(work, f"p{i}")) if x.endswith(".parquet")][0]
        os.rename(os.path.join(work, f"p{i}", f), os.path.join(src, f"events_{i}.parquet"))
    spark.read.parquet(f"{SF_SMALL}/customer.parquet").write.parquet(os.path.join(src, "customer.parquet"))
    streamed = ST.stream_scores(spark, src, os.path.join(work, "out"), os.path.join(work, "ckpt"))
    batch = queries()["s06_score_requests"](spark, SF_SMALL)
    cols = ["transaction_id", "recent_impulse", "total_txn", "balance_after", "tier", "risk_score"]
    a = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in streamed.select(*cols).collect())
    b = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in batch.select(*cols).collect())
    assert len(a) == ev.count() and a == b


def test_late_rows_are_scored_in_order(spark):
    """Events arrive up to six hours late, over micro-batch borders; with a delay of twelve hours the result is that of the
    batch query. A last event far ahead moves the watermark past all others; a row later than the delay is dropped."""
    work = tempfile.mkdtemp(prefix="st1-late-", dir=os.environ.get("TMPDIR", "/tmp"))
    src = os.path.join(work, "sf")
    os.makedirs(src)
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    arrives = F.expr("ts + make_dt_interval(0, 0, 0, pmod(hash(event_id), 21600))")
    lo, hi = ev.agg(F.min(arrives), F.max(arrives)).first()
    span = (hi - lo) / 4
    first = ev.orderBy("ts", "event_id").limit(1)
    ahead = first.withColumns({"ts": F.lit(hi).cast(ev.schema["ts"].dataType) + F.expr("INTERVAL 100 DAYS"), "event_id": F.lit(10**9).cast(ev.schema["event_id"].dataType)})
    too_late = first.withColumn("event_id", F.lit(10**9 + 1).cast(ev.schema["event_id"].dataType))
    parts = [ev.where((arrives >= lo + span * i) & ((arrives < lo + span * (i + 1)) if i < 3 else F.lit(True))) for i in range(4)] + [ahead, too_late, ahead.withColumn("event_id", F.col("event_id") + 2)]
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(os.path.join(work, f"p{i}"))
        f = [x for x in os.listdir(os.path.join(work, f"p{i}")) if x.endswith(".parquet")][0]
        os.rename(os.path.join(work, f"p{i}", f), os.path.join(src, f"events_{i}.parquet"))
        os.utime(os.path.join(src, f"events_{i}.parquet"), (1_700_000_000 + i, 1_700_000_000 + i))      # read in this order
    spark.read.parquet(f"{SF_SMALL}/customer.parquet").write.parquet(os.path.join(src, "customer.parquet"))
    cols = ["transaction_id", "recent_impulse", "total_txn", "balance_after", "tier", "risk_score"]
    rows = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())
    batch = rows(queries()["s06_score_requests"](spark, SF_SMALL))
    ordered = rows(ST.stream_scores(spark, src, os.path.join(work, "out"), os.path.join(work, "ckpt"), delay="12 hours"))
    assert ordered == batch
    at_once = rows(ST.stream_scores(spark, src, os.path.join(work, "out1"), os.path.join(work, "ckpt1")).where("transaction_id < 1000000000"))
    assert len(at_once) == len(batch) and at_once != batch         # without waiting, late rows come out of order


def test_trained_request_model_scores_stream_as_batch(spark):
    cols = ["transaction_id", "prob", "tier", "risk_score"]
    rows = lambda name: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r)
                               for r in queries()[name](spark, SF_SMALL).select(*cols).collect())
    a, b = rows("st1_stream_scoring_model"), rows("s06_score_requests_model")
    assert a == b and len({t for _, _, t, _ in a}) > 1
    assert all(0 <= p <= 1 for _, p, _, _ in a)
