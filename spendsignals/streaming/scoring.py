"""Request and stream scoring: P27, P19, S6, ST1.

The reference scores one web-form request at a time (amount, salary, balance, weekend flag, recent
impulses, total recent transactions -> five features -> probability -> score and tier). Here the
same rule runs over a batch table of requests (S6) or over a Structured Streaming source of events
(ST1). The stream keeps, per user, the running spend (for the balance) and the labels of the last
seven transactions in ``applyInPandasWithState``. Two modes:

* at once: the rows of one user inside a micro-batch are processed in time order as they come; a row
  that comes in a later micro-batch than its successors is applied after them;
* in order (``delay``): rows wait in the state until the watermark has passed them (an event-time timer per user),
  so rows that are late by less than ``delay`` are scored as the batch query scores them; later ones are dropped.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import columns as C
from ..sources import transactions as S

RECENT_N = 7
BURST_RATIO = 0.25
REQUEST_FEATURES = ["spend_to_salary_ratio", "balance_stress_indicator", "recent_impulse_rate",
                    "spend_burst_signal", "weekend_effect"]


def request_features(df: DataFrame) -> DataFrame:
    """The five request features; the recent rate is guarded (0 without history)."""
    ratio = F.try_divide(F.col("transaction_amount"), F.col("monthly_salary"))
    return df.withColumns({
        "spend_to_salary_ratio": ratio,
        "balance_stress_indicator": C.flag(F.col("balance_after") < C.STRESS_SHARE * F.col("monthly_salary")),
        "recent_impulse_rate": F.when(F.col("total_txn") > 0, F.col("recent_impulse") / F.col("total_txn"))
                                .otherwise(F.lit(0.0)),
        "spend_burst_signal": C.flag(ratio > BURST_RATIO),
        "weekend_effect": C.flag(F.col("is_weekend") == 1),
    })


def tiered(df: DataFrame, prob: str = "prob") -> DataFrame:
    """P19 / S6 result record: probability (3 places), score 100 p (1 place), tier on strict edges."""
    score = F.col(prob) * 100
    exact = F.col(prob).cast("decimal(20,10)")   # display rounding in decimal: no binary half-way cases
    return df.withColumns({"prob_rounded": F.round(exact, 3).cast("double"),
                           "risk_score": F.round(exact * 100, 1).cast("double"),
                           "tier": C.txn_tier(score)})


def requests_from_transactions(txn: DataFrame) -> DataFrame:
    """Batch requests: every transaction with its recent history (impulses and transactions among
    the previous 7 of the same user)."""
    from ..operators.timeline import Rolling, with_timeline
    specs = [Rolling("_pos", "sum", F.col("impulse_label"), -RECENT_N, -1),
             Rolling("_n", "count", F.col("impulse_label"), -RECENT_N, -1)]
    t = with_timeline(txn, specs)
    return t.withColumns({"recent_impulse": F.coalesce(F.col("_pos"), F.lit(0)).cast("double"),
                          "total_txn": F.col("_n").cast("double")}).drop("_pos", "_n")


def score_requests(requests: DataFrame, model=None, prob: str = "impulse_prob") -> DataFrame:
    """Features -> probability (a fitted 5-feature pipeline, or an existing score column) -> tier."""
    f = request_features(requests)
    if model is not None:
        from ..plans.models import score
        f = score(model, f, "prob")
    else:
        f = f.withColumn("prob", F.col(prob))
    return tiered(f)


# ------------------------------------------------------------------------------------------ stream
STATE = T.StructType([T.StructField("cum_cents", T.LongType()), T.StructField("recent", T.ArrayType(T.IntegerType()))])
OUT = T.StructType([
    T.StructField("transaction_id", T.LongType()), T.StructField("user_id", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType()), T.StructField("is_weekend", T.IntegerType()),
    T.StructField("transaction_amount", T.DoubleType()), T.StructField("monthly_salary", T.DoubleType()),
    T.StructField("balance_after", T.DoubleType()), T.StructField("impulse_label", T.IntegerType()),
    T.StructField("impulse_prob", T.DoubleType()), T.StructField("recent_impulse", T.DoubleType()),
    T.StructField("total_txn", T.DoubleType()),
])


def _scored_rows(pdf: pd.DataFrame, cum: int, recent: list[int]) -> tuple[pd.DataFrame, int, list[int]]:
    """A user's rows, in time order after the state (running spend in cents, last seven labels): result rows, new state."""
    pdf = pdf.sort_values(["timestamp", "transaction_id"], kind="mergesort")
    cents = pdf["cents"].to_numpy().astype(np.int64)
    labels = pdf["impulse_label"].to_numpy().astype(np.int64)
    running = cum + np.cumsum(cents)
    bal = np.maximum(pdf["monthly_salary"].to_numpy() - running / 100.0, 0.0)
    # last-7 window over (carried labels + these labels)
    m = len(recent)
    ext = np.concatenate([np.asarray(recent, dtype=np.int64), labels])
    pre = np.concatenate([[0], np.cumsum(ext)])
    pos = np.arange(m, m + len(labels))
    lo = np.maximum(pos - RECENT_N, 0)
    out = pdf[["transaction_id", "user_id", "timestamp", "is_weekend", "transaction_amount", "monthly_salary",
               "impulse_label", "impulse_prob"]].copy()
    out["balance_after"] = bal
    out["recent_impulse"] = (pre[pos] - pre[lo]).astype(float)
    out["total_txn"] = (pos - lo).astype(float)
    return out[[f.name for f in OUT.fields]], (int(running[-1]) if len(running) else cum), [int(v) for v in ext[-RECENT_N:]]


def _advance(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Per user: running spend and last-7 labels carried across micro-batches."""
    cum, recent = (state.get if state.exists else (0, []))
    out, cum, recent = _scored_rows(pd.concat(list(pdfs), ignore_index=True), int(cum), list(recent or []))
    state.update((cum, recent))
    yield out


ORDERED_STATE = T.StructType([*STATE.fields, T.StructField("waiting", T.BinaryType())])


def _pack(pdf: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(pdf, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _advance_in_order(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows wait until the watermark has passed them: no earlier row can come then. What waits is at most the user's rows
    of the last ``delay``, and the timer is set for the first of them."""
    cum, recent, waiting = (state.get if state.exists else (0, [], b""))
    parts = [pa.ipc.open_stream(waiting).read_all().to_pandas()] if waiting else []
    if not state.hasTimedOut:
        parts += list(pdfs)
    pdf = pd.concat(parts, ignore_index=True) if parts else None
    passed = state.getCurrentWatermarkMs()
    cum, recent, waiting = int(cum), list(recent or []), b""
    if pdf is not None and len(pdf):
        ready = pdf["event_ms"] <= passed
        rest = pdf[~ready]
        if ready.any():
            out, cum, recent = _scored_rows(pdf[ready], cum, recent)
            yield out
        if len(rest):
            waiting = _pack(rest)
            state.setTimeoutTimestamp(max(int(rest["event_ms"].min()), passed + 1))
    state.update((cum, recent, waiting))


def event_rows(events: DataFrame, customer: DataFrame) -> DataFrame:
    """Row-level part of the adapter (everything except the running balance), stream or batch."""
    idx = (F.col("event_id") % 11).cast("int") + 1
    late = (F.hour("ts") < 5) | (F.hour("ts") >= 21)
    risk = F.element_at(F.array(*[F.lit(r) for r in S.ADAPTER_RISK]), idx)
    wk = (F.weekday("ts") >= 5).cast("int")
    pts = risk * 10 + F.when(late, 20).otherwise(0) + wk * 10 + F.least(F.col("value") / 4, F.lit(40.0))
    k = F.get_json_object("props", "$.k").cast("int")
    j = events.join(customer.select("c_custkey", "c_acctbal"), events.user_id == F.col("c_custkey"))
    return j.select(
        F.col("event_id").alias("transaction_id"), "user_id", F.col("ts").alias("timestamp"),
        F.col("ts").cast("timestamp").alias("event_time"), wk.alias("is_weekend"), F.col("value").alias("transaction_amount"),
        (F.lit(S.ADAPTER_BASE_SALARY) + F.abs("c_acctbal") * S.ADAPTER_SALARY_PER_BALANCE).alias("monthly_salary"),
        F.when(pts + k * S.ADAPTER_NOISE_WEIGHT > S.ADAPTER_CUTOFF, 1).otherwise(0).alias("impulse_label"),
        F.round(1 / (1 + F.exp(-(pts + 20 - S.ADAPTER_CUTOFF) / 12)), 6).alias("impulse_prob"),
        F.round(F.col("value") * 100).cast("long").alias("cents"))


def stateful_requests(rows: DataFrame, delay: str | None = None) -> DataFrame:
    """ST1 state step on a streaming DataFrame of event rows: at once, or in order within ``delay`` (such as "12 hours"). In
    order, a row comes out once the watermark (the latest event time seen less ``delay``) has passed it."""
    if delay is None:
        return rows.groupBy("user_id").applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
    timed = rows.withColumn("event_ms", F.unix_millis("event_time")).withWatermark("event_time", delay)
    return timed.groupBy("user_id").applyInPandasWithState(_advance_in_order, OUT, ORDERED_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stream_scores(spark: SparkSession, sf_dir: str, out_dir: str, checkpoint: str,
                  files_per_trigger: int = 1, model=None, bytes_per_trigger: str | None = None, delay: str | None = None) -> DataFrame:
    """ST1: score the events of ``sf_dir`` as a stream (file source, availableNow trigger) into
    parquet at ``out_dir``; returns the written table. A user's rows of one micro-batch are one group in
    memory: ``files_per_trigger``, or ``bytes_per_trigger`` (such as "512m") instead, bounds the micro-batch.
    ``delay``: see ``stateful_requests``."""
    schema = spark.read.parquet(f"{sf_dir}/events*.parquet").schema
    bound = ("maxBytesPerTrigger", bytes_per_trigger) if bytes_per_trigger else ("maxFilesPerTrigger", files_per_trigger)
    events = spark.readStream.schema(schema).option(*bound).parquet(f"{sf_dir}/events*.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    scored = score_requests(stateful_requests(event_rows(events, customer), delay), model)
    q = (scored.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_dir)


def stream_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """Fresh output and checkpoint folders for a stream run inside the shared checkpoint folder."""
    import uuid
    from ..session import ensure_checkpoint_dir
    base = os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:12]}")
    return os.path.join(base, "out"), os.path.join(base, "state")
