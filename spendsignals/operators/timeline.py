"""Per-key ordered windows that stay balanced when one key holds a large share of all rows.

Every per-user feature of the reference (rolling frames, lags, the next label, running rates,
streaks, whole-user baselines) is a window over ``partitionBy(user) orderBy(time, id)``. A plain
Spark window puts a whole user into one task, so a user with a third of the rows would be a
third of the job in one task. This module plans those windows in two shapes:

* ordinary keys (fewer than ``rows_per_chunk`` rows): one window partition per key;
* hot keys: the key's rows are range-partitioned by (time, id) into chunks of about
  ``rows_per_chunk`` rows, pinned by a checkpoint, and the window runs per ``(key, chunk)``; rows of
  equal time are split like any others. Bounded frames get the rows they need from the neighbouring chunks as *ghost rows* (the last ``back`` rows before the chunk and the first
  ``fwd`` rows after it); unbounded running sums and streaks get the totals of all earlier
  chunks as a broadcast offset. Ghost rows are dropped after the window.

The hot-key table has at most ``N / rows_per_chunk`` rows, and the ghost and offset tables at most
``(back + fwd + 1)`` rows per hot chunk. Up to ``MAX_BROADCAST_ROWS`` rows such a table is broadcast; a
larger one is joined by shuffle. Results are the same at every size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

DEFAULT_ROWS_PER_CHUNK = 1 << 22
MAX_BROADCAST_ROWS = 2_000_000

_AGG = {
    "avg": F.avg,
    "stddev_samp": F.stddev_samp,
    "count": F.count,
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
}


@dataclass(frozen=True)
class Rolling:
    """``fn(expr)`` over the rows ``lo..hi`` relative to the current row (``rowsBetween``)."""

    name: str
    fn: str
    expr: Column
    lo: int
    hi: int


@dataclass(frozen=True)
class Shift:
    """Value ``k`` rows back (``k > 0``, lag) or ``-k`` rows ahead (``k < 0``, lead)."""

    name: str
    expr: Column
    k: int


@dataclass(frozen=True)
class Running:
    """Sum of ``expr`` over all earlier rows of the key (and the current one if ``inclusive``)."""

    name: str
    expr: Column
    inclusive: bool = False


@dataclass(frozen=True)
class Streak:
    """Number of consecutive earlier rows with ``flag == 1`` right before the current row."""

    name: str
    flag: Column


@dataclass(frozen=True)
class KeyStat:
    """Aggregate over all rows of the key, attached to every row."""

    name: str
    fn: str
    expr: Column


def _reach(specs) -> tuple[int, int]:
    back = fwd = 0
    for s in specs:
        if isinstance(s, Rolling):
            back = max(back, -s.lo)
            fwd = max(fwd, s.hi)
        elif isinstance(s, Shift):
            if s.k > 0:
                back = max(back, s.k)
            else:
                fwd = max(fwd, -s.k)
    return back, fwd


@dataclass(frozen=True)
class HotKeys:
    """Result of hot-key detection: ``table`` (key, chunk count) is None when no key exceeds ``rows_per_chunk``.

    Any key set gives exact results (chunking only balances work), so one detection can serve
    every timeline over the same rows, e.g. transactions, engineered and scored tables."""

    table: DataFrame | None
    keys: int = 0


def detect_hot_keys(df: DataFrame, key: str = "user_id", ts: str = "timestamp",
                    rows_per_chunk: int = DEFAULT_ROWS_PER_CHUNK) -> HotKeys:
    """Keys with more than ``rows_per_chunk`` rows and their chunk count."""
    # one aggregate over the key only: Catalyst prunes every other column of the input
    hot = (df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_chunk)
           .select(key, F.ceil(F.col("_n") / F.lit(rows_per_chunk)).cast("long").alias("_nchunks")))
    n_hot = hot.count()
    # at most N / rows_per_chunk rows; written once so every branch sees the same chunking
    return HotKeys(cut_lineage(hot), n_hot) if n_hot else HotKeys(None)


def with_timeline(df: DataFrame, specs, key: str = "user_id", order=("timestamp", "transaction_id"),
                  rows_per_chunk: int = DEFAULT_ROWS_PER_CHUNK, hot: HotKeys | None = None) -> DataFrame:
    """Add one column per spec; see the module docstring for the plan. ``hot`` reuses an earlier
    detection over the same keys."""
    order = tuple(order)
    if hot is None:
        hot = detect_hot_keys(df, key, order[0], rows_per_chunk)
    if hot.table is None:
        return _plain(df, specs, key, order)
    return _chunked(df, specs, key, order, hot.table, hot.keys)


def _plain(df: DataFrame, specs, key: str, order) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    whole = Window.partitionBy(key)
    if any(isinstance(s, Streak) for s in specs):
        # a window value cannot be nested in another window expression: materialise it first
        df = df.withColumn("_rn", F.row_number().over(w))
    cols = {}
    for s in specs:
        if isinstance(s, Rolling):
            cols[s.name] = _AGG[s.fn](s.expr).over(w.rowsBetween(s.lo, s.hi))
        elif isinstance(s, Shift):
            cols[s.name] = F.lag(s.expr, s.k).over(w) if s.k > 0 else F.lead(s.expr, -s.k).over(w)
        elif isinstance(s, Running):
            hi = Window.currentRow if s.inclusive else -1
            cols[s.name] = F.coalesce(F.sum(s.expr).over(w.rowsBetween(Window.unboundedPreceding, hi)), F.lit(0))
        elif isinstance(s, Streak):
            last0 = F.max(F.when(F.coalesce(s.flag, F.lit(0)) != 1, F.col("_rn"))).over(
                w.rowsBetween(Window.unboundedPreceding, -1))
            cols[s.name] = (F.col("_rn") - 1 - F.coalesce(last0, F.lit(0))).cast("int")
        elif isinstance(s, KeyStat):
            cols[s.name] = _AGG[s.fn](s.expr).over(whole)
    out = df.withColumns(cols)
    return out.drop("_rn") if "_rn" in out.columns else out


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint up to the size bound; beyond it the join is an ordinary shuffle join."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def _split_rows(df: DataFrame, key: str, order, hot: DataFrame, n_hot: int) -> tuple[DataFrame, DataFrame, int]:
    """(all rows, rows of hot keys, chunks) with ``_hot, _chunk, _maxchunk``. Hot rows are range-partitioned by
    (key, order): a partition is a chunk, so bursts and equal times are split like any other rows. They
    are pinned by one reliable checkpoint that every later branch reads."""
    chunks = hot.agg(F.sum("_nchunks")).first()[0]
    joined = df.join(_small(hot, n_hot), key, "left")
    cold = joined.where(F.col("_nchunks").isNull()).drop("_nchunks")
    ranged = cut_lineage(joined.where(F.col("_nchunks").isNotNull()).drop("_nchunks")
                         .repartitionByRange(chunks, key, *order)
                         .withColumn("_chunk", F.spark_partition_id().cast("long")))
    ends = ranged.groupBy(key).agg(F.min("_chunk").alias("_first"), F.max("_chunk").alias("_last"))
    hot_rows = (ranged.join(_small(ends, n_hot), key)
                .withColumns({"_hot": F.lit(True), "_maxchunk": F.col("_last") - F.col("_first"),
                              "_chunk": F.col("_chunk") - F.col("_first")}).drop("_first", "_last"))
    none = F.lit(0).cast("long")
    base = cold.withColumns({"_hot": F.lit(False), "_maxchunk": none, "_chunk": none}).unionByName(hot_rows)
    return base, hot_rows, chunks


def _chunked(df: DataFrame, specs, key: str, order, hot: DataFrame, n_hot: int) -> DataFrame:
    back, fwd = _reach(specs)
    cols = df.columns
    base, hot_rows, chunks = _split_rows(df, key, order, hot, n_hot)

    # --- ghost rows: the last `back` rows before each hot chunk and the first `fwd` rows after it
    w_desc = Window.partitionBy(key, "_chunk").orderBy(*[F.col(c).desc() for c in order])
    w_asc = Window.partitionBy(key, "_chunk").orderBy(*order)
    ghosts = []
    if back > 0:
        tails = hot_rows.withColumn("_r", F.row_number().over(w_desc)).filter(F.col("_r") <= back).drop("_r")
        wk = Window.partitionBy(key).orderBy(*order)
        nxt = F.lead("_chunk", back).over(wk)
        lo, hi = F.col("_chunk") + 1, F.coalesce(nxt, F.col("_maxchunk"))
        tails = tails.withColumn("_targets", F.when(lo <= hi, F.sequence(lo, hi)))
        ghosts.append(tails.withColumn("_chunk", F.explode("_targets")).drop("_targets"))
    if fwd > 0:
        heads = hot_rows.withColumn("_r", F.row_number().over(w_asc)).filter(F.col("_r") <= fwd).drop("_r")
        wk = Window.partitionBy(key).orderBy(*order)
        prv = F.lag("_chunk", fwd).over(wk)
        lo, hi = F.coalesce(prv, F.lit(0).cast("long")), F.col("_chunk") - 1
        heads = heads.withColumn("_targets", F.when(lo <= hi, F.sequence(lo, hi)))
        ghosts.append(heads.withColumn("_chunk", F.explode("_targets")).drop("_targets"))

    # --- per hot chunk totals -> offsets carried into later chunks
    running = [s for s in specs if isinstance(s, Running)]
    streaks = [s for s in specs if isinstance(s, Streak)]
    keystats = [s for s in specs if isinstance(s, KeyStat)]
    offsets = None
    if running or streaks:
        summ = hot_rows
        aggs = [F.count(F.lit(1)).alias("_cn")]
        for i, s in enumerate(running):
            aggs.append(F.sum(s.expr).alias(f"_rs{i}"))
        for i, s in enumerate(streaks):
            nz = F.sum(F.when(F.coalesce(s.flag, F.lit(0)) != 1, 1).otherwise(0)).over(
                w_desc.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            summ = summ.withColumn(f"_nz{i}", nz)
            aggs.append(F.count_if(F.col(f"_nz{i}") == 0).alias(f"_tr{i}"))
            aggs.append((F.count_if(F.coalesce(s.flag, F.lit(0)) != 1) == 0).alias(f"_all1{i}"))
        summ = summ.groupBy(key, "_chunk").agg(*aggs)
        wc = Window.partitionBy(key).orderBy("_chunk")
        before = wc.rowsBetween(Window.unboundedPreceding, -1)
        ocols = {"_o_n": F.coalesce(F.sum("_cn").over(before), F.lit(0))}
        for i, _ in enumerate(running):
            ocols[f"_o_rs{i}"] = F.sum(f"_rs{i}").over(before)
        for i, _ in enumerate(streaks):
            # trailing ones before chunk c: ones at the end of the last chunk holding a non-one,
            # plus every row of the all-ones chunks after it
            cum_through = F.sum("_cn").over(wc.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            summ = summ.withColumn(f"_cum{i}", cum_through)
            last_tr = F.last(F.when(~F.col(f"_all1{i}"), F.col(f"_tr{i}")), ignorenulls=True).over(before)
            last_cum = F.last(F.when(~F.col(f"_all1{i}"), F.col(f"_cum{i}")), ignorenulls=True).over(before)
            n_before = F.coalesce(F.sum("_cn").over(before), F.lit(0))
            ocols[f"_o_st{i}"] = F.when(last_tr.isNull(), n_before).otherwise(last_tr + n_before - last_cum)
        offsets = summ.withColumns(ocols).select(key, "_chunk", *ocols.keys())

    hstats = None
    if keystats:
        hstats = hot_rows.groupBy(key).agg(
            *[_AGG[s.fn](s.expr).alias(f"_h{i}") for i, s in enumerate(keystats)])

    real = base.withColumn("_ghost", F.lit(0))
    union = real
    for g in ghosts:
        union = union.unionByName(g.withColumn("_ghost", F.lit(1)))
    if offsets is not None:
        union = union.join(_small(offsets, chunks + n_hot), [key, "_chunk"], "left")
    if hstats is not None:
        union = union.join(_small(hstats, n_hot), key, "left")

    w = Window.partitionBy(key, "_chunk").orderBy(*order, "_ghost")
    whole = Window.partitionBy(key, "_chunk")
    isreal = F.col("_ghost") == 0
    union = union.withColumn("_rn", F.sum(F.when(isreal, 1).otherwise(0)).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = {}
    ri = si = ki = 0
    for s in specs:
        if isinstance(s, Rolling):
            out[s.name] = _AGG[s.fn](s.expr).over(w.rowsBetween(s.lo, s.hi))
        elif isinstance(s, Shift):
            out[s.name] = F.lag(s.expr, s.k).over(w) if s.k > 0 else F.lead(s.expr, -s.k).over(w)
        elif isinstance(s, Running):
            hi = Window.currentRow if s.inclusive else -1
            inside = F.sum(F.when(isreal, s.expr)).over(w.rowsBetween(Window.unboundedPreceding, hi))
            out[s.name] = F.coalesce(inside, F.lit(0)) + F.coalesce(F.col(f"_o_rs{ri}"), F.lit(0))
            ri += 1
        elif isinstance(s, Streak):
            last0 = F.max(F.when(isreal & (F.coalesce(s.flag, F.lit(0)) != 1), F.col("_rn"))).over(
                w.rowsBetween(Window.unboundedPreceding, -1))
            carry = F.coalesce(F.col(f"_o_st{si}"), F.lit(0))
            out[s.name] = F.when(last0.isNotNull(), F.col("_rn") - 1 - last0).otherwise(
                F.col("_rn") - 1 + carry).cast("int")
            si += 1
        elif isinstance(s, KeyStat):
            out[s.name] = F.coalesce(F.col(f"_h{ki}"), _AGG[s.fn](F.when(isreal, s.expr)).over(whole))
            ki += 1
    res = union.withColumns(out).filter(isreal)
    return res.select(*cols, *[s.name for s in specs])
