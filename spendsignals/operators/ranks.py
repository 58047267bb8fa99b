"""Global order statistics without a single-partition window.

``Window.orderBy(x)`` with no partition moves every row into one task. Here the distinct values are
counted first (a partial aggregate, so a value shared by a third of all rows is one row), split into
range buckets whose edges come from ``approxQuantile`` over the distinct values (literals, so a
recomputed stage gets the same buckets), summed within each bucket by a window partitioned on the
bucket, and shifted by the totals of all earlier buckets (one row per bucket, broadcast).

``prefix_sums`` is the one primitive behind percentile ranks (W11), Mann-Whitney (T2), ROC-AUC (X3),
average precision (X4) and the ROC / PR curves (X5).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def prefix_sums(df: DataFrame, value: str, measures: dict[str, Column], by=(), descending: bool = False,
                buckets: int | None = None) -> DataFrame:
    """One row per ``(by..., distinct non-NULL value)``: each measure summed at that value (``name``)
    and summed over all values strictly before it in the chosen order within its group
    (``name_before``).

    Plan: partial aggregate to distinct values (a value held by a third of the rows is one row);
    ``repartitionByRange`` on (group, value) (Spark samples the bounds, so buckets stay balanced at
    any cardinality; AQE sizes them unless ``buckets`` is given), bucket id = partition id, pinned by a reliable
    checkpoint so every consumer sees the same buckets; running sums inside (bucket, group);
    offsets from the bucket totals (one row per bucket and group, broadcast)."""
    from ..session import cut_lineage
    by = list(by)
    vc = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        *[F.sum(m).alias(n) for n, m in measures.items()])
    vkey = F.col(value).desc() if descending else F.col(value).asc()
    keys = [F.col(b) for b in by] + [vkey]
    # without an explicit count AQE sizes the ranges (coalesced ranges stay contiguous and ordered)
    ranged = vc.repartitionByRange(buckets, *keys) if buckets else vc.repartitionByRange(*keys)
    vb = cut_lineage(ranged.withColumn("_b", F.spark_partition_id()))
    # partition ids follow the range order (value descending when ``descending``)
    w = Window.partitionBy(*by, "_b").orderBy(vkey).rowsBetween(Window.unboundedPreceding, -1)
    inner = vb.withColumns({f"_in_{n}": F.coalesce(F.sum(n).over(w), F.lit(0)) for n in measures})
    tot = vb.groupBy(*by, "_b").agg(*[F.sum(n).alias(f"_t_{n}") for n in measures])
    wb = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*by, "_b", *[F.coalesce(F.sum(f"_t_{n}").over(wb), F.lit(0)).alias(f"_o_{n}")
                                   for n in measures])
    out = inner.join(F.broadcast(offs), by + ["_b"])
    return out.select(*by, value, *measures.keys(),
                      *[(F.col(f"_in_{n}") + F.col(f"_o_{n}")).alias(f"{n}_before") for n in measures])


def rank_table(df: DataFrame, value: str, out: str = "rank", pct: bool = False, scale: float = 1.0,
               buckets: int | None = None) -> DataFrame:
    """Distinct non-NULL ``value`` -> average rank over the whole table (ties share the mean rank).

    ``pct=True`` divides by the number of non-NULL values (pandas ``rank(pct=True)``)."""
    ps = prefix_sums(df, value, {"_c": F.lit(1)}, buckets=buckets)
    ranks = ps.select(value, (F.col("_c_before") + (F.col("_c") + 1) / 2.0).alias("_r"), "_c")
    if pct:
        total = ranks.agg(F.sum("_c").alias("_n"))   # one row
        ranks = ranks.crossJoin(F.broadcast(total)).withColumn("_r", F.col("_r") / F.col("_n") * scale)
    return ranks.select(value, F.col("_r").alias(out))


TIE_PLACES = 9
FREQUENT = 1000


def _key(value: str, tie_places: int | None):
    # values that agree to `tie_places` decimals are ties: a mean that is 0 in exact arithmetic must
    # not be ordered by floating-point noise, which differs between engines and summation orders
    return F.round(F.col(value), tie_places) if tie_places is not None else F.col(value)


def with_ranks(df: DataFrame, outputs: dict[str, str], pct: bool = False, scale: float = 1.0,
               buckets: int | None = None, tie_places: int | None = TIE_PLACES, key: str | None = None) -> DataFrame:
    """Attach several rank columns, every one ranked over the whole table.

    With a unique ``key`` all columns are ranked in one pass: unpivot to (metric, value), one
    prefix-sum job grouped by metric, pivot back per key. Without a key, one rank table per column."""
    if key is None or len(outputs) == 1:
        out = df
        for name, value in outputs.items():
            keyed = df.select(_key(value, tie_places).alias("_k"))
            rt = rank_table(keyed, "_k", "_r", pct=pct, scale=scale, buckets=buckets)
            rt = rt.select(F.col("_k").alias("_rank_key"), F.col("_r").alias(name))
            out = out.join(rt, _key(value, tie_places) == rt["_rank_key"], "left").drop("_rank_key")
        return out
    names = list(outputs)
    long = df.select(key, F.explode(F.array(*[
        F.struct(F.lit(n).alias("_m"), _key(v, tie_places).cast("double").alias("_k")) for n, v in outputs.items()
    ])).alias("_p")).select(key, "_p._m", "_p._k").where(F.col("_k").isNotNull())     # no value, no rank
    ps = prefix_sums(long, "_k", {"_c": F.lit(1)}, by=["_m"], buckets=buckets)
    totals = ps.groupBy("_m").agg(F.sum("_c").alias("_n"))      # one row per output
    ps = ps.join(F.broadcast(totals), "_m")
    r = F.col("_c_before") + (F.col("_c") + 1) / 2.0
    if pct:
        r = r / F.col("_n") * scale
    # values shared by many rows (a rate of 0) would be one join key each: at most FREQUENT per output, so they are
    # broadcast; the rest joins by shuffle, no key with more than 1 / FREQUENT of the rows
    from ..session import cut_lineage
    ranks = cut_lineage(ps.select("_m", "_k", r.alias("_r"), (F.col("_c") * FREQUENT > F.col("_n")).alias("_hot")))     # read three times
    hot, rest = ranks.where("_hot").drop("_hot"), ranks.where("NOT _hot").drop("_hot")
    ranked = long.join(F.broadcast(hot), ["_m", "_k"]).unionByName(
        long.join(F.broadcast(hot.select("_m", "_k")), ["_m", "_k"], "left_anti").join(rest, ["_m", "_k"]))
    wide = ranked.groupBy(key).pivot("_m", names).agg(F.first("_r"))
    return df.join(wide, key, "left")


def percentile_scores(df: DataFrame, outputs: dict[str, str], key: str | None = None) -> DataFrame:
    """Percentile rank x100 with average ranks on ties, for several columns."""
    return with_ranks(df, outputs, pct=True, scale=100.0, key=key)
