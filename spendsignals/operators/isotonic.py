"""M8: isotonic calibration without collecting the scores.

Pool-adjacent-violators is associative: pooling ranges of scores apart and then the pools of neighbouring ranges gives the
pools of the whole. Distinct scores are counted first (a score shared by a third of the rows is one row) and dealt out
in ranges; every task pools its range as a stream, holding its pools only; then the pools of ``FAN_IN`` neighbouring ranges
are pooled together, until one range is left. Sums are whole numbers, so the result does not depend on the ranges.

Few pools are left of many scores: their borders are corners of a convex chain of whole-number points, at most about
rows ** (2/3) of them. They are the model, which the driver holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

FAN_IN = 16
POOLS = "part long, low double, high double, weight long, total long"


def _add(pools: list[list], low: float, high: float, weight: int, total: int) -> None:
    """Appends a pool and merges it with those before it while the means do not rise."""
    while pools and pools[-1][3] * weight >= total * pools[-1][2]:
        low, _, w, t = pools.pop()
        weight, total = weight + w, total + t
    pools.append([low, high, weight, total])


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, low) -> the pools of each part."""
    part, pools = None, []

    def done():
        return pa.RecordBatch.from_arrays([pa.array([part] * len(pools), pa.int64()), *(pa.array([p[k] for p in pools], t) for k, t in enumerate(
            (pa.float64(), pa.float64(), pa.int64(), pa.int64())))], names=["part", "low", "high", "weight", "total"])

    for batch in batches:
        for p, low, high, weight, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part:
                if pools:
                    yield done()
                part, pools = p, []
            _add(pools, low, high, weight, total)
    if pools:
        yield done()


@dataclass
class Isotonic:
    """A non-decreasing map: linear between the points, flat outside them."""
    x: np.ndarray
    y: np.ndarray

    def transform(self, df: DataFrame, score: str = "raw_prob", out: str = "cal_prob") -> DataFrame:
        """``df`` with the calibrated score; a null score stays null, a map without points gives null."""
        x, y = self.x, self.y

        @F.pandas_udf("double")
        def calibrate(s: pd.Series) -> pd.Series:
            v = s.to_numpy(dtype=float, na_value=np.nan)
            return pd.Series(np.interp(v, x, y) if len(x) else np.full(len(v), np.nan)).where(~np.isnan(v), None)

        return df.withColumn(out, calibrate(F.col(score)))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(self.x, self.y, strict=True))], "place int, x double, y double").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Isotonic:
        rows = list(spark.read.parquet(path).orderBy("place").toLocalIterator())
        return Isotonic(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows]))


def pools(df: DataFrame, score: str, label: str, ranges: int | None = None) -> DataFrame:
    """``low, high, weight, total``: the pools of the isotonic regression of a 0/1 (or whole-number) label on the score, in
    ascending order of ``low``. Rows without a score or label are left out; an empty table has no pools."""
    rows = df.select(F.col(score).cast("double").alias("low"), F.col(label).cast("long").alias("y")).where("low IS NOT NULL AND NOT isnan(low) AND y IS NOT NULL")
    distinct = rows.groupBy("low").agg(F.count("*").alias("weight"), F.sum("y").alias("total"))
    dealt = distinct.repartitionByRange(ranges, "low") if ranges else distinct.repartitionByRange("low")
    # partition k lies below partition k + 1; checkpointed, so every round sees the same ranges
    found = dealt.sortWithinPartitions("low").select(F.spark_partition_id().cast("long").alias("part"), "low", F.col("low").alias("high"), "weight", "total")
    found = cut_lineage(found.mapInArrow(_pool, POOLS))
    while (found.agg(F.max("part").alias("p")).first()["p"] or 0) > 0:
        near = found.withColumn("part", F.floor(F.col("part") / FAN_IN))
        found = cut_lineage(near.repartition("part").sortWithinPartitions("part", "low").mapInArrow(_pool, POOLS))
    return found.select("low", "high", "weight", "total")


def fit_isotonic(df: DataFrame, score: str = "raw_prob", label: str = "impulse_label") -> Isotonic:
    """The calibration map: both ends of every pool with its mean."""
    rows = pools(df, score, label).orderBy("low").collect()         # the model
    x, y = [], []
    for r in rows:
        for end in dict.fromkeys((r["low"], r["high"])):
            x.append(end)
            y.append(r["total"] / r["weight"])
    return Isotonic(np.array(x), np.array(y))
