"""Distributed pool-adjacent-violators against the plain algorithm."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendsignals.operators import isotonic as ISO


def _plain(points):
    """Isotonic regression by the textbook: value of every distinct score."""
    blocks = []
    for x in sorted({p[0] for p in points}):
        ys = [y for s, y in points if s == x]
        blocks.append([sum(ys), len(ys), [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, w, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2] + xs]
    return {x: s / w for s, w, xs in blocks for x in xs}


@pytest.mark.parametrize("ranges", [None, 1, 40])
@pytest.mark.parametrize("kind", ["random", "tied", "falling", "perfect"])
def test_equals_plain_version(spark, monkeypatch, ranges, kind):
    monkeypatch.setattr(ISO, "FAN_IN", 3)           # several rounds
    rng = random.Random(kind)
    score = {"random": rng.random, "tied": lambda: rng.randint(0, 9) / 10, "falling": rng.random, "perfect": rng.random}[kind]
    points = []
    for _ in range(500):
        s = score()
        p = {"random": s * s, "tied": s, "falling": 1 - s, "perfect": float(s > 0.5)}[kind]
        points.append((s, int(rng.random() < p)))
    df = spark.createDataFrame(points, "raw_prob double, impulse_label int")
    want = _plain(points)
    got = ISO.pools(df, "raw_prob", "impulse_label", ranges).orderBy("low").collect()
    value = {x: r["total"] / r["weight"] for x in want for r in got if r["low"] <= x <= r["high"]}
    assert value == pytest.approx(want)
    assert all(a["total"] / a["weight"] < b["total"] / b["weight"] and a["high"] < b["low"] for a, b in zip(got, got[1:], strict=False))


def test_map_and_odd_rows(spark, tmp_path):
    rows = [(0.1, 0), (0.2, 1), (0.2, 0), (0.6, 1), (0.6, 0), (0.9, 1), (None, 1), (0.5, None), (float("nan"), 1)]
    df = spark.createDataFrame(rows, "raw_prob double, impulse_label int")
    model = ISO.fit_isotonic(df)
    at = spark.createDataFrame([(v,) for v in (0.0, 0.1, 0.15, 0.2, 0.4, 0.6, 0.75, 0.9, 2.0, None)], "raw_prob double")
    got = [r["cal_prob"] for r in model.transform(at).collect()]
    assert got == pytest.approx([0, 0, 0.25, 0.5, 0.5, 0.5, 0.75, 1, 1, None])
    model.save(spark, str(tmp_path / "m"))
    back = ISO.Isotonic.load(spark, str(tmp_path / "m"))
    assert np.array_equal(back.x, model.x) and np.array_equal(back.y, model.y)
    empty = ISO.fit_isotonic(df.where(F.lit(False)))
    assert len(empty.x) == 0 and [r["cal_prob"] for r in empty.transform(at).collect()] == [None] * 10
