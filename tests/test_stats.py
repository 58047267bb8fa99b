"""p-value helpers and statistics against known values."""

from spendsignals.operators.stats import normal_two_sided_p, t_two_sided_p


def test_t_p_value():
    assert abs(t_two_sided_p(2.0, 10) - 0.07338803477074) < 1e-9
    assert abs(t_two_sided_p(0.0, 5) - 1.0) < 1e-12
    assert t_two_sided_p(50.0, 1000) < 1e-200


def test_normal_p_value():
    assert abs(normal_two_sided_p(1.959963984540054) - 0.05) < 1e-12
    assert abs(normal_two_sided_p(-1.0) - 0.3173105078629141) < 1e-12


def test_p_value_udfs_on_spark_results(spark):
    from conftest import SF_SMALL
    from spendsignals.operators import stats as S
    from spendsignals.plans import inputs as I

    t = S.with_t_p(S.t_test(I.txn(spark, SF_SMALL))).first()
    assert abs(t["p_value"] - t_two_sided_p(t["t_stat"], t["dof"])) < 1e-12 and 0.0 <= t["p_value"] <= 1.0
    mw = S.mann_whitney(I.eng(spark, SF_SMALL), ["spend_zscore", "drawdown_ratio"], p_values=True).collect()
    for r in mw:
        assert abs(r["p_value"] - normal_two_sided_p(r["z"])) < 1e-12


def test_exact_u_equals_enumeration(spark):
    """Small groups without ties: every arrangement counted; ties or larger groups: the normal tail."""
    import random
    from itertools import combinations
    from math import ceil, comb

    from spendsignals.operators import stats as S
    rng = random.Random(9)
    for m, n in ((1, 1), (2, 5), (4, 4), (3, 9), (8, 6)):
        every = [sum(c) - m * (m - 1) // 2 for c in combinations(range(m + n), m)]       # U of the first group per arrangement
        values = rng.sample(range(1000), m + n)
        rows = [(int(k >= m), float(v)) for k, v in enumerate(values)]
        u = sum(a > b for a in values[:m] for b in values[m:])
        want = min(1.0, 2 * sum(x >= max(u, m * n - u) for x in every) / comb(m + n, m))
        got = S.mann_whitney(spark.createDataFrame(rows, "impulse_label int, v double"), ["v"], p_values=True).first()
        assert got["u_stat"] == u and abs(got["p_value"] - want) < 1e-12
        assert abs(S.exact_u_two_sided_p(m, n, ceil(u)) - want) < 1e-12
    tied = S.mann_whitney(spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 2.0), (1, 3.0)], "impulse_label int, v double"), ["v"], p_values=True).first()
    assert abs(tied["p_value"] - normal_two_sided_p(tied["z"])) < 1e-12
    assert S.exact_u_two_sided_p(8, 5000, 40_000) < 1e-20


def test_curve_corners_keep_the_curve(spark):
    """Same area and same corners as the full curve, however small the buckets."""
    import random

    from spendsignals.operators import evaluation as X
    rng = random.Random(4)
    rows = [(m, int(rng.random() < p), p) for m in ("a", "b") for p in ([round(rng.random(), 2 + (m == "b")) for _ in range(400)] + [0.5] * 50)]
    rows += [("perfect", int(k >= 20), k / 40) for k in range(40)]
    scores = spark.createDataFrame(rows, "model string, label int, prob double")
    full = {}
    for r in X.curve_points(scores).collect():
        full.setdefault(r["model"], []).append((r["fp"], r["tp"], r["threshold"]))
    for size in (3, 17, 10**6):
        got = {}
        for r in X.curve_corners(scores, size).collect():
            got.setdefault(r["model"], []).append((r["fp"], r["tp"], r["threshold"]))
        for m, points in full.items():
            points = sorted(points)
            path = [(0, 0, None), *points]
            want = [p for a, p, b in zip(path, points, [*points[1:], None], strict=False)
                    if b is None or (p[0] - a[0]) * (b[1] - p[1]) != (p[1] - a[1]) * (b[0] - p[0])]
            assert sorted(got[m]) == want
            area = lambda q: sum((b[0] - a[0]) * (a[1] + b[1]) for a, b in zip([(0, 0), *q], q, strict=False))
            assert area(sorted(got[m])) == area(points)
    assert len(got["perfect"]) == 2
