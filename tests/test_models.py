"""Model invariants (no SQL oracle exists for trained models)."""

import os
import tempfile

from pyspark.sql import functions as F

from spendsignals.operators.features import feature_columns
from spendsignals.plans import inputs as I
from spendsignals.plans import models as M

from conftest import SF_SMALL

LABEL = "impulse_label"


def _train(spark):
    e = I.eng(spark, SF_SMALL)
    feats = [c for c in feature_columns(e) if c != "impulse_prob"]
    return e, feats


def test_split_is_stratified_and_exact(spark):
    d, _ = _train(spark)
    s = M.stratified_split(d, LABEL)
    counts = {(r[0], r[1]): r[2] for r in s.groupBy(LABEL, "split").count().collect()}
    for lab in (0, 1):
        n = counts.get((lab, "test"), 0) + counts.get((lab, "train"), 0)
        assert counts.get((lab, "test"), 0) == -(-n * 2 // 10)   # ceil(0.2 n)


def test_tree_attribution_adds_up_to_margin(spark):
    d, feats = _train(spark)
    m = M.fit(d, feats, M.boosted({"n_estimators": 8, "max_depth": 3}))
    attr = M.tree_attribution(m, d, feats)
    total = attr.groupBy("transaction_id").agg(F.sum("value").alias("s"))
    mg = M.margin(m, d)
    worst = total.join(mg, "transaction_id").agg(F.max(F.abs(F.col("s") - F.col("margin")))).first()[0]
    assert worst < 1e-9


def test_forest_attribution_adds_up_to_probability(spark):
    d, feats = _train(spark)
    m = M.fit(d, feats, M.forest({"n_estimators": 5, "max_depth": 4}))
    total = M.tree_attribution(m, d, feats, name="forest").groupBy("transaction_id").agg(F.sum("value").alias("s"))
    worst = total.join(M.score(m, d), "transaction_id").agg(F.max(F.abs(F.col("s") - F.col("prob")))).first()[0]
    assert worst < 1e-9


def test_shapley_values_equal_all_coalitions():
    """A small tree that splits twice on one feature, against the sum over every coalition."""
    from itertools import combinations
    from math import factorial

    import numpy as np
    #        0: x0<=1 ; 1: x1<=2 ; 2: x0<=3 ; leaves 3 4 5 6
    tree = {"feat": [0, 1, 0, -1, -1, 2, -1, -1, -1], "thr": [1, 2, 3, 0, 0, 5, 0, 0, 0], "left": [1, 3, 5, -1, -1, 7, -1, -1, -1],
            "right": [2, 4, 6, -1, -1, 8, -1, -1, -1], "cover": [100, 40, 60, 10, 30, 45, 15, 20, 25], "val": [0, 0, 0, 1.0, -2.0, 0, 5.0, 3.0, 0.5]}

    def expected(x, known, i=0):
        f = tree["feat"][i]
        if f < 0:
            return tree["val"][i]
        a, b = tree["left"][i], tree["right"][i]
        if f in known:
            return expected(x, known, a if x[f] <= tree["thr"][i] else b)
        return (tree["cover"][a] * expected(x, known, a) + tree["cover"][b] * expected(x, known, b)) / tree["cover"][i]

    rows = np.array([[a, b, c] for a in (0, 1, 2, 4) for b in (1, 3) for c in (4, 6)], dtype=float)
    got = M.shapley_values(M.leaf_paths(tree), rows, 3)
    for x, phi in zip(rows, got):
        for f in range(3):
            others = [g for g in range(3) if g != f]
            want = sum(factorial(k) * factorial(2 - k) / 6 * (expected(x, {*s, f}) - expected(x, {*s}))
                       for k in range(3) for s in combinations(others, k))
            assert abs(phi[f] - want) < 1e-12
        assert abs(phi.sum() - expected(x, {0, 1, 2})) < 1e-12


def _random_tree(rng, n_feats, depth):
    tree = {k: [] for k in ("feat", "cut", "thr", "left", "right", "cover", "val")}

    def grow(d, cover):
        i = len(tree["feat"])
        leaf = d == depth or (d > 3 and rng.random() < 0.15)
        f, cut = int(rng.integers(n_feats)), int(rng.integers(7))
        for k, v in (("feat", -1 if leaf else f), ("cut", cut), ("thr", float(cut)), ("left", 0), ("right", 0), ("cover", cover), ("val", float(rng.normal()))):
            tree[k].append(v)
        if not leaf:
            share = rng.uniform(0.05, 0.95)
            tree["left"][i] = grow(d + 1, cover * share)
            tree["right"][i] = grow(d + 1, cover * (1 - share))
        return i

    grow(0, 100.0)
    return tree


def test_shapley_values_by_parts_equal_those_leaf_by_leaf(monkeypatch):
    """Trees of many parts and of one, with repeated features, equal rows and values that pass no condition."""
    import numpy as np

    from spendsignals.operators import shapley

    rng = np.random.default_rng(3)
    for n_feats, depth, leaves in ((3, 2, 16), (5, 7, 16), (9, 9, 4), (30, 9, 16), (4, 6, 1), (1, 0, 16)):
        monkeypatch.setattr(shapley, "LEAVES", leaves)
        trees = [_random_tree(rng, n_feats, depth) for _ in range(3)]
        bins = rng.integers(0, 8, (200, n_feats))
        bins[::3, 0] = -1
        bins[7] = bins[8]
        x = np.where(bins < 0, np.nan, bins.astype(float))
        want = M.shapley_values([p for t in trees for p in M.leaf_paths(t)], x, n_feats)
        assert np.abs(shapley.values(trees, bins, n_feats) - want).max() < 1e-12
        assert shapley.values(trees, bins[:0], n_feats).shape == (0, n_feats + 1)


def test_a_deep_forest_is_not_worked_leaf_by_leaf(monkeypatch):
    """Rows that a part of a tree cannot tell apart are worked on once: 2,000 rows of 2 kinds cost what 2 do."""
    import numpy as np

    from spendsignals.operators import shapley

    tree, seen = _random_tree(np.random.default_rng(5), 8, 8), []
    walked = shapley.Walker.walked
    monkeypatch.setattr(shapley.Walker, "walked", lambda self, root, columns, n: (seen.append(n), walked(self, root, columns, n))[1])
    bins = np.tile(np.array([[0, 1, 2, 3, 4, 5, 6, 7], [7, 6, 5, 4, 3, 2, 1, 0]]), (1000, 1))
    got = shapley.values([tree], bins, 8)
    assert max(seen) <= 2 and len(seen) < sum(f < 0 for f in tree["feat"]) / 2
    assert np.abs(got - np.tile(M.shapley_values(M.leaf_paths(tree), bins[:2].astype(float), 8), (1000, 1))).max() < 1e-12


def test_attribution_uses_all_cores(spark):
    """Few stored partitions do not hold up the work; rows without an id and copies are kept."""
    rows = [(None if i == 5 else i // 2, float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "transaction_id long, a double, b double, impulse_label int").coalesce(1)
    m = M.fit(df.where("transaction_id is not null"), ["a", "b"], M.boosted({"n_estimators": 3, "max_depth": 2}))
    attr = M.tree_attribution(m, df, ["a", "b"])
    assert attr.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert attr.count() == 900 and attr.where("transaction_id is null").count() == 3


def test_logistic_attribution_adds_up_and_probabilities_in_range(spark):
    d, feats = _train(spark)
    m = M.fit(d, feats, M.logistic(), scale=True)
    sc = M.score(m, d)
    lo, hi = sc.agg(F.min("prob"), F.max("prob")).first()
    assert 0.0 <= lo <= hi <= 1.0
    attr = M.logistic_attribution(m, d, feats)
    raw = m.transform(d).select("transaction_id", M.vector_to_array("rawPrediction")[1].alias("margin"))
    total = attr.groupBy("transaction_id").agg(F.sum("value").alias("s"))
    worst = total.join(raw, "transaction_id").agg(F.max(F.abs(F.col("s") - F.col("margin")))).first()[0]
    assert worst < 1e-9


def test_isotonic_is_monotone_and_save_load_equal(spark):
    d, feats = _train(spark)
    d = M.stratified_folds(d, LABEL, k=3)
    pairs = M.fit_calibrated(d, feats, M.logistic, folds=3, label=LABEL, scale=True)
    m, iso = pairs[0]
    raw = M.score(m, d, "raw_prob")
    cal = iso.transform(raw).select("raw_prob", "cal_prob").toPandas().sort_values("raw_prob")
    assert (cal["cal_prob"].diff().dropna() >= -1e-12).all()
    path = os.path.join(tempfile.mkdtemp(dir=os.environ.get("TMPDIR", "/tmp")), "model")
    M.save_model(m, path)
    back = M.load_model(path)
    a = M.score(m, d, "a").select("transaction_id", "a")
    b = M.score(back, d, "b").select("transaction_id", "b")
    assert a.join(b, "transaction_id").agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] == 0.0


def test_patterns_counted_sorted_and_wide_agree():
    import numpy as np

    rng = np.random.default_rng(7)
    for n, m in ((500, 3), (40, 12), (200, 70)):
        through = rng.integers(0, 2, (n, m))
        codes = [sum(through[:, j].astype(np.int64) << j % M.WORD for j in range(a, min(a + M.WORD, m))) for a in range(0, m, M.WORD)]
        patterns, of_row = M._patterns(codes, m)
        assert (patterns[of_row] == through).all() and len(np.unique(patterns, axis=0)) == len(patterns)


def test_each_kind_is_fitted_alone(spark, monkeypatch):
    """A query that reads the forest does not wait for the boosted trees."""
    from spendsignals.plans import catalog  # noqa: F401
    from spendsignals.plans import q_models as Q

    kinds = []
    monkeypatch.setattr(Q, "_KEPT", {})
    monkeypatch.setattr(M, "search", lambda data, make, space, **_: ([{"n_estimators": 50, "max_depth": 3}], [0.5], 0, 1))
    train = M.trees.train
    monkeypatch.setattr(M.trees, "train", lambda data, models: (kinds.extend(m.kind for m in models), train(data, models)))
    Q.ModelCtx(spark, SF_SMALL).fitted("forest")
    assert kinds == ["forest"]


def test_folds_are_judged_together(spark, monkeypatch):
    from spendsignals.operators import evaluation as X

    seen = []
    auc = X.roc_auc
    monkeypatch.setattr(X, "roc_auc", lambda scores: (seen.append(scores), auc(scores))[1])
    rows = [(i, float(i % 7), float(i % 3), int(i * 37 % 11 < i % 7), i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "transaction_id long, a double, b double, impulse_label int, fold int")
    got = {r["fold"]: r for r in M.cross_validate(df, ["a", "b"], M.logistic, folds=3).collect()}
    assert len(seen) == 1 and "Scan ExistingRDD" in seen[0]._jdf.queryExecution().toString()
    assert sorted(got) == [0, 1, 2]
    for f, r in got.items():
        m = M.fit(df.where(F.col("fold") != f), ["a", "b"], M.logistic(), scale=True)
        s = M.score(m, df.where(F.col("fold") == f)).select("impulse_label", "prob").collect()
        pos, neg = [x["prob"] for x in s if x["impulse_label"] == 1], [x["prob"] for x in s if x["impulse_label"] == 0]
        assert abs(r["roc_auc"] - sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)) < 1e-9
        assert r["model"] == f"fold{f}" and abs(r["recall"] - sum(p >= 0.5 for p in pos) / len(pos)) < 1e-9


def test_fits_read_stored_rows(spark, monkeypatch):
    """The request model's rows are stored once, and fits without folds make none."""
    from spendsignals.plans import catalog  # noqa: F401
    from spendsignals.plans import q_models as Q
    from spendsignals.plans import q_stream as S

    plans = []
    monkeypatch.setattr(M, "fit", lambda df, *a, **k: plans.append(df._jdf.queryExecution().optimizedPlan().toString()))
    S.request_model(spark, SF_SMALL)
    assert "Window" not in plans[0] and "parquet" not in plans[0]
    monkeypatch.setattr(M, "stratified_folds", lambda *a, **k: 1 / 0)
    monkeypatch.setattr(M, "logistic_attribution", lambda m, df, feats: df)
    assert Q.e02a(spark, SF_SMALL).count() > 0 and len(plans) == 2
