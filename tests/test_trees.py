"""Histogram trees: equal to a plain version on the same bins, independent of partitioning, every parameter acts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendsignals.operators import trees as T

FEATS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 600
    x = np.stack([rng.normal(size=n), rng.integers(0, 4, n), rng.exponential(size=n).round(2), rng.integers(0, 2, n)], axis=1)
    y = (x[:, 0] + 0.7 * x[:, 3] * x[:, 2] + rng.normal(scale=0.7, size=n) > 0.6).astype(int)
    data = [(i + 1, *map(float, x[i]), int(y[i]), i % 5) for i in range(n)]
    return spark.createDataFrame(data, "transaction_id long, a double, b double, c double, d double, y int, fold int")


def _table(data):
    got = data.rows.orderBy("id").collect()
    return (np.array([r["id"] for r in got]), np.array([r["label"] for r in got]), np.array([r["fold"] for r in got]),
            np.array([list(r["bins"]) for r in got]))


def _plain_boosted(ids, y, bins, sizes, p, seed=T.SEED):
    """One row and one split at a time; returns the margins after all trees."""
    p = T.BOOSTED_DEFAULTS | p
    margin = np.zeros(len(y))
    positive = (y == 0).sum() / (y == 1).sum()
    draw = lambda i, of: int(T.draws(np.array([i]), of)[0])
    for t in range(int(p["n_estimators"])):
        prob = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, positive, 1.0)
        g, h = np.rint(w * (prob - y) * T.UNIT), np.rint(w * prob * (1 - prob) * T.UNIT)
        rows = [k for k in range(len(y)) if p["subsample"] >= 1 or draw(ids[k], T.stream(T.ROWS, t)) < p["subsample"] * T.PRIME]
        order = sorted(range(bins.shape[1]), key=lambda f: (draw(f + 1, T.stream(T.COLUMNS, t)), f))
        feats = sorted(order[:max(1, int(p["colsample_bytree"] * bins.shape[1]))])

        def value(G, H):
            cut = math.copysign(max(abs(G) - p["reg_alpha"], 0), G)
            return cut, H + p["reg_lambda"]

        def score(G, H):
            a, b = value(G, H)
            return a * a / b

        def grow(inside, everyone, depth):
            G, H = sum(g[k] for k in inside) / T.UNIT, sum(h[k] for k in inside) / T.UNIT
            best = None
            if depth < p["max_depth"] and inside:
                for f in feats:
                    for b in range(sizes[f] - 1):
                        left = [k for k in inside if bins[k, f] <= b]
                        gl, hl = sum(g[k] for k in left) / T.UNIT, sum(h[k] for k in left) / T.UNIT
                        if hl < p["min_child_weight"] or H - hl < p["min_child_weight"]:
                            continue
                        gain = 0.5 * (score(gl, hl) + score(G - gl, H - hl) - score(G, H))
                        if gain > T.MIN_GAIN and (best is None or gain > best[0]):
                            best = (gain, f, b)
            if best is None:
                a, b = value(G, H)
                for k in everyone:
                    margin[k] += -a / b * p["learning_rate"]
                return
            _, f, b = best
            for side in (lambda k: bins[k, f] <= b, lambda k: bins[k, f] > b):
                grow([k for k in inside if side(k)], [k for k in everyone if side(k)], depth + 1)

        grow(rows, list(range(len(y))), 0)
    return margin


@pytest.mark.parametrize("params", [
    {"n_estimators": 3, "max_depth": 2},
    {"n_estimators": 2, "max_depth": 3, "subsample": 0.6, "colsample_bytree": 0.5, "reg_alpha": 1.5, "reg_lambda": 4.0, "min_child_weight": 6.0, "learning_rate": 0.3}])
def test_boosted_equals_plain_version(rows, params):
    data = T.pack(rows, FEATS, "y", max_bins=12)
    ids, y, _, bins = _table(data)
    model = T.Ensemble("boosted", params)
    T.train(data, [model])
    want = _plain_boosted(ids, y, bins, data.sizes, params)
    got = T.TreeModel(model, FEATS, data.edges).score(rows, "m", margin=True).orderBy("transaction_id").select("m").collect()
    assert np.abs(np.array([r["m"] for r in got]) - want).max() < 1e-9


def _plain_forest(ids, y, bins, sizes, p, seed=T.SEED):
    p = T.FOREST_DEFAULTS | p
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    w = {0: len(y) / (2 * n0), 1: len(y) / (2 * n1)}
    out = np.zeros(len(y))
    for t in range(p["n_estimators"]):
        k = T.bootstrap_counts(ids, t)
        number = [0]

        def grow(inside, everyone, depth, name):
            c0, c1 = (sum(k[i] for i in inside if y[i] == v) for v in (0, 1))
            best = None
            gini = lambda a, b: 2 * a * b / (a + b) if a + b else 0.0
            if depth < p["max_depth"] and len(inside) >= p["min_samples_split"]:
                for f in T.some_of(bins.shape[1], p["max_features"], T.stream(T.NODES, t, name)):
                    for b in range(sizes[f] - 1):
                        left = [i for i in inside if bins[i, f] <= b]
                        if min(len(left), len(inside) - len(left)) < p["min_samples_leaf"]:
                            continue
                        l0, l1 = (sum(k[i] for i in left if y[i] == v) for v in (0, 1))
                        gain = gini(w[0] * c0, w[1] * c1) - gini(w[0] * l0, w[1] * l1) - gini(w[0] * (c0 - l0), w[1] * (c1 - l1))
                        if gain > T.MIN_GAIN and (best is None or gain > best[0]):
                            best = (gain, f, b)
            if best is None:
                for i in everyone:
                    out[i] += w[1] * c1 / (w[0] * c0 + w[1] * c1)
                return []
            return [(best, inside, everyone, depth)]

        # nodes are numbered level by level, as the job numbers them
        todo = [(list(np.flatnonzero(k > 0)), list(range(len(y))), 0, 0)]
        while todo:
            split = [s for node in todo for s in grow(*node)]
            todo = []
            for (_, f, b), inside, everyone, depth in split:
                for side in (lambda i: bins[i, f] <= b, lambda i: bins[i, f] > b):
                    number[0] += 1
                    todo.append(([i for i in inside if side(i)], [i for i in everyone if side(i)], depth + 1, number[0]))
    return out / p["n_estimators"]


@pytest.mark.parametrize("params", [{"n_estimators": 3, "max_depth": 3, "max_features": 0.75},
                                    {"n_estimators": 2, "max_depth": 5, "min_samples_split": 60, "min_samples_leaf": 12, "max_features": 0.5}])
def test_forest_equals_plain_version(rows, params):
    data = T.pack(rows, FEATS, "y", max_bins=10)
    ids, y, _, bins = _table(data)
    model = T.Ensemble("forest", params)
    T.train(data, [model])
    got = T.TreeModel(model, FEATS, data.edges).score(rows).orderBy("transaction_id").select("prob").collect()
    assert np.abs(np.array([r["prob"] for r in got]) - _plain_forest(ids, y, bins, data.sizes, params)).max() < 1e-9


def test_partitioning_and_company_change_nothing(rows, monkeypatch):
    """The same trees from one and from eight partitions, alone or beside other models, in small passes and with pinned margins."""
    kinds = [("boosted", {"n_estimators": 4, "max_depth": 3, "subsample": 0.7}, None), ("forest", {"n_estimators": 3, "max_depth": 4}, 2), ("boosted", {"n_estimators": 2, "max_depth": 2}, 1)]
    together = [T.Ensemble(*k) for k in kinds]
    one = T.pack(rows.repartition(1), FEATS, "y", max_bins=16)
    T.train(one, together)
    monkeypatch.setattr(T, "PASS_BYTES", 3000)
    monkeypatch.setattr(T, "PIN_TREES", 1)
    eight = T.pack(rows.repartition(8), FEATS, "y", max_bins=16)
    for k, model in zip(kinds, together, strict=True):
        alone = T.Ensemble(*k)
        T.train(eight, [alone])
        assert alone.trees == model.trees


@pytest.mark.parametrize("kind,change", [("boosted", c) for c in (
    {"n_estimators": 3}, {"max_depth": 1}, {"learning_rate": 0.5}, {"subsample": 0.5}, {"colsample_bytree": 0.5}, {"reg_alpha": 20.0}, {"reg_lambda": 50.0}, {"min_child_weight": 40.0})]
    + [("forest", c) for c in ({"n_estimators": 3}, {"max_depth": 1}, {"min_samples_split": 300}, {"min_samples_leaf": 150}, {"max_features": 0.25})])
def test_every_searched_parameter_acts(packed_once, kind, change):
    base, data = packed_once[kind], packed_once["data"]
    model = T.Ensemble(kind, {"n_estimators": 2, "max_depth": 3, "max_features": 1.0} | change)
    T.train(data, [model])
    assert model.trees != base.trees


@pytest.fixture(scope="module")
def packed_once(rows):
    data = T.pack(rows, FEATS, "y", max_bins=16)
    both = {k: T.Ensemble(k, {"n_estimators": 2, "max_depth": 3, "max_features": 1.0}) for k in ("boosted", "forest")}
    T.train(data, list(both.values()))
    return both | {"data": data}


def test_bootstrap_draws():
    ids = np.arange(1, 40_001)
    for tree in (0, 1, 7):
        k = T.bootstrap_counts(ids, tree)
        assert abs(k.mean() - 1) < 0.02 and abs(k.var() - 1) < 0.04
    assert abs(np.corrcoef(T.bootstrap_counts(ids, 0), T.bootstrap_counts(ids, 1))[0, 1]) < 0.02


def test_search_ranks_by_held_out_auc(rows):
    data = T.pack(rows, FEATS, "y", max_bins=16)
    candidates = [{"n_estimators": 1, "max_depth": 1, "learning_rate": 0.01}, {"n_estimators": 8, "max_depth": 3, "learning_rate": 0.3}]
    auc, passes = T.search(data, "boosted", candidates, folds=5)
    assert auc[1] > auc[0] > 0.5 and passes <= 24
    # exact: one candidate's folds by hand
    model = T.Ensemble("boosted", candidates[1], 3)
    T.train(data, [model])
    fold = T.TreeModel(model, FEATS, data.edges).score(rows.where("fold = 3")).select("y", "prob").collect()
    pos, neg = [r["prob"] for r in fold if r["y"] == 1], [r["prob"] for r in fold if r["y"] == 0]
    by_hand = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    models = [T.Ensemble("boosted", candidates[1], f) for f in range(5)]
    T.train(data, models)
    from spendsignals.operators.evaluation import roc_auc
    got = roc_auc(T.held_out_scores(data, models).withColumn("model", F.col("model").cast("string"))).where("model = '3'").first()["roc_auc"]
    assert abs(got - by_hand) < 1e-9


def test_save_and_load(spark, rows, tmp_path, packed_once):
    model = T.TreeModel(packed_once["boosted"], FEATS, packed_once["data"].edges)
    model.save(spark, str(tmp_path))
    back = T.TreeModel.load(spark, str(tmp_path))
    a, b = (m.score(rows).orderBy("transaction_id").select("prob").collect() for m in (model, back))
    assert a == b and abs(model.importance().sum() - 1) < 1e-9


def test_deep_forest_takes_a_pass_per_level(rows, monkeypatch):
    """Nodes of few rows hold no sums: with room for the sums of a few nodes only, a level of all trees is one pass."""
    monkeypatch.setattr(T, "PASS_BYTES", 10_000)
    data = T.pack(rows, FEATS, "y", max_bins=16)
    model = T.Ensemble("forest", {"n_estimators": 4, "max_depth": 12, "max_features": 0.75})
    assert T.train(data, [model]) <= 12
    assert max(len(t.feat) for t in model.trees) > 40


def test_few_partitions_in_a_pass(rows):
    """A pass writes sums per partition; many small ones are put together."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    assert T.pack(rows.repartition(8 * cores), FEATS, "y", max_bins=16).rows.rdd.getNumPartitions() == cores


def test_boosted_nodes_grown_by_one_task(rows, monkeypatch):
    """Level by level, from the middle on or whole trees at once: the same trees, numbers included, in fewer passes."""
    data = T.pack(rows, FEATS, "y", max_bins=16)
    kinds = [("boosted", {"n_estimators": 3, "max_depth": 5, "subsample": 0.8, "colsample_bytree": 0.75, "min_child_weight": 2.0, "reg_alpha": 0.1}, f) for f in (None, 2)]
    found = []
    for most, passes in ((1 << 17, 3), (120, 14), (0, 15)):
        monkeypatch.setattr(T, "GROW_ROWS", most)
        models = [T.Ensemble(*k) for k in kinds]
        assert T.train(data, models) <= passes
        found.append([m.trees for m in models])
    assert found[0] == found[1] == found[2] and max(len(t.feat) for t in found[0][0]) > 15
    monkeypatch.setattr(T, "GROW_ROWS", 1 << 17)
    monkeypatch.setattr(T, "SENT_BYTES", 0)             # no room for rows: sums
    models = [T.Ensemble(*k) for k in kinds]
    assert T.train(data, models) > 3 and [m.trees for m in models] == found[0]


def test_features_counted_jointly():
    """Sums of joined features, taken apart, are each feature's own sums; large and small nodes count alike."""
    rng = np.random.default_rng(3)
    sizes, n = np.array([24, 2, 64, 1, 52, 3] + [2] * 14), 3 * T.BLOCK
    bins = np.stack([rng.integers(0, s, n) for s in sizes], axis=1).astype(np.uint8)
    slot, weight = rng.integers(0, 3, n), rng.integers(-1000, 1000, n).astype(float)
    groups = T._joined(sizes, 512)
    assert sorted(f for g in groups for f in g) == list(range(len(sizes))) and len(groups) < 8
    for group, code in zip(groups, T._codes(np.ascontiguousarray(bins.T), sizes, groups), strict=True):
        width = int(np.prod(sizes[group]))
        for f, own in T._apart(np.bincount(slot * width + code, weight, 3 * width), sizes, group, 3):
            assert (own.ravel() == np.bincount(slot * sizes[f] + bins[:, f], weight, 3 * sizes[f])).all()
    slopes = np.stack([rng.integers(-T.UNIT, T.UNIT, n), rng.integers(1, T.UNIT, n)], axis=1).astype(np.int64)
    grown = list(T.grow_boosted(bins, slopes, sizes, np.arange(len(sizes)), T.BOOSTED_DEFAULTS, 3))
    _, f, cut, gain, inside, total = grown[0]
    left = bins[:, f] <= cut
    assert (total * T.UNIT == slopes.sum(axis=0)).all() and (inside * T.UNIT == slopes[left].sum(axis=0)).all()
    plain = [np.bincount(bins[:, j], slopes[:, c].astype(float), sizes[j]) for c in range(2) for j in range(len(sizes))]
    assert T.boosted_split(np.concatenate(plain).reshape(2, -1).astype(np.int64), sizes, np.arange(len(sizes)), T.BOOSTED_DEFAULTS)[:3] == (f, cut, gain)


def test_a_pass_reads_blocks(spark):
    """Rows in work are stored as blocks, not one table row each, and come back as they were."""
    n = 3000
    rows = spark.range(n).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 7).cast("double").alias("a"))
    data = T.pack(rows, ["a"], "y", id_col="id")
    job = T._Job(data, [T.Ensemble("boosted", {"n_estimators": 1})])
    stored = job.rows.toArrow()
    assert 0 < stored.num_rows <= data.rows.rdd.getNumPartitions()
    back = [b for b in T._from_blocks(iter(stored.to_batches()), 1, 1)]
    assert sorted(np.concatenate([b[1] for b in back]).tolist()) == list(range(n))
    for _, ids, label, _, bins, margins in back:
        assert (label == (ids % 3 == 0)).all() and (bins[:, 0] == ids % 7).all() and not margins.any()


def test_small_forest_nodes_split_together():
    """Nodes split in one go get the split each would get alone; features it may not use are left out."""
    rng = np.random.default_rng(8)
    sizes, nodes, n = np.array([24, 2, 1, 64, 7]), 5, 900
    bins = np.stack([rng.integers(0, s, n) for s in sizes], axis=1).astype(np.uint8)
    last = (4 * rng.integers(1, 4, n) + rng.integers(0, 3, n)).astype(np.uint8)[:, None]        # draws and class, 2 for none
    rows, node = np.concatenate([bins, last], axis=1), rng.integers(0, nodes - 1, n)
    node[:3] = nodes - 1                            # too few to be split
    allowed = rng.random((nodes, len(sizes))) < 0.6
    allowed[:, 0] |= ~allowed.any(axis=1)
    p = T.FOREST_DEFAULTS | {"weights": [0.7, 1.9], "min_samples_split": 4, "min_samples_leaf": 3}
    for i, got in enumerate(T.forest_splits(rows, node, nodes, sizes, allowed, p)):
        feats, own = np.flatnonzero(allowed[i]), rows[node == i]
        sums = [np.concatenate([np.bincount(own[:, f], w, sizes[f]) for f in feats]) for w in
                [(own[:, -1] >> 2) * (own[:, -1] & 3 == k) for k in (0, 1)] + [np.ones(len(own))]]
        want = T.forest_split(np.array(sums).astype(np.int64), sizes[feats], feats, p)
        assert got[:3] == want[:3] and (got[3] == want[3]).all() and (got[4] == want[4]).all() and (got[0] < 0) == (i == nodes - 1)
