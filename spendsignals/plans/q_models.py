"""Queries for model preparation, training, evaluation and explanation (milestones 6-8).

Trained-model outputs have no SQL oracle (the driver checks rows only; invariants are in tests).
Splits, standardisation and every operator over attribution tables are checked exactly: the latter
run on the deterministic stand-in attribution of FIXTURES section 3.
"""

from __future__ import annotations

import os
import uuid
from functools import cached_property, reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as X
from ..operators import explain as E
from ..operators import trees
from ..operators.features import feature_columns
from ..operators.isotonic import Isotonic
from ..operators.segments import CLUSTER_FEATURES
from ..session import ensure_checkpoint_dir
from . import inputs as I
from . import models as M
from .catalog import register
from .oracle_sql import with_ctes

LABEL = "impulse_label"


class ModelCtx(I.Ctx):
    """Training data: engineered features, 80/20 stratified split, 5 stratified folds on the training
    part. Class weights belong to each fit (``M.fit``)."""

    @cached_property
    def eng(self):
        from ..session import cut_lineage
        return cut_lineage(super().eng)         # read by the cutoffs of split and folds and by every fit and score

    @cached_property
    def feats(self):
        return feature_columns(self.eng)

    @cached_property
    def split(self):
        return M.stratified_split(self.eng, LABEL)      # literal cutoffs: a filter over the stored rows

    @cached_property
    def train(self):
        return M.stratified_folds(self.fit_rows, LABEL)

    @property
    def fit_rows(self):
        """The training rows, for fits without folds."""
        return self.split.where("split = 'train'")

    @cached_property
    def thirds(self):
        """The training rows in three even stratified folds (M8)."""
        return M.stratified_folds(self.fit_rows, LABEL, k=3)

    @cached_property
    def test(self):
        return self.split.where("split = 'test'")

    @cached_property
    def packed(self):
        return trees.pack(self.train, self.feats, LABEL)

    def once(self, what: str, make):
        """``make()``, kept for this session and input: several queries use the same search and the same fits. What is kept
        is of the size of a model."""
        key = (self.spark.sparkContext.applicationId, os.path.abspath(self.sf), what)
        if key not in _KEPT:
            _KEPT[key] = make()
        return _KEPT[key]

    def searched(self, kind: str):
        """M7: (candidates, AUCs, best) of one space over five folds."""
        make, space = (M.forest, M.RF_SPACE) if kind == "forest" else (M.boosted, M.GBT_SPACE)
        return self.once(f"search {kind}", lambda: M.search(self.packed, make, space)[:3])

    def tuned(self, kind: str) -> M.TreeSpec:
        """The winner of the search."""
        candidates, _, best = self.searched(kind)
        return M.TreeSpec(kind, candidates[best])

    def fitted(self, kind: str):
        """M5 / M6: the tuned ensemble on the training rows. A query pays for the search and the fit of the kind it reads."""
        return self.once(f"fit {kind}", lambda: M.fit_trees(self.packed, self.feats, [self.tuned(kind)], LABEL)[0])

    def calibrated(self):
        """M8: the tuned boosted trees with isotonic maps over three even folds."""
        spec = self.tuned("boosted")
        return self.once("calibrated", lambda: M.fit_calibrated(self.thirds, self.feats, lambda: spec, folds=3, label=LABEL))


_KEPT: dict = {}


# ------------------------------------------------------------------------------------------ O: split, scaling
@register("m01_stratified_split", with_ctes("eng") + """SELECT transaction_id,
  CASE WHEN row_number() OVER (PARTITION BY impulse_label ORDER BY substr(md5('42-' || CAST(transaction_id AS VARCHAR)), 1, 15)) - 1
       < ceil(0.2 * count(*) OVER (PARTITION BY impulse_label)) THEN 'test' ELSE 'train' END AS split FROM eng""")
def m01(spark, sf):
    """M1: exact stratified 80/20 split by a seeded md5 key (no global sort)."""
    return M.stratified_split(I.eng(spark, sf), LABEL).select("transaction_id", "split")


_STD = ["spend_zscore", "drawdown_ratio", "user_impulse_rate"]


@register("m03_standardise", with_ctes("eng") + "SELECT transaction_id, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS z_{c}" for c in _STD) + " FROM eng")
def m03(spark, sf):
    """M3: MLlib StandardScaler (mean 0, sample std 1)."""
    e = I.eng(spark, sf)
    model = M.Pipeline(stages=[M.assembler(_STD), M.scaler()]).fit(e)
    z = model.transform(e).withColumn("_z", vector_to_array("scaled"))
    return z.select("transaction_id", *[z["_z"][i].alias(f"z_{c}") for i, c in enumerate(_STD)])


# ------------------------------------------------------------------------------------------ I: training
@register("m02_folds", with_ctes("eng") + """SELECT transaction_id, CAST(CASE WHEN pos < (n // 5 + 1) * (n % 5) THEN pos // (n // 5 + 1)
  ELSE (pos - n % 5) // (n // 5) END AS INT) AS fold FROM (SELECT transaction_id,
  row_number() OVER (PARTITION BY impulse_label ORDER BY substr(md5('42-' || CAST(transaction_id AS VARCHAR)), 1, 15)) - 1 AS pos,
  count(*) OVER (PARTITION BY impulse_label) AS n FROM eng)""")
def m02b(spark, sf):
    """M2: five shuffled stratified folds of all transactions by literal cutoffs of a seeded hash."""
    return M.stratified_folds(I.eng(spark, sf), LABEL).select("transaction_id", "fold")


@register("m02_cross_validate")
def m02(spark, sf):
    """M2: 5-fold stratified CV of the balanced logistic model: AUC, F1, precision, recall per fold."""
    c = ModelCtx(spark, sf)
    return M.cross_validate(c.train, c.feats, M.logistic, folds=5, label=LABEL)


@register("m04_logistic_scores")
def m04(spark, sf):
    """M4 + M9: balanced logistic regression (C = 0.1) on the training split, test-split scores."""
    c = ModelCtx(spark, sf)
    m = M.fit(c.fit_rows, c.feats, M.logistic(), scale=True)
    return M.score(m, c.test).select("transaction_id", LABEL, "prob")


@register("m05_forest_scores")
def m05(spark, sf):
    """M5: balanced random forest with the parameters found by M7, test-split scores."""
    c = ModelCtx(spark, sf)
    m = c.fitted("forest")
    return M.score(m, c.test).select("transaction_id", LABEL, "prob")


@register("m06_boosted_scores")
def m06(spark, sf):
    """M6: boosted trees with positive-class weight and the parameters found by M7, test-split scores."""
    c = ModelCtx(spark, sf)
    m = c.fitted("boosted")
    return M.score(m, c.test).select("transaction_id", LABEL, "prob")


@register("m05_bootstrap_draws", with_ctes("eng") + """, x AS (SELECT transaction_id, tree, (transaction_id % 2147483647 * 48271 + (42 * 7919 + tree * 104729 + 3 * 15485863) % 2147483647) % 2147483647 AS a,
  (42 * 7919 + tree * 104729 + 3 * 15485863) % 2147483647 AS s FROM eng, range(3) t(tree)),
  y AS (SELECT transaction_id, tree, (a * a % 2147483647 * 16807 + a + s) % 2147483647 AS a FROM x),
  z AS (SELECT transaction_id, tree, (a * a % 2147483647 * 48271 + a) % 2147483647 / 2147483647.0::DOUBLE AS u FROM y),
  cdf AS (SELECT k, sum(exp(-1.0) / CASE WHEN k = 0 THEN 1 ELSE factorial(CAST(k AS INT)) END) OVER (ORDER BY k) AS p FROM range(13) r(k))
  SELECT transaction_id, CAST(tree AS INT) AS tree, CAST((SELECT count(*) FROM cdf WHERE p <= u) AS INT) AS drawn FROM z""")
def m05b(spark, sf):
    """M5: how often each transaction is drawn for the first three trees of a forest (Poisson, a function of its id)."""
    rows = I.eng(spark, sf).select("transaction_id")
    drawn = trees.drawn_rows(rows, "transaction_id", range(3))
    return drawn.select("transaction_id", "tree", "drawn")


@register("m07_search")
def m07(spark, sf):
    """M7: seeded random search over both spaces, five even folds, exact held-out AUC; one row per candidate."""
    c = ModelCtx(spark, sf)
    rows = [(kind, i, float(a), i == best) for kind in ("forest", "boosted") for _, auc, best in [c.searched(kind)] for i, a in enumerate(auc)]
    return spark.createDataFrame(rows, "model string, trial int, cv_auc double, is_best boolean")


@register("m08_calibrated")
def m08(spark, sf):
    """M8: 3-fold isotonic calibration of boosted trees; Brier score before and after on the test split."""
    c = ModelCtx(spark, sf)
    pairs = c.calibrated()
    raw = M.score_mean([m for m, _ in pairs], c.test, "raw")
    cal = M.score_calibrated(pairs, raw, "prob")
    return cal.agg(F.avg(F.pow(F.col("raw") - F.col(LABEL), 2)).alias("brier_raw"),
                   F.avg(F.pow(F.col("prob") - F.col(LABEL), 2)).alias("brier_calibrated"),
                   F.count(F.lit(1)).alias("rows"))


@register("m09_score_mean")
def m09(spark, sf):
    """M9: score every transaction with the mean of fold models."""
    c = ModelCtx(spark, sf)
    models = [M.fit(c.train.where(F.col("fold") != f), c.feats, M.logistic(), scale=True) for f in range(5)]
    return M.score_mean(models, c.eng).select("transaction_id", "prob")


def _long(scored, model: str):
    return scored.select("transaction_id", F.lit(model).alias("model"), F.col(LABEL).alias("label"), "prob")


def _three_models(c):
    """Logistic, forest and boosted models with thresholds tuned on a held-out training fold: (scores of the
    test split with ``pred`` at that threshold, thresholds)."""
    fit_on, tune_on = c.train.where("fold <> 0"), c.train.where("fold = 0")
    forest, boosted = M.fit_trees(fit_on, c.feats, [c.tuned("forest"), c.tuned("boosted")], LABEL)
    models = {"logistic": M.fit(fit_on, c.feats, M.logistic(), scale=True), "forest": forest, "boosted": boosted}
    both = lambda rows: reduce(DataFrame.unionByName, (_long(M.score(m, rows), k) for k, m in models.items()))
    best = X.best_threshold(X.threshold_sweep(both(tune_on)))       # one row per model
    s = both(c.test).join(F.broadcast(best.select("model", F.col("best_threshold").alias("_t"))), "model")
    return s.withColumn("pred", (F.col("prob") >= F.col("_t")).cast("int")).drop("_t"), best


@register("x14_model_comparison_trained")
def x14(spark, sf):
    """X12 on the three trained models, each judged on the test split at the threshold tuned on a training fold."""
    return X.compare_models(*_three_models(ModelCtx(spark, sf)))


@register("p29_odds_ratios")
def p29(spark, sf):
    """Odds ratio exp(coef) per standardised feature of the logistic model."""
    c = ModelCtx(spark, sf)
    m = M.fit(c.fit_rows, c.feats, M.logistic(), scale=True)
    return M.odds_ratios(spark, m, c.feats)


@register("e01_importance")
def e01(spark, sf):
    """Feature importances of the forest and the boosted trees with ordinal ranks."""
    c = ModelCtx(spark, sf)
    f, b = c.fitted("forest"), c.fitted("boosted")
    return M.importance(spark, f, c.feats, "forest").unionByName(M.importance(spark, b, c.feats, "boosted"))


@register("s05_save_load")
def s05(spark, sf):
    """Persist and reload the fitted pipeline, its isotonic maps, the tuned thresholds and the split (all in
    the shared checkpoint folder); what comes back gives the same results."""
    c = ModelCtx(spark, sf)
    root = os.path.join(ensure_checkpoint_dir(spark), "models", uuid.uuid4().hex)
    pairs = M.fit_calibrated(c.thirds, c.feats, M.logistic, folds=3, label=LABEL, scale=True)
    for i, (m, iso) in enumerate(pairs):
        M.save_model(m, f"{root}/model-{i}")
        iso.save(spark, f"{root}/isotonic-{i}")
    back = [(M.load_model(f"{root}/model-{i}"), Isotonic.load(spark, f"{root}/isotonic-{i}")) for i in range(len(pairs))]
    c.split.select("transaction_id", "split").write.parquet(f"{root}/split")
    test = c.eng.join(spark.read.parquet(f"{root}/split").where("split = 'test'"), "transaction_id", "left_semi")
    a = M.score_calibrated(pairs, c.test, "p_a").select("transaction_id", "p_a", LABEL)
    X.best_threshold(X.threshold_sweep(_long(a.withColumn("prob", F.col("p_a")), "logistic"))).write.parquet(f"{root}/thresholds")
    limit = spark.read.parquet(f"{root}/thresholds").select("best_threshold")      # one row
    b = M.score_calibrated(back, test, "p_b").select("transaction_id", "p_b")
    return a.join(b, "transaction_id").crossJoin(F.broadcast(limit)).agg(
        F.max(F.abs(F.col("p_a") - F.col("p_b"))).alias("max_abs_diff"), F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("p_b") >= F.col("best_threshold")).alias("predicted"), F.first("best_threshold").alias("threshold"))


@register("s05_bundle")
def s05b(spark, sf):
    """The other models of one bundle, saved and reloaded: boosted trees, next-transaction model, clusters
    and plane of the users. One row per model: the largest difference of its outputs before and after."""
    from ..operators.kmeans import KMeansModel
    from ..operators.nexttxn import NEXT_FEATURES, time_split
    from ..session import cut_lineage
    c = ModelCtx(spark, sf, shared=True)
    root = os.path.join(ensure_checkpoint_dir(spark), "models", uuid.uuid4().hex)
    trees_a = c.fitted("boosted")
    M.save_model(trees_a, f"{root}/boosted")
    train, _, _ = time_split(cut_lineage(c.next_dataset.na.fill(0, NEXT_FEATURES)), 0.8)
    next_a = M.fit(train, NEXT_FEATURES, M.next_txn_model(), scale=True)
    M.save_model(next_a, f"{root}/next")
    users = _users(spark, sf)
    clusters_a = M.final_kmeans(users, CLUSTER_FEATURES, 4, restarts=1)
    clusters_a.save(spark, f"{root}/clusters")
    plane_a = M.fit_pca(users, CLUSTER_FEATURES)
    M.save_model(plane_a, f"{root}/plane")
    trees_b, next_b = M.load_model(f"{root}/boosted", "trees"), M.load_model(f"{root}/next")
    clusters_b, plane_b = KMeansModel.load(spark, f"{root}/clusters"), M.load_model(f"{root}/plane")

    def compare(name, a, b, key, column):
        pairs = a.select(key, F.col(column).cast("double").alias("_a")).join(b.select(key, F.col(column).cast("double").alias("_b")), key)
        return pairs.agg(F.lit(name).alias("model"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_abs_diff"), F.count(F.lit(1)).alias("rows"))

    return reduce(DataFrame.unionByName, [
        compare("boosted", M.score(trees_a, c.test), M.score(trees_b, c.test), "transaction_id", "prob"),
        compare("next_txn", M.score(next_a, train), M.score(next_b, train), "transaction_id", "prob"),
        compare("clusters", clusters_a.assign(users), clusters_b.assign(users), "user_id", "cluster"),
        compare("plane", M.in_plane(plane_a, users), M.in_plane(plane_b, users), "user_id", "pc1")])


@register("e02_attribution_logistic")
def e02a(spark, sf):
    """Closed-form attribution of the logistic model (long table incl. bias row)."""
    c = ModelCtx(spark, sf)
    m = M.fit(c.fit_rows, c.feats, M.logistic(), scale=True)
    return M.logistic_attribution(m, c.test, c.feats)


@register("e02_attribution_boosted")
def e02b(spark, sf):
    """Shapley values of boosted trees via mapInPandas; values add up to the margin."""
    c = ModelCtx(spark, sf)
    return M.tree_attribution(c.fitted("boosted"), c.test, c.feats)


def _both_attributions(spark, sf):
    """Shapley values of the test rows under the forest and the boosted trees, stored once."""
    from ..session import cut_lineage
    c = ModelCtx(spark, sf)
    return c, cut_lineage(M.tree_attribution(c.fitted("forest"), c.test, c.feats, name="forest").unionByName(
        M.tree_attribution(c.fitted("boosted"), c.test, c.feats)).where("feature <> 'bias'"))


@register("e03_global_attribution_trained")
def e03b(spark, sf):
    """E2 + E3 on the trained ensembles: features by mean |Shapley value| per model, top 15."""
    return E.global_attribution(_both_attributions(spark, sf)[1], 15)


@register("e04_dependence_trained")
def e04b(spark, sf):
    """E4 on the boosted trees: the two strongest features with the third as colour."""
    c, attr = _both_attributions(spark, sf)
    return E.dependence(attr.where("model = 'boosted'"), c.test)


@register("e06_rank_agreement_trained")
def e06b(spark, sf):
    """E6 on two models: ranks of mean |Shapley value| in the forest and the boosted trees, top 10."""
    mean = E.mean_abs_attribution(_both_attributions(spark, sf)[1])
    side = lambda k: mean.where(F.col("model") == k).select("feature", F.col("mean_abs_value").alias("importance"))
    return E.rank_agreement(side("forest"), side("boosted"), 10)


def _next_model(c):
    """M13 + M14: (train, test, model) of the next-transaction set at the 0.8 quantile of time."""
    from ..operators.nexttxn import NEXT_FEATURES, time_split
    from ..session import cut_lineage
    train, test, _ = time_split(cut_lineage(c.next_dataset.na.fill(0, NEXT_FEATURES)), 0.8)      # read by every stage of the fit
    return train, test, M.fit(train, NEXT_FEATURES, M.next_txn_model(), scale=True)


@register("m14_next_txn_model")
def m14(spark, sf):
    """M14 + M13: next-transaction boosted model on the time-split training rows; test AUC."""
    _, test, m = _next_model(I.Ctx(spark, sf, shared=True))
    s = M.score(m, test).select("transaction_id", F.lit("next_txn").alias("model"),
                                F.col("next_impulse").alias("label"), "prob",
                                (F.col("prob") >= 0.5).cast("int").alias("pred"))
    return X.roc_auc(s).join(X.class_report(s).select("model", "f1_1", "accuracy"), "model")


@register("m14_next_txn_folds")
def m14b(spark, sf):
    """M14 + M15: AUC, F1, precision and recall of the next-transaction model over the unshuffled folds of its
    training rows."""
    from ..operators.nexttxn import NEXT_FEATURES, block_folds, time_split
    from ..session import cut_lineage
    ds = cut_lineage(I.Ctx(spark, sf, shared=True).next_dataset.na.fill(0, NEXT_FEATURES))
    train, _, _ = time_split(ds, 0.8)
    folds = cut_lineage(block_folds(train))
    return M.cross_validate(folds, NEXT_FEATURES, M.next_txn_model, folds=5, label="next_impulse")


class TrainedCtx(ModelCtx):
    """The report chain on trained parts: M8's calibrated probabilities, M11's clusters, M14's next-impulse model."""

    def __init__(self, spark, sf):
        super().__init__(spark, sf, shared=True)

    @cached_property
    def scored(self):
        from ..operators.risk import score_transactions
        from ..session import cut_lineage
        p = M.score_calibrated(self.calibrated(), self.eng.drop("impulse_prob"), "impulse_prob")
        return cut_lineage(score_transactions(p))

    @cached_property
    def segmented(self):
        from ..operators.segments import assign_persona, dominant_signal
        from ..session import cut_lineage
        return cut_lineage(dominant_signal(assign_persona(_clustered(cut_lineage(self.profile)))))     # read by every fit

    @cached_property
    def at_risk(self):
        """The next-transaction model on each user's newest row."""
        from ..operators.nexttxn import NEXT_FEATURES, at_risk_users, attach_user
        _, _, m = _next_model(self)
        newest = attach_user(self.next_features.where(F.col("next_impulse").isNull()), self.segmented).na.fill(0, NEXT_FEATURES)
        return at_risk_users(M.score(m, newest, "next_impulse_prob"), self.segmented)


@register("trained_user_risk")
def trained_user_risk(spark, sf):
    """A6-A9, M11, P21, P22 on the calibrated model's probabilities."""
    return TrainedCtx(spark, sf).segmented.select(
        "user_id", "mean_impulse_prob", "recency_weighted_prob", "risk_score", "risk_tier", "cluster", "persona", "dominant_signal")


@register("trained_nudges")
def trained_nudges(spark, sf):
    """M17, P20, P23-P26 with the next-transaction model: one alert and nudge per user."""
    return TrainedCtx(spark, sf).nudged.select(
        "user_id", "next_impulse_prob", "alert_level", "risk_score", "risk_tier", "persona", "dominant_signal", "urgency", "full_nudge")


# ------------------------------------------------------------------------------------------ segmentation
def _users(spark, sf):
    from ..session import cut_lineage
    return cut_lineage(I.profile(spark, sf).na.fill(0.0, CLUSTER_FEATURES))     # read by every fit


def _clustered(profile):
    """M10 + M11: best k of the sweep (ten restarts each), then the best of twenty restarts at that k."""
    filled = profile.na.fill(0.0, CLUSTER_FEATURES)
    _, info = M.kmeans_sweep(filled, CLUSTER_FEATURES)
    ids = M.final_kmeans(filled, CLUSTER_FEATURES, info["best_k"]).assign(filled).select("user_id", "cluster")
    return profile.join(ids, "user_id")


@register("m10_kmeans_sweep")
def m10(spark, sf):
    """K-means k = 2..10 on standardised user signals: cost and silhouette per k."""
    table, info = M.kmeans_sweep(_users(spark, sf), CLUSTER_FEATURES)
    return table.withColumns({"is_best_silhouette": F.col("k") == info["best_k"],
                              "is_elbow": F.col("k") == info["elbow_k"]})


@register("m11_assign_clusters")
def m11(spark, sf):
    """Final clusters at the best-silhouette k."""
    return _clustered(_users(spark, sf)).select("user_id", "cluster")


_GIVEN = {"pred_impulse_rate": (0.1, 0.3, 0.6), "late_night_rate": (0.1, 0.2, 0.4), "weekend_rate": (0.2, 0.3, 0.5)}


@register("m11_assign_given", with_ctes("prof") + "SELECT user_id, CAST(CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS INT) AS cluster FROM (SELECT user_id, "
          + ", ".join(" + ".join(f"power({c} - {v[i]}, 2)" for c, v in _GIVEN.items()) + f" AS d{i}" for i in range(3)) + " FROM prof)")
def m11b(spark, sf):
    """Every user to the nearest of three given centres (an expression, no model fit)."""
    from ..operators.kmeans import nearest_of
    users = I.profile(spark, sf)
    return users.select("user_id", nearest_of([F.col(c) for c in _GIVEN], [list(c) for c in zip(*_GIVEN.values(), strict=True)]).alias("cluster"))


@register("m12_pca")
def m12(spark, sf):
    """2-D PCA of the standardised user signals with explained variance."""
    out, ev = M.pca_2d(_users(spark, sf), CLUSTER_FEATURES)
    return out.select("user_id", "pc1", "pc2", F.lit(ev[0]).alias("explained_pc1"), F.lit(ev[1]).alias("explained_pc2"))


@register("a23_cluster_centroids")
def a23b(spark, sf):
    """Size, mean risk score and centre of every trained cluster in the plane of the first two components."""
    users = _clustered(_users(spark, sf))
    out, _ = M.pca_2d(users, CLUSTER_FEATURES)
    return out.groupBy("cluster").agg(F.count("*").alias("user_count"), F.avg("risk_score").alias("avg_risk_score"),
                                      F.avg("pc1").alias("centroid_pc1"), F.avg("pc2").alias("centroid_pc2"))


# ------------------------------------------------------------------------------------------ O*: attribution tables
_F = E.STANDIN_FEATURES
ATTR_CTE = ", attr AS (SELECT transaction_id, 'centered' AS model, feature, value FROM (SELECT transaction_id, " + \
    ", ".join(f"CAST({c} - avg({c}) OVER () AS DOUBLE) AS {c}" for c in _F) + \
    " FROM eng) UNPIVOT (value FOR feature IN (" + ", ".join(_F) + ")))," + \
    " mabs AS (SELECT model, feature, avg(abs(value)) AS mean_abs_value FROM attr GROUP BY model, feature)\n"


def asql(select, doubles=()):
    body = select
    if doubles:
        body = "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in doubles) + f") FROM ({select}) q"
    return with_ctes("eng").rstrip("\n") + ATTR_CTE + body


def _attr(spark, sf):
    return E.centered_attribution(I.eng(spark, sf))


@register("a24_mean_abs_attribution", asql("SELECT * FROM mabs", ["mean_abs_value"]))
def a24(spark, sf):
    """Mean |attribution| per feature."""
    return E.mean_abs_attribution(_attr(spark, sf))


@register("e03_global_attribution", asql(
    "SELECT model, feature, mean_abs_value, CAST(row_number() OVER (PARTITION BY model ORDER BY mean_abs_value DESC, "
    "feature) AS INT) AS rank FROM mabs QUALIFY rank <= 3", ["mean_abs_value"]))
def e03(spark, sf):
    """Top features by mean |attribution| (top 3 of the five stand-in features)."""
    return E.global_attribution(_attr(spark, sf), 3)


@register("a25_share_of_max", asql(
    "SELECT model, feature, mean_abs_value, mean_abs_value / max(mean_abs_value) OVER (PARTITION BY model) * 100 "
    "AS pct_of_max FROM mabs", ["mean_abs_value", "pct_of_max"]))
def a25(spark, sf):
    """Attribution bar length as a percentage of the largest."""
    return E.share_of_max(E.mean_abs_attribution(_attr(spark, sf)), "mean_abs_value")


@register("e04_dependence", asql(
    "SELECT a.transaction_id, a.model, a.feature, a.value, CASE a.feature WHEN 'category_impulse_risk' THEN "
    "e.category_impulse_risk ELSE e.spend_to_salary_ratio END AS feature_value, e.drawdown_ratio AS colour_value, "
    "'drawdown_ratio' AS colour_feature FROM attr a JOIN eng e USING (transaction_id) "
    "WHERE a.feature IN ('category_impulse_risk', 'spend_to_salary_ratio')",
    ["value", "feature_value", "colour_value"]))
def e04(spark, sf):
    """Dependence rows for two features with a third as colour."""
    return _dependence_fixed(spark, sf)


def _dependence_fixed(spark, sf):
    e = I.eng(spark, sf)
    attr = _attr(spark, sf)
    from ..operators.stats import unpivot
    show = ["category_impulse_risk", "spend_to_salary_ratio"]
    longv = unpivot(e.select("transaction_id", *show, "drawdown_ratio"), show,
                    keep=["transaction_id", "drawdown_ratio"]).withColumnRenamed("value", "feature_value") \
        .withColumnRenamed("drawdown_ratio", "colour_value")
    return attr.where(F.col("feature").isin(show)).join(longv, ["transaction_id", "feature"]).withColumn(
        "colour_feature", F.lit("drawdown_ratio"))


@register("e05_explain_cases", asql(
    "SELECT model, transaction_id, \"case\", feature, value, CAST(row_number() OVER (PARTITION BY model, transaction_id, \"case\" "
    "ORDER BY abs(value) DESC, feature) AS INT) AS rank FROM attr JOIN ("
    "SELECT min(transaction_id) AS transaction_id, 'first_hit' AS \"case\" FROM eng WHERE impulse_label = 1 AND impulse_prob >= 0.7 "
    "UNION ALL SELECT min(transaction_id), 'first_miss' FROM eng WHERE impulse_label = 1 AND impulse_prob < 0.7) USING (transaction_id) "
    "QUALIFY rank <= 12", ["value"]))
def e05(spark, sf):
    """E5: largest attributions (at most 12) of the first hit and the first miss."""
    hit = F.col("impulse_prob") >= 0.7
    ids = (I.eng(spark, sf).where(F.col(LABEL) == 1).groupBy(F.when(hit, "first_hit").otherwise("first_miss").alias("case"))
           .agg(F.min("transaction_id").alias("transaction_id")).select(F.lit("centered").alias("model"), "transaction_id", "case"))
    return E.explain_cases(_attr(spark, sf), ids, 12)


@register("e06_rank_agreement", asql(
    "SELECT feature, rank_a, importance_a, rank_b, importance_b, CAST(abs(rank_a - rank_b) AS INT) AS rank_diff FROM "
    "(SELECT feature, mean_abs_value AS importance_a, CAST(row_number() OVER (ORDER BY mean_abs_value DESC, feature) AS INT)"
    " AS rank_a FROM mabs) JOIN (SELECT feature, max(abs(value)) AS importance_b, "
    " CAST(row_number() OVER (ORDER BY max(abs(value)) DESC, feature) AS INT) AS rank_b FROM attr GROUP BY feature) "
    "USING (feature)",
    ["importance_a", "importance_b"]))
def e06(spark, sf):
    """E6 (+ J2, W12): rank agreement of mean |attribution| against max |attribution|."""
    attr = _attr(spark, sf)
    a = E.mean_abs_attribution(attr).select("feature", F.col("mean_abs_value").alias("importance"))
    b = attr.groupBy("feature").agg(F.max(F.abs("value")).alias("importance"))
    return E.rank_agreement(a, b, 10)
