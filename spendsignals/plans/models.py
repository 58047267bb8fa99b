"""Model preparation, training, scoring and attribution (reference steps 3-6, 8, 9): M1-M12, M14, P29, S5, E1, E2.

Everything trains on Spark DataFrames: forests, boosted trees and their search with ``operators.trees``, the other
models with MLlib; seeds are fixed at the reference's 42. The tree-path attribution runs Python per Arrow batch
inside ``mapInArrow``, with the flattened trees (bounded by the model size) in the closure.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kmeans, shapley, trees
from ..operators.select import order_rows, part_of
from ..operators.trees import TreeModel

SEED = 42


# ------------------------------------------------------------------------------------------ splits
def hash_key(id_col: str, seed: int = SEED):
    """Reproducible pseudo-random key: first 15 hex digits of md5('seed-id') as a long (same in DuckDB)."""
    h = F.md5(F.concat(F.lit(str(seed)), F.lit("-"), F.col(id_col).cast("string")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def stratified_split(df: DataFrame, label: str = "impulse_label", test_frac: float = 0.2, seed: int = SEED,
                     id_col: str = "transaction_id") -> DataFrame:
    """M1: ``split`` = 'test' for ceil(test_frac * n_label) rows of each label (lowest hash key),
    'train' otherwise. One hash value per label is the cutoff (radix selection): the split itself is a filter."""
    key, y = hash_key(id_col, seed), F.col(label)
    cuts = order_rows(df, [key], lambda g, n: [math.ceil(n[g] * test_frac) - 1], y)
    return df.withColumn("split", F.when(part_of([key], cuts, y) == 0, "test").otherwise("train"))


def stratified_folds(df: DataFrame, label: str = "impulse_label", k: int = 5, seed: int = SEED,
                     id_col: str = "transaction_id") -> DataFrame:
    """M2 folds: shuffled stratified k-fold. The rows of a label in hash order fill fold 0, then fold 1, ...; sizes differ
    by one at most, the larger ones first. k - 1 hash values per label are the cutoffs."""
    key, y = hash_key(id_col, seed), F.col(label)
    cuts = order_rows(df, [key], lambda g, n: [n[g] // k * (i + 1) + min(i + 1, n[g] % k) - 1 for i in range(k - 1)], y)
    return df.withColumn("fold", part_of([key], cuts, y))


# ------------------------------------------------------------------------------------------ features
def assembler(feats) -> VectorAssembler:
    return VectorAssembler(inputCols=list(feats), outputCol="features", handleInvalid="keep")


def scaler() -> StandardScaler:
    """M3: standardise (sample std; sklearn divides by the population std, a factor sqrt(n/(n-1)))."""
    return StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)


def balanced_weights(df: DataFrame, label: str = "impulse_label", out: str = "w") -> DataFrame:
    """Class weights n / (2 n_c) as a column (one aggregate, broadcast)."""
    c = df.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(label) == 1).alias("_p"))
    j = df.crossJoin(F.broadcast(c))
    w = F.when(F.col(label) == 1, F.col("_n") / (2.0 * F.col("_p"))).otherwise(
        F.col("_n") / (2.0 * (F.col("_n") - F.col("_p"))))
    return j.withColumn(out, w).drop("_n", "_p")


def positive_weight(df: DataFrame, label: str = "impulse_label", out: str = "w") -> DataFrame:
    """scale_pos_weight = n_neg / n_pos on positives, 1 on negatives."""
    c = df.agg(F.count_if(F.col(label) == 0).alias("_neg"), F.count_if(F.col(label) == 1).alias("_pos"))
    j = df.crossJoin(F.broadcast(c))
    return j.withColumn(out, F.when(F.col(label) == 1, F.col("_neg") / F.col("_pos")).otherwise(1.0)).drop("_neg", "_pos")


# ------------------------------------------------------------------------------------------ estimators
def logistic(C: float = 0.1, label: str = "impulse_label") -> LogisticRegression:
    """M4: sklearn's C * sum(w * loss) + |b|^2 / 2 equals MLlib's mean weighted loss + regParam |b|^2 / 2
    with regParam = 1 / (C * sum(w)); balanced weights sum to n, by which ``fit`` divides."""
    return LogisticRegression(featuresCol="scaled", labelCol=label, weightCol="w", regParam=1.0 / C,
                              elasticNetParam=0.0, standardization=False, maxIter=1000)


@dataclass(frozen=True)
class TreeSpec:
    """M5 / M6: an untrained tree ensemble (``operators.trees``), all searched parameters included."""
    kind: str
    params: dict


def forest(params: dict) -> TreeSpec:
    """M5: balanced forest; parameters of ``RF_SPACE``."""
    return TreeSpec("forest", params)


def boosted(params: dict) -> TreeSpec:
    """M6: second-order boosted trees, positives weighted by the class ratio; parameters of ``GBT_SPACE``."""
    return TreeSpec("boosted", params)


def with_class_weights(df: DataFrame, estimator) -> DataFrame:
    """Class weights of the rows being fitted: positives weighted for boosted trees, balanced otherwise."""
    if not estimator.isSet(estimator.weightCol):
        return df
    add = positive_weight if isinstance(estimator, GBTClassifier) else balanced_weights
    return add(df, estimator.getLabelCol(), estimator.getWeightCol())


def fit_trees(df: DataFrame | trees.Packed, feats, specs, label: str, hold_out=None) -> list[TreeModel]:
    """Train ensembles over the same rows (packed already, or packed here) in common passes; ``hold_out`` lists the fold
    each one does not see."""
    data = df if isinstance(df, trees.Packed) else trees.pack(df, feats, label)
    models = [trees.Ensemble(s.kind, s.params, f) for s, f in zip(specs, hold_out or [None] * len(specs), strict=True)]
    trees.train(data, models)
    return [TreeModel(m, data.feats, data.edges) for m in models]


def fit(df: DataFrame, feats, estimator, scale: bool = False, label: str = "impulse_label") -> PipelineModel | TreeModel:
    """Fit on ``df`` with class weights (and, for the logistic model, the strength of its penalty) taken
    from these rows alone."""
    if isinstance(estimator, TreeSpec):
        return fit_trees(df, feats, [estimator], label)[0]
    if isinstance(estimator, LogisticRegression):
        estimator = estimator.copy({estimator.regParam: estimator.getRegParam() / max(1, df.count())})
    stages = [assembler(feats)] + ([scaler()] if scale else []) + [estimator]
    return Pipeline(stages=stages).fit(with_class_weights(df, estimator))


def score(model: PipelineModel | TreeModel, df: DataFrame, out: str = "prob") -> DataFrame:
    """M9: positive-class probability column."""
    if isinstance(model, TreeModel):
        return model.score(df, out)
    s = model.transform(df)
    return s.withColumn(out, vector_to_array(F.col("probability"))[1]).drop(
        "features", "scaled", "rawPrediction", "probability", "prediction")


def score_mean(models, df: DataFrame, out: str = "prob") -> DataFrame:
    """M9: mean probability of several fitted models (fold models)."""
    cols = []
    cur = df
    for i, m in enumerate(models):
        cur = score(m, cur, f"_p{i}")
        cols.append(F.col(f"_p{i}"))
    return cur.withColumn(out, sum(cols) / len(cols)).drop(*[f"_p{i}" for i in range(len(models))])


# ------------------------------------------------------------------------------------------ search and CV
# The reference's search ranges (forest, boosted trees); "log" = log-uniform.
RF_SPACE = {"n_estimators": (100, 500, "int"), "max_depth": (4, 20, "int"), "min_samples_split": (2, 20, "int"),
            "min_samples_leaf": (1, 10, "int"), "max_features": (0.3, 0.9, "float")}
GBT_SPACE = {"n_estimators": (100, 600, "int"), "max_depth": (3, 10, "int"), "learning_rate": (0.01, 0.3, "log"),
             "subsample": (0.5, 1.0, "float"), "colsample_bytree": (0.5, 1.0, "float"),
             "reg_alpha": (1e-4, 10.0, "log"), "reg_lambda": (1e-4, 10.0, "log"), "min_child_weight": (1, 10, "int")}


def sample_space(space: dict, n: int, seed: int = SEED) -> list[dict]:
    """M7: seeded random candidates from the reference's ranges (log-uniform where marked)."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        p = {}
        for k, (lo, hi, kind) in space.items():
            if kind == "int":
                p[k] = rnd.randint(lo, hi)
            elif kind == "log":
                p[k] = math.exp(rnd.uniform(math.log(lo), math.log(hi)))
            else:
                p[k] = rnd.uniform(lo, hi)
        out.append(p)
    return out


def search(data: trees.Packed, make, space: dict, n_trials: int = 40, folds: int = 5):
    """M7: candidates sampled from the reference's ranges, each trained on all but one of the even folds and judged
    by the mean exact ROC-AUC of the held-out ones; class weights come from the rows of each fit. All candidates and
    folds grow in common passes. Returns the candidates, the AUC of each, the place of the best and the number of passes."""
    candidates = sample_space(space, n_trials)
    auc, passes = trees.search(data, make({}).kind, candidates, folds)
    return candidates, auc, int(np.argmax(auc)), passes


SIDE_BY_SIDE = 500_000      # most rows of folds that are fitted at the same time


def cross_validate(df: DataFrame, feats, make_estimator, folds: int = 5, label: str = "impulse_label",
                   scale: bool = True, threshold: float = 0.5) -> DataFrame:
    """M2: per fold AUC, F1, precision, recall (held-out fold), computed with the distributed metric
    operators; one row per fold. Held-out rows are scored once; all folds are judged together. Few rows leave cores idle:
    up to ``SIDE_BY_SIDE`` of them the folds are fitted side by side."""
    from ..operators.evaluation import class_report, roc_auc
    from ..session import cut_lineage
    at_once = folds if folds > 1 and df.count() <= SIDE_BY_SIDE else 1
    one = lambda f: fit(df.where(F.col("fold") != f), feats, make_estimator(), scale=scale)
    if at_once > 1:
        with ThreadPool(at_once) as pool:
            models = pool.map(inheritable_thread_target(df.sparkSession)(one), range(folds))
    else:
        models = [one(f) for f in range(folds)]
    scored = None
    for f, m in enumerate(models):
        test = df.where(F.col("fold") == f)
        s = score(m, test).select(F.lit(f"fold{f}").alias("model"), F.col(label).alias("label"), "prob",
                                  (F.col("prob") >= threshold).cast("int").alias("pred"))
        scored = s if scored is None else scored.unionByName(s)
    scored = cut_lineage(scored)            # read by the ranks and by the report
    rep = class_report(scored).select("model", F.col("f1_1").alias("f1"), F.col("precision_1").alias("precision"),
                                      F.col("recall_1").alias("recall"))
    return roc_auc(scored).join(rep, "model").withColumn("fold", F.substring("model", 5, 9).cast("int"))


def fit_calibrated(df: DataFrame, feats, make_estimator, folds: int = 3, label: str = "impulse_label",
                   scale: bool = False):
    """M8: for each of ``folds`` folds, fit on the others and fit an isotonic map on the held-out
    fold's scores; returns the (model, isotonic) pairs. Tree ensembles of all folds grow together."""
    from ..operators.isotonic import fit_isotonic
    pairs, ready = [], None
    if isinstance(make_estimator(), TreeSpec):
        ready = fit_trees(df, feats, [make_estimator()] * folds, label, list(range(folds)))
    for f in range(folds):
        train, hold = df.where(F.col("fold") != f), df.where(F.col("fold") == f)
        m = ready[f] if ready else fit(train, feats, make_estimator(), scale=scale)
        pairs.append((m, fit_isotonic(score(m, hold, "raw_prob"), "raw_prob", label)))
    return pairs


def score_calibrated(pairs, df: DataFrame, out: str = "prob") -> DataFrame:
    """M8/M9: mean over folds of isotonic(model(x))."""
    cur = df
    for i, (m, iso) in enumerate(pairs):
        cur = iso.transform(score(m, cur, "raw_prob"), "raw_prob", f"_c{i}").drop("raw_prob")
    return cur.withColumn(out, sum(F.col(f"_c{i}") for i in range(len(pairs))) / len(pairs)).drop(
        *[f"_c{i}" for i in range(len(pairs))])


# ------------------------------------------------------------------------------------------ model tables
def odds_ratios(spark: SparkSession, model: PipelineModel, feats) -> DataFrame:
    """Coefficient and exp(coefficient) per feature of the logistic stage."""
    lr = model.stages[-1]
    rows = [(f, float(c)) for f, c in zip(feats, lr.coefficients.toArray())]
    df = spark.createDataFrame(rows, "feature string, coefficient double")
    return df.withColumn("odds_ratio", F.exp("coefficient"))


def importance(spark: SparkSession, model: TreeModel, feats, model_name: str = "model") -> DataFrame:
    """Model-native importance per feature with its ordinal rank."""
    imp = model.importance()
    from ..operators.explain import ordinal_ranks
    df = spark.createDataFrame([(model_name, f, float(v)) for f, v in zip(feats, imp)],
                               "model string, feature string, importance double")
    return ordinal_ranks(df, "importance", "rank")


def save_model(model: PipelineModel | TreeModel, path: str) -> None:
    """S5."""
    if isinstance(model, TreeModel):
        model.save(SparkSession.active(), path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str, kind: str = "pipeline") -> PipelineModel | TreeModel:
    """``kind`` is "pipeline" or "trees"."""
    return TreeModel.load(SparkSession.active(), path) if kind == "trees" else PipelineModel.load(path)


# ------------------------------------------------------------------------------------------ segmentation
def kmeans_sweep(df: DataFrame, feats, ks=range(2, 11), restarts: int = 10) -> tuple[DataFrame, dict]:
    """For each k the lowest-cost model over ``restarts`` seeds, its cost and silhouette; best k by
    silhouette, elbow from the second difference of the costs (index + 1). All fits share their scans."""
    ks = list(ks)
    fits = kmeans.train(df, feats, ks, restarts)
    best = {k: min((m for m in fits if m.k == k), key=lambda m: m.cost) for k in ks}
    prep = Pipeline(stages=[assembler(feats), scaler()]).fit(df)
    ev = ClusteringEvaluator(featuresCol="scaled", predictionCol="cluster", metricName="silhouette", distanceMeasure="squaredEuclidean")
    rows = [(k, float(best[k].cost), float(ev.evaluate(prep.transform(best[k].assign(df))))) for k in ks]
    costs = [r[1] for r in rows]
    accel = np.diff(np.diff(costs)) if len(costs) >= 3 else np.array([0.0])
    elbow = ks[int(np.argmax(accel)) + 1] if len(costs) >= 3 else ks[0]
    best_k = rows[int(np.argmax([r[2] for r in rows]))][0]
    table = df.sparkSession.createDataFrame(rows, "k int, cost double, silhouette double")
    return table, {"best_k": best_k, "elbow_k": elbow, "models": best}


def final_kmeans(df: DataFrame, feats, k: int, restarts: int = 20) -> kmeans.KMeansModel:
    """The lowest-cost model of ``restarts`` seeds at the chosen k."""
    return min(kmeans.train(df, feats, [k], restarts), key=lambda m: m.cost)


def fit_pca(df: DataFrame, feats) -> PipelineModel:
    """Standardise, then the first two principal components."""
    return Pipeline(stages=[assembler(feats), scaler(), PCA(k=2, inputCol="scaled", outputCol="pcs")]).fit(df)


def in_plane(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``pc1``, ``pc2`` of each row under a fitted model."""
    return model.transform(df).withColumn("_a", vector_to_array("pcs")).withColumns(
        {"pc1": F.col("_a")[0], "pc2": F.col("_a")[1]}).drop("_a", "pcs", "features", "scaled")


def pca_2d(df: DataFrame, feats) -> tuple[DataFrame, list[float]]:
    """First two principal components of the standardised features and explained variance."""
    model = fit_pca(df, feats)
    return in_plane(model, df), [float(v) for v in model.stages[-1].explainedVariance.toArray()]


def next_txn_model(label: str = "next_impulse") -> GBTClassifier:
    """200 trees, depth 4, rate 0.05, subsample 0.8, leaf 10."""
    return GBTClassifier(featuresCol="scaled", labelCol=label, maxIter=200, maxDepth=4, stepSize=0.05,
                         subsamplingRate=0.8, minInstancesPerNode=10, seed=SEED)


# ------------------------------------------------------------------------------------------ attribution
def logistic_attribution(model: PipelineModel, df: DataFrame, feats, id_col: str = "transaction_id",
                         name: str = "logistic") -> DataFrame:
    """E2, linear model: coef_j * (z_j - mean z_j) on the standardised features, long table; the
    'bias' row holds intercept + sum coef_j * mean z_j so that the values add up to the margin."""
    lr = model.stages[-1]
    coef = [float(c) for c in lr.coefficients.toArray()]
    z = model.transform(df).select(id_col, vector_to_array("scaled").alias("_z"))
    means = z.agg(*[F.avg(F.col("_z")[i]).alias(f"_m{i}") for i in range(len(feats))])
    j = z.crossJoin(F.broadcast(means))
    parts = [F.struct(F.lit(f).alias("feature"), (F.lit(coef[i]) * (F.col("_z")[i] - F.col(f"_m{i}"))).alias("value"))
             for i, f in enumerate(feats)]
    bias = F.lit(float(lr.intercept)) + sum(F.lit(coef[i]) * F.col(f"_m{i}") for i in range(len(feats)))
    parts.append(F.struct(F.lit("bias").alias("feature"), bias.alias("value")))
    return j.select(id_col, F.explode(F.array(*parts)).alias("_p")).select(
        id_col, F.lit(name).alias("model"), "_p.feature", "_p.value")


def leaf_paths(tree: dict) -> list[tuple[float, dict[int, tuple[float, float, float]]]]:
    """(output, {feature: (low, high, share)}) per leaf: the row goes there if low < x <= high for every feature
    on its path; share is the part of the training weight that follows the path at the feature's splits."""
    out, todo = [], [(0, {})]
    while todo:
        i, path = todo.pop()
        f = tree["feat"][i]
        if f < 0:
            out.append((tree["val"][i], path))
            continue
        low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
        t = tree["thr"][i]
        for child, lo, hi in ((tree["left"][i], low, min(high, t)), (tree["right"][i], max(low, t), high)):
            todo.append((child, {**path, f: (lo, hi, share * tree["cover"][child] / tree["cover"][i])}))
    return out


def shapley_values(paths, x: np.ndarray, n_features: int) -> np.ndarray:
    """Exact Shapley values (rows x features, last column the expected output) of the sum of leaves, where
    features outside a coalition follow the training weights. Per leaf a feature either lets the row through
    (1 or 0) or counts with its share; the sum over coalitions is a product of linear polynomials whose
    coefficient k belongs to coalitions of k features. The product is built once per leaf and each feature divided
    out of it, once for all rows that pass the same features: a row's pattern is a whole number, one bit per feature, and
    the rows look their values up, feature by feature."""
    phi, columns = np.zeros((n_features + 1, len(x))), np.ascontiguousarray(x.T)
    for value, path in paths:
        phi[n_features] += value * math.prod(s for _, _, s in path.values())
        if not path or not len(x):
            continue
        codes = [np.zeros(len(x), dtype=np.int64) for _ in range(0, len(path), WORD)]
        for j, (f, (low, high, _)) in enumerate(path.items()):
            passed = columns[f] > low
            if high < math.inf:
                passed &= columns[f] <= high
            codes[j // WORD] |= passed.astype(np.int64) << j % WORD
        patterns, of_row = _patterns(codes, len(path))
        table = value * _path_values(patterns, np.array([s for _, _, s in path.values()]))
        for j, f in enumerate(path):
            phi[f] += np.ascontiguousarray(table[:, j])[of_row]
    return phi.T


WORD = 62       # bits of a pattern in one whole number


def _patterns(codes: list[np.ndarray], m: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct patterns of ``m`` features (patterns x features, 0 or 1) and each row's place among them."""
    if len(codes) > 1:
        distinct, of_row = np.unique(np.stack(codes, axis=1), axis=0, return_inverse=True)
        of_row = of_row.ravel()
    elif 1 << m <= len(codes[0]):               # few features: counted, not sorted
        there = np.bincount(codes[0], minlength=1 << m) > 0
        distinct, of_row = np.flatnonzero(there)[:, None], (np.cumsum(there) - 1)[codes[0]]
    else:
        distinct, of_row = np.unique(codes[0], return_inverse=True)
        distinct = distinct[:, None]
    bits = np.arange(m)
    return (distinct[:, bits // WORD] >> bits % WORD & 1).astype(float), of_row


def _path_values(through: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values of one leaf with output 1 (patterns x features of its path)."""
    n, m = through.shape
    product = np.zeros((n, m + 1))
    product[:, 0] = 1.0
    for j in range(m):
        moved = np.zeros_like(product)
        moved[:, 1:] = product[:, :-1] * through[:, j:j + 1]
        product = product * share[j] + moved
    weight = [math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)]
    # product = (share + through z) * quotient: from the top where the feature lets the row through, else by its share
    quotient, total = np.zeros((n, m)), np.zeros((n, m))
    for k in range(m - 1, -1, -1):
        quotient = product[:, k + 1:k + 2] - share * quotient
        total += weight[k] * quotient
    by_share = (product[:, :m] @ np.array(weight))[:, None] / np.where(share > 0, share, 1.0)
    out = np.where(through > 0, total, by_share)
    for j in np.flatnonzero(share == 0):            # nothing to divide by: the product of the others
        rows = np.flatnonzero(through[:, j] == 0)
        if len(rows):
            rest = np.zeros((len(rows), m))
            rest[:, 0] = 1.0
            for g in range(m):
                if g != j:
                    moved = np.zeros_like(rest)
                    moved[:, 1:] = rest[:, :-1] * through[rows, g:g + 1]
                    rest = rest * share[g] + moved
            out[rows, j] = rest @ np.array(weight)
    return (through - share) * out


def tree_attribution(model: TreeModel, df: DataFrame, feats, id_col: str = "transaction_id",
                     name: str = "boosted") -> DataFrame:
    """E2, tree ensembles: Shapley values of the margin (boosted trees) or of the probability (forest), long
    table; the 'bias' row is the expected output, so a row's values add up to its output. The rows are spread evenly over the
    cores and worked on many at a time (``operators.shapley``); the trees in the closure are bounded by the model."""
    own, edges, nf = model.flattened(), model.edges, len(feats)
    x = df.select(F.col(id_col).cast("long").alias(id_col), trees.matrix(list(feats)).alias("_x"))
    names = pa.array([*feats, "bias"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trees._chunks(batches):
            raw = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, nf)
            bins = np.stack([np.where(raw[:, i] > -np.inf, np.searchsorted(e, raw[:, i], side="left"), -1) for i, e in enumerate(edges)], axis=1)
            phi = shapley.values(own, bins, nf)
            for at in range(0, len(phi), OUT_ROWS):
                part = phi[at:at + OUT_ROWS]
                ids = b.column(0).take(pa.array(np.repeat(np.arange(at, at + len(part)), nf + 1)))
                feature = names.take(pa.array(np.tile(np.arange(nf + 1), len(part))))
                yield pa.RecordBatch.from_arrays([ids, pa.array([name] * len(ids)), feature, pa.array(part.ravel())], names=[id_col, "model", "feature", "value"])

    return x.repartition(df.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, f"{id_col} long, model string, feature string, value double")


OUT_ROWS = 1 << 12      # rows whose values leave a task at a time


def margin(model: TreeModel, df: DataFrame, id_col: str = "transaction_id") -> DataFrame:
    """Raw margin of boosted trees (sum of tree outputs), for the additivity check."""
    return model.score(df, "margin", margin=True).select(id_col, "margin")
