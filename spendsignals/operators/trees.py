"""Histogram trees on DataFrames: second-order boosting (M6), forests (M5), and many of either in one scan (M7, M8).

Rows are stored once with their features as bin numbers. A pass over them grows every tree in work by one level: each
task sums gradients and hessians (boosting) or class counts (forest) per (tree, node, feature, bin), the sums of a node
meet by one shuffle on (tree, node), the best split is found where they meet, and only splits reach the driver. Of a
forest's node with few rows the rows themselves go there: a deep level costs what its rows weigh, not nodes x features x
bins. A boosted tree's node of at most about ``GROW_ROWS`` rows is sent as rows once, and all that grows below it is grown
where they meet: few levels cost a pass. Trees of different candidates and folds are keys of the same pass, so a search
costs one scan a level, not one fit each.

All sums are whole numbers (gradients in units of 2^-20), and every random choice is a hash of (seed, tree, row id): a
model depends neither on partitioning nor on the order of rows. What the driver holds is bounded by the models; the sums
a task holds in a pass by ``PASS_BYTES`` and ``CHUNK`` rows. The margins of finished trees are pinned by a checkpoint every ``PIN_TREES``.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

MAX_BINS = 64
PASS_BYTES = 64 << 20
PIN_TREES = 5
GROW_ROWS = 1 << 18          # a boosted node of so many rows (four times as many at the very most) is grown to its leaves by one task
SENT_BYTES = 1 << 30         # rows of such nodes, and of a forest's nodes of few rows, in a pass; more nodes are summed
HELD_NODES = 1 << 24         # most nodes of a search's trees at the driver (or one model's)
BLOCK = 1 << 12
JOINT = 1 << 12             # cells of features that are counted as one number
CHUNK = 1 << 15              # rows worked on at a time: packed class counts of so many stay exact in a double
TOGETHER = 64                # nodes of few rows that a task splits at once
PART_ROWS = 500_000
UNIT = float(1 << 20)
MIN_GAIN = 1e-9
SEED = 42
PRIME = 2_147_483_647
ROWS, COLUMNS, BOOTSTRAP, NODES = 1, 2, 3, 4            # what a stream of draws is for
#: P(X <= k) of a Poisson variable with mean 1, from the series e^-1 / k!.
POISSON_CDF = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(13)])

BOOSTED_DEFAULTS = {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1, "subsample": 1.0, "colsample_bytree": 1.0,
                    "reg_alpha": 0.0, "reg_lambda": 1.0, "min_child_weight": 1.0}
FOREST_DEFAULTS = {"n_estimators": 100, "max_depth": 8, "min_samples_split": 2, "min_samples_leaf": 1, "max_features": 0.5}


# ------------------------------------------------------------------------------------------ draws
def stream(purpose: int, tree: int = 0, node: int = 0, seed: int = SEED) -> int:
    return (seed * 7919 + tree * 104_729 + node * 1_299_709 + purpose * 15_485_863) % PRIME


def draws(ids: np.ndarray, of: int) -> np.ndarray:
    """Numbers in [0, PRIME) for row ids: two squarings modulo a prime, so SQL can repeat them."""
    return draws_of(residues(ids), of)


def residues(ids: np.ndarray) -> np.ndarray:
    """All that draws read of row ids."""
    return np.mod(ids, PRIME).astype(np.int64)


def draws_of(residue: np.ndarray, of: int) -> np.ndarray:
    x = (residue * 48_271 + of) % PRIME
    x = (x * x % PRIME * 16_807 + x + of) % PRIME
    return (x * x % PRIME * 48_271 + x) % PRIME


def bootstrap_counts(ids: np.ndarray, tree: int, seed: int = SEED) -> np.ndarray:
    """How often each row is drawn for a tree of a forest: Poisson with mean 1, a function of (seed, tree, id)."""
    return drawn_of(residues(ids), tree, seed)


def drawn_of(residue: np.ndarray, tree: int, seed: int = SEED) -> np.ndarray:
    return np.searchsorted(POISSON_CDF, draws_of(residue, stream(BOOTSTRAP, tree, 0, seed)) / PRIME, side="right")


def drawn_rows(df: DataFrame, id_col: str, numbers) -> DataFrame:
    """``id_col, tree, drawn`` for the trees ``numbers`` of a forest: the sample each of them is grown on."""
    numbers = list(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for t in numbers:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(ids), t, dtype=np.int32)), pa.array(bootstrap_counts(ids, t).astype(np.int32))],
                                                 names=[id_col, "tree", "drawn"])

    return df.select(F.col(id_col).cast("long").alias(id_col)).mapInArrow(run, f"{id_col} long, tree int, drawn int")


def some_of(n: int, share: float, of: int) -> np.ndarray:
    """``max(1, floor(share * n))`` of the numbers below ``n``: those with the smallest draws."""
    return np.sort(np.argsort(draws(np.arange(1, n + 1), of), kind="stable")[:max(1, int(share * n))])


# ------------------------------------------------------------------------------------------ rows
@dataclass
class Packed:
    """Training rows: ``id long, label int, fold int, bins binary`` (one byte per feature), pinned."""
    rows: DataFrame
    feats: list[str]
    edges: list[np.ndarray]
    counts: dict[tuple[int, int], int]         # (fold, label) -> rows

    @property
    def sizes(self) -> np.ndarray:
        return np.array([len(e) + 1 for e in self.edges])

    def class_counts(self, hold_out: int | None) -> tuple[int, int]:
        """Negatives and positives outside the held-out fold."""
        n = [sum(v for (f, y), v in self.counts.items() if y == k and f != hold_out) for k in (0, 1)]
        return n[0], n[1]


def matrix(feats: list[str]):
    """The features as one array column; missing values are NaN."""
    return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in feats])


def bin_edges(df: DataFrame, feats: list[str], max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Cut points per feature: quantiles of all rows from one aggregate (features x bins numbers reach the driver). A value
    lies in the bin of the cut points below it, so ``x <= edges[b]`` is ``bin <= b``."""
    qs = [k / max_bins for k in range(1, max_bins)]
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), qs, 10_000).alias(f"_{i}") for i, f in enumerate(feats)],
                 *[F.max(F.col(f).cast("double")).alias(f"_m{i}") for i, f in enumerate(feats)]).first()
    out = []
    for i in range(len(feats)):
        e = np.unique(np.array(row[f"_{i}"] or [], dtype=float))
        out.append(e[e < row[f"_m{i}"]] if len(e) else e)       # nothing lies above the maximum
    return out


def pack(df: DataFrame, feats, label: str, id_col: str = "transaction_id", max_bins: int = MAX_BINS) -> Packed:
    """Rows of ``df`` as bin numbers, checkpointed. Without a ``fold`` column all rows belong to fold 0. Missing values
    lie in a feature's last bin."""
    feats = list(feats)
    edges = bin_edges(df, feats, max_bins)
    fold = F.col("fold").cast("int") if "fold" in df.columns else F.lit(0)
    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label"), fold.alias("fold"), matrix(feats).alias("x"))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(feats))
            packed = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([r.tobytes() for r in packed], pa.binary())],
                                             names=["id", "label", "fold", "bins"])

    packed = narrow.mapInArrow(bins, "id long, label int, fold int, bins binary")
    cores = df.sparkSession.sparkContext.defaultParallelism
    if packed.rdd.getNumPartitions() < cores:       # few rows, but a pass does much with each
        packed = packed.repartition(cores)
    rows = cut_lineage(packed)
    counts = {(r["fold"], r["label"]): r["n"] for r in rows.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}     # folds x 2
    # a pass sums per partition: no more of them than keep the cores busy and a task's rows bounded
    rows = rows.coalesce(max(cores, -(-sum(counts.values()) // PART_ROWS)))
    return Packed(rows, feats, edges, counts)


# ------------------------------------------------------------------------------------------ trees in work
@dataclass
class Tree:
    """Node arrays; ``feat`` -1 is a leaf. ``cut`` is the last bin that goes left, ``cover`` the weight of the node."""
    feat: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    val: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def add(self) -> int:
        for a in (self.feat, self.cut, self.left, self.right, self.val, self.cover, self.gain):
            a.append(-1 if a is self.feat else 0)
        return len(self.feat) - 1

    def by_level(self) -> None:
        """Numbers the nodes level by level, left to right, as they come when every level takes a pass."""
        order = [0]
        for k in order:
            if self.feat[k] >= 0:
                order += [self.left[k], self.right[k]]
        place = {k: i for i, k in enumerate(order)}
        for a in (self.feat, self.cut, self.left, self.right, self.val, self.cover, self.gain):
            a[:] = [a[k] for k in order]
        for a in (self.left, self.right):
            a[:] = [place[k] if f >= 0 else 0 for k, f in zip(a, self.feat, strict=True)]

    def packed(self) -> Tree:
        """A finished tree in a quarter of the room."""
        return Tree(*(array("i", map(int, a)) for a in (self.feat, self.cut, self.left, self.right)), *(array("d", a) for a in (self.val, self.cover, self.gain)))

    def arrays(self):
        return tuple(np.array(a) for a in (self.feat, self.cut, self.left, self.right, self.val))


def walk(tree, bins: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """The node each row (or each of ``rows``) has reached."""
    feat, cut, left, right, _ = tree
    at = (np.arange(len(bins)) if rows is None else rows) * bins.shape[1]
    node, cells, own, leaf = np.zeros(len(at), dtype=np.int64), bins.ravel(), np.arange(len(feat)), feat < 0
    child = np.stack([np.where(leaf, own, left), np.where(leaf, own, right)], axis=1).ravel()      # rows in a leaf stay there
    asked, front = np.where(leaf, 0, feat), np.zeros(1, dtype=np.int64)
    while True:
        front = front[feat[front] >= 0]
        if not len(front):
            return node
        node = child[2 * node + (cells[at + asked[node]] > cut[node])]
        front = np.concatenate([left[front], right[front]])


@dataclass
class Ensemble:
    """A model: its parameters, the fold it does not see, and its trees."""
    kind: str                       # "boosted" or "forest"
    params: dict
    hold_out: int | None = None
    seed: int = SEED
    trees: list[Tree] = field(default_factory=list)

    def __post_init__(self):
        self.params = (BOOSTED_DEFAULTS if self.kind == "boosted" else FOREST_DEFAULTS) | self.params

    def features_of(self, tree: int, n: int) -> np.ndarray:
        """Features a tree may split on."""
        return some_of(n, self.params["colsample_bytree"], stream(COLUMNS, tree, 0, self.seed)) if self.kind == "boosted" else np.arange(n)

    def features_at(self, tree: int, node: int, n: int) -> np.ndarray:
        """Features a node may split on."""
        return some_of(n, self.params["max_features"], stream(NODES, tree, node, self.seed)) if self.kind == "forest" else self.features_of(tree, n)


@dataclass
class _Unit:
    """A tree in work: the nodes to split next, their depth and, where it is known, their number of rows."""
    model: int
    number: int
    tree: Tree
    open: dict[int, tuple[int, int | None]] = field(default_factory=lambda: {0: (0, None)})
    sent: set[int] = field(default_factory=set)             # those that go as rows in the pass at hand


def soft(g, alpha: float):
    """Gradient sum shrunk by the L1 penalty."""
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def leaf_value(g: float, h: float, p: dict) -> float:
    return float(-soft(g, p["reg_alpha"]) / (h + p["reg_lambda"]) * p["learning_rate"]) if h + p["reg_lambda"] > 0 else 0.0


def _running(sums: np.ndarray, sizes: np.ndarray):
    """Of sums (channels x cells, feature after feature): the sums up to each bin but a feature's last, the places of these
    bins and where each feature begins."""
    starts = np.cumsum(sizes) - sizes
    up_to = np.cumsum(sums, axis=1)
    before = np.repeat(np.where(starts > 0, up_to[:, starts - 1], 0), sizes, axis=1)
    inner = np.ones(sums.shape[1], dtype=bool)
    inner[starts + sizes - 1] = False
    places = np.flatnonzero(inner)
    return (up_to - before)[:, places], places, starts


def _best(gain: np.ndarray, places: np.ndarray, starts: np.ndarray, feats: np.ndarray):
    """(feature, bin, gain, place in ``gain``) of the first largest gain, or None."""
    k = int(np.argmax(gain)) if len(gain) else 0
    if not len(gain) or not gain[k] > MIN_GAIN:
        return None
    j = int(np.searchsorted(starts, places[k], side="right")) - 1
    return int(feats[j]), int(places[k] - starts[j]), float(gain[k]), k


def boosted_split(sums: np.ndarray, sizes: np.ndarray, feats: np.ndarray, p: dict):
    """Best (feature, bin, gain, left sums, all sums) of a node from its sums (2 x cells of ``feats``), or no feature (-1)."""
    a, l2, least = p["reg_alpha"], p["reg_lambda"], p["min_child_weight"]
    total = sums[:, :sizes[0]].sum(axis=1) / UNIT
    score = lambda g, h: soft(g, a) ** 2 / np.maximum(h + l2, 1e-16)
    inside, places, starts = _running(sums, sizes)
    g, h = inside / UNIT
    gr, hr = total[0] - g, total[1] - h
    found = _best(np.where((h >= least) & (hr >= least), 0.5 * (score(g, h) + score(gr, hr) - score(*total)), -1.0), places, starts, feats)
    return (-1, 0, 0.0, total, total) if found is None else (*found[:3], np.array([g[found[3]], h[found[3]]]), total)


def forest_split(sums: np.ndarray, sizes: np.ndarray, feats: np.ndarray, p: dict):
    """The same for class counts (3 x cells: draws of class 0 and 1, rows), weighted Gini impurity."""
    total = sums[:, :sizes[0]].sum(axis=1).astype(float)
    if total[2] < p["min_samples_split"]:
        return -1, 0, 0.0, total, total
    w0, w1 = p["weights"]
    least = p["min_samples_leaf"]
    impurity = lambda a, b: 2 * a * b / np.maximum(a + b, 1e-300)  # noqa: E731   (Gini times weight)
    inside, places, starts = _running(sums, sizes)
    n0, n1, n = inside.astype(float)
    gain = impurity(w0 * total[0], w1 * total[1]) - impurity(w0 * n0, w1 * n1) - impurity(w0 * (total[0] - n0), w1 * (total[1] - n1))
    found = _best(np.where((n >= least) & (total[2] - n >= least), gain, -1.0), places, starts, feats)
    return (-1, 0, 0.0, total, total) if found is None else (*found[:3], inside[:, found[3]].astype(float), total)


def forest_splits(rows: np.ndarray, node: np.ndarray, n: int, sizes: np.ndarray, allowed: np.ndarray, p: dict):
    """``forest_split`` of ``n`` nodes at once from at most ``CHUNK`` rows (bins, then draws and class) and the node of each;
    ``allowed`` (nodes x features) says what a node may split on."""
    width, starts, n_feats = int(sizes.sum()), np.cumsum(sizes) - sizes, len(sizes)
    packed = _packed(rows[:, -1].astype(np.int64) >> 2, rows[:, -1] & 3)
    cells = (node * width)[:, None] + starts[None, :] + rows[:, :-1]
    sums = _class_counts(np.bincount(cells.ravel(), np.repeat(packed, n_feats), n * width)).reshape(3 * n, width)
    total = sums[:, :sizes[0]].sum(axis=1).reshape(3, n).astype(float)
    inside, places, _ = _running(sums, sizes)
    if not len(places):
        return [(-1, 0, 0.0, total[:, i], total[:, i]) for i in range(n)]
    inside = inside.reshape(3, n, -1).astype(float)
    (n0, n1, m), (t0, t1, tm) = inside, total[:, :, None]
    (w0, w1), least = p["weights"], p["min_samples_leaf"]
    impurity = lambda a, b: 2 * a * b / np.maximum(a + b, 1e-300)
    gain = impurity(w0 * t0, w1 * t1) - impurity(w0 * n0, w1 * n1) - impurity(w0 * (t0 - n0), w1 * (t1 - n1))
    feature = np.searchsorted(starts, places, side="right") - 1
    gain = np.where((m >= least) & (tm - m >= least) & allowed[:, feature], gain, -1.0)
    best = np.argmax(gain, axis=1)
    out = []
    for i, k in enumerate(best):
        if total[2, i] < p["min_samples_split"] or not gain[i, k] > MIN_GAIN:
            out.append((-1, 0, 0.0, total[:, i], total[:, i]))
        else:
            f = int(feature[k])
            out.append((f, int(places[k] - starts[f]), float(gain[i, k]), inside[:, i, k], total[:, i]))
    return out


def may_split(kind: str, p: dict, sums) -> bool:
    """False where no split of a node could count: too few rows, too little weight or a single class."""
    if kind == "boosted":
        return sums[1] >= 2 * p["min_child_weight"]
    return sums[0] > 0 and sums[1] > 0 and sums[2] >= max(p["min_samples_split"], 2 * p["min_samples_leaf"])


def _joined(sizes: np.ndarray, most: int) -> list[list[int]]:
    """The features in groups that have at most ``most`` cells together (or are one feature): the bins of a group's features
    are counted as one number, and each feature's own sums are sums of these."""
    groups: list[list[int]] = []
    cells: list[int] = []
    for f in np.argsort(-sizes, kind="stable"):
        k = next((k for k, c in enumerate(cells) if c * sizes[f] <= most), None)
        if k is None:
            groups.append([int(f)])
            cells.append(int(sizes[f]))
        else:
            groups[k].append(int(f))
            cells[k] *= int(sizes[f])
    return groups


def _codes(columns: np.ndarray, sizes: np.ndarray, groups: list[list[int]]) -> list[np.ndarray]:
    """One number per row and group for the bins of its features."""
    out = []
    for first, *others in groups:
        code = columns[first].astype(np.int64)
        for f in others:
            code *= sizes[f]
            code += columns[f]
        out.append(code)
    return out


def _apart(sums: np.ndarray, sizes: np.ndarray, group: list[int], nodes: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """(feature, nodes x bins) of a group's sums (nodes x cells)."""
    before, after = 1, sums.size // nodes
    for f in group:
        after //= int(sizes[f])
        yield f, sums.reshape(nodes, before, int(sizes[f]), after).sum(axis=(1, 3))
        before *= int(sizes[f])


def grow_boosted(bins: np.ndarray, slopes: np.ndarray, sizes: np.ndarray, feats: np.ndarray, p: dict, depth: int):
    """All splits below (and at) a node from its rows: bins (rows x ``feats``) and first and second derivatives (rows x 2, in
    whole units). Yields (place, feature, bin, gain, left sums, all sums); the node's place is 1, the children of place k
    have 2k and 2k + 1. Of two children only the smaller one is summed, the other is what remains."""
    starts, place_of = np.cumsum(sizes) - sizes, {int(f): j for j, f in enumerate(feats)}
    groups = _joined(sizes, JOINT) if len(bins) > BLOCK else []
    codes, values = _codes(np.ascontiguousarray(bins.T), sizes, groups), [np.ascontiguousarray(c, dtype=float) for c in slopes.T]

    def summed(rows):
        sums = np.zeros((2, int(sizes.sum())), dtype=np.int64)
        if len(rows) > BLOCK:
            own = [v[rows] for v in values]
            for group, code in zip(groups, codes, strict=True):
                cells, width = code[rows], int(np.prod(sizes[group]))
                for c in range(2):
                    for j, found in _apart(np.bincount(cells, own[c], width), sizes, group):
                        sums[c, starts[j]:starts[j] + sizes[j]] = found[0]
            return sums
        for at in range(0, len(rows), BLOCK):
            some = rows[at:at + BLOCK]
            cells = (bins[some] + starts[None, :]).ravel()
            for c in range(2):
                sums[c] += np.bincount(cells, np.repeat(slopes[some, c].astype(float), len(feats)), sums.shape[1]).astype(np.int64)
        return sums

    every = np.arange(len(bins))
    level = [(1, every, summed(every))]
    while level:
        below = []
        for place, rows, sums in level:
            f, cut, gain, inside, total = boosted_split(sums, sizes, feats, p)
            yield place, f, cut, gain, inside, total
            if f < 0 or depth + 1 >= p["max_depth"]:
                continue
            go = bins[rows, place_of[f]] <= cut
            parts = [rows[go], rows[~go]]
            opened = [may_split("boosted", p, side) for side in (inside, total - inside)]
            if any(opened):
                small = int(len(parts[1]) < len(parts[0]))
                own = summed(parts[small])
                of = {small: own, 1 - small: sums - own}
                below += [(2 * place + k, parts[k], of[k]) for k in range(2) if opened[k]]
        level, depth = below, depth + 1


def gradients(margin: np.ndarray, label: np.ndarray, positive: float) -> tuple[np.ndarray, np.ndarray]:
    """Logistic loss: first and second derivative per row in whole units; positives count ``positive`` times."""
    p = 1.0 / (1.0 + np.exp(-margin))
    w = np.where(label == 1, positive, 1.0)
    return np.rint(w * (p - label) * UNIT), np.rint(w * np.maximum(p * (1 - p), 1e-16) * UNIT)


# ------------------------------------------------------------------------------------------ one pass
def _raw(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column without nulls, and where each value begins (and the last ends)."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], dtype=wide)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0]:ends[-1]] if ends[-1] > ends[0] else np.zeros(0, dtype=np.uint8)
    return data, ends - ends[0]


def _read(batch: pa.RecordBatch, n_feats: int):
    ids, label, fold = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
    return ids, label, fold, _raw(batch.column(3))[0].reshape(len(ids), n_feats)


BLOCKS = "types string, ids binary, label binary, fold binary, bins binary, margins binary"


def _into_blocks(n_feats: int, n_models: int):
    """Rows -> blocks of at most ``CHUNK`` of them, a table row each: a pass reads a few values, not one per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            *keys, bins = _read(batch, n_feats)
            yield _block("".join(k.dtype.char for k in keys), [*keys, bins, np.zeros((len(bins), n_models))])
    return run


def _block(types: str, arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([types]), *[pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays]], names=["types", "ids", "label", "fold", "bins", "margins"])


def _from_blocks(batches: Iterator[pa.RecordBatch], n_feats: int, n_models: int):
    """(types, ids, label, fold, bins, margins) of every block."""
    for batch in batches:
        for k in range(batch.num_rows):
            types, *data = (batch.column(c)[k] for c in range(6))
            data = [np.frombuffer(d.as_buffer(), dtype=t) for d, t in zip(data, [*types.as_py(), np.uint8, np.float64], strict=True)]
            yield types.as_py(), *data[:3], data[3].reshape(-1, n_feats), data[4].reshape(len(data[0]), n_models)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ``CHUNK``, however they arrive."""
    def cut(held):
        whole = pa.Table.from_batches(held).combine_chunks()
        for at in range(0, whole.num_rows, CHUNK):
            yield from whole.slice(at, CHUNK).to_batches()

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= CHUNK:
            yield from cut(held)
            held, n = [], 0
    if held:
        yield from cut(held)


def _blobs(unit: int, nodes: np.ndarray, data: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """``unit, node, sums`` with the bytes of ``data`` cut at ``ends``."""
    binary = pa.Array.from_buffers(pa.binary(), len(nodes), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), unit, dtype=np.int32)), pa.array(nodes.astype(np.int32)), binary], names=["unit", "node", "sums"])


def _cells_of(feats: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Cells of some features among those of all."""
    starts = np.cumsum(sizes) - sizes
    return np.concatenate([np.arange(starts[f], starts[f] + sizes[f]) for f in feats])


def _class_sums(cells: np.ndarray, packed: np.ndarray, n: int) -> np.ndarray:
    """Class counts (3 x cells) of at most ``CHUNK`` rows from one count of packed weights."""
    return _class_counts(np.bincount(cells, packed, n))


def _class_counts(packed: np.ndarray) -> np.ndarray:
    sums = packed.astype(np.int64)
    return np.stack([sums & 0x7FFFF, sums >> 19 & 0x7FFFF, sums >> 38])


def _packed(drawn: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Draws of class 0, draws of class 1 and one row as a single whole number; without a label only the row counts."""
    return np.where(label == 1, drawn << 19, np.where(label == 0, drawn, 0)).astype(float) + float(1 << 38)


def _summer(plan):
    """Sums per (unit, node) of a partition, or the node's rows where the plan says so; ``plan`` is a broadcast description
    of the trees in work."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = plan.value
        sizes, held, rows_at = work["sizes"], {}, {}
        n_feats = len(sizes)
        grouped = {most: _joined(sizes, most) for most in (JOINT, JOINT >> 3, 1)}
        for _, ids, label, fold, bins, margins in _from_blocks(batches, n_feats, work["models"]):
            columns = np.ascontiguousarray(bins.T)
            codes: dict[int, list[np.ndarray]] = {}
            slope: dict[int, tuple] = {}
            drawn: dict[tuple, np.ndarray] = {}         # units of different models share their draws
            for u, unit in enumerate(work["units"]):
                seen = fold != unit["hold_out"] if unit["hold_out"] is not None else np.ones(len(ids), dtype=bool)
                if unit["kind"] == "boosted":
                    m = unit["model"]
                    if m not in slope:
                        margin = margins[:, unit["margin"]].copy()
                        for t in unit["recent"]:
                            margin += t[4][walk(t, bins)]
                        slope[m] = gradients(margin, label, unit["positive"])
                    if unit["subsample"] < 1:
                        if (key := ("rows", unit["stream"])) not in drawn:
                            drawn[key] = draws(ids, unit["stream"])
                        seen = seen & (drawn[key] < unit["subsample"] * PRIME)
                else:
                    if (key := (unit["number"], unit["seed"])) not in drawn:
                        drawn[key] = bootstrap_counts(ids, *key).astype(np.int64)
                    times = drawn[key]
                    seen = seen & (times > 0)
                rows = np.flatnonzero(seen)
                node = walk(unit["tree"], bins, rows)
                sent = unit["sent"][node]
                if sent.any():
                    own, at = rows[sent], node[sent]
                    order = np.argsort(at.astype(np.uint16) if len(unit["sent"]) <= 1 << 16 else at, kind="stable")
                    own, at = own[order], at[order]
                    first = np.flatnonzero(np.diff(at, prepend=-1))
                    if unit["kind"] == "boosted":
                        both = np.stack([c[own].astype(np.int64) for c in slope[unit["model"]]], axis=1)
                        data = np.concatenate([both.view(np.uint8), bins[own][:, unit["feats"]]], axis=1)
                    else:
                        data = np.concatenate([bins[own], (4 * times[own] + np.where(label[own] == 1, 1, np.where(label[own] == 0, 0, 2))).astype(np.uint8)[:, None]], axis=1)
                    yield _blobs(u, at[first], data, np.append(first, len(at)) * data.shape[1])
                slot = unit["slot"][node]
                rows, slot = rows[slot >= 0], slot[slot >= 0]
                if not len(rows):
                    continue
                n, width = len(unit["nodes"]), int(sizes[unit["feats"]].sum())
                boosted = unit["kind"] == "boosted"
                if u not in held:
                    held[u] = np.zeros((2 if boosted else 3, n * width), dtype=np.int64)
                    rows_at[u] = np.zeros(n, dtype=np.int64)
                rows_at[u] += np.bincount(slot, minlength=n)
                values = [c[rows] for c in slope[m]] if boosted else _packed(times[rows], label[rows])
                at_of, at = {}, 0                       # feature after feature, each nodes x bins
                for f in unit["feats"]:
                    at_of[int(f)], at = at, at + n * int(sizes[f])
                most = JOINT if n <= 2 else JOINT >> 3 if n <= 16 else 1        # the fewer nodes, the more cells
                if most not in codes:
                    codes[most] = _codes(columns, sizes, grouped[most])
                for group, code in zip(grouped[most], codes[most], strict=True):
                    if not any(f in at_of for f in group):
                        continue
                    width = int(np.prod(sizes[group]))
                    cells = code[rows] if n == 1 else slot * width + code[rows]
                    for c, v in enumerate(values if boosted else [values]):
                        for f, own in _apart(np.bincount(cells, v, n * width), sizes, group, n):
                            if f in at_of:
                                here = slice(at_of[f], at_of[f] + own.size)
                                if boosted:
                                    held[u][c, here] += own.ravel().astype(np.int64)
                                else:
                                    held[u][:, here] += _class_counts(own.ravel())
        for u, sums in held.items():
            unit = work["units"][u]
            nodes, own = unit["nodes"], sizes[unit["feats"]]
            ends = np.cumsum(own) * len(nodes)
            by_node = np.concatenate([sums[:, e - k * len(nodes):e].reshape(len(sums), len(nodes), k) for e, k in zip(ends, own, strict=True)], axis=2)
            for i, node in enumerate(nodes):
                if not by_node[:, i].any():
                    continue
                mine = by_node[:, i]
                if unit["kind"] == "forest":            # only what the node may split on
                    mine = mine[:, _cells_of(_allowed(unit, int(node), n_feats), sizes)]
                else:                                   # and the number of rows
                    mine = np.append(mine.ravel(), rows_at[u][i])
                data = np.frombuffer(np.ascontiguousarray(mine).tobytes(), dtype=np.uint8)
                yield _blobs(u, np.array([node]), data, np.array([0, len(data)]))
    return run


def _allowed(unit: dict, node: int, n_feats: int) -> np.ndarray:
    """Features a node may split on."""
    return unit["feats"] if unit["kind"] == "boosted" else some_of(n_feats, unit["params"]["max_features"], stream(NODES, unit["number"], node, unit["seed"]))


SPLIT = "unit int, node int, place long, feat int, cut int, gain double, inside array<double>, total array<double>, rows long"


class _Node:
    """What has arrived of one node: sums from all partitions, or its rows."""

    def __init__(self, unit: dict, node: int, sizes: np.ndarray):
        self.unit, self.sent, self.boosted = unit, bool(unit["sent"][node]), unit["kind"] == "boosted"
        self.depth, self.n = unit["depth"].get(node, 0), 0
        self.node, self.all_sizes, self.n_feats = node, sizes, len(sizes)
        self.rows: list[np.ndarray] = []
        self.sums = None
        if self.boosted or not self.sent:
            self.open()

    def open(self) -> None:
        self.feats = _allowed(self.unit, self.node, self.n_feats)
        self.sizes = self.all_sizes[self.feats]
        self.sums = np.zeros((2 if self.boosted else 3, int(self.sizes.sum())), dtype=np.int64)

    def add(self, data: np.ndarray) -> None:
        if self.sent and self.boosted:
            self.rows.append(data.reshape(-1, 16 + len(self.feats)).copy())
        elif self.sent:
            self.rows.append(data.reshape(-1, self.n_feats + 1).copy())
            if sum(map(len, self.rows)) >= CHUNK:
                self.count()
        elif self.boosted:
            found = np.frombuffer(data.tobytes(), dtype=np.int64).reshape(-1, self.sums.size + 1).sum(axis=0)
            self.sums += found[:-1].reshape(self.sums.shape)
            self.n += int(found[-1])
        elif len(data):
            self.sums += np.frombuffer(data.tobytes(), dtype=np.int64).reshape(-1, *self.sums.shape).sum(axis=0)

    def count(self) -> None:
        """Rows into class counts."""
        if self.sums is None:
            self.open()
        rows, self.rows = np.concatenate(self.rows), []
        starts = np.cumsum(self.sizes) - self.sizes
        for at in range(0, len(rows), CHUNK):
            part = rows[at:at + CHUNK]
            packed = _packed(part[:, -1].astype(np.int64) >> 2, part[:, -1] & 3)
            self.sums += _class_sums((part[:, self.feats] + starts[None, :]).ravel(), np.repeat(packed, len(self.feats)), self.sums.shape[1])

    def splits(self):
        """(place, feature, bin, gain, left sums, all sums) of the node; of a boosted node whose rows are here, of all below it."""
        if self.sent and self.boosted:
            rows = np.concatenate(self.rows)
            slopes = np.ascontiguousarray(rows[:, :16]).view(np.int64)
            yield from grow_boosted(rows[:, 16:], slopes, self.sizes, self.feats, self.unit["params"], self.depth)
            return
        if self.rows:
            self.count()
        find = boosted_split if self.boosted else forest_split
        yield 1, *find(self.sums, self.sizes, self.feats, self.unit["params"])


def _splitter(plan):
    """Sums or rows of a node from all partitions (they arrive sorted by node) -> its best split."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = plan.value
        key, held, out = None, None, []
        waiting: list[tuple[tuple, np.ndarray]] = []        # a forest's nodes of few rows, split together

        def together():
            if waiting:
                unit, sizes = work["units"][waiting[0][0][0]], work["sizes"]
                some = max(1, int(unit["params"]["max_features"] * len(sizes)))
                of = np.array([stream(NODES, unit["number"], node, unit["seed"]) for (_, node), _ in waiting])
                drawn = np.argsort(draws(np.arange(1, len(sizes) + 1)[None, :], of[:, None]), axis=1, kind="stable")[:, :some]      # as ``some_of``
                allowed = np.zeros((len(waiting), len(sizes)), dtype=bool)
                np.put_along_axis(allowed, drawn, True, axis=1)
                node = np.repeat(np.arange(len(waiting)), [len(r) for _, r in waiting])
                splits = forest_splits(np.concatenate([r for _, r in waiting]), node, len(waiting), sizes, allowed, unit["params"])
                out.extend((*k, 1, *found[:3], found[3].tolist(), found[4].tolist(), 0) for (k, _), found in zip(waiting, splits, strict=True))
                waiting.clear()

        def done():
            if held.sent and not held.boosted and held.sums is None:
                rows = np.concatenate(held.rows)
                if waiting and (waiting[0][0][0] != key[0] or len(waiting) >= TOGETHER or sum(len(r) for _, r in waiting) + len(rows) > CHUNK):
                    together()
                waiting.append((key, rows))
                return
            out.extend((*key, *found[:4], found[4].tolist(), found[5].tolist(), held.n) for found in held.splits())

        def flush():
            rows = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, [pa.int32()] * 2 + [pa.int64()] + [pa.int32()] * 2 + [pa.float64()] + [pa.list_(pa.float64())] * 2 + [pa.int64()], strict=True)],
                                              names=["unit", "node", "place", "feat", "cut", "gain", "inside", "total", "rows"])

        for batch in batches:
            if not batch.num_rows:
                continue
            units, nodes = (batch.column(k).to_numpy() for k in range(2))
            data, ends = _raw(batch.column(2))
            first = np.flatnonzero((np.diff(units, prepend=-1) != 0) | (np.diff(nodes, prepend=-1) != 0))
            for a, b in zip(first, np.append(first[1:], len(units)), strict=True):
                now = (int(units[a]), int(nodes[a]))
                if now != key:
                    if key is not None:
                        done()
                    key, held = now, _Node(work["units"][now[0]], now[1], work["sizes"])
                held.add(data[ends[a]:ends[b]])
            if len(out) > 1000:
                yield flush()
        if key is not None:
            done()
        together()
        if out:
            yield flush()
    return run


class _Job:
    """Grows all trees of some models over the same rows."""

    def __init__(self, data: Packed, models: list[Ensemble]):
        self.data, self.models = data, models
        self.boosted = [m for m, model in enumerate(models) if model.kind == "boosted"]
        self.rows = cut_lineage(data.rows.mapInArrow(_into_blocks(len(data.feats), len(self.boosted)), BLOCKS))
        self.pinned = [0] * len(models)         # trees of each model that are in the stored margins
        self.parts = data.rows.rdd.getNumPartitions()
        self.passes = 0
        self.units: list[_Unit] = []
        for m, model in enumerate(models):
            numbers = range(1) if model.kind == "boosted" else range(int(model.params["n_estimators"]))
            self.units += [_Unit(m, t, Tree()) for t in numbers]

    def run(self) -> None:
        while self.units:
            chosen = self._choose()
            splits = self._pass(chosen)
            for k, (unit, nodes) in enumerate(chosen):
                for node in nodes:
                    self._grow(unit, node, splits.get((k, node), {}))
            again = []
            for unit in self.units:
                if unit.open:
                    again.append(unit)
                    continue
                model = self.models[unit.model]
                if model.kind == "boosted":             # parts of it may have come out of turn
                    unit.tree.by_level()
                model.trees.append(unit.tree.packed())
                if model.kind == "boosted" and len(model.trees) < int(model.params["n_estimators"]):
                    again.append(_Unit(unit.model, unit.number + 1, Tree()))
            self.units = again
            if again and any(len(self.models[m].trees) - self.pinned[m] >= PIN_TREES for m in self.boosted):
                self._pin()

    def _choose(self) -> list[tuple[_Unit, list[int]]]:
        """Trees and nodes of the next pass: as many as fit ``PASS_BYTES`` of sums (at least one node). Nodes come in the order
        of their numbers; those that are sent as rows hold no sums."""
        room, chosen, sending = PASS_BYTES, [], SENT_BYTES
        for unit in self.units:
            cost, nodes, unit.sent = self._bytes(unit), [], set()
            for node in sorted(unit.open):
                weight = self._sent(unit, node)
                if weight is not None and weight <= sending:
                    unit.sent.add(node)
                    sending -= weight
                need = 0 if node in unit.sent else cost
                if need and need > room and (chosen or nodes):
                    break
                nodes.append(node)
                room -= need
            if nodes:
                chosen.append((unit, nodes))
        return chosen

    def _bytes(self, unit: _Unit) -> int:
        """Sums of a node."""
        model, sizes = self.models[unit.model], self.data.sizes
        return int(sizes[model.features_of(unit.number, len(sizes))].sum()) * 8 * (2 if model.kind == "boosted" else 3)

    def _sent(self, unit: _Unit, node: int) -> int | None:
        """What a node's rows count against ``SENT_BYTES`` if they are to be sent. Those of a forest are where they weigh less
        than the sums from all partitions (the size is known from the parent's split); those of a boosted tree where one task can grow the rest (the size is the parent's, by the share of the second derivative)."""
        model, rows = self.models[unit.model], unit.open[node][1]
        if model.kind == "forest":
            weight = None if rows is None else rows * (len(self.data.feats) + 1)
            return weight if weight is not None and weight <= self._bytes(unit) // 2 * self.parts else None
        if rows is None and not node and (most := sum(self.data.class_counts(model.hold_out))) <= 4 * GROW_ROWS:
            rows = most * min(1.0, model.params["subsample"])
        return int(rows) * (16 + len(self.data.feats)) if rows is not None and rows <= GROW_ROWS else None

    def _describe(self, unit: _Unit, nodes: list[int]) -> dict:
        model, n = self.models[unit.model], len(self.data.feats)
        feats = model.features_of(unit.number, n)
        summed, sent = [k for k in nodes if k not in unit.sent], np.zeros(len(unit.tree.feat), dtype=bool)
        sent[nodes] = True
        sent[summed] = False
        slot = np.full(len(unit.tree.feat), -1, dtype=np.int64)
        slot[summed] = np.arange(len(summed))
        negative, positive = self.data.class_counts(model.hold_out)
        weights = [(negative + positive) / (2 * max(1, c)) for c in (negative, positive)]
        return {"kind": model.kind, "model": unit.model, "number": unit.number, "seed": model.seed, "hold_out": model.hold_out, "margin": self.boosted.index(unit.model) if model.kind == "boosted" else None, "nodes": np.array(summed, dtype=np.int64), "slot": slot, "sent": sent, "depth": {k: unit.open[k][0] for k in nodes},
                "tree": unit.tree.arrays(), "feats": feats, "params": model.params | {"weights": weights},
                "recent": [t.arrays() for t in model.trees[self.pinned[unit.model]:]] if model.kind == "boosted" else [],
                "positive": negative / max(1, positive), "subsample": model.params.get("subsample", 1.0), "stream": stream(ROWS, unit.number, 0, model.seed)}

    def _pass(self, chosen) -> dict:
        self.passes += 1
        sc = self.rows.sparkSession.sparkContext
        plan = sc.broadcast({"sizes": self.data.sizes, "models": len(self.boosted), "units": [self._describe(u, nodes) for u, nodes in chosen]})
        sums = self.rows.mapInArrow(_summer(plan), "unit int, node int, sums binary")
        met = sums.repartition("unit", "node").sortWithinPartitions("unit", "node").mapInArrow(_splitter(plan), SPLIT)
        splits: dict[tuple, dict] = {}
        for r in met.toArrow().to_pylist():     # a row per node of the trees in work
            splits.setdefault((r["unit"], r["node"]), {})[r["place"]] = r
        plan.destroy()
        return splits

    def _grow(self, unit: _Unit, node: int, found: dict) -> None:
        """The split of a node; if its rows were sent for it, those of all below it."""
        todo, whole = [(node, 1)], self.models[unit.model].kind == "boosted" and node in unit.sent
        for node, place in todo:
            self._apply(unit, node, found.get(place))
            if whole and unit.tree.feat[node] >= 0:
                sides = (unit.tree.left[node], unit.tree.right[node])
                todo += [(child, 2 * place + k) for k, child in enumerate(sides) if child in unit.open]

    def _apply(self, unit: _Unit, node: int, split) -> None:
        depth, _ = unit.open.pop(node)
        model, tree = self.models[unit.model], unit.tree
        if split is None:                       # no row came here
            return
        self._weigh(model, tree, node, split["total"])
        if split["feat"] < 0:
            return
        tree.feat[node], tree.cut[node], tree.gain[node] = split["feat"], split["cut"], split["gain"]
        sides = (split["inside"], [t - i for t, i in zip(split["total"], split["inside"], strict=True)])
        children = []
        for side in sides:
            child = tree.add()
            children.append(child)
            self._weigh(model, tree, child, side)
            if depth + 1 < model.params["max_depth"] and may_split(model.kind, model.params, side):
                unit.open[child] = (depth + 1, int(side[2]) if model.kind == "forest" else self._share(split, side))
        tree.left[node], tree.right[node] = children

    @staticmethod
    def _share(split, side) -> int | None:
        """About how many rows go to a side of a boosted node; nothing where four times ``GROW_ROWS`` could be too few."""
        return int(split["rows"] * side[1] / split["total"][1]) if split["rows"] <= 4 * GROW_ROWS and split["total"][1] > 0 else None

    def _weigh(self, model: Ensemble, tree: Tree, node: int, sums) -> None:
        if model.kind == "boosted":
            tree.val[node], tree.cover[node] = leaf_value(sums[0], sums[1], model.params), sums[1]
        else:
            negative, positive = self.data.class_counts(model.hold_out)
            a, b = sums[0] / max(1, negative), sums[1] / max(1, positive)
            tree.val[node], tree.cover[node] = (b / (a + b) if a + b > 0 else 0.0), (a + b) * (negative + positive) / 2

    def _pin(self) -> None:
        """Adds the finished trees to the stored margins (one pass and one checkpoint)."""
        fresh = {m: [t.arrays() for t in self.models[m].trees[self.pinned[m]:]] for m in self.boosted}
        n_feats, n_models = len(self.data.feats), len(self.boosted)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for types, *keys, bins, margins in _from_blocks(batches, n_feats, n_models):
                now = margins.copy()
                for k, trees in enumerate(fresh.values()):
                    for t in trees:
                        now[:, k] += t[4][walk(t, bins)]
                yield _block(types, [*keys, bins, now])

        self.rows = cut_lineage(self.rows.mapInArrow(add, BLOCKS))
        for m in fresh:
            self.pinned[m] = len(self.models[m].trees)


def train(data: Packed, models: list[Ensemble]) -> int:
    """Grows the trees of all ``models`` (with their parameters and held-out folds) over the same rows, level by level in
    common passes; the number of passes comes back. Models with a different number of levels move at their own pace. Where the
    rows fit a task, tasks grow whole models instead (``whole``): one pass."""
    from . import whole
    if whole.fits(data):
        whole.train(data, models)
        return 1
    job = _Job(data, models)
    job.run()
    return job.passes


# ------------------------------------------------------------------------------------------ models
@dataclass
class TreeModel:
    """A trained ensemble with the feature names and cut points it needs to score raw columns."""
    ensemble: Ensemble
    feats: list[str]
    edges: list[np.ndarray]

    @property
    def kind(self) -> str:
        return self.ensemble.kind

    def flattened(self) -> list[dict]:
        """Trees with thresholds beside bins: ``feat, cut, thr, left, right, cover, val`` (a forest's values divided by the
        number of trees), as the attribution reads them."""
        share = 1.0 if self.kind == "boosted" else 1.0 / max(1, len(self.ensemble.trees))
        return [{"feat": t.feat, "cut": t.cut, "left": t.left, "right": t.right, "cover": t.cover, "val": [v * share for v in t.val],
                 "thr": [float(self.edges[f][c]) if f >= 0 else 0.0 for f, c in zip(t.feat, t.cut, strict=True)]} for t in self.ensemble.trees]

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """Margin (boosted) or probability (forest) of rows of raw feature values."""
        bins = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.feats)), int)
        out = np.zeros(len(x))
        for t in self.ensemble.trees:
            a = t.arrays()
            out += a[4][walk(a, bins)]
        return out if self.kind == "boosted" else out / max(1, len(self.ensemble.trees))

    def score(self, df: DataFrame, out: str = "prob", margin: bool = False) -> DataFrame:
        """``df`` with the probability of class 1 (or the margin) in ``out``, per Arrow batch."""
        boosted, outputs, n = self.kind == "boosted", self.outputs, len(self.feats)

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            found = outputs(np.vstack(x.to_numpy()) if len(x) else np.zeros((0, n)))
            return pd.Series(1.0 / (1.0 + np.exp(-found)) if boosted and not margin else found)

        return df.withColumn(out, predict(matrix(self.feats)))

    def importance(self) -> np.ndarray:
        """Per feature: mean gain of its splits (boosted), or impurity decrease averaged over trees (forest); sums to 1."""
        n = len(self.feats)
        total, splits = np.zeros(n), np.zeros(n)
        for t in self.ensemble.trees:
            own = np.zeros(n)
            for f, g in zip(t.feat, t.gain, strict=True):
                if f >= 0:
                    own[f] += g
                    splits[f] += 1
            total += own / own.sum() if self.kind == "forest" and own.sum() > 0 else own
        if self.kind == "boosted":
            total = total / np.maximum(splits, 1)
        return total / total.sum() if total.sum() > 0 else total

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes as a table, one row each; the model can be reloaded anywhere the folder is shared."""
        nodes = [(i, k, *(a[k] for a in (t.feat, t.cut, t.left, t.right)), *(float(a[k]) for a in (t.val, t.cover, t.gain)))
                 for i, t in enumerate(self.ensemble.trees) for k in range(len(t.feat))]
        spark.createDataFrame(nodes, "tree int, node int, feat int, cut int, left int, right int, val double, cover double, gain double").write.mode("overwrite").parquet(f"{path}/nodes")
        about = [(self.kind, {k: float(v) for k, v in self.ensemble.params.items()}, self.ensemble.seed, self.feats, [[float(v) for v in e] for e in self.edges])]
        spark.createDataFrame(about, "kind string, params map<string,double>, seed int, feats array<string>, edges array<array<double>>").write.mode("overwrite").parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TreeModel:
        about = spark.read.parquet(f"{path}/about").first()
        ensemble = Ensemble(about["kind"], dict(about["params"]), None, about["seed"])
        for r in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toLocalIterator():     # the model's size
            if r["node"] == 0:
                ensemble.trees.append(Tree([], [], [], [], [], [], []))
            t = ensemble.trees[-1]
            for a, c in ((t.feat, "feat"), (t.cut, "cut"), (t.left, "left"), (t.right, "right"), (t.val, "val"), (t.cover, "cover"), (t.gain, "gain")):
                a.append(r[c])
        return TreeModel(ensemble, about["feats"], [np.array(e) for e in about["edges"]])


def held_out_scores(data: Packed, models: list[Ensemble]) -> DataFrame:
    """``model, label, prob``: every model's scores of the fold it has not seen (``model`` is its place in the list)."""
    trees = [(m.hold_out, m.kind, [t.arrays() for t in m.trees]) for m in models]
    n_feats = len(data.feats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            _, label, fold, bins = _read(b, n_feats)
            for k, (hold_out, kind, own) in enumerate(trees):
                rows = np.flatnonzero(fold == hold_out)
                if len(rows):
                    out = np.zeros(len(rows))
                    for t in own:
                        out += t[4][walk(t, bins[rows])]
                    prob = 1.0 / (1.0 + np.exp(-out)) if kind == "boosted" else out / max(1, len(own))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, dtype=np.int32)), pa.array(label[rows].astype(np.int32)), pa.array(prob)], names=["model", "label", "prob"])

    return data.rows.mapInArrow(run, "model int, label int, prob double")


def search(data: Packed, kind: str, candidates: list[dict], folds: int = 5) -> tuple[list[float], int]:
    """M7: mean held-out ROC-AUC of every candidate over all folds (exact, ties count half), and the number of passes.
    Where the rows fit a task, candidates and folds are grown side by side by tasks, else in common passes, as many at once as
    keep ``HELD_NODES``; their trees are forgotten once the held-out rows are scored."""
    from . import whole
    from .evaluation import roc_auc

    models = [Ensemble(kind, c, f) for c in candidates for f in range(folds)]
    if whole.fits(data):
        found, passes = whole.held_out_scores(data, models), 1
    else:
        found, passes, first = None, 0, 0
        for some in _some_at_once(models, sum(data.counts.values())):
            passes += train(data, some)
            scored = cut_lineage(held_out_scores(data, some).withColumn("model", F.col("model") + F.lit(first)))
            found, first = scored if found is None else found.unionByName(scored), first + len(some)
            for m in some:
                m.trees.clear()
    scores = cut_lineage(found.withColumn("model", F.col("model").cast("string")))
    auc = {int(r["model"]): r["roc_auc"] for r in roc_auc(scores).select("model", "roc_auc").collect()}     # candidates x folds
    return [float(np.mean([auc[c * folds + f] for f in range(folds)])) for c in range(len(candidates))], passes


def _some_at_once(models: list[Ensemble], rows: int) -> Iterator[list[Ensemble]]:
    """The models in groups (one at least) of at most ``HELD_NODES`` nodes."""
    some, held = [], 0
    for m in models:
        most = int(m.params["n_estimators"]) * min(2 ** (m.params["max_depth"] + 1), 2 * rows)
        if some and held + most > HELD_NODES:
            yield some
            some, held = [], 0
        some.append(m)
        held += most
    if some:
        yield some
