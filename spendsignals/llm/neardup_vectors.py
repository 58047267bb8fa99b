"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine >= c lie within epsilon = sqrt(2 - 2c) of each other.

1. Equal vectors of a label become one row with a multiplicity.
2. Vectors are rotated to principal axes; the grid cells (side epsilon) on the leading axes give the order
   by which they are sorted and cut into blocks. A block knows its bounds on these axes.
3. Sequence intervals are joined recursively: pairs of intervals split into pairs of quarters, and pairs
   whose bounds are farther apart than epsilon are dropped. Each level is one equi-join on interval numbers.
4. A pair of blocks is compared in one task, again in halves with bounds on all axes. It returns a count
   per vector and a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .components import components

COSINE = 0.93
AXES = 8                 # leading axes of the grid
BLOCK, LEAF = 1024, 128  # rows of a block, rows below which a comparison is not split further
COMPARE_ROWS = 8         # pairs of blocks in an Arrow batch (about 1 MB each)
SLACK = 1e-9             # rounding: never skip within this, recompute a cosine this near to the threshold


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)     # neither overflow nor underflow
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def comparable(vec: str = "embedding") -> Column:
    """Neither null nor empty nor zero; every component there and finite."""
    x = F.col(vec).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(F.col(vec).isNotNull() & (F.size(x) > 0) & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Per dimension the rotation to principal axes, from second moments over all rows (dim * dim numbers)."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims):
                u = _unit(_matrix(batch.column(1).filter(pa.array(dims == dim)), dim))
                sums[dim] = sums.get(dim, 0) + u.T @ u
        for dim, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, dim), pa.int32()), pa.array(np.arange(m.size), pa.int32()), pa.array(m.ravel())], names=["dim", "cell", "value"])

    got = classes.select("dim", "vec").mapInArrow(moments, "dim int, cell int, value double").groupBy("dim", "cell").agg(F.sum("value").alias("value"))
    axes: dict[int, np.ndarray] = {}
    for r in got.collect():
        axes.setdefault(r["dim"], np.zeros((r["dim"], r["dim"]))).flat[r["cell"]] = r["value"]
    return {dim: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy() for dim, m in axes.items()}


def _blocks(classes: DataFrame, axes: dict[int, np.ndarray], epsilon: float) -> DataFrame:
    """``label, dim, block, n, ids, weights, vecs`` and bounds ``lo, hi`` on the leading axes, in grid order."""
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            grid: list = [None] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                y = _unit(_matrix(batch.column("vec").take(pa.array(at)), dim)) @ axes[int(dim)][:, :AXES]
                for i, c in zip(at.tolist(), np.floor(y / epsilon).astype(np.int32).tolist(), strict=True):
                    grid[i] = c
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "dim", "id", "weight", "vec")), pa.array(grid, pa.list_(pa.int32()))],
                                             names=["label", "dim", "id", "weight", "vec", "cells"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, number = [], None, 0      # rows of the open block

        def close():
            nonlocal held, number
            label, dim = key
            raw = np.array([v for _, _, v in held], dtype="<f8")
            y = _unit(raw) @ axes[dim][:, :AXES]
            number += 1
            out = [[label], [dim], [number], [len(held)], [np.array([i for i, _, _ in held], dtype="<i8").tobytes()], [np.array([w for _, w, _ in held], dtype="<i8").tobytes()],
                   [raw.tobytes()], [y.min(axis=0).tolist()], [y.max(axis=0).tolist()]]
            held = []
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=["label", "dim", "block", "n", "ids", "weights", "vecs", "lo", "hi"])

        for batch in batches:
            for label, dim, i, w, vec in zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "id", "weight")), batch.column("vec").to_pylist(), strict=True):
                if held and ((label, dim) != key or len(held) == BLOCK):
                    yield close()
                key = (label, dim)
                held.append((i, w, vec))
        if held:
            yield close()

    schema = "label long, dim int, id long, weight long, vec array<double>"
    order = ["label", "dim", "cells", "id"]
    return written(classes.select("label", "dim", "id", "weight", "vec").mapInArrow(cells, schema + ", cells array<int>")
                   .repartitionByRange(*order).sortWithinPartitions(*order)
                   .mapInArrow(cut, "label long, dim int, block long, n int, ids binary, weights binary, vecs binary, lo array<double>, hi array<double>")
                   .withColumn("part", F.spark_partition_id()), "ego-blocks")


def _interval_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """``label, dim, a, b`` (a <= b): pairs of numbered blocks that may hold a link."""
    sides = [F.get(F.col(c), F.lit(k)).alias(f"{c[0]}{k}") for c in ("lo", "hi") for k in range(AXES)]
    leaves = blocks.select("label", "dim", "number", *sides)
    last = leaves.agg(F.max("number")).first()[0]
    levels = 0
    while last is not None and 4 ** levels <= last:
        levels += 1
    pairs = leaves.select("label", "dim").distinct().select("label", "dim", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for level in range(levels - 1, -1, -1):
        at = F.floor(F.col("number") / 4 ** level)
        kids = leaves.groupBy("label", "dim", at.alias("at")).agg(
            *[F.min(f"l{k}").alias(f"l{k}") for k in range(AXES)], *[F.max(f"h{k}").alias(f"h{k}") for k in range(AXES)])
        kids = kids.withColumn("up", F.floor(F.col("at") / 4))
        named = lambda s: kids.select("label", "dim", F.col("up").alias(s), F.col("at").alias(f"_{s}"), *[F.col(f"{x}{k}").alias(f"{s}{x}{k}") for x in "lh" for k in range(AXES)])  # noqa: E731, B023
        # a missing axis (fewer dimensions than axes) has null bounds and no gap
        gap = sum((F.coalesce(F.greatest(F.col(f"bl{k}") - F.col(f"ah{k}"), F.col(f"al{k}") - F.col(f"bh{k}"), F.lit(0.0)), F.lit(0.0)) ** 2 for k in range(AXES)), F.lit(0.0))
        pairs = (pairs.join(named("a"), ["label", "dim", "a"]).join(named("b"), ["label", "dim", "b"])
                 .where((F.col("_a") <= F.col("_b")) & (gap <= epsilon**2 + SLACK)).select("label", "dim", F.col("_a").alias("a"), F.col("_b").alias("b")))
        pairs = written(pairs, f"ego-pairs-{level}")
    return pairs


def _near(lo_a, hi_a, lo_b, hi_b, limit: float) -> bool:
    gap = np.maximum(np.maximum(lo_b - hi_a, lo_a - hi_b), 0)
    return float(gap @ gap) <= limit


def link_matrix(a: np.ndarray, b: np.ndarray, rotation: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of ``a`` link with which of ``b``; halves of both are joined recursively while bounds are near."""
    limit = 2 - 2 * cosine + SLACK
    ya, yb = _unit(a) @ rotation, _unit(b) @ rotation
    out = np.zeros((len(a), len(b)), dtype=bool)

    def bounds(y):
        return {(s, e): (y[s:e].min(axis=0), y[s:e].max(axis=0)) for s, e in _halves(len(y))}

    box_a, box_b = bounds(ya), bounds(yb)
    todo = [((0, len(a)), (0, len(b)))]
    while todo:
        p, q = todo.pop()
        if not _near(*box_a[p], *box_b[q], limit):
            continue
        if p[1] - p[0] > LEAF or q[1] - q[0] > LEAF:
            todo += [(x, y) for x in _split(p) for y in _split(q)]
            continue
        s = ya[slice(*p)] @ yb[slice(*q)].T
        hit = s >= cosine
        for i, j in np.argwhere(np.abs(s - cosine) < SLACK):
            x, y = a[p[0] + i], b[q[0] + j]
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            hit[i, j] = x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine
        out[slice(*p), slice(*q)] = hit
    return out


def _split(r):
    if r[1] - r[0] <= LEAF:
        return [r]
    m = (r[0] + r[1]) // 2
    return [(r[0], m), (m, r[1])]


def _halves(n):
    todo, out = [(0, n)], []
    while todo:
        r = todo.pop()
        out.append(r)
        if r[1] - r[0] > LEAF:
            todo += _split(r)
    return out


def forest(links: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Per row and per column of ``links`` the least node it is connected to (rows first, then columns)."""
    n, m = links.shape
    big = n + m
    rows, cols = np.arange(n), (np.arange(m) if same else n + np.arange(m))
    linked_r, linked_c = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
    sub = links[np.ix_(linked_r, linked_c)]
    while len(linked_r):
        r2 = np.minimum(rows[linked_r], np.where(sub, cols[linked_c][None, :], big).min(axis=1))
        c2 = np.minimum(cols[linked_c], np.where(sub, r2[:, None], big).min(axis=0))
        stable = (r2 == rows[linked_r]).all() and (c2 == cols[linked_c]).all()
        rows[linked_r], cols[linked_c] = r2, c2
        if same:
            rows = cols = np.minimum(rows, cols)
        if stable:
            break
    return rows, cols


def _compare(axes: dict[int, np.ndarray], cosine: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in ("dim", "a", "b", "ids_a", "weights_a", "vecs_a", "ids_b", "weights_b", "vecs_b")}
                dim, same = row["dim"], row["a"] == row["b"]
                ids = [np.frombuffer(row[f"ids_{s}"], dtype="<i8") for s in "ab"]
                weights = [np.frombuffer(row[f"weights_{s}"], dtype="<i8") for s in "ab"]
                vecs = [np.frombuffer(row[f"vecs_{s}"], dtype="<f8").reshape(-1, dim) for s in "ab"]
                links = link_matrix(*vecs, axes[dim], cosine)
                if same:
                    np.fill_diagonal(links, False)
                if not links.any():
                    continue
                rows, cols = forest(links, same)
                nodes = ids[0] if same else np.concatenate(ids)
                got = [(ids[0], links @ weights[1], nodes[rows])]
                if not same:
                    got.append((ids[1], links.T @ weights[0], nodes[cols]))
                for i, n, root in got:
                    some = n > 0
                    yield pa.RecordBatch.from_arrays([pa.array(i[some]), pa.array(n[some]), pa.array(root[some])], names=["id", "n", "root"])

    return compare


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors`` (``vec_id, embedding, label``).

    Vectors of equal, non-null label and equal dimension link when their cosine in double precision is at
    least ``cosine``. ``n_links`` counts the other rows linked directly, ``component_id`` is the least vec_id
    reachable, ``kept`` says whether it is the row's own.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or
    vec_id, link with nothing: 0 links, their own id, kept. Rows that repeat a vec_id are vectors of their own.
    Extra columns are ignored. An empty table gives an empty result.
    """
    epsilon = (2 - 2 * cosine) ** 0.5
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          F.when(comparable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.col("embedding").cast("array<double>")).alias("vec"))
    classes = written(rows.where("vec is not null").groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
                      .withColumns({"id": F.monotonically_increasing_id(), "dim": F.size("vec")}), "vector-classes")
    axes = principal_axes(classes)
    blocks = _blocks(classes, axes, epsilon)
    numbers = blocks.select("label", "dim", "part", "block", (F.row_number().over(Window.partitionBy("label", "dim").orderBy("part", "block")) - 1).cast("long").alias("number"))
    blocks = blocks.join(numbers, ["label", "dim", "part", "block"])
    pairs = _interval_pairs(written(blocks.select("label", "dim", "number", "lo", "hi"), "ego-bounds"), epsilon)
    side = lambda s: blocks.select("label", "dim", F.col("number").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "weights", "vecs")])
    found = written(pairs.join(side("a"), ["label", "dim", "a"]).join(side("b"), ["label", "dim", "b"])
                    .select("dim", "a", "b", "ids_a", "weights_a", "vecs_a", "ids_b", "weights_b", "vecs_b")
                    .mapInArrow(_compare(axes, cosine), "id long, n long, root long"), "ego-links", COMPARE_ROWS)
    label = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    names = label.join(classes.select("id", "rep"), "id").groupBy("component").agg(F.min("rep").alias("_name"))
    counts = found.groupBy("id").agg(F.sum("n").alias("_n"))
    known = (classes.join(counts, "id", "left").join(label, "id", "left").join(names, "component", "left")
             .select("label", "vec", (F.coalesce("_n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("_name", "rep").alias("_c")))
    out = rows.join(known, ["label", "vec"], "left").withColumn("component_id", F.coalesce("_c", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
                      F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
