"""Order statistics by radix selection: the value (or row key) at given ranks, without a sort, a window or a join.

Whole numbers are counted in buckets of equal width; only the buckets that hold a wanted rank are counted again, more
finely, until they hold one value. Every round is one partial aggregate over a narrow checkpointed table, and what reaches
the driver is bounded by ranks x ``BUCKETS``. A value that a third of the rows share is one counter. Splits and folds
become literal cutoffs: a plain filter, as wide as the table is.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

BUCKETS = 1 << 14


@dataclass
class _Target:
    group: object
    rank: int                   # rows still to skip
    place: int
    found: list[int] = field(default_factory=list)
    low: int = 0
    high: int = 0


def order_rows(df: DataFrame, keys: list[Column], ranks: Callable[[object, dict], list[int]], by: Column | None = None) -> dict:
    """``{group: (rows, [key or None])}``: the row keys (tuples of whole numbers) at the ranks ``ranks(group, counts)``, counted
    from 0 in the order of ``keys`` among the rows of each group; ``counts`` has the rows of all groups. Ranks that no row has
    give None. ``by`` has few values (labels). Rows with a null key are left out. An empty table gives an empty result."""
    names = [f"_k{i}" for i in range(len(keys))]
    group = F.lit(0) if by is None else by
    narrow = df.select(group.alias("_g"), *[k.cast("long").alias(n) for k, n in zip(keys, names, strict=True)]).na.drop(subset=names)
    narrow = cut_lineage(narrow)
    first = narrow.groupBy("_g").agg(F.count("*").alias("n"), F.min(names[0]).alias("lo"), F.max(names[0]).alias("hi")).collect()      # one row per group
    counts, spans = {r["_g"]: r["n"] for r in first}, {(r["_g"],): (r["lo"], r["hi"]) for r in first}
    wanted = {g: ranks(g, counts) for g in counts}
    targets = [_Target(g, r, i) for g, rs in wanted.items() for i, r in enumerate(rs) if 0 <= r < counts[g]]
    for name in names:
        _select(narrow, names, name, targets, spans)
        spans = None
    out = {g: (n, [None] * len(wanted[g])) for g, n in counts.items()}
    for t in targets:
        out[t.group][1][t.place] = tuple(t.found)
    return out


def _inside(names: list[str], t: _Target) -> Column:
    """Rows of the target's group that share the key values found so far."""
    c = F.col("_g").eqNullSafe(F.lit(t.group))
    for n, v in zip(names, t.found, strict=False):
        c = c & (F.col(n) == F.lit(v).cast("long"))
    return c


def _select(rows: DataFrame, names: list[str], name: str, targets: list[_Target], spans: dict | None) -> None:
    """Finds the next key value of every target and counts its rank on among the rows with that value. ``spans``: the least
    and the greatest value of each scope, where they are known."""
    value = F.col(name)
    scopes: dict[tuple, list[_Target]] = {}
    for t in targets:
        scopes.setdefault((t.group, *t.found), []).append(t)
    if not scopes:
        return
    if spans is None:
        number = _numbered([_inside(names, ts[0]) for ts in scopes.values()])
        found = rows.select(number.alias("_i"), value).where("_i IS NOT NULL").groupBy("_i").agg(F.min(name).alias("lo"), F.max(name).alias("hi")).collect()
        keys = list(scopes)
        spans = {keys[r["_i"]]: (r["lo"], r["hi"]) for r in found}
    for scope, ts in scopes.items():
        for t in ts:
            t.low, t.high = spans[scope]
    todo = [t for t in targets if t.low < t.high]
    while todo:
        ranges: dict[tuple, list[_Target]] = {}
        for t in todo:
            ranges.setdefault((t.group, *t.found, t.low, t.high), []).append(t)
        heads = [ts[0] for ts in ranges.values()]
        widths = [-(-(t.high - t.low + 1) // BUCKETS) for t in heads]
        inside = [_inside(names, t) & value.between(F.lit(t.low).cast("long"), F.lit(t.high).cast("long")) for t in heads]
        bucket = None
        for c, t, w in zip(inside, heads, widths, strict=True):
            at = F.floor((value - F.lit(t.low).cast("long")) / F.lit(w)) if w < 1 << 40 else F.expr(f"({name} - ({t.low}L)) DIV {w}L")
            bucket = F.when(c, at) if bucket is None else bucket.when(c, at)
        counted = rows.select(_numbered(inside).alias("_i"), bucket.alias("_b"), value).where("_i IS NOT NULL").groupBy("_i", "_b").agg(
            F.count("*").alias("n"), F.min(name).alias("lo"), F.max(name).alias("hi")).collect()
        for i, ts in enumerate(ranges.values()):
            buckets = sorted((r["lo"], r["hi"], r["n"]) for r in counted if r["_i"] == i)
            for t in ts:
                for low, high, n in buckets:
                    if t.rank < n:
                        t.low, t.high = low, high
                        break
                    t.rank -= n
        todo = [t for t in todo if t.low < t.high]
    for t in targets:
        t.found.append(t.low)


def _numbered(conditions: list[Column]) -> Column:
    out = None
    for i, c in enumerate(conditions):
        out = F.when(c, F.lit(i)) if out is None else out.when(c, F.lit(i))
    return out


def at_or_before(keys: list[Column], row: tuple) -> Column:
    """Whether a row's keys come at or before ``row`` in their order."""
    lits = [F.lit(v).cast("long") for v in row]
    out = keys[-1] <= lits[-1]
    for k, v in zip(keys[-2::-1], lits[-2::-1], strict=True):
        out = (k < v) | ((k == v) & out)
    return out


def part_of(keys: list[Column], cuts: dict, by: Column | None = None, otherwise: int = 0) -> Column:
    """The number of the first cut at or after a row (the number of cuts if none), from ``order_rows``. Cuts that no row has
    are empty parts."""
    out = None
    for g, (_, rows) in cuts.items():
        own = F.lit(True) if by is None else by.eqNullSafe(F.lit(g))
        for i, row in enumerate(rows):
            if row is not None:
                c = own & at_or_before(keys, row)
                out = F.when(c, F.lit(i)) if out is None else out.when(c, F.lit(i))
        out = F.when(own, F.lit(len(rows))) if out is None else out.when(own, F.lit(len(rows)))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def interpolated_quantile(df: DataFrame, value: Column, q: float) -> float | None:
    """Exact linearly interpolated quantile of a whole-number column; None without values."""
    found = order_rows(df, [value], lambda _, n: [math.floor(q * (n[0] - 1)), math.ceil(q * (n[0] - 1))])
    if not found:
        return None
    n, (low, high) = found[0]
    at = q * (n - 1)
    return low[0] + (high[0] - low[0]) * (at - math.floor(at))
