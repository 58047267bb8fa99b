"""Merkle dataset manifest: one hash tree per language, its subroots under one root, a proof per row.

1. Rows become leaves (sha256 of their fields, as SQL functions) in a narrow table; ``repartitionByRange`` and
   per-partition counts give every leaf its place in its language, so no task sorts a whole language.
2. A superblock is ``8 ** 4`` neighbouring leaves, one node four levels up. Superblocks are reduced to their top nodes,
   the top nodes form a layer of superblocks of their own, and so on to the subroot: each layer has 1/4096 of the nodes
   of the one below. The subroots are the leaves of the root tree, grown in the same way.
3. From the top down each layer is cogrouped by superblock with the outer nodes it needs (the siblings above its top
   node): the group reduces its nodes again, joins its own siblings to the outer ones and hands them to the layer below.
4. The leaves are cogrouped with their superblock's outer nodes: local reduction, proof and folding happen together.

A group holds at most 4096 nodes and seven siblings a level, however large a language is.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FANOUT, LOCAL_LEVELS = 8, 4
SUPERBLOCK = FANOUT ** LOCAL_LEVELS
ROOT_LEVEL = 1000           # level numbers of the root tree begin here; subtrees stay below
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODE = "tree string, pos long, total long, hash string"
OUTER = "tree string, pos long, level int, own int, before string, after string"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(name: str) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, ``:`` and the value."""
    value = F.col(name).cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_hash(text: str = "text") -> Column:
    return F.sha2(F.concat(*[field(c) for c in ("doc_id", "source", "lang", "n_chars", text)]), 256)


def positions(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``pos`` (from 0, in the order of ``order``, within ``tree``) and ``total`` (rows of the tree). ``order``
    must hold a unique column. Partition k of the dealt rows precedes partition k + 1, so a row's place is its place in
    the partition plus the rows of its tree in earlier ones."""
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    dealt = written(dealt.withColumn("_part", F.shiftright("_id", 33)), f"{name}-dealt")
    parts = dealt.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    # a tree has at most one row per partition here
    earlier = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(parts.select("tree", "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
                                   F.sum("_n").over(Window.partitionBy("tree")).alias("total")), f"{name}-offsets")
    return dealt.join(offsets, ["tree", "_part"]).withColumn("pos", F.col("_id") + F.col("_shift")).drop("_id", "_part", "_shift")


def local_levels(hashes: list[str], total: int) -> list[list[str]]:
    """The levels of a superblock of a layer with ``total`` nodes, its own nodes first: reduced to one node, which is
    four levels up, or the root of the layer's tree if that is nearer."""
    levels = [hashes]
    while total > 1 and len(levels) <= LOCAL_LEVELS:
        below = levels[-1]
        levels.append([digest(*below[k:k + FANOUT]) for k in range(0, len(below), FANOUT)])
        total = -(-total // FANOUT)
    return levels


def siblings(levels: list[list[str]], k: int) -> list[tuple[int, str, str]]:
    """Per level the place of node ``k``'s ancestor in its run, and the hashes before and after it there."""
    out = []
    for nodes in levels[:-1]:
        own, start = k % FANOUT, k - k % FANOUT
        out.append((own, "".join(nodes[start:k]), "".join(nodes[k + 1:start + FANOUT])))
        k //= FANOUT
    return out


def fold(value: str, steps) -> str:
    for before, after in steps:
        value = digest(before, value, after)
    return value


def _top(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("pos")
    tree, pos, total = group["tree"].iloc[0], int(group["pos"].iloc[0]), int(group["total"].iloc[0])
    return pd.DataFrame({"tree": [tree], "pos": [pos // SUPERBLOCK], "total": [-(-total // SUPERBLOCK)],
                         "hash": [local_levels(group["hash"].tolist(), total)[-1][0]]})


def _block() -> Column:
    return F.floor(F.col("pos") / SUPERBLOCK).alias("block")


def layers(nodes: DataFrame, name: str) -> list[DataFrame]:
    """``nodes`` (tree, pos, total, hash) and the layers above, up to one node per tree."""
    found = [nodes.select("tree", "pos", "total", "hash")]
    while (found[-1].agg(F.max("total").alias("n")).first()["n"] or 0) > 1:
        tops = found[-1].groupBy("tree", _block()).applyInPandas(_top, NODE)
        found.append(written(tops, f"{name}-layer{len(found)}"))
    return found


def _hand_down(first_level: int):
    """Outer nodes of a superblock -> outer nodes of each of its nodes: their siblings inside, then those outside."""
    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        if nodes.empty:
            return pd.DataFrame(columns=["tree", "pos", "level", "own", "before", "after"])
        nodes, outer = nodes.sort_values("pos"), outer.sort_values("level")
        levels = local_levels(nodes["hash"].tolist(), int(nodes["total"].iloc[0]))
        above = list(outer[["level", "own", "before", "after"]].itertuples(index=False, name=None))
        tree = nodes["tree"].iloc[0]
        rows = []
        for k, pos in enumerate(nodes["pos"].tolist()):
            rows += [(tree, pos, first_level + j, *step) for j, step in enumerate(siblings(levels, k))]
            rows += [(tree, pos, *step) for step in above]
        return pd.DataFrame(rows, columns=["tree", "pos", "level", "own", "before", "after"])
    return run


def outer_nodes(tree_layers: list[DataFrame], above: DataFrame, first_level: int, name: str, down_to: int) -> DataFrame:
    """Outer nodes of the nodes of layer ``down_to``, given those ``above`` the trees' roots (pos 0)."""
    outer = above
    for k in range(len(tree_layers) - 1, down_to - 1, -1):
        nodes = tree_layers[k]
        handed = nodes.groupBy("tree", _block()).cogroup(outer.groupBy("tree", F.col("pos").alias("block"))).applyInPandas(
            _hand_down(first_level + LOCAL_LEVELS * k), OUTER)
        outer = written(handed, f"{name}-outer{k}")
    return outer


def _prove(with_proof: bool):
    def run(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "lang", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + ["proof"] * with_proof
        if leaves.empty:
            return pd.DataFrame(columns=columns)
        leaves, outer = leaves.sort_values("pos"), outer.sort_values("level")
        own = leaves["hash"].tolist()
        levels = local_levels(own, int(leaves["total"].iloc[0]))
        steps = list(outer[["before", "after"]].itertuples(index=False, name=None))
        inner = int((outer["level"] < ROOT_LEVEL).sum())
        subroot = fold(levels[-1][0], steps[:inner])
        root = fold(subroot, steps[inner:])
        outside = "".join(b + a for b, a in steps)
        proofs, folded = [], []
        for k, seen in enumerate(leaves["seen"].tolist()):
            inside = [(b, a) for _, b, a in siblings(levels, k)]
            proofs.append("".join(b + a for b, a in inside) + outside)
            folded.append(fold(seen, inside + steps))
        out = pd.DataFrame({"doc_id": leaves["doc_id"], "lang": leaves["lang"], "leaf": own, "subroot": subroot, "root": root,
                            "proof_sha256": [digest(p) for p in proofs], "folded_root": folded,
                            "verified": [f == root for f in folded]})
        if with_proof:
            out["proof"] = [[p[i:i + 64] for i in range(0, len(p), 64)] for p in proofs]
        return out[columns]
    return run


def merkle_manifest(docs: DataFrame, seen_text: Column | None = None, with_proof: bool = False) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, source, lang, n_chars, text``): ``doc_id, lang, leaf, subroot, root,
    proof_sha256, folded_root, verified``, with ``with_proof`` also ``proof`` (the sibling hashes, leaf level first).

    ``leaf`` is the hash of the row; a language's leaves, by doc_id, are reduced in runs of eight to ``subroot`` (a lone
    leaf itself), the subroots by language (null first, then bytewise) to ``root``. ``seen_text`` is the text as it is
    found now: the row's leaf is computed from it and folded with the original siblings to ``folded_root``; ``verified``
    tells whether that is the root. Without it the rows are checked against themselves.

    Null fields count as ``-``; null doc_ids come first, rows without a language are a tree of their own. Rows with equal
    doc_id are ordered by leaf; repeated rows are leaves of their own. Empty and very long texts are hashed whole. An
    empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "n_chars", "text",
                       (F.col("text") if seen_text is None else seen_text).alias("_seen"))
    # a tree's key is never null and sorts as the language does, null first
    tree = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang")))
    leaf = leaf_hash()
    seen = leaf if seen_text is None else F.when(F.col("text").eqNullSafe(F.col("_seen")), leaf).otherwise(leaf_hash("_seen"))
    leaves = written(rows.select("doc_id", "lang", tree.alias("tree"), leaf.alias("hash"), seen.alias("seen"),
                                 F.monotonically_increasing_id().alias("_row")), "manifest-leaves")
    placed = written(positions(leaves, ["doc_id", "hash", "seen", "_row"], "manifest").drop("_row"), "manifest-placed")

    trees = layers(placed, "manifest")
    # the subroots are the leaves of one more tree, in the order of their trees
    tops = positions(trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "hash"), ["of"], "manifest-roots")
    tops = written(tops, "manifest-roots")
    roots = layers(tops, "manifest-root")
    empty = docs.sparkSession.createDataFrame([], OUTER)
    over_tops = outer_nodes(roots, empty, ROOT_LEVEL, "manifest-root", 0)
    over_roots = over_tops.join(tops.select("pos", "of"), "pos").select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("pos"), "level", "own", "before", "after")
    outer = outer_nodes(trees, over_roots, 0, "manifest", 1)
    schema = "doc_id string, lang string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    # as text: pandas would turn whole numbers beside a null into floating-point ones
    proved = placed.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("tree", _block()).cogroup(
        outer.groupBy("tree", F.col("pos").alias("block"))).applyInPandas(_prove(with_proof), schema + (", proof array<string>" if with_proof else ""))
    return proved.withColumn("doc_id", F.col("doc_id").cast("long"))


def lowered(text: str = "text") -> Column:
    """The text with A-Z in lower case."""
    return F.translate(text, UPPER, LOWER)


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """``merkle_manifest`` where the texts of rows with 3 | crc32(doc_id) have been put in lower case since."""
    hit = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 0
    return merkle_manifest(docs, F.when(hit, lowered()).otherwise(F.col("text"))).drop("lang")
