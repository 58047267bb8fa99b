"""MinHash near-duplicates by an LSH forest: sorted signature orders, neighbours by longest common prefix.

1. Each text's distinct word shingles are hashed; texts with equal sets form a class with one
   representative, so a large group of copies is one row from here on.
2. Every representative has ``VALUES`` minhash values. ``TREES`` orders sort the representatives by the
   values from a different starting place. Candidates are rows close to each other that share at least
   ``DEPTH`` leading values: all of a region of up to ``NEIGHBOURS`` more rows; in a denser one the ``NEAREST``
   which share the longest prefix, so the depth adapts to how dense a region is.
3. Candidates whose signatures agree too little are dropped (five standard deviations below the
   threshold), the others are confirmed on full sets: first each with hubs of its candidate component, then
   all pairs that the hubs have not connected.
4. Dense regions that still hold several components are finished exactly: every row outside its region's largest
   component is compared, on full sets, with every row of a dense region in another component. Blocks of them
   of bounded size are indexed by shingle; only links leave a task, one per row and component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NARROW_ROWS, bounded_batches, byte_words, written
from .components import components
from .shingles import WordHasher, mix, shingle_set

TREES, OWN, DEPTH, NEIGHBOURS, NEAREST = 20, 6, 3, 8, 1
KEY_VALUES = 12                       # values in a row's sort key, two bytes each
VALUES = TREES * OWN
PERCENT = 80
HUB_ROUNDS = 2
BLOCK_SHINGLES = 2_000_000            # of the rows that one pass over the dense regions is compared with
SKETCH_SCHEMA = "doc_id long, n_shingles long, print binary, signature binary"


def least_agreement(percent: int) -> float:
    """Signature agreement that a pair at the threshold misses with five standard deviations."""
    p = percent / 100
    return p - 5 * (p * (1 - p) / VALUES) ** 0.5


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:VALUES] >> np.uint64(32)).astype(np.uint32), ((seeds[VALUES:] >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum of every hash function over the shingles (32-bit values)."""
    xor, mul = _parameters()
    out = np.full(VALUES, 0xFFFFFFFF, dtype=np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(low), 2048):
        x = (low[k:k + 2048, None] ^ xor[None, :]) * mul
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        np.minimum(out, x.min(axis=0), out=out)
    return out


def _sketcher(width: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            n, prints, signatures = [], [], []
            for text in batch.column(1):
                s = shingle_set(hasher.hashes(byte_words(text.as_py())), width)
                n.append(len(s))
                prints.append(_print(s) if len(s) else None)
                signatures.append(signature(s).astype(">u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(signatures, pa.binary())],
                                             names=["doc_id", "n_shingles", "print", "signature"])
    return sketch


def _print(shingles: np.ndarray) -> bytes:
    import xxhash
    return xxhash.xxh3_128_digest(shingles.tobytes())


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, print`` (128-bit fingerprint of the set), ``signature`` per row."""
    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketcher(width), SKETCH_SCHEMA)


def _set_maker(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                ids, found = [], []
                for i, mark, text in zip(*(batch.column(c).slice(k, 256) for c in range(3)), strict=True):
                    s = shingle_set(hasher.hashes(byte_words(text.as_py())), width)
                    if _print(s) == mark.as_py():          # not another text under the same doc_id
                        ids.append(i.as_py())
                        found.append(s.view(np.int64))
                if ids:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                    values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), values], names=["id", "shingles"])
    return sets


def _orders(reps: DataFrame) -> DataFrame:
    """``tree, key, id``: every representative once per tree; the key holds the leading values' first bytes."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take = (np.arange(TREES)[:, None] * OWN + np.arange(KEY_VALUES)[None, :]) % VALUES
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                ids, raw = batch.column(0).slice(k, 1024), batch.column(1).slice(k, 1024)
                n = len(ids)
                if not n:
                    continue
                # the low half of a value: its high half is near 0 in every minimum of many
                half = np.frombuffer(b"".join(raw.to_pylist()), dtype=">u4").reshape(n, VALUES).astype(np.uint32)
                half = (half ^ (half >> 16)).astype(np.uint16)
                data = np.ascontiguousarray(half[:, take].astype(">u2")).tobytes()
                size = KEY_VALUES * 2
                offsets = pa.array(np.arange(0, n * TREES * size + 1, size, dtype=np.int32))
                column = pa.Array.from_buffers(pa.binary(), n * TREES, [None, offsets.buffers()[1], pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), column, pa.array(np.repeat(ids.to_numpy(zero_copy_only=False), TREES), pa.int64())],
                                                 names=["tree", "key", "id"])
    return reps.select("id", "signature").mapInArrow(keys, "tree int, key binary, id long")


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows -> candidate pairs (``kind`` 0), the rows at both ends (``kind`` -1 first, 1 last), rows of a region
    wider than the window (``kind`` 2), and the rows of the first and the last region (``kind`` 3, their number in ``place``)."""
    lead, window = DEPTH * 2, NEIGHBOURS
    recent: list[tuple] = []          # the last rows, at most `window`
    head = 0
    region, size, first = None, 0, True
    for pdf in batches:
        kinds, trees, keys, lefts, rights, places = [], [], [], [], [], []

        def put(kind, tree, key, left, right, place):
            for c, v in zip((kinds, trees, keys, lefts, rights, places), (kind, tree, key, left, right, place), strict=True):
                c.append(v)      # noqa: B023

        for part, tree, key, doc in zip(pdf["part"], pdf["tree"], pdf["key"], pdf["id"], strict=True):
            if head < window:
                put(-1, tree, key, part, doc, head)
                head += 1
            prefix, near = key[:lead], []
            if (tree, prefix) != region:
                if region and first:
                    put(3, *region, 0, 0, size)
                    first = False
                region, size = (tree, prefix), 0
            size += 1
            for t, k, d, _ in reversed(recent):
                if t != tree or k[:lead] != prefix:
                    break
                near.append(d)
            dense = len(near) == window
            for d in near[:NEAREST] if dense else near:
                if d != doc:
                    put(0, tree, None, min(d, doc), max(d, doc), 0)
            if dense:
                put(2, tree, prefix, doc, doc, 0)
            recent.append((tree, key, doc, part))
            if len(recent) > window:
                recent.pop(0)
        yield pd.DataFrame({"kind": kinds, "tree": trees, "key": keys, "left": lefts, "right": rights, "place": places})
    if recent:
        yield pd.DataFrame([(3, *region, 0, 0, size)] + [(1, t, k, p, d, len(recent) - 1 - j) for j, (t, k, d, p) in enumerate(recent)], columns=["kind", "tree", "key", "left", "right", "place"])


def _candidates(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs ``a, b``; rows of dense regions ``tree, key, id``)."""
    # every task gets one contiguous piece of the orders; its number is the place among the pieces
    dealt = orders.repartitionByRange("tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    got = written(dealt.withColumn("part", F.spark_partition_id().cast("long"))
                  .mapInPandas(_neighbours, "kind int, tree int, key binary, left long, right long, place int"), "forest-pairs", NARROW_ROWS)
    inside = got.where("kind = 0").select(F.col("left").alias("a"), F.col("right").alias("b"))
    # across the border of two pieces: the last rows of one with the first rows of the next
    last = got.where("kind = 1").select("tree", F.substring("key", 1, DEPTH * 2).alias("lead"), F.col("left").alias("part"), F.col("right").alias("x"), F.col("place").alias("p"))
    first = got.where("kind = -1").select("tree", F.substring("key", 1, DEPTH * 2).alias("lead"), (F.col("left") - 1).alias("part"), F.col("right").alias("y"), F.col("place").alias("q"))
    border = last.join(first, ["part", "tree", "lead"]).where((F.col("p") + F.col("q") < NEIGHBOURS) & (F.col("x") != F.col("y"))).select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    inner = got.where("kind = 2").select("tree", F.col("key").alias("lead"))
    over = got.where("kind = 3").groupBy("tree", F.col("key").alias("lead")).agg(F.sum("place").alias("n")).where(F.col("n") > NEIGHBOURS).select("tree", "lead")
    dense = inner.unionByName(over).distinct()
    return inside.unionByName(border).distinct(), dense


def _agreeing(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures agree enough to be worth the exact test."""
    least = least_agreement(percent)

    @F.pandas_udf("double")
    def agreement(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        out = []
        for k in range(0, len(x), 4096):
            a = np.frombuffer(b"".join(x[k:k + 4096]), dtype=">u4").reshape(-1, VALUES)
            b = np.frombuffer(b"".join(y[k:k + 4096]), dtype=">u4").reshape(-1, VALUES)
            out.append((a == b).mean(axis=1))
        return pd.Series(np.concatenate(out))

    s = reps.select("id", "signature", "n_shingles")
    left = s.select(F.col("id").alias("a"), F.col("signature").alias("_x"), F.col("n_shingles").alias("_n"))
    right = s.select(F.col("id").alias("b"), F.col("signature").alias("_y"), F.col("n_shingles").alias("_m"))
    return (pairs.join(left, "a").join(right, "b")
            .where(100 * F.least("_n", "_m") >= percent * F.greatest("_n", "_m"))     # sizes alone can rule a pair out
            .withColumn("_e", agreement("_x", "_y")).where(F.col("_e") >= least).select("a", "b"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on full sets."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    return (pairs.join(left, "a").join(right, "b").withColumn("_both", both)
            .where(100 * F.col("_both") >= percent * (F.size("_x") + F.size("_y") - F.col("_both"))).select("a", "b"))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links that connect whatever ``pairs`` connects when confirmed, most pairs left unread."""
    label = components(pairs)
    todo, found = label, None
    for round_ in range(HUB_ROUNDS):
        hub = todo.groupBy("component").agg(F.min("id").alias("hub"))
        star = todo.join(hub, "component").select(F.col("hub").alias("a"), F.col("id").alias("b"))
        linked = written(confirm(star.where("a <> b"), sets, percent), f"hub-links-{round_}")
        found = linked if found is None else found.unionByName(linked)
        tied = linked.select(F.col("b").alias("id")).unionByName(star.where("a = b").select(F.col("b").alias("id")))
        todo = written(todo.join(tied, "id", "left_anti"), f"hub-left-{round_}")
    # a doc with a hub carries the hub's id, others their own
    hubs = found.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("hub"))
    side = lambda c: hubs.select(F.col("id").alias(c), F.col("hub").alias(f"_{c}"))
    rest = (pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
            .where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b"))
    return found.unionByName(confirm(rest, sets, percent))


def _block_index(block: pa.Table) -> tuple[np.ndarray, ...]:
    """``id, component, shingles`` rows -> ids, components, set sizes, the distinct shingles in order, and for each where its
    rows start in the last array (row numbers by shingle)."""
    lists = block.column("shingles").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy()
    order = np.argsort(values, kind="stable")
    known, starts = np.unique(values[order], return_index=True)
    rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
    return (block.column("id").to_numpy(), block.column("component").to_numpy(), sizes, known, np.append(starts, len(values)), rows)


def _linker(index: tuple[np.ndarray, ...], percent: int):
    """Links of ``id, component, shingles`` rows with the rows of a block, exactly; one per block row and component."""
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, components_, sizes, known, starts, rows = index
        seen: dict[int, np.ndarray] = {}          # component -> block rows that are linked with it
        for batch in batches:
            a, b = [], []
            for i, c, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = values.values.to_numpy()
                place = np.minimum(np.searchsorted(known, x), len(known) - 1)
                place = place[known[place] == x]
                if 100 * len(place) < percent * len(x):      # too few shingles in the whole block for any link
                    continue
                lengths = starts[place + 1] - starts[place]
                at = np.repeat(starts[place] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
                both = np.bincount(rows[at], minlength=len(ids))
                linked = (100 * both >= percent * (sizes + len(x) - both)) & (components_ != c)
                if c in seen:
                    linked &= ~seen[c]
                found = np.flatnonzero(linked)
                if len(found):
                    seen[c] = seen[c] | linked if c in seen else linked
                    a += np.minimum(ids[found], i).tolist()
                    b += np.maximum(ids[found], i).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return link


def _dense_links(docs: DataFrame, classes: DataFrame, rows: DataFrame, label: DataFrame, width: int, percent: int) -> DataFrame | None:
    """Links ``a, b`` between components of the dense regions (``rows``: ``tree, lead, id``): of each row outside a region's
    largest component with every component that it links with. None where nothing is left to compare."""
    named = written(rows.join(label, "id", "left").withColumn("component", F.coalesce("component", "id")), "dense-rows")
    sizes = named.groupBy("tree", "lead", "component").agg(F.count("*").alias("n"))
    top = sizes.groupBy("tree", "lead").agg(F.max_by("component", F.struct("n", "component")).alias("_top"), F.count("*").alias("_c")).where("_c > 1")
    mixed = written(named.join(top, ["tree", "lead"]).groupBy("id", "component").agg(F.max(F.col("component") != F.col("_top")).alias("outside")), "dense-ids")
    if mixed.where("outside").isEmpty():
        return None
    sets = written(_sets_of(docs, classes, mixed.select("id"), width).join(mixed, "id").select("id", "component", "shingles", "outside"), "dense-sets")
    outside = sets.where("outside").select("id", "component", "shingles")
    blocks = int(outside.agg(F.sum(F.size("shingles"))).first()[0] // BLOCK_SHINGLES) + 1
    found = None
    for k in range(blocks):
        block = outside.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).toArrow()       # about BLOCK_SHINGLES shingles
        if block.num_rows:
            links = sets.select("id", "component", "shingles").mapInArrow(_linker(_block_index(block), percent), "a long, b long")
            links = written(links, f"dense-links-{k}")
            found = links if found is None else found.unionByName(links)
    return found


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs`` (``doc_id, text``).

    Texts are linked when 100 * intersection >= ``percent`` * union of their sets of distinct ``width``-word
    shingles (words: see ``byte_words``; fewer words: the whole sequence is one shingle). ``component_id`` is
    the least doc_id reachable by links, ``kept`` says whether it is the row's own.

    Null, empty and word-free texts have no shingle and link with nothing. Rows that repeat a doc_id are
    judged one by one, each by its own text. A null doc_id links with nothing, has a null component and is
    kept. Only ``doc_id`` and ``text`` are read. An empty table gives an empty result.
    """
    sketch = written(sketches(docs, width), "sketches")
    named = sketch.where("doc_id is not null and n_shingles > 0")
    # one row per distinct set; the number is pinned by writing it
    classes = written(named.groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
                      .withColumn("id", F.monotonically_increasing_id()), "classes")
    orders = _orders(classes)
    pairs, dense = _candidates(orders)
    pairs = written(_agreeing(pairs, classes, percent), "candidates")
    links = written(_links(pairs, _sets_of(docs, classes, _both_ends(pairs), width), percent), "confirmed")
    label = components(links)
    rows = orders.select("tree", F.substring("key", 1, DEPTH * 2).alias("lead"), "id").join(dense, ["tree", "lead"])
    found = _dense_links(docs, classes, rows, label, width, percent)
    if found is not None and not found.isEmpty():
        label = components(links.unionByName(found))
    # a component's name is the least doc_id in it
    grown = label.join(classes.select("id", "doc_id"), "id")
    names = grown.groupBy("component").agg(F.min("doc_id").alias("_name"))
    renamed = classes.select("print", "id", F.col("doc_id").alias("_rep")).join(label, "id", "left").join(names, "component", "left").select(
        "print", F.coalesce("_name", "_rep").alias("component_id"))
    linked = sketch.select("doc_id", "n_shingles", "print").join(renamed, "print", "left").withColumn(
        "component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return linked.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _both_ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()


def _sets_of(docs: DataFrame, classes: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``id, shingles`` (the full set) of the classes in ``ids``, made from their representatives' texts."""
    wanted = classes.select("id", "doc_id", "print").join(ids, "id", "left_semi")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id").select("id", "print", "text")
    return written(rows.mapInArrow(_set_maker(width), "id long, shingles array<long>"), "sets")
