"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

The benchmark is the stated query set; it is taken in blocks of bounded size, each against all documents.
For every item a 64-bit SimHash of its word shingles is made. In a document, windows of as many words as
the item has are fingerprinted with a running sum. Only windows that hold at least one shingle of some item
are looked at: all others have similarity 0. Fingerprints within ``RADIUS`` bits of an item's agree with it
in at least one of four 16-bit blocks up to ``RADIUS // 4`` bits, so the block index misses none. Candidates are
then compared exactly: weighted Jaccard of the two shingle multisets, a shingle weighing its characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, numbered
from .shingles import TextHasher, shingle_hashes

WIDTH, SIMILARITY, RADIUS = 5, 0.8, 20
BLOCK_CHARS = 16_000_000            # text of the benchmark items that one pass takes
_WORDS = re.compile(r"\w+")
_POP16 = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)
HITS = "doc_id long, item_id long, start_word long, n_words long, similarity double, distance int"


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores: marks glued to a word don't hide it."""
    return _WORDS.findall(text.lower()) if text else []


def fingerprint_sums(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Running sums (one row more than shingles) of each shingle's 64 signed weights."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
    out = np.zeros((len(shingles) + 1, 64), dtype=np.int64)
    np.cumsum((2 * bits - 1) * weights[:, None], axis=0, out=out[1:])
    return out


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Four 16-bit blocks per row of 64 sums."""
    return np.packbits((sums > 0).astype(np.uint8), axis=1).view(np.uint16)


def weighted_jaccard(a: Counter, b: Counter, weight: dict) -> float:
    """Sum of the lesser counts over sum of the greater counts, each times the shingle's weight."""
    both = sum(min(n, b[s]) * weight[s] for s, n in a.items() if s in b)
    total = sum(n * weight[s] for s, n in a.items()) + sum(n * weight[s] for s, n in b.items()) - both
    return both / total if total else 0.0


class ItemIndex:
    """One block of benchmark items, ready for search."""

    def __init__(self, items: list[tuple[int, str]]):
        hasher = TextHasher(_WORDS)
        self.items = []                                # (item_id, words, width, shingle counts)
        self.weight: dict[int, int] = {}
        by_size: dict[tuple[int, int], list[int]] = {}     # (words, width) -> items
        owners: dict[int, dict[int, set]] = {}         # width -> shingle -> sizes
        prints = []
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            width = min(WIDTH, len(words))
            sh = shingle_hashes(hasher.hashes(text), width)
            w = shingle_weights(words, width)
            self.weight.update(zip(sh.tolist(), w.tolist(), strict=True))
            for s in sh.tolist():
                owners.setdefault(width, {}).setdefault(s, set()).add(len(words))
            by_size.setdefault((len(words), width), []).append(len(self.items))
            self.items.append((item_id, len(words), width, Counter(sh.tolist())))
            prints.append(fingerprints(fingerprint_sums(sh, w)[-1:])[0])
        self.prints = np.array(prints, dtype=np.uint16).reshape(-1, 4)
        self.by_size = {k: np.array(v) for k, v in by_size.items()}
        self.owners = owners
        self.known = {}                                # width -> (bitmap, sorted shingles)
        for width, table in owners.items():
            s = np.array(sorted(table), dtype=np.uint64)
            bitmap = np.zeros(1 << 20, dtype=bool)
            bitmap[s >> np.uint64(44)] = True
            self.known[width] = bitmap, s
        self._near: dict[tuple, np.ndarray] = {}

    def near_blocks(self, size: tuple[int, int], block: int, value: int) -> np.ndarray:
        """Items of this size whose block lies within RADIUS // 4 bits of ``value``; looked up once per value."""
        key = (size, block, value)
        if key not in self._near:
            if len(self._near) > 200_000:
                self._near.clear()
            ids = self.by_size[size]
            self._near[key] = ids[_POP16[self.prints[ids, block] ^ np.uint16(value)] <= RADIUS // 4]
        return self._near[key]

    def search(self, text: str, hashes: np.ndarray) -> list[tuple[int, int, int, float, int]]:
        """Best window per item: (item_id, start, words, similarity, distance). ``hashes``: those of the text's words."""
        best: dict[int, tuple] = {}
        words = None
        for width, (bitmap, known) in self.known.items():
            sh = shingle_hashes(hashes, width)
            if not len(sh):
                continue
            maybe = np.flatnonzero(bitmap[sh >> np.uint64(44)])
            place = np.minimum(np.searchsorted(known, sh[maybe]), len(known) - 1)
            at = maybe[known[place] == sh[maybe]]
            if not len(at):
                continue
            words = words or words_of(text)
            starts: dict[int, set] = {}
            for p in at.tolist():
                for n in self.owners[width][int(sh[p])]:
                    last = max(len(words) - n, 0)
                    starts.setdefault(n, set()).update(range(max(0, min(p - (n - width), last)), min(p, last) + 1))
            weights = shingle_weights(words, width)
            for n, places in starts.items():
                self._windows(best, (n, width), np.array(sorted(places)), sh, weights)
        return [(self.items[k][0], s, n, sim, d) for k, (sim, s, n, d) in best.items()]

    def _windows(self, best, size, places, sh, weights):
        n, width = size
        count = min(n - width + 1, len(sh))            # shingles in a window; a shorter text is one window
        # runs of places that lie close together share one running sum
        for run in np.split(places, np.flatnonzero(np.diff(places) > 4 * n) + 1):
            lo, hi = int(run[0]), int(run[-1]) + count
            sums = fingerprint_sums(sh[lo:hi], weights[lo:hi])
            prints = fingerprints(sums[run - lo + count] - sums[run - lo])
            found = []
            for place, fp in zip(run.tolist(), prints, strict=True):
                near = [self.near_blocks(size, b, v) for b, v in enumerate(fp.tolist())]
                if any(map(len, near)):
                    items = np.array(sorted(set().union(*(x.tolist() for x in near))))
                    distance = _POP16[self.prints[items] ^ fp].sum(axis=1)
                    found += [(int(d), place, int(k)) for d, k in zip(distance, items, strict=True) if d <= RADIUS]
            for d, place, k in sorted(found):
                if k in best and best[k][0] >= 1.0:
                    continue
                window = sh[place:place + count].tolist()
                weight = self.weight | dict(zip(window, weights[place:place + count].tolist(), strict=True))
                sim = weighted_jaccard(Counter(window), self.items[k][3], weight)
                if sim >= SIMILARITY and (k not in best or (-sim, place) < (-best[k][0], best[k][1])):
                    best[k] = (sim, place, n, d)


def shingle_weights(words: list[str], width: int) -> np.ndarray:
    """Characters in each run of ``width`` words."""
    size = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    return (size[width:] - size[:-width]).astype(np.int64)


def _finder(items: list[tuple[int, str]]):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, hasher = ItemIndex(items), TextHasher(_WORDS)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                hashes = hasher.hashes(text)
                if len(hashes):
                    doc = None if pd.isna(doc) else int(doc)
                    rows += [(doc, *hit) for hit in index.search(text, hashes)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start_word", "n_words", "similarity", "distance"]).astype({"doc_id": "Int64", "item_id": "Int64"})

    return find


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and benchmark item found in it: ``doc_id, item_id, start_word, n_words, similarity,
    distance`` (best window; ties: the first). Documents without a leak give no row.

    ``docs``: ``doc_id, text``; ``benchmark``: ``item_id, text``. Words are ``words_of``; an item of fewer than five
    words is one shingle and must occur as it is. A document shorter than an item is one window. Null or
    word-free texts and items match nothing. Rows that repeat a doc_id are searched each, items likewise. Null
    ids are kept as null. Empty tables give an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(total // block_chars) + 1
    numbered = items.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for block in range(blocks):
        part = [(r["item_id"], r["text"]) for r in numbered.where(F.col("_block") == block).collect()]   # about block_chars characters
        if part:
            hits = rows.mapInPandas(_finder(part), HITS)
            found = hits if found is None else found.unionByName(hits)
    return found if found is not None else spark.createDataFrame([], HITS)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found, each judged by its own text."""
    rows = numbered(docs, "leak-rows")
    leaked = find_leaks(rows.select(F.col("_row").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(leaked, "_row", "left_anti").select(*docs.columns)
