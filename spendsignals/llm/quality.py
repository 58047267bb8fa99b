"""Quality rules with adaptive thresholds: quantile sketches per language and source instead of fixed cutoffs.

1. Each text is measured once (words, symbols, repeated lines, repeated five-word windows); the text goes no further.
2. A sketch is a histogram of integer measures over buckets whose width grows with the value (32 buckets per power of
   two, so a quantile is off by at most 1/32). Sketches merge by adding counts: Spark builds them as one partial
   aggregate, merges sources into their language and languages into all.
3. Quartiles read from the sketches give each language and source its own limits; a source with too few documents takes
   those of its language, a language with too few those of all.
4. The measures are joined with the limits and judged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT_ROWS, written

WINDOW = 5
BLOCK_BYTES = 4_000_000
SUB_BUCKETS = 32            # per power of two
MIN_DOCS = 200              # a group with fewer documents takes the merged sketch above it
REACH = 3                   # how many interquartile ranges a value may lie beyond the quartile
#: Measures per mille (letters a word: thousandths; shares: hundredths of a per cent) and the least range that counts as spread.
SPREAD = {"word_length": 500, "symbol_share": 300, "dup_line_share": 1500, "repeat_share": 600}
TWO_SIDED = ("word_length",)
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Deleted from UTF-8, what is left is one byte for every code point that is no white space.
_NO_POINT = bytes([0x20, *range(9, 14), *range(0x80, 0xC0)])
_SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def word_ids(raw: bytes) -> tuple[np.ndarray, int]:
    """The text's words as numbers (equal words, equal numbers), read in blocks cut at white space; and how many
    different ones there are."""
    known: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + BLOCK_BYTES) if at + BLOCK_BYTES < len(raw) else None
        end = cut.start() if cut else len(raw)
        parts.append(np.array([known.setdefault(w, len(known)) for w in raw[at:end].split()], dtype=np.int64))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64), len(known)


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more. Windows are numbered exactly: those of one word
    more are numbered by the pair (window, next word)."""
    if len(ids) <= width:
        return 0
    base = int(ids.max()) + 1
    window, counts = ids, None
    for k in range(1, width):
        _, window, counts = np.unique(window[:-1] * base + ids[k:], return_inverse=True, return_counts=True)
    twice = counts[window] > 1
    if not twice.any():
        return 0
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    edges[:-width] += twice
    edges[width:] -= twice
    return int((np.cumsum(edges[:-1]) > 0).sum())


def counts_of(raw: bytes) -> tuple[int, ...]:
    """``COUNTS`` of one UTF-8 text."""
    ids, different = word_ids(raw)
    lines, seen, repeated = 0, set(), 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            repeated += line in seen
            seen.add(line)
    return (len(ids), len(raw.translate(None, _NO_POINT)), len(raw) - len(raw.translate(None, _SYMBOLS)), lines, repeated,
            repeated_words(ids) if different < len(ids) else 0)


def _measurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([counts_of(t.as_py() or b"") for t in batch.column(3)], dtype=np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(np.ascontiguousarray(c)) for c in found.T)], names=["doc_id", "lang", "source", *COUNTS])


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and ``COUNTS`` per row, written once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("source").cast("string").alias("source"), F.col("text").cast("binary").alias("text"))
    counts = rows.mapInArrow(_measurer, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))
    return written(counts, "quality-counts", TEXT_ROWS)


def shares() -> dict[str, Column]:
    """The judged measures, in whole units; null for texts without words."""
    per = lambda n, of, unit: F.when(F.col(of) > 0, F.floor(F.col(n) * unit / F.col(of)))
    return {"word_length": per("word_chars", "n_words", 1000), "symbol_share": per("n_symbols", "n_words", 10000),
            "dup_line_share": per("n_dup_lines", "n_lines", 10000), "repeat_share": per("n_repeat_words", "n_words", 10000)}


def bucket(value: str) -> str:
    """SQL: the bucket of a whole number >= 0. Below 64 every number has its own; above, 32 per power of two."""
    shift = f"greatest(length(bin({value})) - 6, 0)"
    return f"CAST({SUB_BUCKETS} * {shift} + shiftright({value}, {shift}) AS BIGINT)"


def least_of(bucket_col: str) -> str:
    """SQL: the smallest number in a bucket."""
    e = f"CAST({bucket_col} DIV {SUB_BUCKETS} - 1 AS INT)"
    return f"CASE WHEN {bucket_col} < {2 * SUB_BUCKETS} THEN {bucket_col} ELSE shiftleft({bucket_col} - {SUB_BUCKETS} * {e}, {e}) END"


def sketches(measured: DataFrame) -> DataFrame:
    """``lang, source, measure, bucket, n``: the sketch of each language and source. Rows of one group are counted where
    they lie before they meet, so a hot source is a few hundred counters."""
    values = F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("v")) for k, v in shares().items()])
    long = measured.select("lang", "source", F.explode(values).alias("_m")).select("lang", "source", "_m.measure", "_m.v").where("v IS NOT NULL")
    return long.groupBy("lang", "source", "measure", F.expr(bucket("v")).alias("bucket")).agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """``by..., measure, docs, q1, q3`` of sketches merged to the groups ``by``."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "measure")          # a group has at most some hundred buckets
    ranked = merged.withColumn("_to", F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("_to") * 4 >= F.col("_all") * q, F.col("bucket")))
    return ranked.groupBy(*by, "measure").agg(F.max("_all").alias("docs"), at(1).alias("_b1"), at(3).alias("_b3")).select(
        *by, "measure", "docs", F.expr(least_of("_b1")).alias("q1"), F.expr(least_of("_b3")).alias("q3"))


def thresholds(sketch: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per language and source and measure the limits ``low`` and ``high``, wide: one row per group. A group under
    ``min_docs`` documents takes the sketch of its language, a language under it that of all."""
    sketch = written(sketch, "quality-sketches")
    own = quartiles(sketch, ["lang", "source"])
    lang = quartiles(sketch, ["lang"]).select(F.col("lang").alias("_l"), F.col("measure").alias("_lm"), F.col("docs").alias("_ld"), F.col("q1").alias("_l1"), F.col("q3").alias("_l3"))
    every = quartiles(sketch, []).select(F.col("measure").alias("_am"), F.col("q1").alias("_a1"), F.col("q3").alias("_a3"))      # one row per measure
    # one row per group: a language's rows are its sources
    both = own.join(lang, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("measure") == F.col("_lm"))).join(F.broadcast(every), F.col("measure") == F.col("_am"))
    pick = lambda k: F.when(F.col("docs") >= min_docs, F.col(f"q{k}")).when(F.col("_ld") >= min_docs, F.col(f"_l{k}")).otherwise(F.col(f"_a{k}"))
    least = F.element_at(F.create_map(*[F.lit(x) for kv in SPREAD.items() for x in kv]), F.col("measure"))
    spread = REACH * F.greatest(pick(3) - pick(1), least)
    limits = both.select("lang", "source", "measure", (pick(1) - spread).alias("low"), (pick(3) + spread).alias("high"))
    edge = lambda side, k: F.max(F.when(F.col("measure") == k, F.col(side))).alias(f"{k}_{side}")
    return written(limits.groupBy("lang", "source").agg(*[edge("high", k) for k in SPREAD], *[edge("low", k) for k in TWO_SIDED]), "quality-limits")


def judge(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, lang, source``, ``COUNTS``, ``base_failed``, ``failed`` (the measures outside their limits) and ``kept``
    per row of ``docs`` (``doc_id, lang, source, text``).

    ``base_failed``: fewer than 10 words, or over 20 % of the words inside repeated five-word windows. ``kept`` is false
    for these, else true where every measure lies within the limits of the row's language and source: quartiles plus
    ``REACH`` interquartile ranges (at least ``SPREAD``) of all documents of that group that hold a word.

    Null and empty texts have no words and fail. A null language or source is a group like any other. Very long texts are
    read whole, in blocks. Repeated rows are judged alike and count each. An empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    measured = measure(docs)
    limits = thresholds(sketches(measured), min_docs)
    # one row per language and source; Spark broadcasts it while its file is small, else splits a hot group of the join (AQE)
    keyed = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[c for c in limits.columns if c not in ("lang", "source")])
    joined = measured.join(keyed, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    outside = [F.when((v > F.col(f"{k}_high")) | ((v < F.col(f"{k}_low")) if k in TWO_SIDED else F.lit(False)), F.lit(k)) for k, v in shares().items()]
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return joined.select("doc_id", "lang", "source", *COUNTS, base.alias("base_failed"), F.array_compact(F.array(*outside)).alias("failed")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed") == 0))


def passing(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns; judged row by row, also where a doc_id is null or repeats."""
    from .common import numbered

    rows = numbered(docs, "quality-rows")
    verdict = judge(rows.select(F.col("_row").alias("doc_id"), "lang", "source", "text"), min_docs).where("kept").select(F.col("doc_id").alias("_row"))
    return rows.join(verdict, "_row", "left_semi").select(*docs.columns)
