"""Language identification by compression: the language whose dictionary codes a text shortest.

Training takes a bounded sample of labelled documents per language and makes of each a zstandard
raw-content dictionary: its distinct words, the most frequent ones last (nearest to the text). A text's
distinct words, in order, are coded with every dictionary; repeats would say nothing about the language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches

SAMPLE_DOCS, SAMPLE_CHARS = 400, 4000       # bound of the training sample, per language
DICT_BYTES, LEVEL, CHUNK = 65_536, 5, 4096
#: A constant head lets even a few words be coded as a compressed block, not stored as they are.
HEAD = b"\n" * 64
NEAR_BYTES = 8000
NEAR = {"window_log": 17, "hash_log": 16, "chain_log": 16, "search_log": 6, "min_match": 4, "strategy": zstandard.STRATEGY_LAZY2, "target_length": 64}
#: Narrower relative margins between the best and the second language are rejected.
MIN_MARGIN = 0.002
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def in_training(doc_id: str = "doc_id") -> Column:
    """Documents to learn from: crc32 of the doc_id as text is not divisible by 5 (null ids: never)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0, F.lit(False))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def distinct_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters in order of first appearance."""
    words = dict.fromkeys(_NOT_LETTERS.sub(" ", text.lower()).split()) if text else {}
    return list(words) if any(any(map(str.isalpha, w)) for w in words) else []


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Language -> dictionary content, from at most ``sample_docs`` labelled texts per language, cut at
    ``sample_chars`` characters each. The sample is the smallest hashes of the texts, so it does not depend
    on order or layout, and copies count once."""
    labelled = docs.where(in_training() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    key = F.xxhash64("text")
    # distinct texts per language, copies are one; one row per language
    counts = {r["lang"]: r["n"] for r in labelled.select("lang", key.alias("_key")).distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    # a share that holds several times the sample, then exactly the smallest hashes
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 8 * sample_docs / n)))])
    near = labelled.select("lang", F.substring("text", 1, sample_chars).alias("text"), key.alias("_key")).where(
        (F.col("_key") / 2.0**64 + 0.5) <= share[F.col("lang")])
    near = near.groupBy("lang", "_key").agg(F.min("text").alias("text"))
    ranked = near.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_key", "text"))).where(F.col("_n") <= sample_docs)
    words: dict[str, Counter] = {}
    for r in ranked.collect():      # at most languages x sample_docs texts of sample_chars characters
        words.setdefault(r["lang"], Counter()).update(_NOT_LETTERS.sub(" ", r["text"].lower()).split())
    content = {}
    for lang, c in sorted(words.items()):
        by_count = sorted(c, key=lambda w: (c[w], w))
        content[lang] = " ".join(by_count).encode()[-DICT_BYTES:]
    return {k: v for k, v in content.items() if len(v) >= 8}


Coders = dict[str, zstandard.ZstdCompressor]


def compressors(model: dict[str, bytes]) -> tuple[Coders, Coders]:
    """Coders by language: with the whole dictionaries, and with their most frequent words only."""
    whole, near = {}, {}
    plain = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
    for lang, content in model.items():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        whole[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, **plain)
        d = zstandard.ZstdCompressionDict(content[-NEAR_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        near[lang] = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(**NEAR, **plain), dict_data=d)
    return whole, near


def classify(words: list[str], coders: tuple[Coders, Coders]) -> tuple[str, float, float]:
    """(language, score, margin). The margin is the second size less the best, as a share of the second.
    Where the whole dictionaries leave a tie (a few words), the short ones decide."""
    if not words or not coders[0]:
        return "und", 0.0, 0.0
    raw = " ".join(words).encode()
    first = _smallest(raw, coders[0])
    return first if first[2] > 0 else _smallest(raw, coders[1])


def _smallest(raw: bytes, coders: Coders) -> tuple[str, float, float]:
    parts = [HEAD + raw[k:k + CHUNK] for k in range(0, len(raw), CHUNK)]
    sizes = {lang: sum(len(c.compress(p)) for p in parts) for lang, c in coders.items()}
    order = sorted(sizes, key=lambda k: (sizes[k], k))
    best = sizes[order[0]]
    second = sizes[order[1]] if len(order) > 1 else best * 2
    weights = np.exp([-(s - best) / max(1.0, 0.01 * best) for s in sizes.values()])
    return order[0], float(1 / weights.sum()), (second - best) / second


def identify(docs: DataFrame, model: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with ``lang_pred, score, margin, accepted``; only ``text`` is looked at, whole.

    ``lang_pred`` is a learned language, or ``und`` if the text is null, empty or without a letter (or
    nothing was learned). ``score`` is the best language's share, 0 to 1. ``accepted`` is false for ``und`` and for
    margins under ``min_margin``. Ties go to the first name. Columns of these names in ``docs`` are replaced.
    """
    def predict(batches: "Iterator[pd.Series]") -> "Iterator[pd.DataFrame]":
        coders = compressors(model)
        for texts in batches:
            rows = [classify(distinct_words(t), coders) for t in texts]
            yield pd.DataFrame(rows, columns=["lang", "score", "margin"])

    udf = F.pandas_udf(predict, "lang string, score double, margin double")
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "margin", "accepted", "_lid")]
    return (bounded_batches(docs).select(*kept, udf("text").alias("_lid"))
            .select(*kept, F.col("_lid.lang").alias("lang_pred"), F.col("_lid.score").alias("score"), F.col("_lid.margin").alias("margin"),
                    ((F.col("_lid.lang") != "und") & (F.col("_lid.margin") >= min_margin)).alias("accepted")))
