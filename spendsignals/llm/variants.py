"""Spelling variant grouping: one-edit neighbours found through words written in a reduced alphabet.

1. Words are cut from the texts and counted (SQL functions, counted where they lie before they meet).
2. Letters are hashed to a few symbols. Words one edit apart have reduced words at most one edit apart, so every distinct
   reduced word generates its full one-edit neighbourhood, as 64-bit polynomial hashes: a word of any length costs a few
   numbers per letter, never copies of itself.
3. Neighbourhoods join the reduced vocabulary; the words behind each pair are compared as they are (edit distance on
   code points), so neither shared reduced words nor hash collisions reach the result.
4. A word's form is its commonest neighbour if that is five times as common; roots follow by pointer doubling.

The number of symbols follows the vocabulary: it grows until no reduced word stands for more than ``SAME_AT_MOST`` words
and pairs within them stay in proportion, at the latest when every letter is a symbol of its own and reduced words are
the words. So no group of words is ever compared pair by pair beyond that bound.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The letters of a word, the rule that drops a letter, and the least length and count of a word.
RUNS = "[A-Za-zÀ-ÿ]"
DROP_EVERY, MIN_LENGTH, MIN_COUNT, FORM_RATIO = 199, 6, 5, 5
LETTERS = LOWER + "".join(chr(c) for c in range(0xC0, 0x100))
LONG_TEXT = 65_536          # longer texts are cut between words first
SYMBOLS = (8, 16, 32, len(LETTERS))
SAME_AT_MOST, PAIRS_PER_WORD = 64, 4
BASE = np.uint64(0x9E3779B97F4A7C15)
#: From U+4E00: one plain character for each symbol of a reduced word.
FIRST_SYMBOL = 0x4E00


def occurrences(docs: DataFrame) -> DataFrame:
    """``word`` per occurrence in ``docs`` (``doc_id, text``): runs of letters with A-Z in lower case, where 199 divides the
    run's hash less one letter, if six code points or more are left. Shorter runs can't give such words."""
    text, run = F.col("text"), F.lit(f"{RUNS}{{{MIN_LENGTH},}}")
    # a piece takes the letters after its last character, so no run is cut
    pieces = F.when(F.length(text) > LONG_TEXT, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{LONG_TEXT}}}{RUNS}*+"), F.lit(0))).otherwise(F.array(text))
    cut = docs.where(text.isNotNull()).select(F.col("doc_id").cast("string").alias("_d"), F.explode(pieces).alias("_p"))
    runs = cut.select("_d", F.explode(F.regexp_extract_all(F.col("_p"), run, F.lit(0))).alias("_r")).select("_d", F.translate("_r", UPPER, LOWER).alias("_r"))
    hashed = runs.withColumn("_h", F.crc32(F.concat(F.coalesce("_d", F.lit("")), F.lit(":"), F.col("_r")).cast("binary")))
    at = "CAST(_h % length(_r) AS INT)"
    word = F.expr(f"CASE WHEN _h % {DROP_EVERY} = 0 THEN concat(substr(_r, 1, {at}), substr(_r, {at} + 2)) ELSE _r END")
    return hashed.select(word.alias("word")).where(F.length("word") >= MIN_LENGTH)


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n``: words with at least ``MIN_COUNT`` occurrences."""
    return written(occurrences(docs).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT), "variant-words")


def reduced(symbols: int):
    """Column: the word in an alphabet of ``symbols``; letters are dealt to symbols by their hash."""
    deal = sorted(LETTERS, key=lambda c: zlib.crc32(c.encode()))
    to = {c: chr(FIRST_SYMBOL + k % symbols) for k, c in enumerate(deal)}
    return F.translate("word", LETTERS, "".join(to[c] for c in LETTERS))


def choose_symbols(words: DataFrame) -> int:
    """The fewest symbols with which reduced words stand for few words each (three numbers per trial reach the driver)."""
    for symbols in SYMBOLS:
        groups = words.groupBy(reduced(symbols).alias("r")).agg(F.count("*").alias("k"))
        got = groups.agg(F.max("k").alias("most"), F.sum(F.col("k") * F.col("k")).alias("pairs"), F.sum("k").alias("words")).first()
        if (got["most"] or 0) <= SAME_AT_MOST and (got["pairs"] or 0) <= PAIRS_PER_WORD * (got["words"] or 0):
            return symbols
    return SYMBOLS[-1]


def _codes(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), dtype="<u4").astype(np.uint64) - np.uint64(FIRST_SYMBOL - 1)


def _hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base, hashes of all beginnings, and of all ends (with the powers they have in the whole word)."""
    n = len(codes)
    powers = np.ones(n + 2, dtype=np.uint64)
    np.multiply.accumulate(np.full(n + 1, BASE), out=powers[1:])
    ends = np.zeros(n + 1, dtype=np.uint64)
    ends[:-1] = np.cumsum((codes * powers[:n][::-1])[::-1], dtype=np.uint64)[::-1]
    starts = np.zeros(n + 1, dtype=np.uint64)       # hash of codes[:i], times base ** (n - i)
    starts[1:] = np.cumsum(codes * powers[:n][::-1], dtype=np.uint64)
    return powers, starts, ends


def key_of(word: str) -> int:
    return int(_hashes(_codes(word))[2][0])


def neighbourhood(word: str, symbols: int) -> Iterator[np.ndarray]:
    """Hashes of the reduced word, of every word with one symbol deleted, replaced or inserted, block by block."""
    codes = _codes(word)
    n = len(codes)
    powers, starts, ends = _hashes(codes)
    whole = ends[0]
    place = powers[:n][::-1]                            # the power at each place
    # an end keeps its powers, a beginning moves by one: divided by the base (it is odd, so this is exact) or times it
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    yield np.concatenate([np.array([whole], dtype=np.uint64), starts[:-1] * inverse + ends[1:]])
    for c in range(1, symbols + 1):
        code = np.uint64(c)
        yield np.concatenate([(whole + (code - codes) * place)[codes != code], starts * BASE + code * powers[:n + 1][::-1] + ends])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.array([key_of(w) for w in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys)], names=["word", "n", "key"])


def _neighbours(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, near, size = [], [], 0
            for w in batch.column(0).to_pylist():
                key = np.uint64(key_of(w))
                for block in neighbourhood(w, symbols):
                    own.append(np.full(len(block), key))
                    near.append(block)
                    size += len(block)
                    if size > 500_000:
                        yield _pairs(own, near)
                        own, near, size = [], [], 0
            if size:
                yield _pairs(own, near)
    return run


def _pairs(own: list[np.ndarray], near: list[np.ndarray]) -> pa.RecordBatch:
    """Each pair of reduced words once: from the smaller hash (the other word has it in its neighbourhood too)."""
    a, b = np.concatenate(own).view(np.int64), np.concatenate(near).view(np.int64)
    keep = a <= b
    return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])


def near_pairs(words: DataFrame, symbols: int | None = None) -> DataFrame:
    """``word, near, near_n``: all pairs of ``words`` (``word, n``) that differ by one inserted, deleted or replaced code
    point, each in both directions."""
    symbols = symbols or choose_symbols(words)
    short = words.select("word", "n", reduced(symbols).alias("r"))
    keyed = written(short.mapInArrow(_keys, "word string, n long, key long"), "variant-keys")
    around = short.select("r").distinct().mapInArrow(_neighbours(symbols), "a long, b long")
    met = around.join(keyed.select(F.col("key").alias("b")).distinct(), "b").distinct()
    one = keyed.select(F.col("key").alias("a"), F.col("word").alias("w1"), F.col("n").alias("n1"))
    two = keyed.select(F.col("key").alias("b"), F.col("word").alias("w2"), F.col("n").alias("n2"))
    apart = (F.col("a") < F.col("b")) | (F.col("w1") < F.col("w2"))
    found = met.join(one, "a").join(two, "b").where(apart & (F.abs(F.length("w1") - F.length("w2")) <= 1)).where(F.levenshtein("w1", "w2", 1) == 1)
    links = written(found.select("w1", "n1", "w2", "n2"), "variant-links")
    return links.select(F.col("w1").alias("word"), F.col("w2").alias("near"), F.col("n2").alias("near_n")).unionByName(
        links.select(F.col("w2").alias("word"), F.col("w1").alias("near"), F.col("n1").alias("near_n")))


def follow(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms`` (``word, form``): forms followed to the last by pointer doubling. Counts grow fivefold a
    step, so a chain is short and the rounds are its logarithm."""
    roots = written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        up = roots.select(F.col("word").alias("_w"), F.col("root").alias("_up"))
        step = written(roots.join(up, F.col("root") == F.col("_w"), "left").select(
            "word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")), "variant-roots")
        roots = step.drop("moved")
        if not step.agg(F.max("moved").alias("m")).first()["m"]:
            return roots


def spelling_variants(docs: DataFrame, symbols: int | None = None) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``docs`` (``doc_id, text``) with at least six code points and
    five occurrences.

    ``n_near`` counts the words one edit away. ``form`` is the commonest of them (ties: first in code-point order) if it
    occurs at least five times as often, else null; ``root`` the last word on the way of forms, the word itself if none.

    Null and empty texts hold no words; a null doc_id reads as nothing before the colon. Texts of any length are read
    whole, words of any length compared. Repeated rows count each. An empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    words = vocabulary(docs)
    best = near_pairs(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("_best"))
    judged = words.join(best, "word", "left").withColumn("_form_n", -F.col("_best.less"))
    common = F.col("_form_n") >= FORM_RATIO * F.col("n")
    judged = written(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, F.col("_best.near")).alias("form"),
                                   F.when(common, F.col("_form_n")).alias("form_n")), "variant-forms")
    roots = follow(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
