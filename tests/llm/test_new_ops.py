"""Spelling variants, quality rules and the Merkle manifest against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spendsignals.llm import manifest, quality, variants

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


# ------------------------------------------------------------------------------------------ 13: manifest
def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(r, text):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[1], r[2], r[3], text)])


def _tree(nodes):
    """Levels of a tree of hashes, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][k:k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def _path(levels, k):
    out = []
    for nodes in levels[:-1]:
        s = k - k % 8
        out.append((nodes[s:k], nodes[k + 1:s + 8]))
        k //= 8
    return out


def _plain_manifest(rows, now):
    """(doc_id, leaf, subroot, root, proof hash, folded root) per row; ``now`` is the text of a row as it is found."""
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees, placed = [], []
    for lang in order:
        own = sorted(langs[lang], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[4]), _leaf(r, now(r))))
        placed.append(own)
        trees.append(_tree([_leaf(r, r[4]) for r in own]))
    top = _tree([t[-1][0] for t in trees])
    out = []
    for j, own in enumerate(placed):
        for k, r in enumerate(own):
            steps = _path(trees[j], k) + _path(top, j)
            x = _leaf(r, now(r))
            for before, after in steps:
                x = _h(*before, x, *after)
            out.append((r[0], _leaf(r, r[4]), trees[j][-1][0], top[-1][0], _h(*[s for b, a in steps for s in b + a]), x, x == top[-1][0]))
    return out


def _lower(text):
    return text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def _found_now(r):
    return _lower(r[4]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[4]


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def _same_manifest(spark, rows, df=None):
    df = spark.createDataFrame(rows, DOCS) if df is None else df
    got = [tuple(r) for r in manifest.tampered_manifest(df).select(*COLUMNS).collect()]
    assert sorted(got, key=str) == sorted(_plain_manifest(rows, _found_now), key=str)
    return got


def test_manifest_sizes_around_runs_and_superblocks(spark, monkeypatch):
    """Languages of 1 to 600 rows with superblocks of 64 leaves: several layers, lone nodes at every border."""
    monkeypatch.setattr(manifest, "LOCAL_LEVELS", 2)
    monkeypatch.setattr(manifest, "SUPERBLOCK", 64)
    rng = random.Random(3)
    rows, n = [], 0
    for lang, size in (("a", 1), ("b", 8), ("c", 9), ("d", 64), ("e", 65), ("f", 513), (None, 70), ("é", 600), ("B", 2), ("", 3)):
        for _ in range(size):
            n += 1
            rows.append((rng.randrange(10**12), f"s{n % 5}", lang, n, "Text ÀB " * (n % 4)))
    got = _same_manifest(spark, rows)
    assert 0 < sum(not r[6] for r in got) < len(got)


def test_manifest_odd_rows(spark):
    """Nulls everywhere, repeated rows, equal ids, ids next to null beyond 2^53, a long text, clashing column names."""
    rows = [(None, None, None, None, None), (None, None, None, None, None), (2**60 + 1, None, None, 3, "ABC"), (5, "s", "en", 1, ""), (5, "s", "en", 1, ""),
            (5, "s", "en", 2, "B"), (7, "s", "en", None, "Long Text " * 100_000), (-3, "s", "en", 1, "x")]
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, DOCS)
    for c in ("tree", "pos", "total", "hash", "seen", "_row", "_id", "_part", "block", "level"):
        df = df.withColumn(c, F.lit("x"))
    _same_manifest(spark, rows, df)
    assert manifest.tampered_manifest(spark.createDataFrame([], DOCS)).collect() == []
    one = _same_manifest(spark, [(3, "s", "en", 1, "x")])
    assert one[0][1] == one[0][2] == one[0][3] and one[0][4] == _h() and one[0][6]


def test_manifest_proof_folds_to_the_root(spark):
    """The proof itself, used by someone who has only the leaf, its place and the root."""
    rows = [(k, "s", "ab"[k % 2], k, f"T{k}") for k in range(200)]
    got = manifest.merkle_manifest(spark.createDataFrame(rows, DOCS), with_proof=True).collect()
    plain = {r[0]: r for r in _plain_manifest(rows, lambda r: r[4])}
    for r in got:
        assert _h(*r["proof"]) == plain[r["doc_id"]][4] and r["verified"] and all(len(s) == 64 for s in r["proof"])


# ------------------------------------------------------------------------------------------ 12: quality
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k:k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab #\n\t\x0b\x0c\rÀ &😀", max_size=80))
def test_quality_counts_equal_plain_version(text):
    assert quality.counts_of(text.encode()) == _plain_counts(text)


def test_quality_counts_in_blocks(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "be", "gamma\n", "Δ", "x" * 40]) for _ in range(4000))
    want = _plain_counts(text)
    monkeypatch.setattr(quality, "BLOCK_BYTES", 37)
    assert quality.counts_of(text.encode()) == want and want[5] > 0


def test_sketch_buckets(spark):
    rows = spark.range(0, 70_000).selectExpr("id * 37 % 65537 AS v").selectExpr("v", f"{quality.bucket('v')} AS b").selectExpr("v", "b", f"{quality.least_of('b')} AS low").collect()
    for v, b, low in rows:
        assert low <= v and (v < 64 and low == v or v - low <= v / 32)
    pairs = sorted((r["v"], r["b"]) for r in rows)
    assert all(x[1] <= y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def _quantile(values, q):
    """Quantile of the sketch: the least number in the bucket of the value at that rank."""
    values = sorted(values)
    v = values[-(-len(values) * q // 4) - 1]
    e = max(v.bit_length() - 6, 0)
    return v >> e << e


def _plain_judge(rows, min_docs):
    measures = {}
    for k, (_, source, lang, _, text) in enumerate(rows):
        n, chars, symbols, lines, dup, rep = _plain_counts(text)
        if n:
            measures[k] = {"word_length": 1000 * chars // n, "symbol_share": 10000 * symbols // n, "dup_line_share": 10000 * dup // lines, "repeat_share": 10000 * rep // n}
    def members(test):
        return [m for k, m in measures.items() if test(rows[k][2], rows[k][1])]
    out = []
    for k, (doc, source, lang, _, text) in enumerate(rows):
        n, *_, rep = _plain_counts(text)
        base = n < 10 or 100 * rep > 20 * n
        kept = not base
        if kept:
            group = members(lambda a, b: (a, b) == (lang, source))
            if len(group) < min_docs:
                group = members(lambda a, b: a == lang)
            if len(group) < min_docs:
                group = members(lambda a, b: True)
            for name, least in quality.SPREAD.items():
                q1, q3 = (_quantile([m[name] for m in group], q) for q in (1, 3))
                reach = quality.REACH * max(q3 - q1, least)
                v = measures[k][name]
                kept &= v <= q3 + reach and not (name in quality.TWO_SIDED and v < q1 - reach)
        out.append((doc, *_plain_counts(text), base, kept))
    return out


def _texts(rng, n):
    rows = []
    for k in range(n):
        lang, source = rng.choice(["en", "en", "en", "xx", None]), rng.choice(["hot", "hot", "hot", "b", None])
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7 + 5 * (lang == "xx")))) for _ in range(rng.randint(8, 60))]
        kind = rng.random()
        if kind < 0.06:
            words = [w + "###$" for w in words]
        elif kind < 0.1:
            words = words[:3] * 9
        elif kind < 0.13:
            words = [w * 6 for w in words]
        text = " ".join(words) if kind < 0.9 else "\n".join(words[:4] * 5 + words)
        rows.append((k, source, lang, len(text), text))
    return rows


def test_quality_equals_plain_version(spark):
    rows = _texts(random.Random(4), 400)
    rows += [(None, None, None, None, None), (7, "hot", "en", 0, ""), (7, "hot", "en", 0, ""), (9, "only", "zz", 1, "one two three four five six seven eight nine ten eleven"),
             (10, "hot", "en", 1, "word " * 50_000), (11, "hot", "en", 1, " ".join(f"w{k}" for k in range(60_000)))]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS n_words", "'x' AS kept", "0 AS measure", "0 AS _lang")
    got = [(r["doc_id"], *(r[c] for c in quality.COUNTS), r["base_failed"], r["kept"]) for r in quality.judge(df, min_docs=40).collect()]
    want = _plain_judge(rows, 40)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert 0 < sum(not r[-1] and not r[-2] for r in want) < 100
    passing = quality.passing(df, min_docs=40)
    assert passing.columns == df.columns and passing.count() == sum(r[-1] for r in want)
    assert quality.judge(spark.createDataFrame([], DOCS)).collect() == []


def test_sketches_merge(spark):
    """Quartiles of merged sketches are those of a sketch of all rows."""
    rows = _texts(random.Random(8), 200)
    docs = spark.createDataFrame(rows, DOCS)
    whole = quality.sketches(quality.measure(docs))
    halves = quality.sketches(quality.measure(docs.where("doc_id % 2 = 0"))).unionByName(quality.sketches(quality.measure(docs.where("doc_id % 2 = 1"))))
    for by in (["lang", "source"], ["lang"], []):
        assert sorted(map(str, quality.quartiles(whole, by).collect())) == sorted(map(str, quality.quartiles(halves, by).collect()))


# ------------------------------------------------------------------------------------------ 11: variants
def _plain_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = _lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def _plain_variants(rows):
    n = _plain_words(rows)
    near = {w: [x for x in n if _one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def _spelled(rng, n_words, times):
    base = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(6, 9))) for _ in range(n_words)]
    out = []
    for k, w in enumerate(base):
        out += [w] * (times * (1 + k % 7))
        for _ in range(2):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1:], w[:i] + "x" + w[i + 1:], w[:i] + "ÿ" + w[i:]])
            out += [v] * rng.choice([4, 7, times])
            out += [v[:1] + "z" + v[1:]] * rng.choice([0, 5])
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("symbols", [None, 2, 8, 90])
def test_variants_equal_plain_version(spark, symbols):
    words = _spelled(random.Random(symbols or 1), 40, 30)
    rows = [(k, " ".join(w.upper() if k % 3 == 0 and w.isascii() else w for w in words[k::50]) + " 12x34") for k in range(50)]
    got = variants.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), symbols)
    want = _plain_variants(rows)
    assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str) == sorted(want, key=str)
    assert any(r[2] not in (r[0], r[1]) for r in want), "a chain of forms is part of the test"


def test_variants_odd_rows(spark, monkeypatch):
    """Nulls, empty and long texts cut into pieces, one very long word, ties, repeated rows, clashing columns."""
    monkeypatch.setattr(variants, "LONG_TEXT", 100)
    long_word = "lengthy" * 700
    text = " ".join(["couleur", "colleur", "coureur"] * 30 + ["spelling"] * 40 + ["speling", "spellling"] * 6) + "\n"
    rows = [(None, None), (1, ""), (2, text * 3), (3, text), (3, text), (None, text)] + [(10 + k, f"{long_word} {long_word[:-1]}, {long_word}x") for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n", "'y' AS form", "0 AS _h", "'k' AS key")
    got = variants.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = _plain_variants(rows)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and max(len(r[0]) for r in want) > 4000
    assert variants.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_neighbourhood_is_complete_and_nothing_more():
    """Hashes of all words one edit away, against writing them out."""
    alphabet = [chr(variants.FIRST_SYMBOL + k) for k in range(3)]
    for word in ("", "a", "ab", "abca", "aaaa"):
        r = "".join(alphabet["abc".index(c)] for c in word)
        want = {r} | {r[:i] + r[i + 1:] for i in range(len(r))} | {r[:i] + c + r[i + 1:] for i in range(len(r)) for c in alphabet} | {r[:i] + c + r[i:] for i in range(len(r) + 1) for c in alphabet}
        got = {int(x) for block in variants.neighbourhood(r, 3) for x in block}
        assert got == {variants.key_of(x) for x in want}


def test_symbols_grow_with_the_vocabulary(spark):
    """Words that share reduced words make the alphabet grow, up to one symbol per letter."""
    few = spark.createDataFrame([("abcdef",), ("uvwxyz",)], "word string")
    assert variants.choose_symbols(few) == variants.SYMBOLS[0]
    rng = np.random.default_rng(2)
    many = spark.createDataFrame([("".join(x),) for x in {tuple(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(3000)}], "word string")
    assert variants.choose_symbols(many.unionByName(few)) >= 8
    crowd = spark.createDataFrame([("aaaa" + a + b + c,) for a in "abcdefghijklmnopqr" for b in "abcdefghijklmnop" for c in "abcdef"], "word string")
    symbols = variants.choose_symbols(crowd)
    most = crowd.groupBy(variants.reduced(symbols).alias("r")).count().agg({"count": "max"}).first()[0]
    assert symbols > variants.SYMBOLS[0] and most <= variants.SAME_AT_MOST
