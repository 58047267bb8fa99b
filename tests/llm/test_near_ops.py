"""Near-duplicates (texts and vectors) and benchmark leaks against brute force on small tables."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendsignals.llm import components, decontam, minhash, neardup_vectors
from spendsignals.llm.shingles import WordHasher, shingle_set

WORDS = [f"w{k}" for k in range(400)]


def clash(df):
    return df.withColumns({c: F.lit(1) for c in ("a", "b", "id", "component", "print", "rep", "signature", "n", "kept")})


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[k:k + width]) for k in range(len(w) - width + 1)}


def groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a in range(n):
        for b in range(a):
            if find(a) != find(b) and linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    texts = [None, "", " \n ", "one", "ONE", "one two", "One  two", "É", "é"]
    for _ in range(12):
        base = rng.choices(WORDS, k=rng.randrange(20, 120))
        texts += [edited(rng, base, k) for k in (0, 0, 1, 2, 3, 5, 8)]
    hot = rng.choices(WORDS, k=60)
    texts += [" ".join(hot)] * 60 + [edited(rng, hot, rng.randrange(0, 4)) for _ in range(120)]       # wider than the window
    shared = " ".join(rng.choices(WORDS, k=40))
    texts += [shared + " " + " ".join(rng.choices(WORDS, k=25)) for _ in range(60)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "width"), [(1, 2), (2, 5)])
def test_near_duplicates(spark, seed, width):
    texts = corpus(seed)
    sets = [shingles(t, width) for t in texts]
    truth = groups(len(texts), lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    df = clash(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5))
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, width).collect()}
    assert len(got) == len(texts)
    for k in range(len(texts)):
        assert got[k]["n_shingles"] == len(sets[k])
        assert got[k]["component_id"] == truth[k], (k, texts[k])
        assert got[k]["kept"] == (truth[k] == k)


@pytest.mark.parametrize("seed", [1, 2])
def test_outliers_of_a_large_group_link_with_their_one_member(spark, seed):
    """Near copies in one dense region, and texts within reach of a single one of them."""
    rng = random.Random(seed)
    hot = rng.choices(WORDS, k=60)
    members = [edited(rng, hot, rng.choice((1, 2, 3))) for _ in range(700)]
    texts = members + [edited(rng, m.split(), 3) for m in rng.sample(members, 300)]
    sets = [shingles(t, 2) for t in texts]
    truth = groups(len(texts), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 2).collect()}
    assert [k for k in range(len(texts)) if got[k] != truth[k]] == []


def test_dense_region_over_piece_borders(spark):
    """A region that the borders cut into pieces of at most NEIGHBOURS rows is dense all the same."""
    rows = [(0, bytes(24), k) for k in range(14)] + [(0, bytes([9] * 24), k) for k in range(100, 104)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        _, dense = minhash._candidates(spark.createDataFrame(rows, "tree int, key binary, id long"))
        assert [(r["tree"], bytes(r["lead"])) for r in dense.collect()] == [(0, bytes(6))]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (3, "other words of its own kind"), (9, "A b c d e f")]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()), key=str)
    assert got == sorted([(None, None, True)] * 2 + [(3, 3, True)] * 3 + [(9, 3, False)], key=str)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_agreement_follows_jaccard():
    h = WordHasher()
    rng = random.Random(3)
    off = []
    for _ in range(60):
        base = rng.choices(WORDS, k=200)
        a, b = shingle_set(h.hashes(base), 2), shingle_set(h.hashes(edited(rng, base, 8).split()), 2)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        off.append((minhash.signature(a) == minhash.signature(b)).mean() - true)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(k, k + 1) for k in range(100, 130)] + [(200, k) for k in range(201, 260)] + [(5, 5), (None, 3)]
    want = groups(300, lambda a, b: (a, b) in links or (b, a) in links)
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert got == {x: want[x] for x in nodes}


def vector_truth(rows, cosine):
    ok = []
    for i, v, label in rows:
        good = i is not None and label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok.append(np.array(v, dtype=float) if good else None)

    def linked(a, b):
        x, y = ok[a], ok[b]
        return x is not None and y is not None and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine
    return [sum(linked(a, b) for b in range(len(rows)) if b != a) for a in range(len(rows))], groups(len(rows), linked)


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(neardup_vectors, "BLOCK", 16)
    monkeypatch.setattr(neardup_vectors, "LEAF", 4)
    rng = np.random.default_rng(5)
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.normal(size=12)
            rows += [(centre + rng.normal(size=12) * s, label) for s in (0, 0, 0.1, 0.2, 0.3, 0.4)]
    hot = rng.normal(size=12)
    rows += [(hot, 1)] * 20 + [(hot + rng.normal(size=12) * 0.1, 1) for _ in range(50)] + [(hot * 3, 1)]
    rows = [([float(x) for x in v], label) for v, label in rows]
    rows += [(None, 1), ([], 1), ([0.0] * 12, 1), ([None] + [1.0] * 11, 1), ([float("nan")] + [1.0] * 11, 1), ([float("inf")] + [1.0] * 11, 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([1e300] * 12, 0), ([1e-300] * 12, 0)]
    rows = [(k, v, label) for k, (v, label) in enumerate(rows)]
    random.Random(6).shuffle(rows)
    rows = [(k, v, label) for k, (_, v, label) in enumerate(rows)]
    scaled = [(i, None if v is None else [x / 1e300 if x and abs(x) > 1e200 else x * 1e300 if x and abs(x) < 1e-200 else x for x in v], label) for i, v, label in rows]
    n_links, root = vector_truth(scaled, 0.93)
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5))
    got = {r["vec_id"]: r for r in neardup_vectors.near_vectors(df).collect()}
    assert len(got) == len(rows)
    for k in range(len(rows)):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (n_links[k], root[k], root[k] == k)


def test_near_vectors_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (2, [0.0, 1.0], 0)]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in neardup_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()), key=str)
    assert got == sorted([(1, 1, 1, True)] * 2 + [(None, 0, None, True), (2, 0, 2, True)], key=str)
    assert neardup_vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_link_matrix_equals_plain_product():
    rng = np.random.default_rng(7)
    a = rng.normal(size=(300, 10))
    a[150:] = a[:150] + rng.normal(size=(150, 10)) * 0.15
    u = a / np.linalg.norm(a, axis=1, keepdims=True)
    q = np.linalg.qr(rng.normal(size=(10, 10)))[0]
    assert (neardup_vectors.link_matrix(a, a, q, 0.93) == (u @ u.T >= 0.93)).mean() > 0.99999


def leak_truth(docs, items):
    """All windows of all sizes, no search."""
    from collections import Counter
    out = {}
    for d, t in docs:
        ws = decontam.words_of(t)
        for i, x in items:
            xs = decontam.words_of(x)
            if not xs or not ws:
                continue
            k = min(5, len(xs))
            cut = lambda w: Counter(tuple(w[j:j + k]) for j in range(len(w) - k + 1))  # noqa: E731, B023
            weight = lambda s: sum(map(len, s))
            b = cut(xs)
            for s in range(max(1, len(ws) - len(xs) + 1)):
                a = cut(ws[s:s + len(xs)])
                both = sum(min(n, b[g]) * weight(g) for g, n in a.items())
                total = sum(max(a[g], b[g]) * weight(g) for g in set(a) | set(b))
                sim = both / total if total else 0
                if sim >= 0.8 and (d, i) not in out or sim > out.get((d, i), (2,))[0]:
                    out[d, i] = (sim, s)
    return out


def test_leaks(spark):
    rng = random.Random(8)
    items = [(k, " ".join(rng.choices(WORDS, k=n))) for k, n in enumerate([30, 45, 12, 60, 7, 5, 20, 33])] + [(50, "tiny phrase here"), (51, None), (52, "..."), (53, "")]
    filler = lambda n: rng.choices(WORDS, k=n)
    docs = [(0, None), (1, ""), (2, "%%%")]
    for n in range(80):
        words = filler(rng.randrange(0, 120))
        if n % 2:
            x = items[rng.randrange(8)][1].split()
            for _ in range(rng.randrange(0, 3)):
                x[rng.randrange(len(x))] = rng.choice(WORDS)
            at = rng.randrange(len(words) + 1)
            words = words[:at] + [w.upper() + rng.choice(["", "!!", "%%%"]) for w in x] + words[at:]
        docs.append((10 + n, " ".join(words)))
    docs += [(900, "a Tiny, phrase: here b"), (901, items[0][1]), (902, " ".join(items[1][1].split()[:-3]))]
    truth = leak_truth(docs, items)
    d = clash(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).withColumn("item_id", F.lit(0))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    assert len(truth) > 15
    for block in (decontam.BLOCK_CHARS, 400):
        got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in decontam.find_leaks(d, b, block).collect()}
        assert got.keys() == truth.keys()
        for k, (sim, start) in truth.items():
            assert abs(got[k][0] - sim) < 1e-9 and got[k][1] == start, k
    left = {r["doc_id"] for r in decontam.without_leaks(d, b).collect()}
    assert left == {k for k, _ in docs} - {k for k, _ in truth}


def test_leaks_odd_rows(spark):
    b = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    d = spark.createDataFrame([(None, "x alpha beta gamma delta epsilon zeta"), (None, "clean"), (4, "alpha beta gamma delta epsilon zeta")], "doc_id long, text string")
    assert sorted(map(str, (r["doc_id"] for r in decontam.find_leaks(d, b).collect()))) == ["4", "None"]
    for x, y in ((d.limit(0), b), (d, b.limit(0)), (d.limit(0), b.limit(0))):
        assert decontam.find_leaks(x, y).count() == 0


def test_block_index_finds_all_within_radius():
    rng = random.Random(9)
    items = [(k, " ".join(rng.choices(WORDS, k=20))) for k in range(200)]
    index = decontam.ItemIndex(items)
    size = (20, 5)
    for _ in range(200):
        k = rng.randrange(200)
        bits = np.unpackbits(index.prints[k].view(np.uint8))
        for j in rng.sample(range(64), rng.randrange(0, decontam.RADIUS + 1)):
            bits[j] ^= 1
        fp = np.packbits(bits).view(np.uint16)
        near = set(np.concatenate([index.near_blocks(size, j, int(fp[j])) for j in range(4)]).tolist())
        assert k in near
