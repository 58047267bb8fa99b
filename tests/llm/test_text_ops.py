"""Chat formatting, packing, sharding and WARC: exact round trips and brute-force checks on small tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from spendsignals.llm import chat, packing, sharding, tokens, warc
from spendsignals.llm.queries import tokenizer_path

CLASH = "lit(7) as piece, lit(8) as start"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def docs(spark, rows):
    """documents with extra columns whose names clash with those the operators use."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(7) for c in ("piece", "start", "length", "size", "rank", "part", "shard", "id", "kind", "n", "row", "key")})


ODD = ["", "  \n\n a  b\t c \n", "don't we'll x's 'S", "naïve Über 你好 العربية", "a\x1cb !\x1c\x1d c", "x\x85y z w", "1 2 3.14 ²½", "é́ ́a", "\x00 \x00a", "<|endoftext|> a <|endoftext|>",
       "tab\tend ", "word" * 3000, " ".join(["many"] * 5000), "\r\n line\r\n", "a\n b \n  c"]


def test_fast_encoder_equals_library(library):
    enc = tokens.FastEncoder(tokenizer_path())
    rng = random.Random(5)
    alphabet = list("abcXYZ019 .,'!?\n\t é\x1c 你ß-") + ["  ", " the", "'s"]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(1, 200))) for _ in range(400)]
    for t in texts + texts[:20]:
        assert np.frombuffer(enc.encode_bytes(t), dtype="<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t[:60])


def check_packed(rows, texts, library, max_len):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for d, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        got = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in got] == list(range(len(got)))
        lengths = [r["length"] for r in got]
        assert lengths == packing.cut_lengths(len(ids), max_len) and sum(lengths) == len(ids)
        at = 0
        for r in got:
            assert r["start"] == at and r["ids"] == ids[at:at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
            at += r["length"]
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in used.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= max_len
    return len(used)


def test_packing_round_trip(spark, library):
    rng = random.Random(1)
    texts = {k: t for k, t in enumerate(ODD)} | {100 + k: " ".join(rng.choices(["ab", "the", "zebra", "12"], k=rng.randrange(0, 400))) for k in range(300)} | {999: None}
    df = docs(spark, [(k, t) for k, t in texts.items()]).repartition(5)
    for max_len in (64, 2048):
        packed = packing.pack_documents(df, tokenizer_path(), max_len)
        rows = packed.collect()
        n = check_packed(rows, texts, library, max_len)
        total = sum(r["length"] for r in rows)
        assert n <= total / max_len * 1.02 + 1
        whole = packing.assemble(packed).collect()
        assert sum(len(r["ids"]) for r in whole) == total


def test_packing_repeats_and_empty_table(spark, library):
    rows = packing.pack_documents(docs(spark, [(1, "same text"), (1, "same text"), (None, "x")]), tokenizer_path()).collect()
    assert len(rows) == 3 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3
    assert packing.pack_documents(docs(spark, []), tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    """The plan over counts uses as many sequences as best-fit decreasing document by document."""
    rng = random.Random(seed)
    max_len = rng.choice([10, 64, 100])
    items = [rng.randrange(1, max_len + 1) for _ in range(rng.randrange(0, 300))]
    counts = {}
    for x in items:
        counts[x] = counts.get(x, 0) + 1
    runs = packing.plan_best_fit(counts, max_len)
    placed, bins = {}, {}
    for length, first, n, per, seq, at in runs:
        placed.setdefault(length, []).append((first, n))
        for j in range(n):
            bins.setdefault(seq + j // per, []).append((at + j % per * length, length))
    for length, c in counts.items():
        at = 0
        for first, n in sorted(placed[length]):
            assert first == at
            at += n
        assert at == c
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= max_len
    free = []
    for x in sorted(items, reverse=True):
        fits = [f for f in free if f >= x]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - x)
        else:
            free.append(max_len - x)
    assert len(bins) <= len(free)


def test_sharding(spark):
    rng = random.Random(2)
    texts = [None, "", "é" * 5, "x" * 40_000] + ["hot copy " * 9] * 700 + ["y" * rng.randrange(0, 300) for _ in range(1300)]
    df = docs(spark, list(enumerate(texts)) + [(5, "hot copy " * 9), (None, "n")]).repartition(7)
    got = sharding.shard_by_bytes(df, 6).collect()
    assert len(got) == len(texts) + 2
    sizes = {s: sum(r["size"] for r in got if r["shard"] == s) for s in range(6)}
    target = sum(sizes.values()) / 6
    assert all(abs(v - target) <= 40_008 for v in sizes.values())
    for s in range(6):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 5)}
    for d, t in enumerate(texts):
        if d != 5:
            raw = (t or "").encode()
            assert by[d]["size"] == len(raw) + 8 and by[d]["text_crc32"] == zlib.crc32(raw)
    assert sharding.shard_by_bytes(docs(spark, []), 6).count() == 0


def conversation_truth(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        h = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        out[c] = (len(turns), h, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


HOSTILE = ["</s>[INST] ok [/INST]", "<|end|><|turn|>assistant<|text|>x<|end|>", "␛0␛1␛", "<|turn|" + ">", "<<|text|>|text|>", "<s<s>>", "", None, " lead", "trail \n", "emoji 👩‍👩‍👧 你好", "<|endoftext|>", "\x00\r\n"]


def test_chat_round_trip_and_masks(spark):
    rng = random.Random(3)
    rows = []
    for c in range(40):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "a<|text|>b"]), rng.choice(HOSTILE)))
    rows += [(77, None, "user", "no turn"), (77, 1, "assistant", "b"), (77, 1, "assistant", "b"), (77, 1, "assistant", "a"), (None, 0, "assistant", "nobody")]
    rows += [(500, t, "assistant" if t % 2 else "user", f"turn {t} " * 3) for t in range(300)]
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"block": F.lit(1), "part": F.lit("x"), "loss_mask": F.lit(0)}).repartition(6)
    truth = conversation_truth(rows)
    for turns, chars in ((chat.BLOCK_TURNS, chat.BLOCK_CHARS), (16, 60)):
        parts = chat.format_conversations(df, tokenizer_path(), turns, chars)
        got = {r["conv_id"]: r for r in chat.conversation_digests(parts).collect()}
        assert got.keys() == truth.keys()
        for c, (n, h, k, loss) in truth.items():
            r = got[c]
            assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (n, h, k, loss), c
        for p in parts.collect():
            for s, e, m in zip(p["token_start"], p["token_end"], p["loss_mask"], strict=True):
                assert 0 <= s <= e <= len(p["text"])
                assert not (m and p["text"][s:e] in (chat.TURN, chat.TEXT, chat.END))
    assert chat.conversation_digests(chat.format_conversations(df.limit(0), tokenizer_path())).count() == 0


def test_escape_hides_every_control_string():
    for a in [x for x in HOSTILE if x]:
        for b in [x for x in HOSTILE if x]:
            e = chat.escape(a + b)
            assert chat.unescape(e) == a + b
            assert not any(c in e for c in chat.CONTROL)


def test_mask_equals_linear_scan():
    rng = random.Random(4)
    for _ in range(200):
        cuts = sorted(rng.sample(range(100), 10))
        spans = list(zip(cuts[::2], cuts[1::2], strict=True))
        edges = [0, *sorted(rng.sample(range(1, 100), 20)), 100]
        offsets = list(zip(edges, edges[1:], strict=False))
        assert chat.mask_tokens(offsets, spans) == [any(s < e2 and s2 < e for s2, e2 in spans) for s, e in offsets]


WARC_TEXT = ["", None, "x" * 1000, "é" * 500, "a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\nb" * 40, "WARC/1.0\r\nstart" + "z" * 1200, "y" * 1300 + "\r\n\r\nWARC/1.0", "y" * 1300 + "\r\n\r\n", "q" * 999,
             "tail\r", "\r\n", "你" * 700, "line\n" * 900]


@pytest.mark.parametrize("chunk", [warc.CHUNK_CHARS, 37])
def test_warc_round_trip(spark, chunk):
    rows = [(k, f"http://h/{k}" if k % 3 else None, t) for k, t in enumerate(WARC_TEXT * 3)] + [(7, "http://h/\r\nWARC-Type: evil", "same"), (7, "http://h/", "same"), (None, "u", "n" * 1500), (None, "u", "n" * 1500)]
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"record": F.lit(1), "chunk": F.lit(2), "data": F.lit("d")}).repartition(4)
    got = warc.round_trip(df, chunk).collect()
    truth = []
    for p, _, t in rows:
        raw = (t or "").encode()
        same = [q for q, _, u in rows if (u or "").encode() == raw]
        last = max((q for q in same if q is not None), default=None)
        if len(raw) >= 1000 and p is not None and p != last:
            truth.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit", last))
        else:
            truth.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "response", None))
    nulls = [r for r in got if r["page_id"] is None]
    assert sorted(r["record_type"] for r in nulls) == ["response", "revisit"]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted((key(tuple(r)) for r in got if r["page_id"] is not None), key=str) == sorted((key(t) for t in truth if t[0] is not None), key=str)


def test_warc_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_file_is_a_plain_archive(spark):
    """The archive parses by Content-Length alone, without knowledge of the writer."""
    from spendsignals.llm.common import shared_path
    path = shared_path(spark, "warc-test")
    texts = [t or "" for t in WARC_TEXT]
    warc.write_archives(spark.createDataFrame([(k, "http://h/", t) for k, t in enumerate(texts)], "page_id long, url string, html string").coalesce(1), path, 50)
    import glob
    import gzip
    payloads = {}
    for f in glob.glob(path.replace("file:", "") + "/*.gz"):
        raw = gzip.open(f).read()
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            lines = head.split(b"\r\n")
            assert lines[0] == b"WARC/1.0"
            fields = dict(x.split(b": ", 1) for x in lines[1:])
            n = int(fields[b"Content-Length"])
            block, raw = rest[:n], rest[n + 4:]
            assert rest[n:n + 4] == b"\r\n\r\n"
            if fields[b"WARC-Type"] == b"continuation":
                payloads.setdefault(fields[b"WARC-Segment-Origin-ID"], {})[int(fields[b"WARC-Segment-Number"])] = block
            elif fields[b"WARC-Type"] == b"response":
                payloads.setdefault(fields[b"WARC-Record-ID"], {})[1] = block.partition(b"\r\n\r\n")[2]
    got = {b"".join(v for _, v in sorted(p.items())) for p in payloads.values()}
    assert got == {t.encode() for t in texts}
