"""Language, page text, personal data and the pipeline."""

import hashlib
import html as entities
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spendsignals.llm import langid, pii, webtext
from spendsignals.llm.common import read_table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    return read_table(spark, SF, "documents")


def test_language_held_out_accuracy(spark, labelled):
    got = langid.identify(labelled, langid.train(labelled)).where(langid.held_out()).select("lang", "lang_pred", "score", "accepted").collect()
    assert len(got) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["accepted"] for r in got) >= 0.97 * len(got)


def test_language_looks_at_text_only(spark, labelled):
    """Training rows alone shape the model; lang, source and doc_id of the rows judged don't matter."""
    model = langid.train(labelled)
    spoiled = labelled.withColumn("lang", F.when(langid.in_training(), F.col("lang")).otherwise("xx"))
    assert langid.train(spoiled) == model
    a = langid.identify(labelled.limit(50), model).select("text", "lang_pred", "score").collect()
    b = langid.identify(labelled.limit(50).withColumns({"lang": F.lit("zz"), "doc_id": -F.col("doc_id")}), model).select("text", "lang_pred", "score").collect()
    assert sorted(a) == sorted(b)


def test_language_odd_rows(spark, labelled):
    model = langid.train(labelled)
    rows = [(1, None), (2, ""), (3, "123 -- 4_5 !!"), (4, "The and of that with this from. " * 20000), (None, "the and of that with"), (6, "²½"), (6, "²½")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang_pred": F.lit("x"), "score": F.lit(9), "margin": F.lit(1), "accepted": F.lit(0)})
    got = langid.identify(df, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "margin", "accepted"]
    pred = [(r["doc_id"], r["lang_pred"], r["accepted"]) for r in got.collect()]
    assert sorted(pred, key=str) == sorted([(1, "und", False), (2, "und", False), (3, "und", False), (4, "en", True), (None, "en", True), (6, "und", False), (6, "und", False)], key=str)
    assert langid.train(labelled.limit(0)) == {} and langid.train(labelled.withColumn("lang", F.lit(None).cast("string"))) == {}
    assert {r["lang_pred"] for r in langid.identify(df, {}).collect()} == {"und"}


def test_language_of_many_copies_is_learned_from_all_its_texts(spark):
    """Copies don't thin out the sample: it is the least hashes of the distinct texts."""
    words = lambda k: " ".join("abcdefghij"[int(d)] * 3 for d in f"{k:05d}")
    rows = [(k, "xx", "aa bb cc dd") for k in range(20000)] + [(20000 + k, "xx", words(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    once = df.where("doc_id >= 20000").unionByName(df.where("doc_id = 1"))
    assert langid.train(df, sample_docs=20) == langid.train(once.withColumn("doc_id", F.col("doc_id")), sample_docs=20) != {}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head>
<body><header>Site</header><nav><ul><li><a href="/">Home</a><li>News</ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div><main><article><header><h1>The  title &amp; more</h1><p>By me</p></header>
<p>First &eacute;<b> bold <i>it</b>alic</i><br>line&nbsp;two<p>Second &lt;tag&gt; &copy; &am
<ul><li>One<li>Two</li></ul><blockquote>Quote</blockquote><table><tr><td>c1<td>c2</table><aside>Side</aside><form><p>Subscribe</p></form>
<div id="share">Share me</div><pre> a   b </pre><section class="comments"><h2>Comments</h2><article><p>I disagree</p></article></section></article></main>
<div class="sidebar"><p>Related</p></div><footer>&copy; 2020</footer></body>"""


def page(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "row", "blocks", "text", "subtree")})


def test_page_rules(spark):
    rows = [(1, "http://a/x", PAGE), (2, None, None), (3, "odd", ""), (4, "http://a/y", "plain  text"), (4, "http://a/y", "plain  text"), (None, "http://b", "<p>unclosed <div>tail"), (6, "http://b", "<<>< a <p" + "<p>x" * 3)]
    got = {}
    for r in webtext.extract_pages(page(spark, rows)).collect():
        got.setdefault(r["page_id"], []).append(r)
    text = "\n\n".join(["The title & more", "First é bold italic line two", "Second <tag> © &am", "One", "Two", "Quote", "c1", "c2", "a b"])
    assert got[1][0]["text"] == text and got[1][0]["n_chars"] == len(text)
    assert got[2][0]["text"] == "" and got[3][0]["text"] == "" and got[2][0]["n_chars"] == 0
    assert [r["text"] for r in got[4]] == ["plain text"] * 2
    assert got[None][0]["text"] == "unclosed\n\ntail"
    assert webtext.extract_pages(page(spark, [])).count() == 0


def test_template_subtrees_go_per_host(spark):
    template = "<div><p>Our site promises quality</p><ul><li>One</li><li>Two</li></ul></div>"
    body = lambda k: f"<html><body>{template}<div><p>Story number {k}</p></div><p>A sentence all share</p></body></html>"
    rows = [(k, f"https://www.site.org:80/{k}", body(k)) for k in range(10)] + [(100, "http://other.org/", body(100))]
    got = {r["page_id"]: r["text"] for r in webtext.extract_pages(page(spark, rows)).collect()}
    for k in range(10):
        assert got[k] == f"Story number {k}\n\nA sentence all share"
    assert got[100].startswith("Our site promises quality")       # one page of its host: nothing recurs


def test_template_counts_before_tag_and_article_rules(spark):
    """A block that recurs inside the articles goes by count; menus and adverts are counted too."""
    inside = "<section><p>Read our other stories</p></section>"
    body = lambda k: f"<html><body><nav><ul><li>Home</li></ul></nav><article><p>Story {k}</p>{inside}</article><div class='ad'>Buy</div></body></html>"
    got = {r["page_id"]: r["text"] for r in webtext.extract_pages(page(spark, [(k, f"http://h/{k}", body(k)) for k in range(8)])).collect()}
    assert got == {k: f"Story {k}" for k in range(8)}
    # an article that is template as a whole leaves the rest of the body
    body = lambda k: f"<body><article><p>Welcome to the site</p></article><div><p>Story {k}</p></div></body>"
    got = {r["page_id"]: r["text"] for r in webtext.extract_pages(page(spark, [(k, f"http://h/{k}", body(k)) for k in range(8)])).collect()}
    assert got == {k: f"Story {k}" for k in range(8)}
    counted = webtext.parse("<nav><ul><li>Home</li></ul></nav><div class='ad'>Buy</div><article><p>x</p></article>").subtrees
    assert len(counted) == 4          # nav, its list, the advert and the article


@pytest.mark.parametrize(("html", "text"), [
    ('<body class="single no-sidebar"><p>a</p></body>', ["a"]),
    ('<article class="post has-comments"><p>a</p></article>', ["a"]),
    ('<main class="with-sidebar"><p>a</p></main>', ["a"]),
    ('<h2 id="related-work">a</h2><h3 id="ad-hoc-queries">b</h3><p class="related">c</p>', ["a", "b", "c"]),
    ('<div class="share-price">a</div><div class="share">b</div><div class="related_posts">c</div><div class="x ad">d</div>', ["a"]),
    ('<div data-id="menu" data-role="navigation" title="x class=ad">a</div><div role="navigation">b</div>', ["a"]),
    ('<p>a <svg class="icon"/> b</p><p>c</p>', ["a b", "c"]),
    ('<p>a <svg class="icon"><text>x</text></svg> b</p><math>y</math><p>c</p>', ["a b", "c"]),
    ('<div>a<svg class="icon"></div><p>b</p>', ["a", "b"]),
    ('<p>a</p><noscript><p>b</p>', ["a", "b"]),
    ('<p>a</p><script>b', ["a"]),
])
def test_text_is_not_lost_to_loose_names_or_open_tags(html, text):
    parsed = webtext.parse(html)
    assert [t for t, d in zip(parsed.texts, parsed.drops, strict=True) if not d] == text


def _kept(html):
    p = webtext.parse(html)
    return webtext.main_text(p.texts, p.mains, p.drops, [], [], [], [], set())


def test_loose_names_inside_an_article_need_links():
    related = '<article><p>a</p><section id="related"><h2>Related work</h2><p>Earlier studies found much.</p></section><div class="notice">Mind the step.</div></article>'
    assert _kept(related) == "a\n\nRelated work\n\nEarlier studies found much.\n\nMind the step."
    linked = '<article><p>a</p><div class="related"><h2>More</h2><ul><li><a href="/1">One story</a><li><a href="/2">Another story</a></ul></div><p>b</p></article>'
    assert _kept(linked) == "a\n\nb"
    assert _kept('<body><div class="related">x</div><p>a</p></body>') == "a"           # outside an article the name is enough
    assert _kept('<article><p>a</p><section class="comments"><p>I disagree</p></section></article>') == "a"


def test_menus_with_other_words_are_one_menu(spark):
    """A list of links recurs by its structure, whatever its words; lists of the article's own do not."""
    menu = lambda k: "<div><ul>" + "".join(f"<li><a href='/{k}/{j}'>Topic {k * 7 + j}</a></li>" for j in range(3 + k % 4)) + "</ul></div>"
    body = lambda k: f"<body>{menu(k)}<div><p>Story {k}</p><ul><li>fact {k}</li><li>proof {k} by <a href='/x'>x</a></li></ul></div></body>"
    got = {r["page_id"]: r["text"] for r in webtext.extract_pages(page(spark, [(k, f"http://h/{k}", body(k)) for k in range(9)])).collect()}
    assert got == {k: f"Story {k}\n\nfact {k}\n\nproof {k} by x" for k in range(9)}


@pytest.mark.parametrize("piece", ["<a b='x ", "<div><p>x", "<svg>", "<!x", "<a", "<ul><li>", "<a \"'>", "<script>", "</ul></p>x", "<p a= b ", "&#", "<![CDATA[<", "<svg><title>", "<b><i>"])
def test_time_grows_with_the_page(piece):
    """Unclosed quotes, tags, comments and nests: ten times the page takes about ten times as long."""
    import time

    def seconds(n):
        html = "<article><p>ok</p>" + piece * (n // len(piece))
        t = time.process_time()
        webtext.parse(html)
        return time.process_time() - t
    small, large = min(seconds(50_000) for _ in range(3)), seconds(500_000)
    assert large < 40 * small + 0.5
    assert webtext.parse("<article><p>ok</p>" + piece * 1000).texts[0].startswith("ok")


def test_long_page_holds_ranges_not_lists():
    parsed = webtext.parse("<div>" * 20_000 + "<p>x" * 20_000)
    assert len(parsed.texts) == 20_000 and len(parsed.subtrees) == 20_000 and {s[2:] for s in parsed.subtrees} == {(0, 20_000)}


def test_tag_ends_equal_one_by_one():
    """Tag ends worked out for a page at once against reading each tag by itself."""
    rng = random.Random(6)
    for _ in range(300):
        html = "".join(rng.choice(["<", "<a", "<b ", "</p", ">", "'", '"', " ", "/", "x", "=", "é", "\u3000"]) for _ in range(rng.randint(0, 60)))
        ends = webtext._TagEnds(html) if html else None
        for at in (m.start() for m in re.finditer("</?[a-zA-Z]", html)):
            m = webtext._TAG.match(html, at)
            assert ends.of(at) == (m.end() - 1 if m else -1)


@pytest.mark.parametrize("around", ["<main>%s</main>", "<div>%s</div>", "<article><section>%s</section></article>"])
def test_copies_of_a_page_are_no_template(spark, around):
    body = lambda k: f"<body>{around % f'<p>Story {k}</p>'}</body>"
    rows = [(k, f"http://h/{k}", body(0 if k < 6 else k)) for k in range(12)]
    got = {r["page_id"]: r["text"] for r in webtext.extract_pages(page(spark, rows)).collect()}
    assert got == {k: f"Story {0 if k < 6 else k}" for k in range(12)}


def test_pages_equal_plain_reading(spark):
    """On the generator's simple pages a reading by regular expression gives the same text."""
    pages = read_table(spark, SF, "pages")
    got = {r["page_id"]: r["text"] for r in webtext.extract_pages(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", article)]
        assert got[r["page_id"]] == "\n\n".join(x for x in blocks if x)


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v - 9 * (v > 9) for v in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(d)))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


PIECES = ["a@b.c", "a@b.c_d@e.f", "x.y@z-1.com.", "@", "é", "你", "+1 (301) 555-0346", "+12", "+123456789012345678", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1",
          "001.002.003.255", "0.0.0.0", "1", "22", "333", " ", "-", ".", "(", ")", "\n", "a", "%", "5500 0000 0000 0004 ", "+", "user (at) mail (dot) com", "call 301 555 0346", "2020-01-02"]


def digest_rows(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_row", "kind", "start", "end", "match", "wide", "tail", "base", "s")})
    return {r["doc_id"]: r for r in pii.span_digests(df.repartition(4)).collect()}


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(1)
    texts = [None, "", "9" * 30_000, "a" * 30_000, "1." * 10_000, "a@" + "b." * 10_000 + "c", "+" + "1 " * 10_000, "x@y.z " * 2000] + ["".join(rng.choices(PIECES, k=rng.randrange(1, 25))) for _ in range(600)]
    got = digest_rows(spark, texts)
    for k, t in enumerate(texts):
        want = plain_spans(t)
        base = ",".join(f"{a}:{b}:{c}" for a, b, c in want)
        assert got[k]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), (t or "")[:200]
        assert [got[k][f"n_{x}"] for x in PLAIN] == [sum(a == x for a, _, _ in want) for x in PLAIN]
        assert not base or set(base.split(",")) <= set(got[k]["spans"].split(","))


def test_spans_odd_tables(spark):
    assert digest_rows(spark, []) == {}
    df = spark.createDataFrame([(1, "a@b.cd"), (1, "a@b.cd"), (None, "a@b.cd")], "doc_id long, text string")
    assert [r["spans"] for r in pii.span_digests(df).collect()] == ["email:0:6"] * 3


def test_added_spans_are_learned(spark):
    """A written-out address beside real ones is added; plain numbers and dates are not."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts = [f"{word()} mail {word()}@{word()}.com {word()} call +1 (301) 555-{rng.randrange(1000, 9999)} {word()} on 2021-03-{rng.randrange(10, 28)} x" for _ in range(200)]
    texts += [f"write to {word()} (at) {word()} (dot) com please", "phone 301 555 0346 now", "in 2020 05 1234 of", "version 2021.100.2000 b"]
    got = digest_rows(spark, texts)
    assert "email:" in got[200]["spans"] and got[200]["n_email"] == 0
    assert got[202]["spans"] == "" and got[203]["spans"] == ""
    assert all(r["spans"].count(":") == 4 for k, r in got.items() if k < 200)


@pytest.mark.parametrize("at", ["(AT)", "[At]", "{aT}", "(at)"])
def test_written_out_addresses_in_any_case_are_candidates(spark, at):
    text = f"write to john {at} example (DOT) com"
    got = pii.find_candidates(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id").where("kind = 'email' and wide").collect()
    assert [text[r["start"]:r["end"]] for r in got] == [f"john {at} example (DOT) com"]


def test_expectation_maximisation_finds_reliable_labelers():
    rng = random.Random(3)
    counts = {}
    for _ in range(40_000):
        y = rng.random() < 0.4
        v = tuple((1 if (y if rng.random() < p else not y) else -1) if rng.random() < 0.9 else 0 for p in (0.95, 0.9, 0.6))
        counts["k", v] = counts.get(("k", v), 0) + 1
    post, rate = pii.expectation_maximisation([(k, v, n) for (k, v), n in counts.items()])
    assert post["k", (1, 1, 1)] > 0.95 > 0.05 > post["k", (-1, -1, -1)]
    sure = [r[True][1] / (r[True][1] + r[True][-1]) for r in rate]
    assert abs(sure[0] - 0.95) < 0.04 and abs(sure[1] - 0.9) < 0.04 and abs(sure[2] - 0.6) < 0.06


def test_redaction(spark):
    rows = [(1, "é a@b.cd, +1 301 555 0346 end", 5), (2, None, None), (3, "clean", 5), (4, "1.2.3.4", 7), (None, "4111 1111 1111 1111", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("start", F.lit(3))
    got = pii.redact(df)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()), key=str) == sorted(
        [(1, "é <EMAIL>, <PHONE> end", 22), (2, None, None), (3, "clean", 5), (4, "<IP>", 4), (None, "<CARD>", 6)], key=str)


def test_pii_plan_has_no_python(spark, labelled):
    plan = pii.span_digests(labelled)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline_stages(spark, labelled, tmp_path):
    """Each stage on its predecessor's rows; its decisions hold and clean documents stay."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_dedup", "decontamination", "personal_data", "packing"]
    docs = labelled
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == labelled.columns
        out.write.parquet(str(tmp_path / name))
        seen[name] = (docs.count(), spark.read.parquet(str(tmp_path / name)))
        docs = seen[name][1]
    texts = {n: {r["doc_id"]: r["text"] for r in d.collect()} for n, (_, d) in seen.items() if n != "packing"}
    before = {r["doc_id"]: r["text"] for r in labelled.collect()}
    assert len(texts["language"]) >= 0.99 * len(before) and all(before[k] == v for k, v in texts["language"].items())
    from spendsignals.llm.decontam import words_of
    items = [" ".join(words_of(r["text"])) for r in read_table(spark, SF, "benchmark").collect()]
    holds = lambda t: any(f" {i} " in f" {' '.join(words_of(t))} " for i in items)
    assert any(map(holds, texts["near_dedup"].values())) and not any(map(holds, texts["decontamination"].values()))
    assert len(set(texts["near_dedup"].values())) == len(texts["near_dedup"])
    assert texts["personal_data"].keys() == texts["decontamination"].keys()
    assert any(map(plain_spans, texts["decontamination"].values())) and not any(map(plain_spans, texts["personal_data"].values()))
    assert {r["doc_id"] for r in seen["packing"][1].collect()} == texts["personal_data"].keys()


def _plain_groups(texts, width=5):
    """Least doc_id of each group of documents whose shingle sets are at least 0.8 alike, pair by pair."""
    sets = {}
    for doc, text in texts.items():
        w = [x.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
        sets[doc] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    holders = {}
    for doc, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(doc)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in sets}


def test_pipeline_dedup_and_packing_equal_plain_versions(spark, labelled, tmp_path):
    """Near-duplicates against comparing every pair that shares a shingle; the ids of the packed pieces, joined, against the
    library's ids of each document, and the sequences they lie in."""
    from tokenizers import Tokenizer

    from spendsignals.llm.queries import tokenizer_path
    corpus_pipeline.near_dedup(spark, labelled, SF).write.parquet(str(tmp_path / "kept"))
    kept = spark.read.parquet(str(tmp_path / "kept"))
    groups = _plain_groups({r["doc_id"]: r["text"] or "" for r in labelled.collect()})
    assert {r["doc_id"] for r in kept.collect()} == set(groups.values())
    packed = corpus_pipeline.packing(spark, kept, SF).collect()
    library = Tokenizer.from_file(tokenizer_path())
    ids, sequences = {}, {}
    for r in sorted(packed, key=lambda r: (r["doc_id"], r["piece"])):
        assert len(r["ids"]) == r["length"] and r["start"] == len(ids.get(r["doc_id"], []))
        ids.setdefault(r["doc_id"], []).extend(r["ids"])
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for r in kept.collect():
        assert ids[r["doc_id"]] == [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
    for places in sequences.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and places[0][0] == 0 and sum(places[-1]) <= 2048


def test_pipeline_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "the and of that with", None, None, None), (5, "the words are and of it", "en", "s", 23), (5, "the words are and of it", "en", "s", 23)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        for d in (docs, docs.limit(0)):
            assert stage(spark, d, SF).count() <= 5


def test_pipeline_decides_row_by_row(spark):
    """Null and repeated ids: one row of each group stays, and only rows that hold a passage go."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(5)]
    leak = read_table(spark, SF, "benchmark").where("length(text) > 60").orderBy("item_id").first()["text"]
    make = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    rows = [(None, texts[0]), (None, texts[0]), (7, texts[1]), (7, texts[1]), (7, texts[2]), (3, texts[2]), (None, texts[3]), (9, texts[3]), (None, texts[4]), (5, None), (5, None)]
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, make(rows), SF).collect()), key=str)
    assert got == sorted([(None, texts[0]), (7, texts[1]), (3, texts[2]), (9, texts[3]), (None, texts[4]), (5, None), (5, None)], key=str)
    rows = [(None, texts[0]), (None, f"{texts[1]} {leak} {texts[2]}"), (4, texts[3]), (4, f"{leak} {texts[1]}"), (None, None)]
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.decontamination(spark, make(rows), SF).collect()), key=str)
    assert got == sorted([(None, texts[0]), (4, texts[3]), (None, None)], key=str)
