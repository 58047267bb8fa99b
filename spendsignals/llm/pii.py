"""Personal data by weak supervision, in DataFrame and SQL functions only.

1. One scan finds matches of the base patterns (email, ip, card, phone) and of wider candidate patterns
   (addresses written out, national phone numbers, card-like numbers) with a little text around each.
2. Labelers vote on every candidate: strict shapes (regex), lists of domains, prefixes and dates (gazetteer),
   and words before it (context). Spark counts the vote patterns; there are at most 3^labelers of them a kind.
3. Expectation-maximisation over these counts estimates each labeler's reliability and every pattern's
   probability of being personal data. With these as soft labels a naive Bayes span classifier is trained
   on vote and shape counts, again a bounded table, and applied as a SQL expression.
4. Base spans that pass their checks always stay; the classifier adds further ones.

The patterns are written so that Java's matcher runs in linear time and constant stack on any text: runs are
possessive, and a run is entered at its start or where the last match ended. Matches equal those of the
plain patterns.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

KINDS = ["email", "ip", "card", "phone"]
#: Base patterns. Fixed values, apart from possessive runs and entry points (see above).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:\(at\)|\[at\]|\{at\})", r"(?:\(dot\)|\[dot\]|\{dot\}|\.)"
#: Wider patterns whose matches the classifier judges.
WIDE = {
    "email": rf"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{{1,64}}+\x20?{_AT}\x20?[A-Z0-9-]{{1,63}}+(?:\x20?{_DOT}\x20?[A-Z0-9-]{{1,63}}+){{1,4}}+",
    "card": r"(?<![0-9A-Za-z.+-])[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{3,4}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])",
}
#: What a text must hold for a pattern to match at all (cheap test first).
NEEDS = {"email": "@", "phone": "+"}
TAIL, LEAD = 40, 12
# Gazetteers and context words. Fixed values.
DOMAINS = "com org net edu gov mil int info biz io co de fr es it uk us ca nl be ch at se no dk fi pl pt br mx ar ru cn jp in au nz eu".split()
CONTEXT = {
    "email": "email e-mail mail contact write reach address".split(),
    "card": "card credit debit visa mastercard amex payment pay".split(),
    "phone": "phone tel telephone call mobile cell fax contact dial sms whatsapp".split(),
}
CONTEXT["ip"] = "ip host server address login from".split()
OTHER = "version isbn issn page pages chapter section license licence invoice order item serial model edition copyright vol volume no token password id".split()
PRIOR, KEEP = 0.3, 0.95       # start of the share of personal data; least probability of an added span
ROUNDS = 60


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def is_valid(kind: Column, match: Column) -> Column:
    """The checks of the base kinds."""
    digits = F.length(_digits(match))
    octet = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[1-9])?+"
    ip = match.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$")
    card = F.when(digits.between(13, 19), F.call_function("luhn_check", _digits(match))).otherwise(False)
    return F.when(kind == "email", F.lit(True)).when(kind == "ip", ip).when(kind == "card", card).otherwise(digits.between(9, 15))


def _matches(text: Column, kind: str, pattern: str, wide: bool) -> list[Column]:
    """Matches, and the length and edges of the pieces between them (one more than matches)."""
    name = ("wide_" if wide else "") + kind
    need = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS and not wide else text.rlike(f"(?i){_AT}" if kind == "email" else "[0-9][\\x20.)-]?[0-9]" if kind != "ip" else "[0-9]\\.[0-9]")
    found = F.when(need, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(TAIL)).alias("tail"), F.left(p, F.lit(LEAD)).alias("lead")))
    return [found.alias(f"m_{name}"), F.when(need & (F.size(found) > 0), pieces).alias(f"p_{name}")]


def _with_edges(matches: Column, pieces: Column) -> Column:
    return F.transform(matches, lambda x, i: F.struct(
        x.alias("match"), pieces[i]["n"].alias("gap"), pieces[i]["tail"].alias("tail"), pieces[i + 1]["lead"].alias("lead")))


def find_candidates(docs: DataFrame, key: str) -> DataFrame:
    """``key, kind, wide, start, end, match, tail, lead``: every match, base and wide, with the text around it."""
    text = F.col("_text")
    base = docs.select(key, text_or_empty().alias("_text"))
    scans = [(k, p, False) for k, p in BASE.items()] + [(k, p, True) for k, p in WIDE.items()]
    cols = [c for k, p, w in scans for c in _matches(text, k, p, w)]
    found = written(base.select(key, *cols), "pii-matches")
    parts = []
    for kind, _, wide in scans:
        m, p = (F.col(x + ("wide_" if wide else "") + kind) for x in ("m_", "p_"))
        parts.append(found.where(F.size(m) > 0).select(key, F.lit(kind).alias("kind"), F.lit(wide).alias("wide"), F.posexplode(_with_edges(m, p)).alias("pos", "x"))
                     .select(key, "kind", "wide", "pos", "x.*"))
    rows = reduce(DataFrame.unionByName, parts)
    upto = Window.partitionBy(key, "kind", "wide").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(upto).cast("long")
    return rows.withColumn("end", end).select(key, "kind", "wide", (F.col("end") - F.length("match")).alias("start"), "end", "match", "tail", "lead")


def _any_word(words: list[str], text: Column) -> Column:
    return F.lower(text).rlike(r"(?:^|[^a-z])(?:" + "|".join(words) + r")(?:[^a-z]+(?:[a-z]{1,3}[^a-z]+)?)?$")


def votes(c: DataFrame) -> DataFrame:
    """Add one vote column per labeler: 1 personal data, -1 not, 0 no opinion."""
    kind, match, tail, lead = (F.col(x) for x in ("kind", "match", "tail", "lead"))
    digits = _digits(match)
    n = F.length(digits)
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    # regex labelers: the strict shape, and shapes of other things (dates, decimals, versions)
    strict = F.when(kind == "phone", match.rlike(r"^(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}$")).otherwise(is_valid(kind, match))
    date = match.rlike(r"^(?:(?:19|20)[0-9]{2}[\x20.-][0-9]{1,3}[\x20.-]?[0-9]{0,4}|[0-9]{1,2}[\x20.-][0-9]{1,2}[\x20.-](?:19|20)[0-9]{2})$")
    # gazetteers: top-level domains, card issuers' first digits
    domain = F.lower(F.regexp_extract(match, r"([A-Za-z0-9]+)$", 1)).isin(DOMAINS)
    issuer = digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))")
    gazetteer = F.when(kind == "email", vote(domain, ~domain)).when(kind == "card", vote(issuer & n.between(15, 16), ~issuer)).otherwise(F.lit(0))
    good = reduce(lambda a, k: F.when(kind == k, _any_word(CONTEXT[k], tail)).otherwise(a), KINDS, F.lit(False))
    inside = F.right(tail, F.lit(1)).rlike("[A-Za-z0-9_=#/]") | F.left(lead, F.lit(1)).rlike("[A-Za-z0-9_=/]")
    return c.withColumns({
        "v_shape": vote(strict, ~strict), "v_date": F.when(date | (n < 7) & (kind != "email"), -1).otherwise(0), "v_list": gazetteer,
        "v_context": vote(good, _any_word(OTHER, tail)), "v_border": F.when(inside, -1).otherwise(0)})


LABELERS = ["v_shape", "v_date", "v_list", "v_context", "v_border"]


def shapes(c: DataFrame) -> DataFrame:
    """Features of the span classifier beside the votes."""
    match, n = F.col("match"), F.length(_digits(F.col("match")))
    return c.withColumns({"f_groups": F.least(F.size(F.split("match", r"[\x20.()-]++")), F.lit(5)), "f_digits": F.least(F.floor(n / 3), F.lit(6)).cast("int"),
                          "f_mixed": F.size(F.array_distinct(F.regexp_extract_all(match, F.lit(r"[\x20.()-]"), F.lit(0)))), "f_line": (F.length("tail") == 0).cast("int")})


FEATURES = [*LABELERS, "f_groups", "f_digits", "f_mixed", "f_line"]


def expectation_maximisation(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = ROUNDS):
    """(kind, votes, count) -> ({(kind, votes): probability}, {labeler: {True: {vote: p}, False: {vote: p}}}).

    Labelers are independent given the truth. Pseudo-counts hold a labeler to "better than chance" where
    there is little data, so no labeler can be read upside down."""
    pseudo = {True: {1: 8.0, 0: 6.0, -1: 2.0}, False: {1: 2.0, 0: 6.0, -1: 8.0}}
    size = len(patterns[0][1]) if patterns else 0
    kinds = sorted({k for k, _, _ in patterns})
    share = dict.fromkeys(kinds, PRIOR)
    rate = [{y: {v: c / 16 for v, c in p.items()} for y, p in pseudo.items()} for _ in range(size)]
    post = {}
    for _ in range(rounds):
        for kind, vote, _ in patterns:
            yes, no = math.log(share[kind]), math.log(1 - share[kind])
            for j, v in enumerate(vote):
                yes, no = yes + math.log(rate[j][True][v]), no + math.log(rate[j][False][v])
            post[kind, vote] = 1 / (1 + math.exp(min(50.0, max(-50.0, no - yes))))
        total = {(k, y): 1.0 for k in kinds for y in (True, False)}
        seen = [{y: dict(p) for y, p in pseudo.items()} for _ in range(size)]
        for kind, vote, n in patterns:
            for y, w in ((True, post[kind, vote] * n), (False, (1 - post[kind, vote]) * n)):
                total[kind, y] += w
                for j, v in enumerate(vote):
                    seen[j][y][v] += w
        share = {k: min(0.99, max(0.01, total[k, True] / (total[k, True] + total[k, False]))) for k in kinds}
        rate = [{y: {v: c / sum(p.values()) for v, c in p.items()} for y, p in s.items()} for s in seen]
    return post, rate


def train_classifier(counted: list[tuple[str, tuple[int, ...], tuple[int, ...], int]]) -> dict[str, dict]:
    """(kind, votes, features, count) -> per kind the log-odds: ``start`` and, per feature, by value."""
    by_votes: dict[tuple, int] = {}
    for kind, vote, _, n in counted:
        by_votes[kind, vote] = by_votes.get((kind, vote), 0) + n
    post, _ = expectation_maximisation([(k, v, n) for (k, v), n in sorted(by_votes.items())])
    model = {}
    for kind in sorted({k for k, _, _, _ in counted}):
        rows = [(f, post[kind, v] * n, (1 - post[kind, v]) * n) for k, v, f, n in counted if k == kind]
        yes, no = 1 + sum(r[1] for r in rows), 1 + sum(r[2] for r in rows)
        terms = []
        for j in range(len(FEATURES)):
            table: dict[int, list[float]] = {}
            for f, p, q in rows:
                t = table.setdefault(f[j], [0.5, 0.5])
                t[0] += p
                t[1] += q
            values = len(table)
            terms.append({v: math.log(p / (yes + values / 2)) - math.log(q / (no + values / 2)) for v, (p, q) in table.items()})
        model[kind] = {"start": math.log(yes / no), "terms": terms}
    return model


def score(model: dict[str, dict]) -> Column:
    """The classifier as an expression over the feature columns: probability of personal data."""
    out = F.lit(0.0)
    for kind, m in model.items():
        logit = F.lit(m["start"])
        for name, table in zip(FEATURES, m["terms"], strict=True):
            term = reduce(lambda a, kv, name=name: F.when(F.col(name) == kv[0], F.lit(kv[1])).otherwise(a), sorted(table.items()), F.lit(0.0))
            logit = logit + term
        out = F.when(F.col("kind") == kind, 1 / (1 + F.exp(-logit))).otherwise(out)
    return out


def find_spans(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, kind, start, end, base, probability``: personal data in ``docs`` (``key, text``), positions in code points,
    end exclusive. ``key`` must name rows one to one. Added spans don't overlap base spans of the row.

    Null and empty texts have no span; very long texts take time in proportion to their length."""
    # a number that fails its checksum is no card, whatever stands around it
    candidates = find_candidates(docs, key).where(~F.col("wide") | (F.col("kind") != "card") | is_valid(F.col("kind"), F.col("match")))
    c = written(shapes(votes(candidates)), "pii-candidates")
    base = c.where(~F.col("wide") & is_valid(F.col("kind"), F.col("match")))
    # what the base finds and fails is evidence too; a wide match that is a base match is the same candidate
    counted = [(r["kind"], tuple(r[x] for x in LABELERS), tuple(r[x] for x in FEATURES), r["n"])
               for r in c.where("kind <> 'ip'").groupBy("kind", *FEATURES).agg(F.count("*").alias("n")).collect()]   # bounded: values of the features
    model = train_classifier(counted)
    judged = c.where("wide").withColumn("probability", score(model)).where(F.col("probability") >= KEEP)
    taken = base.select(key, F.col("start").alias("_s"), F.col("end").alias("_e"))
    added = judged.join(taken, (judged[key] == taken[key]) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")), "left_anti")
    columns = [key, "kind", "start", "end"]
    return base.select(*columns, F.lit(True).alias("base"), F.lit(1.0).alias("probability")).unionByName(
        added.select(*columns, F.lit(False).alias("base"), "probability"))


def _numbered(docs: DataFrame, columns: list[str]) -> DataFrame:
    return written(docs.select(*columns, F.monotonically_increasing_id().alias("_row")), "pii-rows")


def span_digests(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256`` and
    ``spans``. Rows without spans (null or empty text included) have zeros, the digest of "" and "".
    Repeated rows and null doc_ids are rows of their own; extra columns are ignored."""
    rows = _numbered(docs, ["doc_id", "text"])
    spans = find_spans(rows.select("_row", "text"), "_row")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    item = F.struct(order.alias("o"), "start", "end", "kind", "base")
    each = spans.groupBy("_row").agg(F.sort_array(F.collect_list(item)).alias("s"))          # one document's spans
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    got = rows.select("doc_id", "_row").join(each, "_row", "left").withColumn("s", F.coalesce("s", F.array().cast(each.schema["s"].dataType)))
    count = lambda k: F.size(F.filter("s", lambda x: x["base"] & (x["kind"] == k))).cast("long")
    return got.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
                      F.sha2(text(F.filter("s", lambda x: x["base"])).cast("binary"), 256).alias("base_sha256"), text(F.col("s")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in angle brackets; ``n_chars``, if there, is the
    new length. Spans that overlap become one. Other columns stay; null texts stay null."""
    rows = _numbered(docs, docs.columns)
    spans = find_spans(rows.select("_row", "text"), "_row")
    order = Window.partitionBy("_row").orderBy("start", "end", "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = spans.withColumn("_new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    island = first.withColumn("_i", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = island.groupBy("_row", "_i").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", "start").alias("kind"))
    each = merged.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("_s"))
    text, s = F.col("text"), F.col("_s")
    cut = F.transform(s, lambda x, i: F.concat(
        F.substring(text, (F.when(i > 0, s[i - 1]["end"]).otherwise(0) + 1).cast("int"), (x["start"] - F.when(i > 0, s[i - 1]["end"]).otherwise(0)).cast("int")),
        F.lit("<"), F.upper(x["kind"]), F.lit(">")))
    rest = F.substring(text, (s[F.size(s) - 1]["end"] + 1).cast("int"), F.length(text))
    out = rows.join(each, "_row", "left").withColumn("text", F.when(s.isNull(), text).otherwise(F.concat(F.array_join(cut, ""), rest)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(s.isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
