"""DuckDB statements for the operators whose results SQL can state over whole tables."""

from __future__ import annotations

from .chat import CONTROL, END, ESC, TEXT, TURN
from .quality import MIN_DOCS, REACH, SPREAD, SUB_BUCKETS, TWO_SIDED

#: ``reach`` (id, least id reachable) from ``nodes`` (id) and ``links`` (a, b) in both directions.
_COMPONENTS = """reach AS (SELECT id, min(other) AS least FROM (
  WITH RECURSIVE walk(id, other) AS (SELECT id, id FROM nodes UNION SELECT w.id, l.b FROM walk w JOIN links l ON l.a = w.other)
  SELECT * FROM walk) GROUP BY id)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATTERN = "|".join("".join("\\" + c if c in "[]|()<>/." else c for c in x) for x in [*CONTROL, ESC])

#: The CRC-32 table, built by its rule: eight shifts of each byte with the reversed polynomial.
_CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))) AS t)"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of ``text`` (code points up to U+00FF); ``crc`` must be joined."""
    codes = f"flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END FOR c IN string_split({text}, '')])"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _bucket(v: str) -> str:
    shift = f"greatest(length(bin({v})) - 6, 0)"
    return f"{SUB_BUCKETS} * {shift} + ({v} >> {shift})"


def _least(b: str) -> str:
    e = f"({b} // {SUB_BUCKETS} - 1)"
    return f"CASE WHEN {b} < {2 * SUB_BUCKETS} THEN {b} ELSE ({b} - {SUB_BUCKETS} * {e}) << CAST({e} AS INT) END"


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_QUALITY = f"""WITH base AS (SELECT doc_id, lang, source, {_WORDS} AS w, coalesce(text, '') AS text FROM documents),
windows AS (SELECT doc_id, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] || ' ' || w[k + 3] || ' ' || w[k + 4] AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM base WHERE len(w) >= 5)),
twice AS (SELECT doc_id, k FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
repeats AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM twice, range(5) r(j) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS d FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n - l.d, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, l.n AS n_lines
  FROM base LEFT JOIN repeats r USING (doc_id) LEFT JOIN lines l USING (doc_id)),
measures AS (SELECT *, CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words END AS word_length, CASE WHEN n_words > 0 THEN 10000 * n_symbols // n_words END AS symbol_share,
    CASE WHEN n_lines > 0 THEN 10000 * n_dup_lines // n_lines END AS dup_line_share, CASE WHEN n_words > 0 THEN 10000 * n_repeat_words // n_words END AS repeat_share FROM m),
long AS (SELECT doc_id, lang, source, measure, CAST(v AS BIGINT) AS v FROM measures UNPIVOT (v FOR measure IN ({", ".join(SPREAD)}))),
sketch AS (SELECT lang, source, measure, {_bucket("v")} AS b FROM long),
own AS (SELECT lang, source, measure, count(*) AS docs, quantile_disc(b, 0.25) AS b1, quantile_disc(b, 0.75) AS b3 FROM sketch GROUP BY ALL),
langs AS (SELECT lang, measure, count(*) AS docs, quantile_disc(b, 0.25) AS b1, quantile_disc(b, 0.75) AS b3 FROM sketch GROUP BY ALL),
whole AS (SELECT measure, quantile_disc(b, 0.25) AS b1, quantile_disc(b, 0.75) AS b3 FROM sketch GROUP BY ALL),
picked AS (SELECT o.lang, o.source, o.measure, CASE WHEN o.docs >= {MIN_DOCS} THEN o.b1 WHEN l.docs >= {MIN_DOCS} THEN l.b1 ELSE a.b1 END AS b1,
    CASE WHEN o.docs >= {MIN_DOCS} THEN o.b3 WHEN l.docs >= {MIN_DOCS} THEN l.b3 ELSE a.b3 END AS b3
  FROM own o JOIN langs l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN whole a ON o.measure = a.measure),
limits AS (SELECT lang, source, measure, q1 - {REACH} * greatest(q3 - q1, least) AS low, q3 + {REACH} * greatest(q3 - q1, least) AS high
  FROM (SELECT *, {_least("b1")} AS q1, {_least("b3")} AS q3, CASE measure {" ".join(f"WHEN '{k}' THEN {v}" for k, v in SPREAD.items())} END AS least FROM picked)),
outside AS (SELECT DISTINCT doc_id FROM long v JOIN limits t ON v.lang IS NOT DISTINCT FROM t.lang AND v.source IS NOT DISTINCT FROM t.source AND v.measure = t.measure
  WHERE v.v > t.high OR (v.measure IN ({", ".join(f"'{k}'" for k in TWO_SIDED)}) AND v.v < t.low))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND doc_id NOT IN (SELECT doc_id FROM outside) AS kept FROM measures"""

_VARIANTS = f"""WITH {_CRC_TABLE},
runs AS (SELECT d, r, count(*) AS k FROM (SELECT CAST(doc_id AS VARCHAR) AS d, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), '{_UPPER}', '{_LOWER}') AS r
  FROM documents) WHERE length(r) >= 6 GROUP BY d, r),
hashed AS (SELECT r, k, {_crc32("d || ':' || r")} AS h FROM runs, crc),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, CAST(h % length(r) AS INT)) || substr(r, CAST(h % length(r) AS INT) + 2) ELSE r END AS word, k FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT DISTINCT * FROM (SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.d = b.word UNION ALL SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.d = b.word)),
best AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, near_n FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
forms AS (SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
walk AS (WITH RECURSIVE w(word, last) AS (SELECT word, word FROM forms UNION ALL SELECT w.word, f.form FROM w JOIN forms f ON f.word = w.last WHERE f.form IS NOT NULL) SELECT * FROM w)
SELECT f.word, f.form, w.last AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk w ON w.word = f.word WHERE w.last IN (SELECT word FROM forms WHERE form IS NULL)"""


def _merkle(tree_levels: int = 7, root_levels: int = 3) -> str:
    """Trees of up to 8 ** 7 leaves under a root tree of up to 8 ** 3 languages, level by level."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    with_siblings = """SELECT t, pos, n, h, coalesce(string_agg(h, '') OVER (PARTITION BY t, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(h, '') OVER (PARTITION BY t, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after"""

    def levels(prefix: str, first: str, count: int) -> list[str]:
        out = [f"{prefix}0 AS ({with_siblings} FROM ({first}))"]
        for k in range(count):
            out.append(f"{prefix}{k + 1} AS ({with_siblings} FROM (SELECT t, pos // 8 AS pos, (max(n) + 7) // 8 AS n, "
                       f"CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {prefix}{k} GROUP BY t, pos // 8))")
        return out

    tampered = f"CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END"
    ctes = [_CRC_TABLE, f"seen AS (SELECT *, {tampered} AS now FROM documents, crc)",
            f"""leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS t, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos,
  count(*) OVER (PARTITION BY lang) AS n, {leaf("text")} AS h, {leaf("now")} AS f FROM seen)"""]
    ctes += levels("a", "SELECT t, pos, n, h FROM leaves", tree_levels)
    ctes += [f"tops AS (SELECT t AS lang_t, h, row_number() OVER (ORDER BY t) - 1 AS pos, count(*) OVER () AS n FROM a{tree_levels})"]
    ctes += levels("b", "SELECT '' AS t, pos, n, h FROM tops", root_levels)
    ctes.append("f0 AS (SELECT doc_id, t, pos, h AS leaf, f, '' AS proof FROM leaves)")
    step = lambda prefix, k, on: f"""SELECT f.* REPLACE (CASE WHEN x.n = 1 THEN f.f ELSE sha256(x.before || f.f || x.after) END AS f,
  CASE WHEN x.n = 1 THEN proof ELSE proof || x.before || x.after END AS proof, f.pos // 8 AS pos) FROM {on} f JOIN {prefix}{k} x ON x.t = f.t AND x.pos = f.pos"""  # noqa: E731
    for k in range(tree_levels):
        ctes.append(f"f{k + 1} AS ({step('a', k, f'f{k}')})")
    ctes.append(f"g0 AS (SELECT f.* EXCLUDE (t, pos), tops.h AS subroot, '' AS t, tops.pos FROM f{tree_levels} f JOIN tops ON tops.lang_t = f.t)")
    for k in range(root_levels):
        ctes.append(f"g{k + 1} AS ({step('b', k, f'g{k}')})")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT g.doc_id, g.leaf, g.subroot, r.h AS root, sha256(g.proof) AS proof_sha256, g.f AS folded_root, g.f = r.h AS verified FROM g{root_levels} g, b{root_levels} r"""


ORACLES = {
    "op1_chat_format": f"""WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN + TEXT + END)} + length(role) + length(text) + 2 * len(regexp_extract_all(text, '{_PATTERN}'))
      - len(regexp_extract_all(text, '{ESC}'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id""",
    "op3_embedding_dedup": f"""WITH v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len([e FOR e IN x IF e IS NULL OR NOT isfinite(e)]) = 0
  AND len([e FOR e IN x IF e <> 0]) > 0),
links AS (SELECT p.id AS a, q.id AS b FROM good p JOIN good q ON p.label = q.label AND p.id <> q.id AND len(p.x) = len(q.x)
  AND list_cosine_similarity(p.x, q.x) >= 0.93),
nodes AS (SELECT id FROM v), {_COMPONENTS}
SELECT n.id AS vec_id, (SELECT count(*) FROM links l WHERE l.a = n.id) AS n_links, r.least AS component_id, n.id = r.least AS kept
FROM nodes n JOIN reach r ON n.id = r.id""",
    "op5_minhash_dedup": f"""WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id AS id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[k] || ' ' || w[k + 1] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS k FROM words WHERE len(w) > 0)),
sizes AS (SELECT id, count(*) AS n FROM sets GROUP BY id),
meets AS (SELECT p.id AS a, q.id AS b, count(*) AS shared FROM sets p JOIN sets q ON p.s = q.s AND p.id <> q.id GROUP BY 1, 2),
links AS (SELECT a, b FROM meets JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
nodes AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, r.least AS component_id, d.doc_id = r.least AS kept
FROM documents d JOIN reach r ON r.id = d.doc_id LEFT JOIN sizes z ON z.id = d.doc_id""",
    "op10_warc": """SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN strlen(h) >= 1000 AND page_id <> latest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 1000 AND page_id <> latest THEN latest END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS latest FROM pages)""",
    "op11_spelling_variants": _VARIANTS,
    "op12_quality_rules": _QUALITY,
    "op13_merkle_manifest": _merkle(),
}
