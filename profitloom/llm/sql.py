"""SQL counterparts of the operators' queries, where SQL can express them."""

from __future__ import annotations

from profitloom.llm.secretscan import ACCESS, ASSIGN, HEX, SecretRules

_WORD = r"[^\x20\x09-\x0D]+"

OP2 = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS payload, sha256(coalesce(html, '')) AS digest,
         strlen(coalesce(html, '')) AS n
  FROM pages
), f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND p.n >= 100
"""

OP4 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w
  FROM documents
), g AS (
  SELECT r, i, list_slice(w, i, i + 4) AS five, hash(list_slice(w, i, i + 50)) AS long,
         i + 50 <= len(w) AS whole
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) t(k) GROUP BY r
), far AS (
  SELECT DISTINCT r FROM (SELECT r, long FROM g WHERE whole GROUP BY r, long HAVING count(*) > 1)
), lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{_WORD}') GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, far.r IS NOT NULL AS far
  FROM d LEFT JOIN covered USING (r) LEFT JOIN lines USING (r) LEFT JOIN far USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT far AS kept
FROM m
"""

OP5 = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*(/[^?#]*)', 1), '') AS path
  FROM pages
), rules(rule, host, path, verdict) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
         ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
         ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), fit AS (
  SELECT u.page_id, u.url, u.host, u.path, any_value(u.host) AS h,
         max_by(rules.rule, length(rules.rule)) AS rule, max_by(rules.verdict, length(rules.rule)) AS verdict
  FROM u LEFT JOIN rules ON (u.host = rules.host OR ends_with(u.host, '.' || rules.host))
                         AND starts_with(u.path, rules.path)
  GROUP BY ALL
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[.-])(ads|adult|bets|casino|pills|poker|porn|spam)([.-]|$)')
                              THEN 'block' ELSE 'allow' END) AS verdict
FROM fit
"""

OP6 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT r, doc_id, i, lines[i] AS line,
         translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)
), common AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (common.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN common ON l.key = common.key
GROUP BY r, doc_id
"""

OP9 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(list_slice(w, i, i + 3)) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id
FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
GROUP BY d.doc_id
"""


def _op11() -> str:
    """Known shapes and hot windows by counting every window's characters anew."""
    rules = SecretRules()
    shapes = [(k, p.replace("(?<![0-9a-f])", ""), n) for k, p, n in (
        ("assign", ASSIGN, rules.assigned), ("access", ACCESS, rules.access), ("hex", HEX, rules.hexes))]
    shapes += [(c.kind, f"({c.pattern}{{{c.window},}})", c.window) for c in rules.classes]
    found = " UNION ALL ".join(
        f"""SELECT {i} AS o, '{k}' AS kind, {n} AS least, r, regexp_extract_all(text, '{p.replace("'", "''")}', 0) AS v,
        regexp_extract_all(text, '{p.replace("'", "''")}', 1) AS g, string_split_regex(text, '{p.replace("'", "''")}') AS gap FROM d"""
        for i, (k, p, n) in enumerate(shapes)
    )
    windows = " ".join(f"WHEN '{c.kind}' THEN {c.window}" for c in rules.classes)
    limits = " ".join(f"WHEN '{c.kind}' THEN {c.limit()}" for c in rules.classes)
    allow = rules.allow
    before, inside, whole = (x.replace("'", "''") for x in (allow.before, allow.inside, allow.whole))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
m AS (
  SELECT o, kind, least, r, i, v[i] AS v, length(g[i]) AS part, right(gap[i], 16) AS before,
         sum(length(gap[i]) + length(v[i])) OVER (PARTITION BY o, r ORDER BY i) AS stop
  FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM found)
), known AS (
  SELECT o, kind, r, CAST(stop - length(v) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop
  FROM m WHERE o < 3 AND part >= least
), c AS (
  SELECT o, kind, r, i, v, CAST(stop - length(v) AS BIGINT) AS start, CASE kind {windows} END AS w,
         CASE kind {limits} END AS most
  FROM m WHERE o >= 3 AND NOT regexp_matches(v, '{whole}') AND NOT regexp_matches(before, '{before}')
), ch AS (
  SELECT o, r, i, p, CASE WHEN kind = 'entropy16' THEN lower(x) ELSE x END AS x, count(*) AS n,
         sum(CASE WHEN x BETWEEN '0' AND '9' THEN 1 ELSE 0 END) AS digits
  FROM (SELECT *, substr(v, CAST(p + j + 1 AS BIGINT), 1) AS x
        FROM (SELECT *, unnest(range(0, w)) AS j FROM (SELECT *, unnest(range(0, length(v) - w + 1)) AS p FROM c)))
  GROUP BY ALL
), hot AS (
  SELECT o, r, i, p, c.w
  FROM (SELECT o, r, i, p, sum(CASE WHEN n < 2 THEN 0 ELSE CAST(round(n * log2(n) * 1048576) AS BIGINT) END) AS s,
               sum(digits) AS digits FROM ch GROUP BY ALL) JOIN c USING (o, r, i)
  WHERE s <= c.most AND digits BETWEEN 1 AND c.w - 1
), island AS (
  SELECT o, r, i, min(p) AS a, max(p) + any_value(w) AS b
  FROM (SELECT *, sum(apart) OVER (PARTITION BY o, r, i ORDER BY p) AS nr
        FROM (SELECT *, CASE WHEN p > lag(p) OVER (PARTITION BY o, r, i ORDER BY p) + w THEN 1 ELSE 0 END AS apart FROM hot))
  GROUP BY o, r, i, nr
), spans AS (
  SELECT * FROM known UNION ALL
  SELECT o, kind, r, start + a, start + b FROM island JOIN c USING (o, r, i)
  WHERE NOT regexp_matches(substr(v, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT)), '{inside}')
), t AS (
  SELECT r, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) FILTER (o < 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) AS spans
  FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN t USING (r)
"""


def _levels(t: str, group: str, count: int) -> str:
    """Nodes of each level, ``t0`` (group, n, i, d) given; ``tsK`` has what stands left and right of each."""
    out = []
    for k in range(count):
        run = f"PARTITION BY {group}, i // 8 ORDER BY i ROWS BETWEEN"
        out.append(f"""{t}s{k} AS (
  SELECT {group}, i, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {t}{k} WHERE n > 1
), {t}{k + 1} AS (
  SELECT {group}, (n + 7) // 8 AS n, i // 8 AS i, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d
  FROM {t}{k} GROUP BY {group}, n, i // 8
)""")
    return ", ".join(out)


def _op12(levels: int = 7, tops: int = 3) -> str:
    """Level by level: for up to 8**7 documents a language and 8**3 languages."""

    def leaf(text: str) -> str:
        fields = [f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || {x}, '-')" for x in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(fields)})"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda a, b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(a, b)),
      4294967295), 4294967295)"""
    folds, now = [], "f0"
    for side, k in [("g", k) for k in range(levels)] + [("t", k) for k in range(tops)]:
        at = f"{now}.i // {8**k}" if side == "g" else f"{now}.lang_i // {8**k}"
        same = f"{side}s{k}.lang = {now}.lang AND " if side == "g" else ""
        following = f"f{len(folds) + 1}"
        folds.append(f"""{following} AS (
  SELECT {now}.* EXCLUDE (h, proof), proof || coalesce(l || r, '') AS proof, CASE WHEN l IS NULL THEN h ELSE sha256(l || h || r) END AS h
  FROM {now} LEFT JOIN {side}s{k} ON {same}{side}s{k}.i = {at}
)""")
        now = following
    return f"""
WITH d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS lang, {leaf("text")} AS leaf,
         CASE WHEN {crc} % 3 = 0 THEN {leaf(lowered)} ELSE {leaf("text")} END AS claim
  FROM documents
), g AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d
), g0 AS (SELECT lang, n, i, leaf AS d FROM g), {_levels("g", "lang", levels)},
t AS (SELECT 0 AS one, lang, d, row_number() OVER (ORDER BY lang) - 1 AS i, count(*) OVER () AS n FROM g{levels}),
t0 AS (SELECT one, n, i, d FROM t), {_levels("t", "one", tops)},
f0 AS (
  SELECT g.doc_id, g.lang, g.leaf, g.i, t.i AS lang_i, t.d AS subroot, '' AS proof, g.claim AS h FROM g JOIN t ON g.lang = t.lang
), {", ".join(folds)}
SELECT doc_id, leaf, subroot, t{tops}.d AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = t{tops}.d AS verified
FROM {now}, t{tops}
"""


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP13 = f"""
WITH t AS (
  SELECT r, doc_id, unnest(w) AS term, len(w) AS n FROM (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents)
), q AS (
  SELECT q, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark)
), a AS (SELECT count(DISTINCT r) AS docs, count(*) AS terms FROM t),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, a GROUP BY term, docs
), s AS (
  SELECT q.q, q.item_id, tf.r, tf.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN tf ON q.term = tf.term JOIN w ON w.term = q.term, a GROUP BY ALL
), k AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 20
"""


def llm_sql() -> dict[str, str]:
    return {
        "op2_warc": OP2,
        "op4_quality": OP4,
        "op5_url_filter": OP5,
        "op6_line_dedup": OP6,
        "op9_jaccard_join": OP9,
        "op11_secret_scan": _op11(),
        "op12_merkle_manifest": _op12(),
        "op13_ranked_search": OP13,
    }
