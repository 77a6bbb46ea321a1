"""SQL answers of the registered queries, in their own words: patterns and numbers are written out again here."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS s FROM d WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g FROM k),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
f AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS z FROM d UNION SELECT r.doc_id, f.y FROM r JOIN f ON f.x = r.z)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(z) AS component_id FROM r GROUP BY doc_id) USING (doc_id)
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i1 AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM i1),
lens AS (SELECT DISTINCT n FROM iw),
d1 AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM d1),
hit AS (SELECT doc_id, item_id, s, n FROM dw JOIN iw USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ks, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_ASSIGN = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
_RULES = (
    ("assign", _ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24), ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
    ("jwt", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}", 0, 0),
    ("login", "[a-z]{2,12}://[A-Za-z0-9._-]{1,64}:[^\\x20\\x09-\\x0D@/]{6,128}@[A-Za-z0-9.-]+", 0, 0),
)


def secret_scan() -> str:
    each = []
    for rank, (kind, pattern, group, least) in enumerate(_RULES):
        where = f"regexp_matches(t, '{pattern}')" if kind != "hex" else "regexp_matches(t, '[0-9a-f]{24}')"
        each.append(f"""
SELECT doc_id, {rank} AS r, '{kind}' AS kind, list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS s, length(m[k]) AS n
FROM (SELECT doc_id, m, p, v, unnest(range(1, len(m) + 1)) AS k FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v FROM d WHERE {where}))
WHERE length(v[k]) >= {least}""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(each)}),
g AS (SELECT doc_id, r, kind, s, concat_ws(':', kind, s::BIGINT, (s + n)::BIGINT) AS e FROM f),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(e, ',' ORDER BY s, r) FILTER (r < 3) AS base, string_agg(e, ',' ORDER BY s, r) AS spans FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


def source_mix(tolerance: float = 1e-6, most: int = 200) -> str:
    keys = ("source", "lang", "topic")
    sweep = "r"
    for d in (*keys, *keys):
        sweep = f"(SELECT k, source, lang, topic, tokens, w * want / sum(w) OVER (PARTITION BY {d}) AS w FROM {sweep} JOIN t_{d} USING ({d}) {'WHERE k < 4 OR (err > ' + repr(tolerance) + f' AND k < {most})' if sweep == 'r' else ''})"
    apart = ", ".join(f"abs(sum(w) OVER (PARTITION BY {d}) - want_{d[0]})" for d in keys)
    wants = " ".join(f"JOIN (SELECT {d}, want AS want_{d[0]} FROM t_{d}) USING ({d})" for d in keys)
    sweeps = f"""r AS (SELECT 0 AS k, source, lang, topic, tokens, w, 1.0::DOUBLE AS err FROM c0
  UNION ALL SELECT k + 2, source, lang, topic, tokens, w, max(apart) OVER () / (SELECT sum(tokens) FROM c0) FROM (SELECT *, greatest({apart}) AS apart FROM {sweep} {wants})),
last AS (SELECT source, lang, topic, tokens, w FROM r WHERE k = (SELECT max(k) FROM r))"""
    targets = ", ".join(
        f"t_{d} AS (SELECT {d}, (SELECT sum(tokens) FROM c0) * share / sum(share) OVER () AS want FROM (SELECT {d}, pow(sum(tokens), 0.5) AS share FROM c0 GROUP BY {d}))"
        for d in ("source", "lang", "topic")
    )
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens,
  CASE WHEN regexp_matches(text, '[Ll]icen[cs]e|[Cc]opyright') THEN 'licence' WHEN regexp_matches(text, '@[A-Za-z0-9-]+[.][a-z]') THEN 'contact'
    WHEN regexp_matches(text, '[Pp]assw|[Ss]ecret|[Tt]oken|AKIA') THEN 'credentials' WHEN regexp_matches(text, '[%$#&*]{{3}}') THEN 'markup' ELSE 'prose' END AS topic FROM documents),
c0 AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens, sum(tokens)::DOUBLE AS w FROM d GROUP BY ALL HAVING sum(tokens) > 0),
{targets}, {sweeps},
e AS (SELECT d.*, round(0.5 * coalesce(w / last.tokens, 1), 9) AS rate,
  ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM d LEFT JOIN last USING (source, lang, topic))
SELECT doc_id, topic, tokens::BIGINT AS n_tokens, round(least(1, rate), 6) AS probability, u < least(1, rate) AS kept,
  round(CASE WHEN rate > 0 THEN rate / least(1, rate) ELSE 0 END, 6) AS weight FROM e
"""

_CRC = f"xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, x: list_reduce([xor(a, x)] || range(8), lambda b, z: CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384) ELSE b // 2 END)), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


MERKLE = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id, coalesce('=' || lang, '') AS tree, {_leaf("n_chars")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC} % 7 = 0 THEN {_leaf("n_chars::HUGEINT + 1")} ELSE {_leaf("n_chars")} END AS claim FROM documents),
n0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, k) - 1 AS p, count(*) OVER (PARTITION BY tree) AS n FROM d),
t AS (
  SELECT tree, 0 AS l, p, n, leaf AS h FROM n0
  UNION ALL
  SELECT tree, l + 1, q, (n + 1) // 2, h FROM (SELECT tree, l, p // 2 AS q, n, sha256(string_agg(h, '' ORDER BY p)) AS h FROM t WHERE n > 1 GROUP BY tree, l, p // 2, n)),
s0 AS MATERIALIZED (SELECT tree, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS p, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS l, p, n, subroot AS h FROM s0
  UNION ALL
  SELECT l + 1, q, (n + 1) // 2, h FROM (SELECT l, p // 2 AS q, n, sha256(string_agg(h, '' ORDER BY p)) AS h FROM u WHERE n > 1 GROUP BY l, p // 2, n)),
nodes AS MATERIALIZED (SELECT tree, l, p, n, h FROM t WHERE n > 1 UNION ALL SELECT NULL, l, p, n, h FROM u WHERE n > 1),
way AS (
  SELECT k, p, 0 AS l, tree AS grp, tree, claim AS h, '' AS proof FROM n0
  UNION ALL
  SELECT k, p, l, grp, tree, h, proof FROM (
    SELECT w.k, CASE WHEN x.n IS NULL THEN s.p ELSE w.p // 2 END AS p, CASE WHEN x.n IS NULL THEN 0 ELSE w.l + 1 END AS l, CASE WHEN x.n IS NULL THEN NULL ELSE w.grp END AS grp, w.tree,
      CASE WHEN x.n IS NULL THEN w.h WHEN o.h IS NULL THEN sha256(w.h) WHEN w.p % 2 = 0 THEN sha256(w.h || o.h) ELSE sha256(o.h || w.h) END AS h, w.proof || coalesce(o.h, '') AS proof, x.n IS NULL AND w.grp IS NULL AS over
    FROM way w LEFT JOIN nodes x ON x.tree IS NOT DISTINCT FROM w.grp AND x.l = w.l AND x.p = w.p
    LEFT JOIN nodes o ON o.tree IS NOT DISTINCT FROM w.grp AND o.l = w.l AND o.p = xor(w.p, 1) LEFT JOIN s0 s ON s.tree = w.tree) WHERE NOT over),
last AS (SELECT k, arg_max(h, (grp IS NULL)::INT * 1000 + l) AS folded_root, arg_max(proof, (grp IS NULL)::INT * 1000 + l) AS proof FROM way GROUP BY k)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM n0 JOIN s0 USING (tree) JOIN last USING (k) CROSS JOIN (SELECT h AS root FROM u WHERE n = 1)
"""
