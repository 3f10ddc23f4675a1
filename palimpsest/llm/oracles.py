"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 2 AS cap FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
    - coalesce(CAST(sum(cap) OVER before AS DOUBLE), 0)) / (CAST(sum(w) OVER () AS BIGINT) - coalesce(CAST(sum(w) OVER before AS BIGINT), 0)) AS level
  FROM w WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap <= level * w AS is_full FROM l),
e AS (SELECT level FROM f WHERE NOT is_full ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE (SELECT level FROM e) * w END AS target FROM f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2::DOUBLE) ELSE 0::DOUBLE END AS rate FROM t)
SELECT d.doc_id, d.size, r.source_size, r.target,
  CAST(d.size * (floor(rate) + CASE WHEN CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE
    < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""

_HOST = r"regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)"
_PATH = r"coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _smoothed(n: str, order: int) -> str:
    """The smoothed share of a gram's last class, orders 0 to `order` one within the other."""
    if order < 0:
        return "(1.0::DOUBLE / 32)"
    ends = f"code % {32 ** (order + 1)}"
    context = f"sum({n}) OVER (PARTITION BY ({ends}) // 32)" if order else f"sum({n}) OVER ()"
    return f"((CAST(sum({n}) OVER (PARTITION BY {ends}) AS DOUBLE) + 2.0::DOUBLE * {_smoothed(n, order - 1)}) / (CAST({context} AS DOUBLE) + 2.0::DOUBLE))"


OP5 = rf"""
WITH p AS (SELECT page_id, url, coalesce(translate({_HOST}, '{_UP}', '{_LOW}'), '') AS host, {_PATH} AS path,
    translate(translate(coalesce(url, ''), '{_UP}', '{_LOW}'), '123456789', '000000000') AS plain FROM pages),
rules(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (SELECT page_id, url, host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS rule_verdict
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL),
s AS (SELECT row_number() OVER () AS r, p.*, rule, rule_verdict, CAST('0x' || substr(md5(coalesce(p.url, '')), 1, 4) AS BIGINT) % 5 = 0 AS held,
    list_transform(string_split(plain, ''), lambda c: CASE WHEN c = '' THEN NULL ELSE instr('abcdefghijklmnopqrstuvwxyz0/.-:', c) END) AS cls
  FROM p LEFT JOIN fit ON p.page_id = fit.page_id AND p.url IS NOT DISTINCT FROM fit.url),
c AS (SELECT *, CASE WHEN plain = '' THEN [] ELSE cls END AS cs FROM s),
g AS (SELECT r, rule_verdict, held, ((coalesce(CASE WHEN i > 3 THEN cs[i - 3] END, 0) * 32 + coalesce(CASE WHEN i > 2 THEN cs[i - 2] END, 0)) * 32
    + coalesce(CASE WHEN i > 1 THEN cs[i - 1] END, 0)) * 32 + cs[i] AS code FROM (SELECT r, rule_verdict, held, cs, unnest(generate_series(1, len(cs))) AS i FROM c WHERE len(cs) > 0)),
n AS (SELECT code, count(*) FILTER (WHERE rule_verdict = 'allow' AND NOT held) AS a, count(*) FILTER (WHERE rule_verdict = 'block' AND NOT held) AS r FROM g GROUP BY code),
m AS (SELECT code, CAST(floor((ln({_smoothed("r", 3)}) - ln({_smoothed("a", 3)})) * 1000000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS micro FROM n),
scores AS (SELECT r, CAST(floor(sum(micro) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS score FROM g JOIN m USING (code) GROUP BY r),
bins AS (SELECT CAST(floor(score / 1000.0::DOUBLE) AS BIGINT) AS bin, count(*) FILTER (WHERE rule_verdict = 'block') AS r, count(*) FILTER (WHERE rule_verdict = 'allow') AS a
  FROM c JOIN scores USING (r) WHERE held AND rule_verdict IS NOT NULL GROUP BY bin),
gain AS (SELECT bin, sum(r) OVER down * sum(a) OVER () - sum(a) OVER down * sum(r) OVER () AS gain, sum(r) OVER () > 0 AND sum(a) OVER () > 0 AS both_seen FROM bins WINDOW down AS (ORDER BY bin DESC)),
at_bin AS (SELECT bin * 1000 AS lowest FROM gain WHERE both_seen ORDER BY gain DESC, bin LIMIT 1)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN score >= (SELECT lowest FROM at_bin) THEN 'block' ELSE 'allow' END) AS verdict, score
FROM c LEFT JOIN scores USING (r)
"""

_ENDS = r"""[.!?…:;,。！？；：、؟۔।॥][)\]"''»”’」』 \x{00A0}\t\r\x0b\x0c]*$"""
_SAYS = (
    r"(?i)licensed under|released under|under the .{1,40} licen[cs]e|all rights reserved|copyright \(c\)|©|cookie policy|privacy policy|privacy notice|terms of (use|service)|subscribe to|sign up for|click here"
    "|use cookies|accept (all )?cookies|tous droits réservés|alle rechte vorbehalten|todos los derechos reservados|utilise des cookies|verwendet cookies|utiliza cookies"
    "|mentions légales|politique de confidentialité|datenschutzerklärung|nutzungsbedingungen|política de privacidad|términos y condiciones"
)
_ASKS = (
    "(?i)^ *((read|learn|show|see|load|view) (more|all)|(next|previous|prev)( page)?|back to top|skip to (main )?content|(log|sign) ?(in|up|out)|share( this| on .*)?|(accept|reject) all.*"
    "|add to cart|leave a (comment|reply)|(print|email) this.*|weiterlesen|mehr erfahren|lire la suite|en savoir plus|leer más|más información)[ .…»>]*$"
)


def _chars(of: str) -> str:
    """How many characters of a class a line has."""
    return f"length(regexp_replace(line, '[^{of}]', '', 'g'))"


OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS w FROM documents),
l AS (SELECT r, i, line, regexp_extract_all(line, '{_WORD}') AS lw, len(regexp_extract_all(line, '{_WORD}')) AS n, regexp_matches(line, '{_ENDS}') AS ends
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
o AS (SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY i) AS seen, n <= 4 AND NOT ends AS short,
    {_chars("|›‹•·→←")} + CASE WHEN contains(line, '«') THEN 0 ELSE {_chars("»")} END + len(list_filter(lw, lambda x: x IN ('>', '>>', '<', '<<', '/', '::'))) AS seps FROM l WHERE n > 0),
q AS (SELECT *, short AND ((lag(short, 1, false) OVER t AND lag(short, 2, false) OVER t) OR (lag(short, 1, false) OVER t AND lead(short, 1, false) OVER t) OR (lead(short, 1, false) OVER t AND lead(short, 2, false) OVER t)) AS item
  FROM o WINDOW t AS (PARTITION BY r ORDER BY i)),
j AS (SELECT r, count(*) FILTER (WHERE seen > 1) AS n_dup_lines, sum(n) FILTER (WHERE seen = 1 AND NOT item
    AND NOT (seps > 1 AND 5 * seps >= n) AND NOT (seps = 1 AND n <= 5 AND NOT ends)
    AND NOT (NOT ends AND n >= 4 AND 5 * len(list_filter(lw, lambda x: regexp_matches(x, '^\p{{Lu}}'))) >= 4 * n)
    AND 2 * len(list_filter(lw, lambda x: contains(x, '://') OR starts_with(x, 'www.'))) < n
    AND NOT (n <= 6 AND regexp_matches(line, '{_ASKS}'))
    AND 2 * (len(list_filter(lw, lambda x: regexp_matches(x, '[#*$%&<>]{{3}}'))) + len(list_filter(lw, lambda x: contains(x, '!!')))) <= n
    AND 2 * {_chars(r"\p{L}\p{M}\p{N}")} >= {_chars(r"\x00-\x08\x0E-\x1F\x21-\x{10FFFF}")}
    AND NOT (n >= 5 AND {_chars(r"\p{Lu}")} >= 14 AND 10 * {_chars(r"\p{Lu}")} >= 7 * {_chars(r"\p{L}")})
    AND NOT regexp_matches(line, '[{{}}]|=.*;[ \t\r]*$')
    AND NOT (n <= 40 AND regexp_matches(line, '{_SAYS}'))) AS kept_words
  FROM q GROUP BY r),
win AS (SELECT r, i, list_slice(w, i, i + 4) AS win FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(generate_series(i, i + 4)) AS place FROM again) GROUP BY r),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(kept_words, 0) AS BIGINT) AS n_kept_words
  FROM d LEFT JOIN j USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_kept_words,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_kept_words >= 0.5 * n_words AS kept FROM b
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS w FROM documents),
win AS (SELECT doc_id, r, i, array_to_string(list_slice(w, i, i + 12), ' ') AS win FROM (SELECT doc_id, r, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT win, min(doc_id) AS first FROM win GROUP BY win HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT r, unnest(generate_series(i, i + 12)) AS place FROM win JOIN f USING (win) WHERE doc_id > first),
gone AS (SELECT r, count(*) AS n FROM hit GROUP BY r),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) x ANTI JOIN hit ON x.r = hit.r AND x.i = hit.place GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""

SQL = {"op5_url_filters": OP5, "op7_quality_rules": OP7, "op4_near_duplicates": OP4, "op8_substring_dedup": OP8, "op6_mix_sources": OP6}
