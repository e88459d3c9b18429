"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import licenses, quality_rules

_SPACE = "[\\x20\\x09-\\x0D]"
_BLANKS = "concat(" + ", ".join(f"chr({ord(c)})" for c in quality_rules.BLANKS) + ")"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8) q),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) q WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM rep) q GROUP BY doc_id),
ok AS (SELECT doc_id, ls, list_filter(ls, lambda x: regexp_matches(right(rtrim(x, {_BLANKS}), 4), '[.!?\\x{{2026}}:;\\x{{3002}}\\x{{FF01}}\\x{{FF1F}}]["''\\x{{00BB}}\\x{{201D}}\\x{{2019}})\\]]*$')
  AND len(regexp_extract_all(x, '[|>\\x{{00BB}}\\x{{2022}}\\x{{00B7}}\\x{{2192}}]')) * 4 < len(regexp_split_to_array(trim(x, {_BLANKS}), '{_SPACE}+'))
  AND len(regexp_extract_all(x, '[#*$%&|<>]')) * 10 <= length(x)
  AND NOT regexp_matches(x, '(?i)\\b({"|".join(quality_rules.BOILERPLATE)})\\b')) AS kept FROM w),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_SPACE}+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(w.ls) - len(list_distinct(w.ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(w.ls) AS INTEGER) AS n_lines, CAST(len(ok.kept) AS INTEGER) AS n_lines_kept,
  coalesce(list_sum(list_transform(w.ls, lambda x: length(x))), 0) AS lc, coalesce(list_sum(list_transform(ok.kept, lambda x: length(x))), 0) AS kc
  FROM w JOIN ok ON ok.doc_id = w.doc_id LEFT JOIN cov ON cov.doc_id = w.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lc - kc <= lc * 0.5 AS kept, n_lines, n_lines_kept FROM f
"""

OP2 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS f FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest, CASE WHEN f <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f <> p.page_id THEN f END AS refers_to, true AS valid FROM p LEFT JOIN g ON g.payload_digest = p.payload_digest
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    plain = f"regexp_replace(lower({text}), '(?m)^[^\\p{{L}}\\p{{N}}\\n]*(copyright|\\(c\\)|\\x{{00A9}})([^\\p{{L}}\\n][^\\n]*)?$', '', 'g')"
    out = f"concat(' ', replace(trim(regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ', '  '), ' ')"
    for old, new in licenses.SPELLINGS.items():
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"sha256(trim(replace({out}, '  ', ' ')))"


def _op4() -> str:
    every = [(i, t) for i, ts in licenses.known_texts().items() for t in ts]
    values = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in every)
    return f"""
WITH k AS (SELECT {_canonical('t')} AS digest, min(id) AS license_id FROM (VALUES {values}) AS v(id, t) GROUP BY 1),
w AS (SELECT doc_id, {_canonical("coalesce(text, '')")} AS digest FROM documents),
l AS (SELECT DISTINCT doc_id, k.license_id FROM (SELECT doc_id, {_canonical('x')} AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) q) q JOIN k ON k.digest = q.digest),
n AS (SELECT doc_id, list(license_id ORDER BY license_id) AS notices FROM l GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.license_id, coalesce(n.notices, CAST([] AS VARCHAR[])) AS notices FROM w LEFT JOIN k ON k.digest = w.digest LEFT JOIN n ON n.doc_id = w.doc_id
"""


OP7 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
p AS (SELECT doc_id, i, doc_id * 10000000 + i AS spot, md5(substr(h, 2 * i + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM s WHERE n >= 100) q),
f AS (SELECT m, min(spot) AS early FROM p GROUP BY m HAVING count(*) > 1),
r AS (SELECT p.doc_id, p.i FROM p JOIN f ON f.m = p.m WHERE p.spot > f.early),
e AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e),
v AS (SELECT doc_id, k, min(i) AS lo, max(i) + 100 AS hi FROM g GROUP BY doc_id, k),
c AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM v),
a AS (SELECT c.doc_id, sum(hi - lo) AS removed, count(*) AS spans, max(hi) AS final, string_agg(substr(s.h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (lo - before) AS BIGINT)), '' ORDER BY lo) AS kept FROM c JOIN s ON s.doc_id = c.doc_id GROUP BY c.doc_id)
SELECT s.doc_id, s.n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN a.doc_id IS NULL THEN s.h ELSE concat(a.kept, substr(s.h, CAST(2 * final + 1 AS BIGINT))) END)) AS kept_sha256 FROM s LEFT JOIN a ON a.doc_id = s.doc_id
"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0) q),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM pr JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, label) AS (SELECT a, a FROM e UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node),
k AS (SELECT node, min(label) AS component FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(k.component, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.node = d.doc_id
"""

ORACLES = {
    "op1_quality_rules": OP1,
    "op2_warc": OP2,
    "op4_license_scan": _op4(),
    "op7_suffix_dedup": OP7,
    "op8_jaccard_join": OP8,
}
