"""DuckDB forms of the queries of this subpackage, where SQL can express them."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from . import quality

_WORDS = r"[\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]"


def _quality() -> str:
    symbols = "regexp_replace(t, '[#*$%&|<>]', '', 'g')"
    rules = len(quality.GRIDS)
    grid = " UNION ALL ".join(f"SELECT '{r}' AS rule, {i} AS i, CAST({c!r} AS DOUBLE) AS cutoff" for r, g in quality.GRIDS.items() for i, c in enumerate(g))
    shares = " UNION ALL ".join(f"SELECT doc_id, stratum, good, '{r}' AS rule, {r} AS v FROM lab" for r in quality.GRIDS)
    over = " OR ".join(f"coalesce(f.{r} > (SELECT cutoff FROM best b WHERE b.stratum IS NOT DISTINCT FROM f.stratum AND b.rule = '{r}'), false)" for r in quality.GRIDS)
    a = quality.ALPHA / rules
    return rf"""
WITH d AS (SELECT doc_id, lang AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, stratum, t, list_filter(regexp_split_to_array(t, '{_WORDS}'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{_SPACE}', '', 'g') <> '') AS lines FROM d),
grams AS (SELECT doc_id, p, w[p] || ' ' || w[p+1] || ' ' || w[p+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM w WHERE len(w) >= 3)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, p + k AS q FROM again, (VALUES (0), (1), (2)) AS s(k)) GROUP BY doc_id),
c AS (SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length({symbols}) AS BIGINT) AS n_symbols, CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_shouts,
             len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
             CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share, CASE WHEN n_words > 0 THEN n_shouts / n_words ELSE 0 END AS shout_share,
             n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c),
lab AS (SELECT f.*, good FROM f JOIN (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed),
grid AS ({grid}),
v AS ({shares}),
cells AS (SELECT stratum, rule, i, cutoff, sum(CASE WHEN good = 1 THEN 1 ELSE 0 END) AS n, sum(CASE WHEN good = 1 AND v > cutoff THEN 1 ELSE 0 END) AS lost,
                 sum(CASE WHEN good <> 1 AND v > cutoff THEN 1 ELSE 0 END) AS caught FROM v JOIN grid USING (rule) GROUP BY ALL),
tested AS (SELECT *, CASE WHEN lost >= n * {a!r} THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({a!r}) + (n - j) * ln(1 - {a!r}))) FROM range(0, CAST(lost + 1 AS BIGINT)) AS r(j)) END
                  <= {quality.DELTA / rules!r} / (SELECT count(*) FROM (SELECT DISTINCT stratum FROM lab)) AS certified FROM cells),
run AS (SELECT *, bool_and(certified) OVER (PARTITION BY stratum, rule ORDER BY i) AS ok FROM tested),
best AS (SELECT stratum, rule, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY caught DESC, i) AS k FROM run WHERE ok AND caught > 0) WHERE k = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) AS kept FROM f
"""


#: Shingle sets, pairs that share a shingle, links, and the least document that links lead to.
_NEAR = rf"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{_WORDS}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(g) AS g FROM (
    SELECT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') || chr(10) FROM t WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY a)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, least(t.doc_id, coalesce(m.low, t.doc_id)) AS component_id, t.doc_id <= coalesce(m.low, t.doc_id) AS kept
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

#: Base 32 of a SHA-1: twenty bits, five hexadecimal digits, are four letters.
_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS low FROM pages),
x AS (SELECT *, sha1(h) AS d FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(d, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> low THEN low END AS refers_to
FROM x
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_quality_rules": _quality(), "op4_minhash_near_dedup": _NEAR, "op7_warc_in_zip": _WARC}
