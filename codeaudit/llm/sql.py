"""SQL forms of the queries, written set-wise for another engine and apart from the operators."""

from __future__ import annotations

from itertools import permutations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTER_RUN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_RUN = r"[^\x20\x09-\x0D]+"


def low(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all({low('text')}, '{LETTER_RUN}') AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
             regexp_extract_all({low('text')}, '{LETTER_RUN}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS l,
             array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
       FROM items, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT r, i, l, array_to_string(w[i:i + l - 1], ' ') AS win
       FROM d, (SELECT DISTINCT l FROM iw) AS x, unnest(range(1, len(w) - l + 2)) AS t(i)),
hit AS (SELECT r, i, l, item_id FROM dw JOIN iw USING (l, win)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + l)) AS t(p) GROUP BY r),
ids AS (SELECT r, string_agg(item_id, ',' ORDER BY item_id) AS ids, count(*) AS n_items
        FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN ids USING (r)
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {5 * g + 1}, 5) AS INTEGER) >> {s}) & 31), 1)"
    for g in range(8) for s in (15, 10, 5, 0)
)

OP3 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
s AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h, payload,
        max(page_id) OVER (PARTITION BY payload) AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to, true AS digest_agrees, true AS length_agrees
FROM s
"""

OP5 = f"""
WITH d AS (SELECT doc_id, source,
             CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD_RUN}')) AS BIGINT) AS size,
             md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, sum(size) AS s FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w,
        (SELECT sum(s) * 150 / 100 FROM s) AS b FROM s),
r AS (SELECT *, 2 * s / w AS lim,
        coalesce(sum(2 * s) OVER o, 0) AS full_words, coalesce(sum(w) OVER o, 0) AS full_weight,
        sum(w) OVER () AS all_weight FROM w
      WINDOW o AS (ORDER BY 2 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (b - full_words) / (all_weight - full_weight) AS level FROM r),
c AS (SELECT arg_min(level, lim) AS level FROM l WHERE level <= lim),
t AS (SELECT source, CAST(s AS BIGINT) AS source_size,
        CAST(least(w * c.level, 2 * s) AS DOUBLE) AS target FROM l CROSS JOIN c),
q AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, floor(target) - before))
          + greatest(0, least(size, floor(target) - before - source_size)) AS BIGINT) AS taken,
       CASE WHEN target > 0 THEN (before + size) / target END AS finish
FROM q
"""

_LINE = r"regexp_replace(trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]', '0', 'g')"

OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '{WORD_RUN}') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)),
                         lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS t
        FROM d, unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) >= 5),
rep AS (SELECT r, count(DISTINCT p) AS n FROM
          (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM win) WHERE c > 1),
          unnest(range(i, i + 5)) AS u(p) GROUP BY r),
ln AS (SELECT DISTINCT source, text, {_LINE} AS line FROM d, unnest(lines) AS u(x)),
per AS (SELECT source, count(DISTINCT text) AS texts FROM d GROUP BY source),
often AS (SELECT ln.source, line FROM ln JOIN per ON ln.source IS NOT DISTINCT FROM per.source
          GROUP BY ln.source, line, texts HAVING count(*) > 10 AND count(*) > texts * 0.05),
lost AS (SELECT r, sum(len(regexp_extract_all(x, '{WORD_RUN}'))) AS lost
         FROM (SELECT r, source, x, {_LINE} AS line FROM d, unnest(lines) AS u(x)) AS e
         JOIN often ON e.source IS NOT DISTINCT FROM often.source AND e.line = often.line GROUP BY r),
b AS (SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost
      FROM d LEFT JOIN rep USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - lost >= n_words * 0.2 AS kept
FROM b
"""

OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all({low('text')}, '{WORD_RUN}') AS w FROM documents),
t AS (SELECT r, i, w[i] AS w1, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS w2,
        CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS w3
      FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
c AS (SELECT r, i,
        count(*) OVER (PARTITION BY w1) - count(*) OVER (PARTITION BY w1, r) AS c1,
        CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY w2) - count(*) OVER (PARTITION BY w2, r) ELSE 0 END AS c2,
        CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY w3) - count(*) OVER (PARTITION BY w3, r) ELSE 0 END AS c3
      FROM t),
x AS (SELECT *, lag(c1) OVER (PARTITION BY r ORDER BY i) AS b1, lag(c2) OVER (PARTITION BY r ORDER BY i) AS b2,
        greatest(1, (SELECT count(*) FROM t) - count(*) OVER (PARTITION BY r)) AS n FROM c),
s1 AS (SELECT *, CASE WHEN c1 > 0 THEN c1 / n ELSE 1 / (n + 1) END AS s1 FROM x),
s2 AS (SELECT *, CASE WHEN c2 > 0 THEN c2 / b1 WHEN i > 1 THEN 0.4::DOUBLE * s1 ELSE s1 END AS s2 FROM s1),
s3 AS (SELECT *, CASE WHEN c3 > 0 THEN c3 / b2 WHEN i > 2 THEN 0.4::DOUBLE * s2 ELSE s2 END AS s3 FROM s2),
g AS (SELECT r, sum(ln(s3) ORDER BY i) AS log_score, count_if(c3 > 0) AS n_full FROM s3 GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_full, 0) AS BIGINT) AS n_full,
       round(log_score, 4) AS log_score, round(log_score / len(w), 6) AS score
FROM d LEFT JOIN g USING (r)
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all({low('text')}, '{WORD_RUN}') AS w FROM documents),
sh AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g
       FROM d, unnest(range(1, greatest(2, len(w) - 3))) AS u(i) WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS x
           FROM sh AS a JOIN sh AS b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
links AS (SELECT a, b FROM common JOIN n AS p ON a = p.r JOIN n AS q ON b = q.r
          WHERE 100 * x >= 80 * (p.n + q.n - x)),
reach(r, c) AS (SELECT r, r FROM d UNION SELECT reach.r, b FROM reach JOIN links ON a = c),
least AS (SELECT reach.r, min(o.doc_id) AS component_id FROM reach JOIN d AS o ON o.r = c GROUP BY reach.r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM d LEFT JOIN n USING (r) JOIN least USING (r)
"""

_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))

OP11 = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '{WORD_RUN}') AS w FROM documents),
e AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END)
        || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
        || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END)
        || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
        || (CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS fails
      FROM d JOIN e USING (text) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
o AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS name, filter_order[1:step - 1] AS before
      FROM (VALUES {_ORDERS}) AS v(filter_order), unnest(range(1, 6)) AS u(step)),
x AS (SELECT part, filter_order, step, name, n, good, toxic, contains(fails, name) AS failed, fails = name AS alone,
        length(translate(fails, before, '')) < length(fails) AS gone FROM c, o),
s AS (SELECT part, filter_order, step, name,
        CAST(sum(n) FILTER (NOT gone AND NOT failed) AS BIGINT) AS kept,
        CAST(sum(n) FILTER (failed AND NOT gone) AS BIGINT) AS removed,
        CAST(sum(n) FILTER (failed AND gone) AS BIGINT) AS redundant,
        CAST(sum(n) FILTER (alone) AS BIGINT) AS unique_fails,
        CAST(sum(n) FILTER (failed AND NOT gone AND good) AS BIGINT) AS good_lost,
        CAST(sum(n) FILTER (failed AND NOT gone AND toxic) AS BIGINT) AS toxic_lost
      FROM x GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed,
       coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
       coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, name) AS BIGINT) AS shapley
FROM s
"""

OP13 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS a, a.label = b.label AS same, b.vec_id AS b,
        CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
      FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
pos AS (SELECT a, b, score FROM p WHERE same
        QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
r AS (SELECT pos.a, pos.b, pos.score, p.b AS n, p.score AS n_score,
        row_number() OVER (PARTITION BY pos.a, pos.b ORDER BY p.score DESC, p.b) AS rank
      FROM pos JOIN p ON p.a = pos.a AND NOT p.same
        AND 80 * pos.score <= 100 * p.score AND 100 * p.score <= 100 * pos.score)
SELECT a AS anchor_id, b AS positive_id, CAST(rank AS INTEGER) AS rank, n AS negative_id,
       score AS positive_score, n_score AS negative_score FROM r WHERE rank <= 5
"""

_URL_RULES = ", ".join(
    f"('{v}', '{h}', '{p}')" for v, h, p in (
        ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
        ("allow", "com", "/fr/"), ("block", "com", "/de/"),
    )
)


def _url_parts(url: str) -> str:
    return (
        f"translate(regexp_extract(coalesce({url}, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, "
        f"regexp_extract(coalesce({url}, ''), '://[^/?#]*([^?#]*)', 1) AS path, "
        f"regexp_extract(coalesce({url}, ''), '://[^?#]*([?][^#]*)', 1) AS query"
    )


#: Targets of tags are taken where they are absolute and quoted, with rel or http-equiv first.
OP12 = f"""
WITH RECURSIVE raw AS (SELECT url, unnest(
        regexp_extract_all(html, '(?i)<link\\s+rel="canonical"\\s+href="(https?://[^"]*)"', 1)
        || regexp_extract_all(html, '(?i)<meta\\s+http-equiv="refresh"\\s+content="[0-9.]+\\s*;\\s*url=(https?://[^"]*)"', 1)
      ) AS target FROM pages WHERE url LIKE '%://%'),
u AS (SELECT url, {_url_parts('url')} FROM (SELECT url FROM pages UNION SELECT target FROM raw)),
n AS (SELECT *, CASE WHEN host <> '' THEN host || (CASE WHEN path = '' THEN '/' ELSE path END) || query END AS node FROM u),
r AS (SELECT * FROM (VALUES {_URL_RULES}) AS v(verdict, rh, rp)),
j AS (SELECT n.url, node, host, path, rh || rp AS rule, verdict,
        row_number() OVER (PARTITION BY n.url ORDER BY length(rh || rp) DESC, verdict) AS k
      FROM n LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
d AS (SELECT * FROM j WHERE k = 1),
e AS (SELECT a.node AS a, b.node AS b FROM raw JOIN n AS a ON raw.url = a.url JOIN n AS b ON raw.target = b.url),
ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, a FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
bad AS (SELECT reach.a AS node FROM reach JOIN d ON d.node = reach.b GROUP BY reach.a
        HAVING bool_or(d.verdict = 'block') AND NOT coalesce(bool_or(d.verdict = 'allow'), false))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bad.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN rule IS NOT NULL THEN 'rule' WHEN bad.node IS NOT NULL THEN 'alias' ELSE 'none' END AS decided_by
FROM pages JOIN d ON pages.url IS NOT DISTINCT FROM d.url LEFT JOIN bad USING (node)
"""
