"""DuckDB statements for the rows of the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a text, with A-Z in lower case or unchanged.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str, lower: bool = True) -> str:
    value = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')" if lower else f"coalesce({text}, '')"
    return f"regexp_extract_all({value}, '{WORD}')"


def shingles(table: str, key: str, n: int = 5) -> str:
    """Rows (key, s): the distinct n-word shingles; of fewer words, the whole sequence."""
    return f"""
    SELECT DISTINCT {key}, unnest(CASE WHEN len(ws) >= {n} THEN list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))
                                       WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s
    FROM (SELECT {key}, {words('text')} AS ws FROM {table})"""


OP10 = f"""
WITH d AS ({shingles('documents', 'doc_id')}), b AS ({shingles('benchmark', 'item_id')}),
     i AS (SELECT item_id, {words('text')} AS ws FROM benchmark), n AS (SELECT item_id, count(*) AS n_item_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_item_shingles, count(*) AS n_shared
FROM b JOIN d USING (s) JOIN n USING (item_id) WHERE item_id IN (SELECT item_id FROM i WHERE len(ws) >= 5)
GROUP BY doc_id, item_id, n_item_shingles HAVING 100 * count(*) >= 80 * n_item_shingles
UNION ALL
SELECT doc_id, item_id, 1, 1 FROM (SELECT doc_id, ' ' || array_to_string({words('text')}, ' ') || ' ' AS whole FROM documents)
JOIN i ON len(ws) BETWEEN 1 AND 4 AND contains(whole, ' ' || array_to_string(ws, ' ') || ' ')"""


def near_groups(n: int, more: str = "") -> str:
    return f"""
WITH RECURSIVE s AS ({shingles('documents', 'doc_id', n)}), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     link AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
              GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
     reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b) AS component_id{more}
FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a"""


OP5, OP13 = near_groups(5), near_groups(2, ", min(b) = a AS kept")

_HOST = f"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
_PATH = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def op9(rules: list[tuple[str, str, str]]) -> str:
    values = ", ".join(str(r) for r in rules)
    return f"""
    WITH r(host, path, verdict) AS (VALUES {values}), u AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
         m AS (SELECT page_id, r.host || r.path AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC, r.host || r.path DESC) AS k
               FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN (SELECT page_id, rule, verdict FROM m WHERE k = 1) USING (page_id)"""


OP1 = rf"""
WITH a AS (SELECT page_id, url IS NOT NULL AS has_url, md5(coalesce(html, '')) AS tag, strlen(coalesce(html, ''))::VARCHAR AS bytes,
                  regexp_replace(regexp_replace(coalesce(url, ''), '(?s)#.*$', ''), '(?s)^[A-Za-z][A-Za-z0-9+.-]*://', '') AS t FROM pages),
     b AS (SELECT page_id, has_url, tag, bytes, regexp_replace(regexp_replace(translate(regexp_extract(t, '(?s)^([^/?]*)', 1), '{UPPER}', '{LOWER}'), '^www\.', ''), ':(80|443)$', '') AS host,
                  regexp_replace(regexp_extract(t, '(?s)^[^/?]*([^?]*)', 1), '/$', '') AS path,
                  list_filter(string_split(regexp_extract(t, '(?s)^[^?]*\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_')) AS q FROM a),
     c AS (SELECT page_id AS p, has_url, '"' || tag || '"' AS first, '"' || tag || '-2"' AS second, bytes, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END AS u, page_id * 1000 AS t FROM b),
     f AS (SELECT u, has_url, p * 4 AS id, t AS ts, first AS etag, 'm' || p AS modified, 'max-age=60' AS cache, bytes FROM c UNION ALL SELECT u, has_url, p * 4 + 1, t + 300000, second, 'n' || p, 'max-age=30', bytes FROM c WHERE p % 3 = 0),
     r AS (SELECT u, has_url, p * 4 + 2 AS record_id, CASE WHEN p % 7 = 0 THEN t - 1 ELSE t + 700000 END AS ts, CASE WHEN p % 4 = 0 THEN 'W/' || first WHEN p % 4 = 1 AND p % 3 = 0 THEN second WHEN p % 4 = 1 THEN first END AS etag,
                  CASE WHEN p % 4 = 2 THEN CASE WHEN p % 3 = 0 THEN 'n' ELSE 'm' END || p END AS modified, 'max-age=600' AS cache, (t + 700000)::VARCHAR AS date FROM c
           UNION ALL SELECT u, has_url, p * 4 + 3, t + 100000, 'W/' || first, NULL, NULL, (t + 100000)::VARCHAR FROM c),
     m AS (SELECT r.record_id, max(row(f.ts, f.id))[2] AS source_id FROM r JOIN f ON f.u = r.u AND f.ts < r.ts AND r.has_url AND f.has_url GROUP BY r.record_id),
     j AS (SELECT r.*, source_id, f.etag AS f_etag, f.modified AS f_modified, f.cache AS f_cache, f.bytes, source_id IS NOT NULL AND CASE WHEN r.etag IS NOT NULL THEN regexp_replace(r.etag, '^W/', '') = f.etag WHEN r.modified IS NOT NULL THEN r.modified = f.modified ELSE true END AS good
           FROM r LEFT JOIN m USING (record_id) LEFT JOIN f ON f.id = source_id)
SELECT record_id, u AS canonical_url, ts, source_id, CASE WHEN source_id IS NULL THEN 'no_response' WHEN good THEN 'resolved' ELSE 'mismatch' END AS outcome,
       CASE WHEN good THEN 6 ELSE 0 END AS n_headers, CASE WHEN good THEN bytes END AS content_length, CASE WHEN good THEN coalesce(cache, f_cache) END AS cache_control, CASE WHEN good THEN date END AS date,
       CASE WHEN good THEN coalesce(etag, f_etag) END AS etag, CASE WHEN good THEN coalesce(modified, f_modified) END AS last_modified
FROM j"""


def op7(grid: dict, risk: float, confidence: float) -> str:
    tests = sum(map(len, grid.values()))
    cells = [(num, den, cut) for (num, den), cuts in grid.items() for cut in cuts]
    counts = " UNION ALL ".join(f"SELECT stratum, '{num}' AS measure, {cut} AS cutoff, count(*) AS n, count(*) FILTER (1000 * {num} > {cut} * {den}) AS k FROM good GROUP BY stratum" for num, den, cut in cells)
    rate = risk / len(grid)
    rejected = " OR ".join(f"EXISTS (SELECT 1 FROM cut WHERE cut.stratum = m.stratum AND cut.measure = '{num}' AND 1000 * m.{num} > cut.cutoff * m.{den})" for num, den in grid)
    blank = r"[\x20\x09-\x0D]"
    return rf"""
    WITH w AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, {words('text', lower=False)} AS ws,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{blank}', '', 'g') <> '') AS ls FROM documents),
         p AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
         g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 7], ' ')) AS times FROM p),
         r AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM g WHERE times > 1) GROUP BY doc_id),
         m AS (SELECT w.doc_id, stratum, len(ws) AS n_words, length(regexp_replace(text, '{blank}', '', 'g')) AS word_chars,
                      length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
                      coalesce(r.n, 0) AS n_repeat_words, len(ws) < 20 OR 100 * coalesce(r.n, 0) > 30 * len(ws) AS base_failed FROM w LEFT JOIN r USING (doc_id)),
         good AS (SELECT m.* FROM m JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id) WHERE NOT base_failed),
         c AS ({counts}),
         t AS (SELECT c.*, (SELECT count(DISTINCT stratum) FROM good) AS strata,
                      list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rate}) + (n - i) * ln(1 - {rate})))) AS tail FROM c),
         cut AS (SELECT stratum, measure, min(cutoff) AS cutoff FROM t WHERE k < n * {rate} AND tail <= {confidence} / (strata * {tests}) GROUP BY stratum, measure)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({rejected}) AS kept, n_lines FROM m"""


OP8 = f"""
WITH w AS (SELECT doc_id, {words('text', lower=False)} AS ws FROM documents),
     p AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, ws FROM w WHERE len(ws) >= 35),
     g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY md5(array_to_string(ws[i:i + 34], ' '))) AS times FROM p),
     r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM g WHERE times > 1),
     k AS (SELECT doc_id, list(pos) AS gone FROM r GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(gone, i)), ' '), '') END) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)"""


def op12(least: int = 30, top: int = 2000) -> str:
    return rf"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
         w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
         n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
         g AS (SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase FROM w, range(1, 5) s(size) WHERE len(ws) >= size),
         f AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS ws, count(*) AS f FROM g GROUP BY lang, size, phrase HAVING count(*) >= {least}),
         k AS (SELECT lang, phrase, f AS a, ws, unnest(range(1, size)) AS k FROM f WHERE size > 1),
         s AS (SELECT k.lang, k.phrase, a, k, p.f AS l, q.f AS r, (2000000::HUGEINT * a) // (p.f + q.f) AS score
               FROM k JOIN f p ON p.lang = k.lang AND p.phrase = array_to_string(k.ws[1:k], ' ') JOIN f q ON q.lang = k.lang AND q.phrase = array_to_string(k.ws[k + 1:], ' ')),
         b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
         m AS (SELECT lang, f, unnest(flatten(list_transform(range(2, size), lambda j: list_transform(range(1, size - j + 2), lambda i: array_to_string(ws[i:i + j - 1], ' '))))) AS phrase FROM f WHERE size > 2),
         o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.lang = b.lang AND m.phrase = b.phrase AND 100 * m.f >= 80 * b.a))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n USING (lang) QUALIFY rank <= {top}"""


OP12 = op12()
