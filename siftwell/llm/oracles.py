"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP4 = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM t),
win AS (SELECT rid, p, md5(array_to_string(w[p:p + 7], ' ')) AS k
        FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS p FROM w WHERE len(w) >= 8)),
dup AS (SELECT rid, p FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
rep AS (SELECT rid, sum(g) AS n FROM (SELECT rid, least(8, p - coalesce(lag(p) OVER (PARTITION BY rid ORDER BY p), -8)) AS g FROM dup) GROUP BY rid),
l AS (SELECT rid, source, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS l FROM t),
nd AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM l GROUP BY rid),
n AS (SELECT rid, source, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM l),
own AS (SELECT DISTINCT rid, source, line, md5(line) AS h FROM n),
other AS (SELECT source, line, coalesce(CASE WHEN h = m[1] THEN m[2] ELSE m[1] END, h) AS other
          FROM (SELECT *, list_sort(list(h) OVER (PARTITION BY rid)) AS m FROM own)),
hosts AS (SELECT source, count(*) AS docs FROM documents GROUP BY source),
freq AS (SELECT o.source, line FROM (SELECT source, line, count(DISTINCT other) AS n FROM other GROUP BY source, line) o
         JOIN hosts h ON o.source IS NOT DISTINCT FROM h.source WHERE n > 20 AND 100 * n > 2 * docs),
gone AS (SELECT n.rid, sum(length(n.line)) AS chars, sum(CASE WHEN f.line IS NULL THEN 0 ELSE length(n.line) END) AS gone
         FROM n LEFT JOIN freq f ON n.source IS NOT DISTINCT FROM f.source AND n.line = f.line GROUP BY n.rid),
f AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(nd.n, 0) AS n_dup_lines,
             coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone, 0) AS gone, coalesce(chars, 0) AS chars
      FROM t JOIN w USING (rid) LEFT JOIN nd USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (gone > 0 AND 100 * gone >= 80 * chars AND chars - gone < 100) AS kept, gone::BIGINT AS n_removed_chars
FROM b
"""

OP6 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS stop, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM s),
c AS (SELECT *, sum(source_size) OVER () AS total, coalesce(sum(stop) OVER b, 0) AS stops, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS lft
      FROM w WINDOW b AS (ORDER BY stop / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT stops AS kstops, lft AS klft FROM c WHERE weight * (total - stops) <= stop * lft ORDER BY stop / weight, pos LIMIT 1),
g AS (SELECT source, source_size, stop, (weight * (total - kstops))::DOUBLE / klft::DOUBLE AS level FROM c LEFT JOIN k ON true),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR stop::DOUBLE <= level THEN stop::DOUBLE ELSE level END AS target FROM g),
r AS (SELECT d.*, source_size, target, target / source_size::DOUBLE AS each,
             (('0x' || substr(md5(coalesce(d.source, '') || '17'), 1, 4))::INT + 0.5) / 65536.0::DOUBLE AS u,
             (row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id))::DOUBLE AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN size * least(3, floor(u + each * k) - floor(u + each * (k - 1))) ELSE 0 END)::BIGINT AS taken
FROM r
"""

OP9 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""

OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reached FROM w UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.node = w.doc_id
"""

ORACLES = {"op1_minhash_dedup": OP1, "op4_quality_rules": OP4, "op6_source_mixing": OP6, "op9_warc_zip": OP9}
