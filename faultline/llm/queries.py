"""Registered queries of this subpackage, and the SQL of those that SQL can state."""

from __future__ import annotations

from faultline.llm.extraction import op4_site_style_tree
from faultline.llm.fingerprints import op2_consistent_weighted
from faultline.llm.jaccard import op3_size_aware_jaccard
from faultline.llm.langid import op7_hyperdimensional
from faultline.llm.lexical import op12_nra
from faultline.llm.mixing import op8_pareto_mixing
from faultline.llm.neighbours import op10_small_world
from faultline.llm.packing import op1_best_fit_packing
from faultline.llm.quality import op9_ordinal_quality
from faultline.llm.simhash import op13_ball_hashing
from faultline.llm.spelling import op11_fm_index
from faultline.llm.suffix import op6_prefix_doubling
from faultline.llm.warc import op5_salvaged_warc

QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_consistent_weighted, op3_size_aware_jaccard, op4_site_style_tree,
    op5_salvaged_warc, op6_prefix_doubling, op7_hyperdimensional, op8_pareto_mixing,
    op9_ordinal_quality, op10_small_world, op11_fm_index, op12_nra, op13_ball_hashing)}

SQL: dict[str, str] = {}

SQL["op5_salvaged_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id, count(*) AS n FROM d
      WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN n > 1 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""

SQL["op8_pareto_mixing"] = r"""
WITH d AS (SELECT doc_id, source,
             coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             (('0x' || substr(md5('mix|' || doc_id::VARCHAR), 1, 12))::BIGINT + 0.5::DOUBLE)
               / 281474976710656::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1 AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k FROM r),
c AS (SELECT *, coalesce(sum(source_size) OVER before, 0) AS cs, coalesce(sum(w) OVER before, 0) AS cw,
        sum(source_size) OVER () AS ts, sum(w) OVER () AS tw FROM o
      WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (ts - 3 * cs)::BIGINT AS over_, (tw - cw)::BIGINT AS lw FROM c),
g AS (SELECT k, over_, lw FROM f WHERE over_ * w <= 3 * source_size * lw ORDER BY k LIMIT 1),
t AS (SELECT f.source, f.source_size, CASE WHEN f.source_size = 0 THEN 0.0
        WHEN g.k IS NULL OR f.k < g.k THEN (3 * f.source_size)::DOUBLE
        ELSE (g.over_ * f.w)::DOUBLE / g.lw::DOUBLE END AS target FROM f LEFT JOIN g ON true),
x AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS whole FROM t),
y AS (SELECT *, target - whole * source_size AS rest FROM x),
z AS (SELECT source, size, sum(n * size) OVER (PARTITION BY source ORDER BY size DESC
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS certain,
        sum(n * size * size) OVER (PARTITION BY source ORDER BY size) AS squares
      FROM (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY 1, 2)),
i AS (SELECT z.source, z.size AS lim, (rest - coalesce(certain, 0)::DOUBLE) / squares::DOUBLE AS c
      FROM z JOIN y ON z.source IS NOT DISTINCT FROM y.source
      WHERE (rest - coalesce(certain, 0)::DOUBLE) / squares::DOUBLE * z.size < 1
      QUALIFY row_number() OVER (PARTITION BY z.source ORDER BY z.size DESC) = 1),
p AS (SELECT d.*, y.source_size, y.target, y.whole, y.rest, coalesce(i.lim, 0) AS lim,
        least(greatest(coalesce(i.c, 0) * d.size, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE) AS p
      FROM d JOIN y ON d.source IS NOT DISTINCT FROM y.source
      LEFT JOIN i ON d.source IS NOT DISTINCT FROM i.source),
q AS (SELECT doc_id, size, source_size, target, whole, rest, coalesce(sum(size) OVER (PARTITION BY source
          ORDER BY CASE WHEN size > lim THEN 0 ELSE (u / (1 - u)) / (p / (1 - p)) END, doc_id, size
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM p)
SELECT doc_id, size, source_size, target,
  ((whole + CASE WHEN source_size > 0 AND upto + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM q
"""

SQL["op12_nra"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
c AS (SELECT count(*)::BIGINT AS big_n, sum(len(ts))::BIGINT AS big_l FROM d WHERE len(ts) > 0),
i AS (SELECT DISTINCT item_id, unnest(
             regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
p AS (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS t FROM d),
f AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM p WHERE t IN (SELECT t FROM i) GROUP BY ALL),
w AS (SELECT t, floor(1000::DOUBLE * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM f, c GROUP BY t, big_n),
s AS (SELECT i.item_id, f.r, f.doc_id, sum(w.w * ((1000000000 * tf)
             // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
      FROM i JOIN f USING (t) JOIN w USING (t), c GROUP BY i.item_id, f.r, f.doc_id),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank,
             doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM o WHERE rank <= 10
"""

SQL["op11_fm_index"] = r"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(
         list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384)
           ELSE c >> 1 END) AS v FROM range(256) r(i))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents),
each AS (SELECT w, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x
         FROM runs WHERE length(w) >= 7 GROUP BY doc_id, w),
hashed AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
             range(0, length(x), 2), lambda i: ('0x' || substr(x, i + 1, 2))::BIGINT)),
             lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS h FROM each, crc),
cut AS (SELECT n, CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2)
          ELSE w END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word
          HAVING sum(n) >= 2),
gaps AS (SELECT word, n, left(word, i) AS a, substr(word, i + 2) AS b
         FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT g.word AS w, v.word AS v, v.n FROM gaps g JOIN gaps v
            ON g.a || '*' || g.b = v.a || '*' || v.b AND g.word <> v.word
          UNION SELECT g.word, v.word, v.n FROM gaps g JOIN words v ON v.word = g.a || g.b
          UNION SELECT v.word, g.word, g.n FROM gaps g JOIN words v ON v.word = g.a || g.b),
best AS (SELECT w, count(*) AS n_near, max(n) AS top, arg_min(v, struct_pack(n := -n, v := v)) AS v
         FROM pairs GROUP BY w),
forms AS (SELECT word, words.n, coalesce(n_near, 0) AS n_near,
            CASE WHEN top >= 10 * words.n THEN v END AS form,
            CASE WHEN top >= 10 * words.n THEN top END AS form_n
          FROM words LEFT JOIN best ON w = word),
walk AS (SELECT word, form AS root FROM forms WHERE form IS NOT NULL
         UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.root
         WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, root FROM walk JOIN forms f ON f.word = walk.root WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n
FROM forms LEFT JOIN ends USING (word)
"""
