"""DuckDB SQL for the numbered queries that SQL can express on a test table."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# CRC32 by its table, bit by bit; h turns come from the first conversation of the hundred.
ORACLES["op11_prefix_tree"] = """
WITH RECURSIVE bits AS (
  SELECT i, 0 AS step, i::UBIGINT AS c FROM range(256) r(i)
  UNION ALL SELECT i, step + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE step < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS first,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) % 256)::BIGINT + 1])), 4294967295::UBIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc
), rebuilt AS (
  SELECT c.conv_id, t.p, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.first WHERE t.p <= c.h
  UNION ALL SELECT c.conv_id, t.p, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE t.p > c.h
), steps AS (
  SELECT conv_id, text, row_number() OVER w AS depth,
    string_agg(md5(concat(length(role), ':', role, text)), '') OVER (PARTITION BY conv_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS path
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), every AS (SELECT conv_id, depth, path, length(text) AS chars FROM steps UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
lengths AS (SELECT conv_id, max(depth) AS top FROM every GROUP BY conv_id),
nodes AS (
  SELECT e.depth, e.path, min(e.conv_id) AS conv_id, count(*) AS n_convs, any_value(e.chars) AS chars,
    coalesce(string_agg(e.conv_id::VARCHAR, ',' ORDER BY e.conv_id) FILTER (WHERE l.top = e.depth), '') AS ends
  FROM every e JOIN lengths l USING (conv_id) GROUP BY e.depth, e.path
), above AS (
  SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 32)
), children AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1)
SELECT x.conv_id, x.depth, x.parent_conv_id, x.n_convs, max(coalesce(cx.n, 0))::BIGINT AS n_children,
  count(*) FILTER (WHERE cy.n IS NULL) AS n_leaves, sum((y.n_convs - 1) * y.chars)::BIGINT AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM above x JOIN above y ON starts_with(y.path, x.path) LEFT JOIN children cx ON cx.path = x.path LEFT JOIN children cy ON cy.path = y.path
GROUP BY x.conv_id, x.depth, x.parent_conv_id, x.n_convs, x.ends
"""

_ROUND = """given{n} AS (
  SELECT vec_id, v, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
    SELECT k.vec_id, k.v, c.j, list_sum(list_transform(list_zip(k.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept k, centroids{n} c
  ) GROUP BY vec_id, v
)"""
_MOVE = """centroids{m} AS (
  SELECT c.j, coalesce(s.c, c.c) AS c FROM centroids{n} c LEFT JOIN (
    SELECT j, list(x ORDER BY pos) AS c FROM (
      SELECT j, pos, floor(sum(x)::DECIMAL(38,0) / count(*))::BIGINT AS x FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM given{n}) GROUP BY j, pos
    ) GROUP BY j
  ) s ON s.j = c.j
)"""
ORACLES["op12_centroid_clusters"] = f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), centroids0 AS (
  SELECT (row_number() OVER (ORDER BY sha256(concat('2:', vec_id::VARCHAR))) - 1)::INTEGER AS j, v AS c FROM kept ORDER BY sha256(concat('2:', vec_id::VARCHAR)) LIMIT 40
), {", ".join(_ROUND.format(n=n) + ", " + _MOVE.format(n=n, m=n + 1) for n in range(5))}, {_ROUND.format(n=5)}
SELECT vec_id, g.j AS cluster, d AS distance, (sum(d) OVER (PARTITION BY g.j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM given5 g JOIN centroids5 c ON c.j = g.j
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op13_reserved_passages"] = f"""
WITH items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
held AS (
  SELECT DISTINCT item, array_to_string(w[a:a + n - 1], ' ') AS gram, n FROM (
    SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS a FROM items WHERE len(w) > 0
  )
), docs AS (SELECT doc_id, row_number() OVER () AS row_no, {_WORDS} AS w FROM documents),
places AS (
  SELECT row_no, a, s.n, array_to_string(w[a:a + s.n - 1], ' ') AS gram FROM (
    SELECT row_no, w, unnest(range(1, len(w) + 1)) AS a FROM docs
  ) d, (SELECT DISTINCT n FROM held) s WHERE a + s.n - 1 <= len(w)
), found AS (SELECT row_no, a, n, gram FROM places WHERE gram IN (SELECT gram FROM held)),
hits AS (SELECT row_no, count(*) AS n_hit FROM (SELECT DISTINCT row_no, unnest(range(a, a + n)) AS at FROM found) GROUP BY row_no),
named AS (
  SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT f.row_no, h.item FROM found f JOIN held h ON h.gram = f.gram) GROUP BY row_no
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits USING (row_no) LEFT JOIN named USING (row_no)
"""
