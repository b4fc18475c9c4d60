"""The results of the training-data queries in DuckDB SQL, written apart from the operators."""

SQL: dict[str, str] = {}

SQL["op7_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, n * -1000000000000 + doc_id) AS keep_id FROM t GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
"""

SQL["op5_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
    translate(regexp_replace(regexp_replace(line, '\A[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+\z', ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), r AS (
  SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.*, r.keep_id IS NOT NULL AND r.keep_id <> doc_id AS gone FROM k LEFT JOIN r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

SQL["op9_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
), s AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS said,
    -- start, role, line feed, text with its escape signs, end and line feed
    sum(12 + 1 + 10 + 1 + length(role) + length(text) + length(text) - length(replace(text, '\', ''))
      + length(regexp_replace(text, '<(\|(im_start|im_end|br|endoftext|startoftext)\||/?s|</?SYS>)>|\[/?INST\]', '\0#', 'g')) - length(text)) AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(said) AS loss_chars, sha256(said) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
FROM s
"""


def _clusters(rounds: int = 3) -> str:
    """Rounds written out one after the other; centroids are rows of lists."""
    parts = [r"""
e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k, v AS c FROM e
  ORDER BY sha256('1:' || vec_id), v LIMIT 16
)"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS (
  SELECT vec_id, v, min((d, k)) AS m FROM (
    SELECT vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d, rn
    FROM (SELECT *, row_number() OVER () AS rn FROM e) CROSS JOIN c{i})
  GROUP BY rn, vec_id, v
)""")
        if i < rounds:
            parts.append(f"""s{i} AS (
  SELECT k, list(floor_mean ORDER BY i) AS c FROM (
    SELECT m[2] AS k, i, (sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_mean
    FROM a{i} CROSS JOIN range(1, 65) r(i) GROUP BY 1, 2) GROUP BY k
), c{i + 1} AS (SELECT k, coalesce(s{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN s{i} USING (k))""")
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, k::INT AS cluster, m[1] AS distance, (sum(m[1]) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
  (sum(m[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM (SELECT *, m[2] AS k FROM a{rounds}) JOIN c{rounds} USING (k)
"""


SQL["op13_centroids"] = _clusters()

# The targets by filling up: a source stops when its most is below its share of what is left, over all sources at least as needy.
SQL["op11_curriculum"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, 'null:' || coalesce(text, ''))) AS place
  FROM documents
), s AS (
  SELECT source, sum(size)::DOUBLE AS source_size, 3.0::DOUBLE * sum(size) AS most,
    [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
    [7.5::DOUBLE, 2.0, 0.5][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w0,
    [-5.0::DOUBLE, 0.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS slope
  FROM d GROUP BY source
), f AS (
  SELECT a.source, bool_and(b.most * (SELECT sum(c.w) FROM s c WHERE c.most / c.w >= b.most / b.w)
    <= b.w * ((SELECT sum(source_size) FROM s) - coalesce((SELECT sum(c.most) FROM s c WHERE c.most / c.w < b.most / b.w), 0))) AS stops
  FROM s a JOIN s b ON b.most / b.w <= a.most / a.w GROUP BY a.source
), t AS (
  SELECT s.*, CASE WHEN stops THEN most ELSE w * ((SELECT sum(source_size) FROM s)
      - coalesce((SELECT sum(most) FROM s JOIN f ON s.source IS NOT DISTINCT FROM f.source WHERE stops), 0))
    / (SELECT sum(w) FROM s JOIN f ON s.source IS NOT DISTINCT FROM f.source WHERE NOT stops) END AS target
  FROM s JOIN f ON s.source IS NOT DISTINCT FROM f.source
), p AS (
  SELECT d.*, t.* EXCLUDE (source), floor(target + 0.5)::BIGINT AS lim,
    (sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), y AS (SELECT *, a / lim * w AS y FROM p)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  (greatest(least(lim - a, size), 0) + greatest(least(lim - a - source_size, size), 0) + greatest(least(lim - a - 2 * source_size, size), 0))::BIGINT AS taken,
  CASE WHEN least(lim - a, size) > 0 THEN 2.0 * y / (w0 + sqrt(w0 * w0 + 2.0 * slope * y)) END AS position
FROM y
"""

# CRC-32 bit by bit; costs from the last row to the first; then one edit a step, the least letter that the costs allow.
SQL["op12_turn_repair"] = r"""
WITH RECURSIVE b AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295::BIGINT] || list_transform(
        string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT),
      lambda c, x: list_reduce([xor(c, x)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1)))), 4294967295::BIGINT) % 20 AS fault
  FROM conversations
), d AS (
  SELECT g, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END))
  FROM b WHERE fault <> 0
), n AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS pos, substr(role, 1, 1) AS initial FROM d
), k AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY g, role, text ORDER BY pos) > 1 AS again,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) NOT IN ('.', '!', '?') AS cut,
    lag(initial) OVER (PARTITION BY g ORDER BY pos) || initial AS pair, lag(g) OVER (PARTITION BY g ORDER BY pos) IS NOT NULL AS has_pair
  FROM n
), r AS (
  SELECT g, pos, role, text, blank OR again AS must, cut::INT AS extra,
    CASE initial WHEN 's' THEN [1, 99, 99, 99] WHEN 'u' THEN [2, 2, 99, 2] WHEN 'a' THEN [99, 99, 3, 99] ELSE [99, 99, 99, 99] END AS keep
  FROM k
), c AS (
  SELECT g, count(*) AS rows, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (cut AND NOT blank AND NOT again) AS truncated, count(*) FILTER (has_pair AND pair NOT IN ('su', 'ua', 'au')) AS illegal,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
  FROM k GROUP BY g
), v AS (
  SELECT g, rows + 1 AS pos, [0, 4, 2, 0]::BIGINT[] AS v FROM c
  UNION ALL
  SELECT g, pos, [least(e[1], 2 + e[3], 4 + e[4]), least(e[2], 2 + e[3], 4 + e[4]), least(e[3], 2 + e[4]), least(e[4], 2 + e[3])]
  FROM (
    SELECT r.g, r.pos, CASE WHEN must THEN list_transform(v.v, lambda x: x + 3) ELSE list_transform([1, 2, 3, 4], lambda s:
      least(3 + v.v[s], 2 + extra + v.v[[3, 3, 4, 3][s]], CASE WHEN keep[s] < 99 THEN extra + v.v[keep[s] + 1] ELSE 1000000000 END)) END AS e
    FROM v JOIN r ON r.g = v.g AND r.pos = v.pos - 1)
), t AS (
  SELECT g, 1::BIGINT AS pos, 0 AS s, 0::BIGINT AS cost, '' AS audit, NULL::VARCHAR AS made, false AS done FROM c
  UNION ALL
  SELECT g, CASE edit WHEN 'I' THEN pos WHEN '' THEN pos ELSE pos + 1 END, CASE edit WHEN 'D' THEN s WHEN '' THEN s WHEN 'K' THEN keep[s + 1] ELSE [2, 2, 3, 2][s + 1] END,
    cost + CASE edit WHEN 'D' THEN 3 WHEN 'I' THEN 2 WHEN 'R' THEN 2 + extra WHEN 'K' THEN extra ELSE 0 END, audit || edit,
    CASE WHEN edit IN ('D', '') THEN made ELSE CASE WHEN made IS NULL THEN '' ELSE made || chr(10) END
      || CASE WHEN edit = 'K' THEN role WHEN s = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END END, edit = ''
  FROM (
    SELECT t.*, r.keep, r.extra, r.role, r.text, CASE
      WHEN r.g IS NULL THEN CASE WHEN a.v[t.s + 1] > 0 THEN 'I' ELSE '' END
      WHEN 3 + z.v[t.s + 1] = a.v[t.s + 1] THEN 'D'
      WHEN 2 + a.v[[3, 3, 4, 3][t.s + 1]] = a.v[t.s + 1] THEN 'I'
      WHEN keep[t.s + 1] < 99 AND extra + z.v[keep[t.s + 1] + 1] = a.v[t.s + 1] THEN 'K'
      ELSE 'R' END AS edit
    FROM t JOIN v a ON a.g = t.g AND a.pos = t.pos LEFT JOIN r ON r.g = t.g AND r.pos = t.pos LEFT JOIN v z ON z.g = t.g AND z.pos = t.pos + 1
    WHERE NOT t.done)
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(made, '')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM b) i LEFT JOIN c ON c.g = i.g LEFT JOIN t ON t.g = i.g AND t.done
"""
