"""DuckDB SQL for the queries that SQL can state."""

from __future__ import annotations

from flowsift.llm.shard_tree import HEX_DIGITS, Shard, regular_topology


def _tree_sql(topology: list[Shard], name: str) -> str:
    """CTEs ``name`` (k, shard): each key's three weighted draws."""
    rows = ", ".join(f"('{t.region}', '{t.region}.{t.rack}', '{t.region}.{t.rack}.{t.shard}', {t.shard}, {t.weight})"
                     for t in topology)
    draw = ("arg_min({c}, -ln((CAST('0x' || substr(md5(k || '/' || {c}), 1, %d) AS BIGINT) + 0.5) / %d.0) / w)"
            % (HEX_DIGITS, 16 ** HEX_DIGITS))
    return f"""
{name}_t(g, r, s, shard, w) AS (VALUES {rows}),
{name}_1 AS (SELECT k, {draw.format(c='g')} AS g FROM keys, (SELECT g, sum(w) AS w FROM {name}_t GROUP BY g) GROUP BY k),
{name}_2 AS (SELECT k, {draw.format(c='r')} AS r FROM {name}_1
             JOIN (SELECT g, r, sum(w) AS w FROM {name}_t GROUP BY g, r) USING (g) GROUP BY k),
{name}_3 AS (SELECT k, {draw.format(c='s')} AS s FROM {name}_2 JOIN {name}_t USING (r) GROUP BY k),
{name} AS (SELECT k, shard FROM {name}_3 JOIN {name}_t USING (s))"""


SHARD_TREE = f"""
WITH keys AS (SELECT DISTINCT coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents),
{_tree_sql(regular_topology(8), 'now')},
{_tree_sql(regular_topology(9), 'more')},
crc AS (SELECT list(list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1)
                                ELSE c >> 1 END, i) ORDER BY i) AS tab FROM range(256) t(i)),
body AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, encode(coalesce(text, '')) AS b FROM documents),
bytes AS (SELECT doc_id, k, CAST(octet_length(b) + 1 AS BIGINT) AS size,
                 CASE WHEN octet_length(b) = 0 THEN CAST([] AS VARCHAR[])
                      ELSE string_split(rtrim(regexp_replace(hex(b), '(..)', '\\1,', 'g'), ','), ',') END AS hs
          FROM body),
sums AS (SELECT doc_id, k, size, xor(list_reduce(list_transform(hs, lambda x: CAST('0x' || x AS BIGINT)),
                lambda c, x: xor(c >> 8, tab[CAST(xor(c, x) & 255 AS BIGINT) + 1]), 4294967295), 4294967295)
                AS text_crc32 FROM bytes, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(now.shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY now.shard ORDER BY md5(k || '/' || size || '/' || text_crc32),
                          doc_id, size, text_crc32) - 1 AS slot,
       CAST(more.shard AS INTEGER) AS grown_shard
FROM sums JOIN now USING (k) JOIN more USING (k)
"""

CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
esc AS (SELECT *, length(replace(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '\', '\\'), chr(10), '\n'))
                  + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))
                  + length('<|im_start|>') + 1 + length('<|im_end|>') + 1 AS chars,
               lead(role) OVER w AS after, lag(role) OVER w AS before
        FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars,
       bool_and(CASE coalesce(before, '') WHEN '' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user'
                     WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role IN ('user', 'tool')
                     WHEN 'tool' THEN role = 'assistant' ELSE false END)
         AND bool_and(after IS NOT NULL OR role IN ('user', 'assistant')) AS valid
FROM esc GROUP BY conv_id
"""

LINES = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
                      generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
solid AS (SELECT doc_id, i, trim(raw, ' ') AS x FROM lines WHERE trim(raw, ' ') <> ''),
win AS (SELECT doc_id, i AS p0, lead(i, 2) OVER w AS p2,
               [x, lead(x, 1) OVER w, lead(x, 2) OVER w] AS k
        FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
full_win AS (SELECT * FROM win WHERE p2 IS NOT NULL),
firsts AS (SELECT k, min({'d': doc_id, 'p0': p0, 'p2': p2}) AS f FROM full_win GROUP BY k HAVING count(*) > 1),
later AS (SELECT doc_id, CASE WHEN doc_id = f.d THEN greatest(p0, f.p2 + 1) ELSE p0 END AS p0, p2
          FROM full_win JOIN firsts USING (k)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p0, p2 + 1)) AS i FROM later WHERE p0 <= p2),
kept AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY i) AS text, count(*) AS n
         FROM lines ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

_WORDS4 = r"""
words AS (SELECT doc_id, list_filter(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
                             WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i:
                                  w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
         FROM words)"""

NEAR_DUP = f"""
WITH RECURSIVE {_WORDS4},
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
held AS (SELECT doc_id, unnest(s) AS k FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM held a JOIN held b USING (k)
          WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * i >= 80 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT doc_id, doc_id FROM sizes UNION
                     SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM sizes JOIN (SELECT id, min(other) AS c FROM reach GROUP BY id) ON id = doc_id
"""

DECONTAMINATION = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
said AS (SELECT item_id, text, list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'),
                lambda x: regexp_matches(x, '[\p{L}\p{N}_]')) AS s FROM benchmark WHERE text IS NOT NULL),
parts AS (SELECT item_id, 'whole' AS part, text FROM said
          UNION ALL SELECT item_id, 'question', CASE WHEN len(s) > 1 THEN array_to_string(s[:-2], ' ') ELSE text END FROM said
          UNION ALL SELECT item_id, 'answer', CASE WHEN len(s) > 1 THEN s[-1] ELSE text END FROM said),
pw AS (SELECT item_id, part, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM parts),
pk AS (SELECT DISTINCT item_id, part, least(5, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2),
              lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS k FROM pw WHERE len(w) > 0),
dk AS (SELECT DISTINCT doc_id, t.n, unnest(list_transform(range(1, len(w) - t.n + 2),
              lambda i: array_to_string(w[i:i + t.n - 1], ' '))) AS k
       FROM dw, (SELECT DISTINCT n FROM pk) t WHERE len(w) >= t.n),
size AS (SELECT item_id, part, count(*) AS total FROM pk GROUP BY ALL),
held AS (SELECT doc_id, item_id, part, count(*) AS c FROM dk JOIN pk USING (n, k) GROUP BY ALL),
met AS (SELECT DISTINCT doc_id, item_id FROM held),
shares AS (SELECT m.doc_id, m.item_id, s.part, s.total, coalesce(h.c, 0) / s.total AS share
           FROM met m JOIN size s USING (item_id) LEFT JOIN held h USING (doc_id, item_id, part)),
pairs AS (SELECT doc_id, item_id, max(share) FILTER (part = 'whole') AS overlap,
                 max(share) FILTER (part = 'question') AS question_overlap, max(total) FILTER (part = 'question') AS q,
                 max(share) FILTER (part = 'answer') AS answer_overlap FROM shares GROUP BY doc_id, item_id)
SELECT doc_id, item_id, round(overlap, 6) AS overlap, round(question_overlap, 6) AS question_overlap,
       round(answer_overlap, 6) AS answer_overlap
FROM pairs WHERE overlap >= 0.8 OR (q >= 8 AND question_overlap >= 0.8)
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

RUNS = r"""
WITH crc AS (SELECT list(list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1)
                                     ELSE c >> 1 END, i) ORDER BY i) AS tab FROM range(256) t(i)),
given AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k,
                 regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
hashed AS (SELECT rid, doc_id, w, CAST(len(w) AS BIGINT) AS n,
                  xor(list_reduce(CASE WHEN k = '' THEN CAST([] AS BIGINT[]) ELSE list_transform(string_split(k, ''),
                      lambda x: CAST(ascii(x) AS BIGINT)) END,
                      lambda c, x: xor(c >> 8, tab[CAST(xor(c, x) & 255 AS BIGINT) + 1]), 4294967295), 4294967295) AS h
           FROM given, crc),
cut AS (SELECT *, (h // 10) % greatest(n, 1) AS a, (h // 10) % 8 AS g8 FROM hashed),
docs AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
                  w[(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g8)) END) + 1]) ELSE w END AS w
         FROM cut),
sixes AS (SELECT rid, n, unnest(list_transform(range(1, greatest(n - 4, 1)), lambda i: hash(w[i:i + 5]))) AS k,
                 unnest(range(0, greatest(n - 5, 0))) AS i FROM docs WHERE n >= 12),
same AS (SELECT x.rid, x.i, y.i - x.i AS q FROM sixes x JOIN sixes y
         ON x.rid = y.rid AND x.k = y.k AND y.i > x.i AND y.i - x.i <= x.n // 2),
isles AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS isle FROM same),
spans AS (SELECT rid, q, min(i) AS s, count(*) + 5 + q AS l FROM isles GROUP BY rid, q, isle),
long AS (SELECT * FROM spans WHERE l >= greatest(12, 2 * q)),
runs AS (SELECT * FROM long x WHERE NOT EXISTS (SELECT 1 FROM long y WHERE y.rid = x.rid AND y.q < x.q
         AND x.q % y.q = 0 AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
sums AS (SELECT rid, count(*) AS n_runs, arg_min({'s': s, 'l': l, 'q': q}, {'a': -l, 'b': s, 'c': q}) AS best,
                string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + l)) AS i FROM runs),
words AS (SELECT rid, unnest(w) AS w, unnest(range(n)) AS i FROM docs SEMI JOIN sums USING (rid)),
rest AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start,
       CAST(best.l AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
       CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(CASE WHEN n_runs IS NULL THEN coalesce(array_to_string(w, ' '), '') ELSE kept END) AS collapsed_sha256
FROM docs LEFT JOIN sums USING (rid) LEFT JOIN rest USING (rid)
"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND label IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, c.vec_id AS b, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b, score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
r AS (SELECT p.a, p.b, p.score AS ps, s.b AS n, s.score AS ns,
             row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, b AS positive_id, CAST(rank AS INTEGER) AS rank, n AS negative_id,
       ps AS positive_score, ns AS negative_score FROM r WHERE rank <= 3
"""
