"""DuckDB SQL for the registered queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY_LEDGER = rf"""
d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)),
                         lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
      FROM documents),
g AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
             len(regexp_extract_all(t, '[A-Z]')) AS n_capitals, len(regexp_extract_all(t, '!')) AS n_exclamations
      FROM d LEFT JOIN c USING (doc_id)),
q AS (SELECT *,
             CASE WHEN n_words < 50 THEN 1 ELSE 0 END
             + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
             + CASE WHEN 10 * n_dup_lines > 6 * n_lines THEN 8 ELSE 0 END
             + CASE WHEN word_chars > 20 * n_words OR word_chars < 2 * n_words THEN 16 ELSE 0 END
             + CASE WHEN 2 * n_capitals > word_chars THEN 32 ELSE 0 END
             + CASE WHEN 2 * n_exclamations > n_words THEN 64 ELSE 0 END AS failed
      FROM m)"""

ORACLES = {
    "op1_quality_rules": f"""WITH {QUALITY_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals,
       n_exclamations, failed, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept FROM q""",
    "op6_substring_dedup": f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
r AS (SELECT doc_id, i FROM p QUALIFY min(doc_id) OVER (PARTITION BY h) < doc_id),
x AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest(range(0, 50)) AS k)),
k AS (SELECT e.doc_id, e.i, e.word, x.i IS NOT NULL AS gone
      FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d) e
      LEFT JOIN x ON x.doc_id = e.doc_id AND x.i = e.i),
s AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed,
             coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)""",
    "op7_jaccard_join": rf"""WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
      FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM l JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS reached FROM d UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.reached)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(reached) FROM r WHERE r.node = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)""",
    "op9_chat_perspectives": r"""WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'),
                                     coalesce(text, '')) - 1 AS rank,
         replace(replace(replace(replace(coalesce(role, 'unknown'), '\', '\\'), '<|im_', '<\|im_'),
                         ' ', '\s'), chr(10), '\n') AS role,
         replace(replace(coalesce(text, ''), '<|im_', '<\|im_'), chr(13) || chr(10), chr(10)) AS text
  FROM conversations),
c AS (SELECT conv_id, rank // 64 AS chunk, rank, role, text FROM t),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM c WHERE role <> 'system'),
x AS (SELECT c.conv_id, c.chunk, speaker, rank, role, text,
             '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant'
                                    ELSE 'user name=' || role END || chr(10) AS head
      FROM c JOIN p ON c.conv_id IS NOT DISTINCT FROM p.conv_id),
y AS (SELECT *, sum(length(head) + length(text) + 11)
                OVER (PARTITION BY conv_id, chunk, speaker ORDER BY rank) - length(text) - 11 AS pos FROM x)
SELECT conv_id, chunk, speaker, count(*) AS n_turns,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY rank) AS text,
       coalesce(string_agg(CAST(pos AS BIGINT) || ':' || CAST(pos + length(text) AS BIGINT), ',' ORDER BY rank)
                FILTER (role = speaker), '') AS mask
FROM y GROUP BY conv_id, chunk, speaker""",
}
