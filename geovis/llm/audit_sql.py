"""Reference SQL of the archive, filter audit and conversation repair queries."""

from __future__ import annotations

# A SHA-1 is 40 hexadecimal digits; five of them are four digits of base 32. The place in the index
# is that by URL key, time and page.
WARC = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, regexp_extract(regexp_replace(coalesce(url, ''), '[\x00-\x20\x7f]', '%20', 'g'),
    '^((?:[A-Za-z][A-Za-z0-9+.-]*:)?//)(?:[^/@?#]*@)?([^/:?#]*)(:\d+)?([^?#]*)(\?[^#]*)?', ['scheme', 'host', 'port', 'path', 'query']) AS u,
    coalesce(url, '') AS url
  FROM pages
), keyed AS (
  SELECT page_id, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top, CASE WHEN u.scheme = '' THEN url ELSE
    array_to_string(list_reverse(string_split(regexp_replace(lower(u.host), '^www\.', ''), '.')), ',')
    || CASE WHEN u.port IN (':80', ':443') THEN '' ELSE u.port END || ')' || CASE WHEN u.path = '' THEN '/' ELSE u.path END || u.query END AS url_key
  FROM p
)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(x, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31), 1) FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to,
  row_number() OVER (ORDER BY url_key, page_id % 1000000000, page_id) - 1 AS place, url_key
FROM keyed
"""

# Every order of the five filters against every set of failed filters.
FILTER_AUDIT = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS again FROM d
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
      regexp_matches(t, '[#$%&*|]'), again] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l USING (doc_id)
), m AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), letters(x) AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E'])
), orders(o) AS (
  SELECT '' UNION ALL SELECT o || x FROM orders, letters WHERE NOT contains(o, x)
), s AS (
  SELECT o, k, ascii(substr(o, k, 1)) - 64 AS bit, [ascii(substr(o, j, 1)) - 64 FOR j IN range(1, k)] AS before
  FROM orders, range(1, 6) AS r(k) WHERE length(o) = 5
), judged AS (
  SELECT part, o AS filter_order, k, bit, n, good, toxic, fails[bit] AS here, len([j FOR j IN before IF fails[j]]) > 0 AS earlier,
    len([x FOR x IN fails IF x]) AS failed
  FROM m, s
), counted AS (
  SELECT part, filter_order, k::INT AS step, bit,
    coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (here AND NOT earlier), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (here AND earlier), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (here AND failed = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (here AND NOT earlier), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (here AND NOT earlier), 0)::BIGINT AS toxic_lost
  FROM judged GROUP BY part, filter_order, k, bit
)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
"""


def _add(state: str, cost: str, letter: str, row: str) -> str:
    """A state's (cost, audit, repaired text) after one more edit."""
    return f"{{'c': ({state}.c + {cost})::BIGINT, 't': {state}.t || '{letter}', 'r': {state}.r || {row}}}"


def _ways(states: str, role: str) -> list[str]:
    """All ways to come from one of the states to a row of the role, inserted ones not included."""
    extra, may, out = "CASE WHEN fault = 3 THEN 3 ELSE 0 END", "fault IN (0, 3)", []
    for s in states.split():
        kept = _add(s, extra, "K", "chr(10) || role || ':' || text")
        out.append(f"CASE WHEN {may} AND left(role, 1) = '{role[0]}' THEN {kept} END")
        if role != "system":
            out.append(f"CASE WHEN {may} THEN " + _add(s, f"3 + {extra}", "R", f"chr(10) || '{role}:' || text") + " END")
    return out


def _inserted(states: str, role: str) -> list[str]:
    return [_add(s, "3", "I", f"chr(10) || '{role}:'") for s in states.split()]


def _least(*ways: str) -> str:
    return f"least({', '.join(ways)})"


def _deleted(state: str) -> str:
    return _add(state, "4", "D", "''")


_NEVER = "{'c': 1000000000000::BIGINT, 't': '', 'r': ''}"

# Checksums character by character. The repair holds whole audits and texts, row by row: the best
# (cost, audit, repaired) with nothing yet (n), after the system row (s), a user row (u), an assistant row (a).
CONVERSATION_REPAIR = rf"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) AS r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc_table AS (
  SELECT i, c FROM bits WHERE k = 8
), keys AS (
  SELECT DISTINCT coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), crc(key, pos, c) AS (
  SELECT key, 0::BIGINT, 4294967295::BIGINT FROM keys
  UNION ALL SELECT key, pos + 1, xor(crc.c >> 8, x.c) FROM crc JOIN crc_table x ON x.i = xor(crc.c & 255, ascii(substr(key, pos + 1, 1))::BIGINT) WHERE pos < length(key)
), kinds AS (
  SELECT key, xor(c, 4294967295) % 20 AS kind FROM crc WHERE pos = length(key)
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM conversations JOIN kinds ON key = coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') WHERE kind <> 0
), placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g
  FROM damaged
), judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
      WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) || left(role, 1) AS pair
  FROM placed
), counts AS (
  SELECT g, any_value(conv_id) AS conv_id, count(*) AS rows_left, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY g
), walk(g, i, n, s, u, a) AS (
  SELECT g, 0::BIGINT, {{'c': 0::BIGINT, 't': '', 'r': ''}}, {_NEVER}, {_NEVER}, {_NEVER} FROM counts
  UNION ALL
  SELECT g, i, {_deleted("n")}, {_least(_deleted("s"), *_ways("n", "system"))},
    {_least(_deleted("u"), *_ways("n s a", "user"))}, {_least(_deleted("a"), *_ways("u", "assistant"))}
  FROM (
    SELECT g, i, role, text, fault, n, s, u, {_least("a", *_inserted("u", "assistant"))} AS a FROM (
      SELECT walk.g, j.i, j.role, j.text, j.fault, n, s, a, {_least("u", *_inserted("n s a", "user"))} AS u
      FROM walk JOIN judged j ON j.g = walk.g AND j.i = walk.i + 1
    )
  )
), ended AS (
  SELECT g, {_least("n", "a", *_inserted("u", "assistant"))} AS best FROM (
    SELECT w.g, n, a, {_least("u", *_inserted("n s a", "user"))} AS u FROM walk w JOIN counts c ON c.g = w.g AND c.rows_left = w.i
  )
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.t, '') AS audit, sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN (counts JOIN ended USING (g)) c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
"""
