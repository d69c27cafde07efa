"""DuckDB statements for operators 11 and 12, written from the definition, not from the operators' methods: repair as a
relaxation row by row from the end, near words by joins on deletion variants, roots by recursion."""

from __future__ import annotations

# CRC-32 by its table of 256, which a reduction over eight shifts gives (the polynomial is the standard's).
_CRC_TABLE = """tb AS (
  SELECT list(list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i) x)"""


def _crc(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes (``tb.t`` must be in scope)."""
    nibble = "(strpos('0123456789ABCDEF', x[{}]) - 1)"
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ({nibble.format(1)} * 16 + {nibble.format(2)})::BIGINT)"
    return f"xor(list_reduce({data}, lambda c, b: xor(c >> 8, tb.t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SPELLING = f"""WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, translate(r, '{_UP}', '{_UP.lower()}') AS r, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS r FROM documents) x GROUP BY ALL),
hashed AS (SELECT r, c, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || r")} AS h FROM runs, tb WHERE length(r) >= 6),
cut AS (SELECT c, CASE WHEN h % 199 = 0 THEN left(r, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word
        FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
del AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS d
        FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM words) x),
shorter AS (SELECT DISTINCT del.word, w.word AS other FROM del JOIN words w ON w.word = del.d),
near AS (
  SELECT word, other FROM shorter UNION SELECT other, word FROM shorter
  UNION SELECT a.word, b.word FROM del a JOIN del b ON a.d = b.d AND a.i = b.i AND a.word <> b.word),
best AS (
  SELECT near.word, count(*)::BIGINT AS n_near, first(near.other ORDER BY w.n DESC, near.other) AS other,
         max(w.n) AS other_n
  FROM near JOIN words w ON w.word = near.other GROUP BY near.word),
formed AS (
  SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN other_n >= 5 * words.n THEN other END AS form, CASE WHEN other_n >= 5 * words.n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
walk(word, reached) AS (
  SELECT word, word FROM formed
  UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = walk.reached WHERE formed.form IS NOT NULL),
roots AS (SELECT walk.word, walk.reached AS root FROM walk JOIN formed ON formed.word = walk.reached WHERE formed.form IS NULL)
SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)"""


def _add(value: str, cost: str, letter: str) -> str:
    """A value is nine digits of cost and the audit; text order is the order of (cost, audit).  NULL: no way."""
    return f"(lpad((left({value}, 9)::INT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({value}, 10))"


def _closed(source: str) -> str:
    """With insertions before what ``source(ck, k, b0, bs, bu, ba)`` gives for each state."""
    u, a = f"least(bu, {_add('ba', '5', 'I')})", f"least(ba, {_add('bu', '5', 'I')})"
    return f"""SELECT ck, k, least(b0, {_add('vu', '5', 'I')}) AS v0, least(bs, {_add('vu', '5', 'I')}) AS vs, vu, va
    FROM (SELECT *, {u} AS vu, {a} AS va FROM ({source}) b) c"""


_TO_U = f"CASE WHEN stays THEN {_add('vu', '1 + late', 'R')} END"
_TO_A = f"CASE WHEN stays THEN {_add('va', '1 + late', 'R')} END"


def _kept(initial: str, value: str) -> str:
    return f"CASE WHEN stays AND initial = '{initial}' THEN {_add(value, 'late', 'K')} END"


_STEP = f"""SELECT ck, k, least({_add('v0', '2', 'D')}, {_kept('s', 'vs')}, {_kept('u', 'vu')}, {_TO_U}) AS b0,
      least({_add('vs', '2', 'D')}, {_kept('u', 'vu')}, {_TO_U}) AS bs,
      least({_add('vu', '2', 'D')}, {_kept('a', 'va')}, {_TO_A}) AS bu,
      least({_add('va', '2', 'D')}, {_kept('u', 'vu')}, {_TO_U}) AS ba
    FROM (SELECT dp.ck, dp.k - 1 AS k, v0, vs, vu, va, initial, fault NOT IN (1, 2) AS stays, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS late
          FROM dp JOIN rows r ON r.ck = dp.ck AND r.pos = dp.k) j"""

REPAIR = f"""WITH RECURSIVE {_CRC_TABLE},
raw AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') AS ck, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, tb),
made AS (
  SELECT ck, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM raw WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos FROM made),
rows AS (
  SELECT ck, turn, role, text, pos, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY ck ORDER BY pos) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1
              WHEN row_number() OVER (PARTITION BY ck, role, text ORDER BY pos) > 1 THEN 2
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault
  FROM placed),
sums AS (
  SELECT ck, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
         count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
         count(*) FILTER (WHERE fault = 3) AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY ck),
dp(ck, k, v0, vs, vu, va) AS (
  {_closed("SELECT ck, n AS k, '000000000' AS b0, NULL::VARCHAR AS bs, NULL::VARCHAR AS bu, '000000000' AS ba FROM sums")}
  UNION ALL
  {_closed(_STEP)}),
plans AS (SELECT ck, left(v0, 9)::BIGINT AS cost, substr(v0, 10) AS audit FROM dp WHERE k = 0),
letters AS (SELECT ck, unnest(string_split(audit, '')) AS e, unnest(range(1, length(audit) + 1)) AS i FROM plans WHERE audit <> ''),
counted AS (SELECT *, sum((e <> 'I')::INT) OVER (PARTITION BY ck ORDER BY i) AS pos, sum((e <> 'D')::INT) OVER (PARTITION BY ck ORDER BY i) AS j,
                   sum((e <> 'D')::INT) OVER (PARTITION BY ck) AS m FROM letters),
lines AS (
  SELECT c.ck, j, CASE WHEN e = 'K' THEN r.role WHEN (j + m) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
         CASE WHEN e = 'I' THEN '' ELSE r.text END AS line
  FROM counted c LEFT JOIN rows r ON r.ck = c.ck AND r.pos = c.pos AND c.e <> 'I' WHERE e <> 'D'),
hashes AS (SELECT ck, sha256(string_agg(line, chr(10) ORDER BY j)) AS h FROM lines GROUP BY ck)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS ck FROM conversations) d
LEFT JOIN sums USING (ck) LEFT JOIN plans USING (ck) LEFT JOIN hashes USING (ck)"""
