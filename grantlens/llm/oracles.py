"""The results of numbered queries in plain SQL, for DuckDB over the same tables."""

from __future__ import annotations

# The reversed polynomial of CRC-32, and its first and last value.
POLYNOMIAL = 0xEDB88320
ALL_ONES = 0xFFFFFFFF


def _crc_step(crc: str, byte: str) -> str:
    """CRC-32 after one more byte."""
    start = f"list_prepend(xor({crc}, CAST({byte} AS BIGINT)), CAST(range(8) AS BIGINT[]))"
    shift = f"CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST({POLYNOMIAL} AS BIGINT)) ELSE c // 2 END"
    return f"list_reduce({start}, lambda c, b: {shift})"


def spelling() -> str:
    """Near words by deleting letters: words one edit apart share a word with one letter less, or are one."""
    digit = "instr('0123456789ABCDEF', substr(code, {}, 1)) - 1"
    byte = f"16 * ({digit.format('2 * i + 1')}) + {digit.format('2 * i + 2')}"
    return f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
),
keys AS (
  SELECT run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS code
  FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run
),
bytes AS (
  SELECT run, n, list_prepend(CAST({ALL_ONES} AS BIGINT),
    list_transform(range(length(code) // 2), lambda i: CAST({byte} AS BIGINT))) AS bytes
  FROM keys
),
hashed AS (
  SELECT run, n, xor(list_reduce(bytes, lambda crc, byte: {_crc_step('crc', 'byte')}), CAST({ALL_ONES} AS BIGINT)) AS h
  FROM bytes
),
damaged AS (
  SELECT n, CASE WHEN h % 31 = 0
    THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
    ELSE run END AS word
  FROM hashed
),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
),
cut AS (
  SELECT DISTINCT word, n, substr(word, 1, i) || substr(word, i + 2) AS part, i
  FROM (SELECT *, unnest(range(length(word))) AS i FROM words)
),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS n_other
  FROM cut a JOIN cut b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT c.word, c.n, w.word, w.n FROM cut c JOIN words w ON w.word = c.part
  UNION
  SELECT w.word, w.n, c.word, c.n FROM cut c JOIN words w ON w.word = c.part
),
nears AS (SELECT word, count(*) AS n_near FROM near GROUP BY word),
forms AS (
  SELECT word, other AS form, n_other AS form_n FROM near WHERE n_other >= 10 * n
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY n_other DESC, other) = 1
),
ways AS (
  SELECT word, form AS last, 1 AS steps FROM forms
  UNION ALL
  SELECT w.word, f.form, w.steps + 1 FROM ways w JOIN forms f ON f.word = w.last
),
roots AS (SELECT word, last AS root FROM ways QUALIFY row_number() OVER (PARTITION BY word ORDER BY steps DESC) = 1)
SELECT word, form, coalesce(root, word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
FROM words LEFT JOIN nears USING (word) LEFT JOIN forms USING (word) LEFT JOIN roots USING (word)
"""


def prefix_trie() -> str:
    return rf"""
WITH RECURSIVE ranked AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
),
bits AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS digits, 0 AS i, CAST({ALL_ONES} AS BIGINT) AS crc FROM ranked
  UNION ALL
  SELECT conv_id, digits, i + 1, {_crc_step('crc', 'ascii(digits[i + 1])')} FROM bits WHERE i < length(digits)
),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(crc, CAST({ALL_ONES} AS BIGINT)) % 4 AS h
  FROM bits WHERE i = length(digits)
),
rebuilt AS (
  SELECT c.conv_id, 0 AS own, r.place, r.role, r.text
  FROM convs c JOIN ranked r ON r.conv_id = c.base AND r.place <= c.h
  UNION ALL
  SELECT c.conv_id, 1 AS own, r.place, r.role, r.text
  FROM convs c JOIN ranked r ON r.conv_id = c.conv_id AND r.place > c.h
),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth,
    md5(length(role) || ':' || role || text) AS digest,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM rebuilt
),
paths AS (
  SELECT c.conv_id, coalesce(list(t.digest ORDER BY t.depth) FILTER (t.depth IS NOT NULL), []) AS path,
    coalesce(list(t.words ORDER BY t.depth) FILTER (t.depth IS NOT NULL), []) AS words
  FROM convs c LEFT JOIN turns t USING (conv_id) GROUP BY c.conv_id
),
members AS (
  SELECT conv_id, path[1:d] AS node, d AS depth, CASE WHEN d = 0 THEN 0 ELSE words[d] END AS words, d = len(path) AS ends
  FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM paths)
),
nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY node, depth
),
kids AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
sums AS (
  SELECT node[1:d] AS node, count(*) FILTER (n_children IS NULL) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT n.*, k.n_children, unnest(range(n.depth + 1)) AS d FROM nodes n LEFT JOIN kids k USING (node))
  GROUP BY 1
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs,
  coalesce(k.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (node) LEFT JOIN kids k USING (node)
LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.node[1:n.depth - 1]
"""


def chat_format() -> str:
    return r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL
  SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
sized AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
    length(regexp_replace(replace(text, '\', '\\'), '([\[<])(/?(?:INST|SYS|ROLE)\]|TEXT\]|/?s>)', '\1\\\2', 'g')) + CASE role
      WHEN 'assistant' THEN 4 WHEN 'user' THEN 15 WHEN 'system' THEN 13
      ELSE 19 + length(regexp_replace(replace(role, '\', '\\'), '([\[<])(/?(?:INST|SYS|ROLE)\]|TEXT\]|/?s>)', '\1\\\2', 'g'))
    END AS size
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
),
placed AS (SELECT *, 3 + sum(size) OVER (PARTITION BY conv_id ORDER BY place) AS up_to FROM sized)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(up_to) FILTER (role = 'assistant' OR place = n) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""
