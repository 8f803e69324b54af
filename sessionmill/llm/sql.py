"""The same queries as SQL over the test tables, where SQL can express them."""

WARC = """
WITH records AS (
  SELECT page_id,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: '
           || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
           || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages
), hashed AS (
  SELECT page_id, strlen(record) AS length, sha256(record) AS digest,
         CASE WHEN page_id % 401 = 13 AND page_id % 211 <> 7 AND page_id % 307 <> 11 THEN 'missing'
              WHEN page_id % 211 = 7 AND left(record, 199) || '~~~' || substr(record, 203) <> record THEN 'corrupt'
              WHEN page_id % 211 <> 7 AND page_id % 307 = 11 THEN 'corrupt'
              ELSE 'ok' END AS status
  FROM records
), counted AS (
  SELECT page_id, length, digest, status, count(*) AS copies FROM hashed GROUP BY ALL
)
SELECT page_id, CAST(floor(page_id / 1024) AS BIGINT) AS archive,
       CAST(coalesce(sum(length * copies) OVER (
         PARTITION BY floor(page_id / 1024) ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
       ), 0) AS BIGINT) AS "offset",
       CAST(length AS BIGINT) AS length, copies, digest, status
FROM counted
"""



def crc32(text: str) -> str:
    """The checksum of a string's bytes (ASCII), a bit at a time; the first bit of each byte brings the byte in."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    turn = "lambda x, b: xor(xor(x, b) >> 1, 3988292384 * (xor(x, b) & 1))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {bits}), {turn}))"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"


def _climb(nodes: str, group: str, levels: int, start: str) -> str:
    """CTEs: {nodes}0 (group, i, d, n) grown ``levels`` times, and {start}0 (row, group, i, fold, proof) folded along."""
    out = []
    for h in range(levels):
        out.append(f"""
{nodes}r{h} AS (SELECT {group}, i // 16 AS up, n, list(d ORDER BY i) AS ch FROM {nodes}{h} WHERE n > 1 GROUP BY ALL),
{nodes}{h + 1} AS (
  SELECT {group}, up AS i, sha256(array_to_string(ch, '')) AS d, (n + 15) // 16 AS n FROM {nodes}r{h}
  UNION ALL SELECT {group}, i, d, n FROM {nodes}{h} WHERE n = 1
),
{start}{h + 1} AS (
  SELECT p.row, p.{group}, p.leaf, p.i // 16 AS i,
         CASE WHEN ch IS NULL THEN fold ELSE sha256(array_to_string(ch[1:p.i % 16], '') || fold || array_to_string(ch[p.i % 16 + 2:], '')) END AS fold,
         CASE WHEN ch IS NULL THEN proof ELSE proof || array_to_string(ch[1:p.i % 16], '') || array_to_string(ch[p.i % 16 + 2:], '') END AS proof
  FROM {start}{h} p LEFT JOIN {nodes}r{h} r ON p.{group} IS NOT DISTINCT FROM r.{group} AND p.i // 16 = r.up
)""")
    return ",".join(out)


# Trees of up to 16^6 rows a source and 16^4 sources.
MANIFEST = f"""
WITH rows AS (
  SELECT row_number() OVER () AS row, doc_id, source, {_leaf('text')} AS leaf,
         CASE WHEN {crc32('doc_id::VARCHAR')} % 5 = 0 AND text IS NOT NULL
              THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS replaced
  FROM documents
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM rows
), t0 AS (SELECT source, i, leaf AS d, n FROM numbered),
p0 AS (SELECT row, source, leaf, i, coalesce(replaced, leaf) AS fold, '' AS proof FROM numbered),
{_climb('t', 'source', 6, 'p')},
ranked AS (SELECT source, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n, 1 AS one FROM t6),
f0 AS (SELECT one, i, d, n FROM ranked),
q0 AS (
  SELECT p.row, 1 AS one, p.leaf, r.i, p.fold, p.proof FROM p6 p JOIN ranked r ON p.source IS NOT DISTINCT FROM r.source
),
{_climb('f', 'one', 4, 'q')}
SELECT doc_id, q.leaf, r.d AS subroot, f.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = f.d AS verified
FROM q4 q JOIN rows USING (row) JOIN ranked r ON rows.source IS NOT DISTINCT FROM r.source CROSS JOIN f4 f
"""

NAMING = r"""
WITH normalised AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
)
SELECT doc_id, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
       row_number() OVER same = 1 AS kept, sha256(bare) AS text_sha256
FROM normalised WINDOW same AS (PARTITION BY bare ORDER BY length(text) DESC, doc_id)
"""


def _more(value: str, cost: str, letter: str) -> str:
    """A cost (nine digits) and the audit behind it, with one edit more in front: text order is cost, then audit."""
    return f"lpad((left({value}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({value}, 10)"


def _before(state: int, then: int, keeps: str) -> str:
    """The best that begins with taking the turn in ``state``; ``keeps`` maps initials that may be kept to the state after them."""
    kept = " ".join(f"WHEN lower(code) = '{k[0]}' THEN {_more(f'v{k[1]}', 'extra', 'K')}" for k in keeps.split())
    return f"least({_more(f'v{state}', '4', 'D')}, CASE WHEN code <> 'd' THEN {_more(f'v{then}', '3 + extra', 'R')} END, CASE {kept or 'WHEN FALSE THEN NULL'} END)"


REPAIR = f"""
WITH RECURSIVE original AS (
  SELECT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') AS key, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
  FROM conversations
), damaged AS (
  SELECT key, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM original WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY key) AS n,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS stripped
  FROM damaged
), faults AS (
  SELECT *, CASE WHEN stripped = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(stripped, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
         left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY key ORDER BY i) AS earlier
  FROM placed
), coded AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'x' END AS code,
         CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra
  FROM faults
), counted AS (
  SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM coded GROUP BY key
), ends AS (
  SELECT key, max(n) + 1 AS i, '000000000' AS v0, '000000006II' AS v1, '000000003I' AS v2, '000000000' AS v3 FROM coded GROUP BY key
), best AS (
  SELECT * FROM ends
  UNION ALL
  SELECT key, i, least(b0, {_more("least(b2, " + _more('b3', '3', 'I') + ")", '3', 'I')}), least(b1, {_more("least(b2, " + _more('b3', '3', 'I') + ")", '3', 'I')}),
         least(b2, {_more('b3', '3', 'I')}), least(b3, {_more('b2', '3', 'I')})
  FROM (
    SELECT c.key, c.i, {_before(0, 2, 's1 u2')} AS b0, {_before(1, 2, 'u2')} AS b1, {_before(2, 3, 'a3')} AS b2, {_before(3, 2, 'u2')} AS b3
    FROM best JOIN coded c ON c.key = best.key AND c.i = best.i - 1
  )
), chosen AS (
  SELECT key, left(v0, 9)::BIGINT AS cost, substr(v0, 10) AS audit FROM best WHERE i = 1
), letters AS (
  SELECT key, unnest(string_split(audit, '')) AS letter, unnest(range(1, length(audit) + 1)) AS p FROM chosen WHERE audit <> ''
), aligned AS (
  SELECT *, sum((letter <> 'I')::INT) OVER (PARTITION BY key ORDER BY p) AS i FROM letters
), output AS (
  SELECT a.key, a.p, a.letter, c.role, CASE WHEN a.letter = 'I' THEN '' ELSE c.text END AS text, row_number() OVER (PARTITION BY a.key ORDER BY a.p) AS o,
         max((a.letter = 'K' AND c.initial = 's')::INT) OVER (PARTITION BY a.key) AS system
  FROM aligned a LEFT JOIN coded c ON a.key = c.key AND a.i = c.i AND a.letter <> 'I' WHERE a.letter <> 'D'
), rebuilt AS (
  SELECT key, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS text
  FROM output GROUP BY key
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, key FROM original) o LEFT JOIN counted USING (key) LEFT JOIN chosen USING (key) LEFT JOIN rebuilt r USING (key)
"""

ORACLE: dict[str, str] = {"op2_warc": WARC, "op11_manifest": MANIFEST, "op12_naming": NAMING, "op13_repair": REPAIR}
