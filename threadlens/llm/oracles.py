"""DuckDB SQL for the rows of those queries that SQL can express.

The statements spell out their own patterns and limits and work relationally (a row per
word, line or match), apart from the operators. The rest has none: learned models (op4,
op10), the Viterbi recurrence (op1), hash draws (op7) and XXH64 (op8).
"""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
FOLDED_WORDS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = f"""
WITH d AS (SELECT doc_id, {FOLDED_WORDS} AS w FROM documents),
b AS (SELECT item_id, {FOLDED_WORDS} AS w FROM benchmark),
starts AS (
  SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s
  FROM b WHERE len(w) > 0
),
item_windows AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS win FROM starts),
lengths AS (SELECT DISTINCT n FROM item_windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n),
windows AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS win FROM places),
hits AS (SELECT doc_id, s, n, item_id FROM windows JOIN item_windows USING (n, win)),
words_hit AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS i FROM hits),
n_hits AS (SELECT doc_id, count(*) AS n_hit FROM words_hit GROUP BY doc_id),
owners AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL)
  GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n_hits USING (doc_id) LEFT JOIN owners USING (doc_id)
"""

OP3 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35),
windows AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 34], ' ')) AS win FROM places),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY win) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM again),
every AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
left_over AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept
  FROM every ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""

#: kind, expression, group that is judged and its least length, in the order of listing.
SECRETS = (
    (
        "assign",
        "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("hosting", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("payment", "[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", 0, 0),
    ("signed", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0),
    ("key", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 0),
)


def matches(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    spelled = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, length(gap) AS gap, length(hit) AS n, length(judged) >= {least} AS ok, i
  FROM (
    SELECT doc_id, unnest(hits) AS hit, unnest(judged) AS judged, unnest(gaps[1 : len(hits)]) AS gap,
      generate_subscripts(hits, 1) AS i
    FROM (
      SELECT doc_id, regexp_extract_all(body, '{spelled}') AS hits,
        regexp_extract_all(body, '{spelled}', {group}) AS judged, string_split_regex(body, '{spelled}') AS gaps
      FROM d WHERE regexp_matches(body, '{spelled}')
    )
  )"""


OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
found AS ({" UNION ALL ".join(matches(rank, *rule) for rank, rule in enumerate(SECRETS))}
),
placed AS (SELECT *, CAST(sum(gap + n) OVER (PARTITION BY doc_id, rank ORDER BY i) AS BIGINT) AS stop FROM found),
spans AS (SELECT doc_id, rank, kind, stop - n AS start, kind || ':' || (stop - n) || ':' || stop AS span FROM placed WHERE ok),
told AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
    count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base,
    string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (doc_id)
"""

OP6 = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
e AS (
  SELECT *, replace(replace(role, '\', '\b'), '|', '\p') AS safe_role, replace(replace(text, '\', '\b'), '|', '\p') AS safe_text
  FROM m
),
c AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length('<|turn ' || safe_role || '|>' || chr(10) || safe_text || '<|end|>' || chr(10))) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM c
"""

OP6_PARTS = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS k
  FROM conversations
),
p AS (
  SELECT *, CAST(conv_id AS VARCHAR) || '-' || turn AS name, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS caption FROM m
),
t AS (
  SELECT conv_id, k, role, text,
    role || chr(10) || 'text|' || substr(text, 1, 5) || '|-' || chr(10) || 'image|' || caption || '|' || name || chr(10)
      || 'text|' || substr(text, 6) || '|-' || chr(10) || CASE WHEN turn % 3 = 0 THEN 'audio' ELSE 'document' END || '||' || name || chr(10) AS told,
    substr(text, 1, 5) || caption || substr(text, 6) AS said,
    85 + 170 * greatest(1, ceil(300 * turn / 512)) * 2
      + CASE WHEN turn % 3 = 0 THEN ceil(greatest(1.5 * turn, 0) * 25) ELSE 600 * greatest(turn, 1) END AS tokens
  FROM p
)
SELECT conv_id, count(*) AS n_turns, 2 * count(*) AS n_attachments, CAST(sum(tokens) AS BIGINT) AS expanded_tokens,
  sha256(string_agg(told, '' ORDER BY k)) AS parts_sha256,
  sha256(coalesce(string_agg(said, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256
FROM t GROUP BY conv_id
"""

OP13 = r"""
WITH terms AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
),
size AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM terms WHERE len(t) > 0),
tf AS (SELECT doc_id, row, n, term, count(*) AS tf FROM (SELECT doc_id, row, len(t) AS n, unnest(t) AS term FROM terms) GROUP BY ALL),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), size
),
item AS (
  SELECT item_id, row, term, count(*) AS times FROM (
    SELECT item_id, row_number() OVER () AS row, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
),
scored AS (
  SELECT item_id, i.row AS item, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM item i JOIN weight USING (term) JOIN tf ON tf.term = i.term, size
  GROUP BY item_id, i.row, doc_id, tf.row
)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW o AS (PARTITION BY item ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 10
"""

#: CRC-32 by its table of 256, made from the polynomial; letters beyond ASCII are two bytes here.
OP12 = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
),
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
    FROM documents) GROUP BY ALL
),
marked AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
      lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195::BIGINT, unicode(ch)::BIGINT - 64] END))),
    lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM runs, crc
),
words AS MATERIALIZED (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, times FROM marked)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
),
cut AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON w.word = c.head || c.tail
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.head || c.tail
),
best AS MATERIALIZED (
  SELECT near.word, count(*) AS n_near, min(struct_pack(less := -o.n, other := encode(near.other))) AS b
  FROM near JOIN words o ON o.word = near.other GROUP BY near.word
),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 2 * w.n THEN decode(b.other) END AS form,
    CASE WHEN -b.less >= 2 * w.n THEN -b.less END AS form_n
  FROM words w LEFT JOIN best ON best.word = w.word
),
way AS (
  SELECT word, word AS root FROM formed
  UNION SELECT way.word, f.form FROM way JOIN formed f ON f.word = way.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, way.root, f.n, f.n_near, f.form_n
FROM formed f JOIN way ON way.word = f.word JOIN formed l ON l.word = way.root WHERE l.form IS NULL
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, {WORDS} AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
grams AS (
  SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS gram
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
),
again AS (
  SELECT doc_id, i
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams WHERE gram IS NOT NULL) WHERE n > 1
),
repeated AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, (VALUES (0), (1), (2)) AS t(j) GROUP BY doc_id),
chars AS (SELECT doc_id, sum(length(word)) AS n FROM words GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(chars.n, 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(lines.n, 0) AS n_lines, coalesce(lines.dup, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words,
    length(regexp_replace(body, '\P{{L}}+', '', 'g')) AS n_letters
  FROM d LEFT JOIN chars USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)
),
bits AS (
  SELECT *, n_words < 50 AS few, 100 * n_repeat_words > 50 * n_words AS rep,
    word_chars < 2 * n_words OR word_chars > 20 * n_words AS odd, 10 * n_symbols > 3 * n_words AS sym,
    2 * n_dup_lines > n_lines AS dup, 2 * n_letters < word_chars AS bare, n_words > 100000 AS many
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few OR rep AS base_failed,
  NOT (few OR rep OR odd OR sym OR dup OR bare) AS kept,
  CAST(1 * few::INT + 2 * rep::INT + 4 * odd::INT + 8 * sym::INT + 16 * dup::INT + 32 * bare::INT + 64 * many::INT AS BIGINT)
    AS failed
FROM bits
"""

#: Rule names of policy default-1 and the columns of their bits above.
ABLATED = {"few_words": "few", "repeated_words": "rep", "word_length": "odd", "symbols": "sym", "duplicate_lines": "dup", "few_letters": "bare"}
OP9_ABLATIONS = OP9[: OP9.rindex("SELECT doc_id, n_words")] + " UNION ALL ".join(
    f"""(SELECT '{rule}' AS rule, CAST(count(*) FILTER (WHERE {own}) AS BIGINT) AS n_failed,
    CAST(count(*) FILTER (WHERE {own} AND NOT ({' OR '.join(o for o in ABLATED.values() if o != own)})) AS BIGINT) AS n_failed_alone,
    CAST(count(*) FILTER (WHERE NOT ({' OR '.join(o for o in ABLATED.values() if o != own)})) AS BIGINT) AS n_kept_without FROM bits)"""
    for rule, own in ABLATED.items()
)

ORACLE = {
    "op2_decontaminate": OP2,
    "op3_substring_dedup": OP3,
    "op5_secret_scan": OP5,
    "op6_chat_format": OP6,
    "op6_chat_parts": OP6_PARTS,
    "op12_spelling_variants": OP12,
    "op13_lexical_search": OP13,
    "op9_quality": OP9,
    "op9_quality_ablations": OP9_ABLATIONS,
}
