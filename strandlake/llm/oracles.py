"""DuckDB SQL for the registered queries that SQL can express."""

from .secret_scan import RULES

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = f"""
WITH hashed AS (
  SELECT doc_id, sha256({_ASCII_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM hashed WINDOW w AS (PARTITION BY text_sha256)
"""

_WORDS = f"coalesce(regexp_extract_all({_ASCII_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
OP3 = f"""
WITH docs AS (SELECT row_number() OVER () AS doc, doc_id, {_WORDS} AS words FROM documents),
items AS (SELECT item_id, words, least(10, len(words)) AS k FROM (SELECT item_id, {_WORDS} AS words FROM benchmark) WHERE len(words) > 0),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(words[i:i + k - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(words) - k + 2)) AS i FROM items)
),
grams AS (
  SELECT doc, i, k, array_to_string(words[i:i + k - 1], ' ') AS gram
  FROM (SELECT doc, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows))
),
found AS (SELECT doc, i, k, item_id FROM grams JOIN windows USING (k, gram)),
hit AS (SELECT doc, count(DISTINCT pos) AS n_hit FROM (SELECT doc, unnest(range(i, i + k)) AS pos FROM found) GROUP BY doc),
met AS (
  SELECT doc, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc, item_id::VARCHAR AS item FROM found) GROUP BY doc
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc) LEFT JOIN met USING (doc)
"""

_RULES = ",\n       ".join(
    "({}, '{}', '{}', {}, {})".format(number, rule.kind, rule.pattern.replace("'", "''"), rule.group, rule.least)
    for number, rule in enumerate(RULES)
)


def _with_rule(call: str) -> str:
    """A regex and its group are literals to DuckDB."""
    cases = " ".join(
        "WHEN {} THEN {}".format(i, call.format(pattern="'" + rule.pattern.replace("'", "''") + "'", group=rule.group))
        for i, rule in enumerate(RULES)
    )
    return f"CASE number {cases} END"


OP6 = f"""
WITH rules(number, kind, pattern, grp, least) AS (
  VALUES {_RULES}
),
docs AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
met AS (
  SELECT doc, number, kind, least,
         list_transform({_with_rule("regexp_split_to_array(text, {pattern})")}, lambda x: length(x)) AS gaps,
         list_transform({_with_rule("regexp_extract_all(text, {pattern}, 0)")}, lambda x: length(x)) AS sizes,
         list_transform({_with_rule("regexp_extract_all(text, {pattern}, {group})")}, lambda x: length(x)) AS groups
  FROM docs, rules
),
spans AS (
  SELECT doc, number, kind, starts, starts + sizes[i] AS ends
  FROM (SELECT *, list_sum(gaps[:i]) + coalesce(list_sum(sizes[:i - 1]), 0) AS starts FROM (SELECT *, unnest(range(1, len(sizes) + 1)) AS i FROM met))
  WHERE groups[i] >= least
),
listed AS (
  SELECT doc, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access, count(*) FILTER (number = 2) AS n_hex,
         string_agg(span, ',' ORDER BY starts, number) FILTER (number < 3) AS base, string_agg(span, ',' ORDER BY starts, number) AS spans
  FROM (SELECT *, kind || ':' || starts::BIGINT || ':' || ends::BIGINT AS span FROM spans) GROUP BY doc
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (doc)
"""

OP10 = f"""
WITH split AS (SELECT doc_id, string_split({_ASCII_LOWER.format("coalesce(text, '')")}, chr(10)) AS lines FROM documents),
numbered AS (
  SELECT doc_id, n, list_filter(regexp_split_to_array(lines[n + 1], '[ \\t\\x0b\\f\\r]+'), lambda x: x <> '') AS words
  FROM (SELECT *, unnest(range(len(lines))) AS n FROM split)
),
places AS (SELECT doc_id, n, array_to_string(words, ' ') AS line, len(words) AS size FROM numbered WHERE len(words) > 0),
firsts AS (SELECT line, any_value(size) AS size, min(row(doc_id, n)) AS place FROM places GROUP BY line),
variants AS (
  SELECT line, size, place, 'words' AS kind, i,
         md5(CASE WHEN i = 0 THEN line ELSE array_to_string(string_split(line, ' ')[:i - 1] || string_split(line, ' ')[i + 1:], ' ') END) AS v
  FROM (SELECT *, unnest(range(size + 1)) AS i FROM firsts WHERE size >= 7)
  UNION ALL
  SELECT line, size, place, 'letters', i, md5(CASE WHEN i = 0 THEN line ELSE line[:i - 1] || line[i + 1:] END)
  FROM (SELECT *, unnest(range(length(line) + 1)) AS i FROM firsts WHERE size <= 8 AND length(line) >= 7)
),
gone AS (
  SELECT DISTINCT a.line FROM variants a JOIN variants b ON a.kind = b.kind AND a.v = b.v AND b.place < a.place
  WHERE (a.i = b.i OR a.i = 0 OR b.i = 0)
    AND CASE a.kind WHEN 'words' THEN greatest(a.size, b.size) >= 8 ELSE least(a.size, b.size) < 8 AND greatest(length(a.line), length(b.line)) >= 8 END
),
stay AS (SELECT place[1] AS doc_id, place[2] AS n FROM firsts WHERE line NOT IN (SELECT line FROM gone))
SELECT documents.doc_id, count(n)::INT AS n_kept, coalesce(string_agg(n::VARCHAR, ',' ORDER BY n), '') AS kept_lines
FROM documents LEFT JOIN stay ON stay.doc_id = documents.doc_id GROUP BY documents.doc_id
"""

#: A table-driven CRC-32 over the bytes of ``key``, which is a text; the table is made by its rule.
_CRC32 = """
crc_table AS (
  SELECT list(list_reduce(list_concat([b], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
              ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)
),
crc AS (
  SELECT key, xor(list_reduce(list_concat([4294967295::BIGINT], key_bytes),
                              lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1])), 4294967295) AS h
  FROM (SELECT DISTINCT key,
               [('0x' || hex(encode(key))[2 * i - 1:2 * i])::BIGINT FOR i IN range(1, octet_length(encode(key)) + 1)] AS key_bytes
        FROM keyed), crc_table
)"""

OP11 = f"""
WITH RECURSIVE keyed AS (
  SELECT DISTINCT coalesce(doc_id::VARCHAR, 'null') || ':' || run AS key, run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all({_ASCII_LOWER.format("text")}, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL
),
{_CRC32},
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word, sum(times)::BIGINT AS n
  FROM keyed JOIN crc USING (key) GROUP BY 1 HAVING length(word) >= 5 AND sum(times) >= 3
),
variants AS (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS less FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
),
longer AS (SELECT DISTINCT a.word, a.n, w.word AS near, w.n AS near_n FROM variants a JOIN words w ON a.less = w.word),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM variants a JOIN variants b USING (less, i) WHERE a.word <> b.word
  UNION SELECT word, n, near, near_n FROM longer
  UNION SELECT near, near_n, word, n FROM longer
),
best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS form_n, min(near) FILTER (near_n = m) AS form
  FROM (SELECT *, max(near_n) OVER (PARTITION BY word) AS m FROM near) GROUP BY word
),
forms AS (
  SELECT word, CASE WHEN form_n >= 2 * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)
),
way AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT way.word, way.next, forms.form FROM way JOIN forms ON forms.word = way.next
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM way WHERE next IS NULL) USING (word)
"""

_TERMS = f"regexp_extract_all({_ASCII_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP13 = f"""
WITH terms AS (SELECT row_number() OVER () AS doc, doc_id, unnest({_TERMS}) AS term FROM documents),
postings AS (SELECT doc, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT doc, sum(tf)::BIGINT AS n FROM postings GROUP BY doc),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings, whole GROUP BY term, n_docs
),
items AS (
  SELECT DISTINCT item, item_id, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS item, * FROM benchmark)
),
scores AS (
  SELECT item, item_id, doc, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM items JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (doc), whole
  GROUP BY item, item_id, doc, doc_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLES = {
    "op3_decontamination": OP3,
    "op6_secret_scan": OP6,
    "op9_exact_dedup": OP9,
    "op10_line_dedup": OP10,
    "op11_spelling": OP11,
    "op13_ranked_search": OP13,
}
