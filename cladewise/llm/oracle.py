"""DuckDB statements for the queries that SQL can express on whole tables.

They state the results from the definitions, not by the operators' methods: near
duplicates come from a join of all shingles, revisits from a window over digests.
The constants of the quality rules and of the template are the operators' own.
"""

from __future__ import annotations

import re

from cladewise.llm import quality as Q
from cladewise.llm import templates as T
from cladewise.llm.chat import CONTROL

_WORDS = r"'[^\x20\x09-\x0D]+'"

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _escaped_chars(text: str) -> str:
    """Code points of an escaped text: one more for each control string and each backslash."""
    found = "|".join([r"\\", *map(re.escape, CONTROL)])
    return f"(length({text}) + len(regexp_extract_all({text}, '{found}')))"


CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
),
whole AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS said,
         coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS learned,
         sum({_escaped_chars("text")} + CASE role
             WHEN 'user' THEN length('<s>[INST][/INST]')
             WHEN 'assistant' THEN length('[OUT]</s>')
             ELSE length('<s>[ROLE][/ROLE][END]') + {_escaped_chars("role")} END) AS chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
       CAST(chars AS BIGINT) AS formatted_chars
FROM whole"""


def _quality() -> str:
    ratios = {
        "word_length": "word_chars / n_words",
        "symbols": "n_symbols / word_chars",
        "dup_lines": "n_dup_lines / n_lines",
        "repeats": "n_repeat_words / n_words",
    }
    pairs = ", ".join(f"{{'measure': '{k}', 'v': {v}}}" for k, v in ratios.items())
    names = ["q1_word_length", *(f"q3_{k}" for k in ratios)]

    def quartiles(keys: str) -> str:
        window = f"PARTITION BY {keys}measure"
        return f"""
  SELECT {keys}max(n) AS n, min(v) FILTER (measure = 'word_length' AND upto >= ceil(n * 0.25)) AS q1_word_length,
         {", ".join(f"min(v) FILTER (measure = '{k}' AND upto >= ceil(n * 0.75)) AS q3_{k}" for k in ratios)}
  FROM (SELECT {keys}measure,
               CASE WHEN bucket = {Q._ZERO} THEN 0.0::DOUBLE ELSE exp((bucket - 0.5) * {Q._LOG_GAMMA!r}::DOUBLE) END AS v,
               sum(m) OVER ({window} ORDER BY bucket) AS upto, sum(m) OVER ({window}) AS n
        FROM (SELECT {keys}measure, bucket, sum(n) AS m FROM sketch GROUP BY {keys}measure, bucket))
  {"GROUP BY " + keys.rstrip(", ") if keys else "HAVING count(*) > 0"}"""

    picked = ", ".join(
        f"CASE WHEN a.n >= {Q.LEAST_DOCS} THEN a.{k} WHEN b.n >= {Q.LEAST_DOCS} THEN b.{k} ELSE c.{k} END AS {k}"
        for k in names
    )
    stretch = f"pow(greatest(q3_word_length / q1_word_length, {Q.LEAST_RATIO}::DOUBLE), {Q.FENCE}::DOUBLE)"
    within = " AND ".join(
        [f"{ratios['word_length']} BETWEEN q1_word_length / {stretch} AND q3_word_length * {stretch}"]
        + [f"{ratios[k]} <= greatest(q3_{k} * {f}::DOUBLE, {floor}::DOUBLE)" for k, (f, floor) in Q.UPPER.items()]
    )
    return rf"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents
),
worded AS MATERIALIZED (
  SELECT *, regexp_extract_all(text, {_WORDS}) AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
),
starts AS (SELECT r, w, unnest(range(1, len(w) - {Q.SPAN - 2})) AS i FROM worded WHERE len(w) >= {Q.SPAN}),
windows AS (SELECT r, i, array_to_string(w[i:i + {Q.SPAN - 1}], ' ') AS s FROM starts),
twice AS (SELECT r, unnest(list(i)) AS i FROM windows GROUP BY r, s HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {Q.SPAN})) AS p FROM twice) GROUP BY r),
counted AS (
  SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, len(string_split(text, chr(10))) AS n_lines
  FROM worded LEFT JOIN covered USING (r)
),
measured AS MATERIALIZED (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
),
sketch AS (
  SELECT lang, source, p.measure AS measure,
         CASE WHEN p.v > 0 THEN ceil(ln(p.v) / {Q._LOG_GAMMA!r}::DOUBLE)::BIGINT ELSE {Q._ZERO} END AS bucket, count(*) AS n
  FROM (SELECT lang, source, unnest([{pairs}]) AS p FROM measured WHERE NOT base_failed AND word_chars > 0)
  GROUP BY ALL
),
own AS ({quartiles("lang, source, ")}),
by_lang AS ({quartiles("lang, ")}),
corpus AS ({quartiles("")}),
bounds AS (
  SELECT a.lang, a.source, {picked}
  FROM own a JOIN by_lang b ON a.lang IS NOT DISTINCT FROM b.lang LEFT JOIN corpus c ON true
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CASE WHEN base_failed THEN false ELSE coalesce({within}, false) END AS kept
FROM measured m LEFT JOIN bounds t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source"""


QUALITY = _quality()

_TOKENS = r"regexp_extract_all(raw, '[^\x20\x09-\x0D]+')"

TEMPLATES = f"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
split_lines AS MATERIALIZED (
  SELECT text, pos, lines[pos] AS raw
  FROM (SELECT text, lines, unnest(range(1, len(lines) + 1)) AS pos
        FROM (SELECT DISTINCT text, string_split(text, chr(10)) AS lines FROM texts WHERE text <> ''))
),
parsed AS MATERIALIZED (
  SELECT text, pos, len(w) AS n, len(w) || ' ' || array_to_string(w[1:{T.LEADING}], ' ') AS leaf, w AS line
  FROM (SELECT text, pos,
               list_transform({_TOKENS}, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{T.FIELD}' ELSE x END) AS w
        FROM split_lines)
  WHERE len(w) >= {T.LEAST_TOKENS}
),
lines AS MATERIALIZED (SELECT leaf, line, any_value(n) AS n, count(DISTINCT text) AS docs FROM parsed GROUP BY leaf, line),
leaves AS (
  SELECT leaf, sum(docs) AS leaf_docs, count(*) AS n_lines FROM lines GROUP BY leaf HAVING sum(docs) >= {T.LEAST_DOCS}
),
cells AS MATERIALIZED (
  SELECT leaf, line, n, docs, leaf_docs, place, line[place] AS token
  FROM (SELECT *, unnest(range(1, n + 1)) AS place FROM lines JOIN leaves USING (leaf) WHERE n_lines > 1)
),
fixed AS (
  SELECT leaf, place, token FROM cells WHERE token <> '{T.FIELD}'
  GROUP BY leaf, leaf_docs, place, token HAVING 2 * sum(docs) > leaf_docs
),
n_fixed AS (SELECT leaf, count(*) AS n_fixed FROM fixed GROUP BY leaf),
agreeing AS (
  SELECT leaf, line FROM cells JOIN fixed USING (leaf, place, token) JOIN n_fixed USING (leaf)
  GROUP BY leaf, line, n, n_fixed
  HAVING n_fixed >= {T.FIXED} * n AND count(*) >= {T.AGREE} * n_fixed
),
templates AS MATERIALIZED (
  SELECT leaf, line, CASE WHEN a.line IS NULL THEN line END AS own
  FROM lines LEFT JOIN agreeing a USING (leaf, line) SEMI JOIN leaves USING (leaf)
),
recurring AS (
  SELECT leaf, own FROM parsed JOIN templates USING (leaf, line)
  GROUP BY leaf, own HAVING count(DISTINCT text) >= {T.LEAST_DOCS}
),
dropped AS (
  SELECT DISTINCT text, pos FROM parsed JOIN templates t USING (leaf, line)
  JOIN recurring k ON k.leaf = t.leaf AND k.own IS NOT DISTINCT FROM t.own
),
shorter AS (
  SELECT text, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (d.pos IS NULL), '') AS short,
         count(d.pos) AS n_dropped, count(*) AS n_lines
  FROM split_lines s LEFT JOIN dropped d USING (text, pos) GROUP BY text
),
judged AS (
  SELECT *, length(text) - length(short) <= {T.MOST_LOSS} * length(text) AS shortened FROM shorter
)
SELECT doc_id, CASE WHEN shortened THEN short ELSE t.text END AS text,
       CASE WHEN t.text IS NULL THEN 0 ELSE coalesce(n_lines, 1) END AS lines_before,
       CASE WHEN shortened THEN n_dropped ELSE 0 END AS lines_dropped
FROM texts t LEFT JOIN judged j ON t.text = j.text"""

WARC = f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
hashed AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h FROM payloads),
first AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM hashed)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('{_BASE32}',
         CAST((('0x' || substr(h, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31 AS BIGINT) + 1, 1)), '')
         AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM first"""

NEAR = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), {_WORDS}) AS w
  FROM documents
),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
  FROM worded
),
shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
reached AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT r.doc_id, y FROM reached r JOIN links ON x = other
)
SELECT doc_id, any_value(len(s)) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reached JOIN sets USING (doc_id) GROUP BY doc_id"""

ORACLE: dict[str, str] = {
    "op1_chat_formatting": CHAT,
    "op4_adaptive_quality": QUALITY,
    "op5_line_templates": TEMPLATES,
    "op7_warc": WARC,
    "op8_minhash_neardup": NEAR,
}
