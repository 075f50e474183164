"""SQL for DuckDB of the operators that SQL can express."""

from __future__ import annotations

from ward_analytics.llm.licenses import CONTAINED_PERCENT, ORDERED_PERCENT, OWN_PERCENT, PHRASES, TEMPLATES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
WORDS = r"[^\x20\x09-\x0D]+"
LICENSE_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

NGRAM_JOIN = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOW}, '{WORDS}') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS gram
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM least LEFT JOIN sizes USING (doc_id)"""

SUBSTRING_DEDUP = f"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM words)),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM windows JOIN firsts USING (s) WHERE first < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM words),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text FROM each ANTI JOIN gone USING (doc_id, place) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) USING (doc_id)"""

SUFFIX_DEDUP = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
windows AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS s FROM (SELECT *, unnest(range(1, n - 48)) AS i FROM bytes)),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS place FROM windows JOIN firsts USING (s) WHERE first < doc_id),
spans AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < place - 1) AS n_spans
  FROM (SELECT *, lag(place) OVER (PARTITION BY doc_id ORDER BY place) AS before FROM gone) GROUP BY 1),
each AS (SELECT doc_id, unnest(range(1, n + 1)) AS place, h FROM bytes),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * place - 1, 2), '' ORDER BY place) AS h FROM each ANTI JOIN gone USING (doc_id, place) GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
FROM bytes LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _values(name: str, columns: str, rows: list[tuple[str, ...]]) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows) + ")"


LICENSES = f"""
WITH {_values("phrases", "phrase, label", list(PHRASES.items()))},
{_values("notices", "notice_label, notice", [(k, v) for k, v in TEMPLATES.items()])},
templates AS (
  SELECT notice_label, list_distinct(t) AS t, list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS p
  FROM (SELECT notice_label, string_split(notice, ' ') AS t FROM notices)),
template_words AS (SELECT notice_label, unnest(t) AS word FROM templates),
own_words AS (
  SELECT notice_label, list(word) AS own FROM template_words
  WHERE word IN (SELECT word FROM template_words GROUP BY 1 HAVING count(*) = 1) GROUP BY 1),
words AS (SELECT doc_id, regexp_extract_all({LOW}, '{LICENSE_WORDS}') AS w FROM documents),
places AS (
  SELECT doc_id, label, i FROM (
    SELECT doc_id, w, label, string_split(phrase, ' ') AS p, unnest(range(1, len(w) + 1)) AS i FROM words, phrases
    WHERE contains(array_to_string(w, ' '), phrase))
  WHERE w[i:i + len(p) - 1] = p),
base AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS lo, max(i) - 1 AS hi FROM places GROUP BY 1),
blocks AS (
  SELECT doc_id, list_distinct(w) AS b, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bp
  FROM (SELECT doc_id, regexp_extract_all(unnest(string_split_regex({LOW}, '\n[\x09\x0B\x0C\x0D\x20]*\n')), '{LICENSE_WORDS}') AS w FROM documents)),
met AS (
  SELECT doc_id, notice_label AS label, max(len(list_intersect(b, t)) / len(t)) AS share FROM blocks, templates LEFT JOIN own_words USING (notice_label)
  WHERE 100 * len(list_intersect(b, coalesce(own, []))) >= {OWN_PERCENT} * len(coalesce(own, [])) AND 100 * len(list_intersect(b, t)) >= {CONTAINED_PERCENT} * len(t) AND 100 * len(list_intersect(bp, p)) >= {ORDERED_PERCENT} * len(p)
  GROUP BY 1, 2),
base_labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM places GROUP BY 1),
labels AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS l
  FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM met) GROUP BY 1)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word,
  coalesce(base_labels.l, '') AS base_labels, coalesce(labels.l, '') AS labels,
  CASE WHEN n > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(share, CAST(0 AS DOUBLE)) END AS score
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN base_labels USING (doc_id) LEFT JOIN labels USING (doc_id)
LEFT JOIN (SELECT doc_id, max(share) AS share FROM met GROUP BY 1) USING (doc_id)"""

#: CRC-32 of an ASCII text: its bytes one after another, each followed by eight steps of one bit.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({text}, ''),
  lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END))"""


def _leaf(text: str) -> str:
    fields = "".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-') || " for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({fields}'')"


MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf,
    CASE WHEN {CRC32.format(text="CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS changed,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place
  FROM documents),
nodes AS (
  SELECT source, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM leaves
  UNION ALL
  SELECT source, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + 2) // 3
  FROM nodes WHERE n > 1 GROUP BY source, level, place // 3),
subroots AS (
  SELECT source, level AS height, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM nodes WHERE n = 1),
top AS (
  SELECT 0 AS level, place, digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + 2) // 3
  FROM top WHERE n > 1 GROUP BY level, place // 3),
runs AS (
  SELECT a.source, a.level, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
  FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.place // 3 = b.place // 3
  WHERE a.n > 1 GROUP BY 1, 2, 3),
top_runs AS (
  SELECT a.level, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
  FROM top a JOIN top b ON a.level = b.level AND a.place // 3 = b.place // 3 WHERE a.n > 1 GROUP BY 1, 2),
powers AS (SELECT range AS level, pow(3, range)::BIGINT AS width FROM range(25)),
steps AS (
  SELECT doc_id, runs.level, l, r FROM leaves JOIN powers ON true
    JOIN runs ON runs.source IS NOT DISTINCT FROM leaves.source AND runs.level = powers.level AND runs.place = leaves.place // width
  UNION ALL
  SELECT doc_id, height + top_runs.level, l, r FROM leaves JOIN subroots ON subroots.source IS NOT DISTINCT FROM leaves.source
    JOIN powers ON true JOIN top_runs ON top_runs.level = powers.level AND top_runs.place = subroots.place // width),
folded AS (
  SELECT doc_id, 0 AS level, changed AS digest FROM leaves
  UNION ALL
  SELECT f.doc_id, f.level + 1, sha256(l || digest || r) FROM folded f JOIN steps USING (doc_id, level)),
last AS (SELECT doc_id, arg_max(digest, level) AS folded_root FROM folded GROUP BY 1),
proofs AS (SELECT doc_id, string_agg(l || r, '' ORDER BY level) AS siblings FROM steps GROUP BY 1)
SELECT doc_id, leaf, subroots.digest AS subroot, top.digest AS root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root,
  folded_root = top.digest AS verified
FROM leaves JOIN subroots ON subroots.source IS NOT DISTINCT FROM leaves.source JOIN top ON top.n = 1
  JOIN last USING (doc_id) LEFT JOIN proofs USING (doc_id)"""

SQL = {
    "op13_merkle_manifest": MERKLE,
    "op2_ngram_join": NGRAM_JOIN, "op3_suffix_dedup": SUFFIX_DEDUP, "op4_licenses": LICENSES, "op8_substring_dedup": SUBSTRING_DEDUP,
}
