"""DuckDB SQL of the queries that SQL can express, written from the definitions."""

from __future__ import annotations

from quantloom.llm import mixing

SPACE = "[\\x20\\x09-\\x0D]"
WORDS = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

EXACT_DEDUP = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g') AS norm FROM documents),
k AS (SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
             first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(raw) DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k"""

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) USING (doc_id)"""


TERMS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: 3988292384 is the polynomial of CRC-32.
RESAMPLING = f"""
WITH RECURSIVE steps AS (
  SELECT i AS byte, i::BIGINT AS v, 0 AS k FROM range(256) AS r(i)
  UNION ALL SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY byte) AS tab FROM steps WHERE k = 8),
texts AS (
  SELECT 'd' AS side, row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, coalesce(text, '') FROM benchmark),
worded AS (
  SELECT side, n, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERMS}') AS w FROM texts),
grams AS (
  SELECT side, n, unnest(list_concat(w, list_concat(
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS f FROM worded),
counted AS (SELECT side, n, f, count(*) AS c FROM grams GROUP BY ALL),
names AS (SELECT DISTINCT f, hex(encode(f)) AS h FROM counted),
hashed AS (
  SELECT f, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i:
      16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1),
      lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM names, crc_table),
spread AS (SELECT side, n, bucket, sum(c) AS c FROM counted JOIN hashed USING (f) GROUP BY ALL),
sums AS (SELECT bucket, sum(c) FILTER (side = 'd') AS s, sum(c) FILTER (side = 'b') AS t FROM spread GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM sums),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(sums.t, 0) + 1)::DOUBLE * (total.s + 10000) / ((coalesce(sums.s, 0) + 1)::DOUBLE * (total.t + 10000))))::BIGINT AS g
  FROM sums, total),
weighed AS (SELECT n, sum(c * g) AS weight, sum(c) AS n_features FROM spread JOIN gain USING (bucket) WHERE side = 'd' GROUP BY n),
scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, len(w) >= 20 AS enough,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296))))::BIGINT AS score
  FROM worded LEFT JOIN weighed USING (n) WHERE side = 'd'),
placed AS (SELECT *, row_number() OVER (ORDER BY enough DESC, score DESC, doc_id) AS place, count(*) FILTER (enough) OVER () AS many FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * many // 100 THEN place END AS rank FROM placed"""


def _fill(name: str, source: str, family: str, order: str) -> str:
    """CTEs that divide ``family_budget`` among the rows of ``source`` (cap, weight): ``name`` adds ``budget``."""
    by = f"PARTITION BY {family} " if family else ""
    before = f"OVER ({by}ORDER BY cap / weight, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    whole = f"OVER ({by.strip()})"
    upto = f"OVER ({by}ORDER BY cap / weight, {order} ROWS UNBOUNDED PRECEDING)"
    return f"""
{name}_a AS (SELECT *, coalesce(sum(cap) {before}, 0) AS used, sum(weight) {whole} - coalesce(sum(weight) {before}, 0) AS still FROM {source}),
{name}_b AS (SELECT *, min(CASE WHEN cap * still <= (family_budget - used) * weight THEN 1 ELSE 0 END) {upto} AS short FROM {name}_a),
{name}_c AS (SELECT *, family_budget - coalesce(sum(CASE WHEN short = 1 THEN cap END) {whole}, 0) AS rest,
  sum(CASE WHEN short = 0 THEN weight END) {whole} AS every, sum(CASE WHEN short = 0 THEN weight END) {upto} AS run FROM {name}_b),
{name} AS (SELECT * EXCLUDE (used, still, short, rest, every, run), CASE WHEN short = 1 THEN cap
  ELSE rest * run // every - rest * (run - weight) // every END AS budget FROM {name}_c)"""


def mixing_sql(fraction: float, max_epochs: int, seed: int) -> str:
    def weight(column: str, table: dict[str, int]) -> str:
        return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {mixing.DEFAULT_WEIGHT} END"

    return f"""
WITH d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
  'd' || CAST(coalesce(TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS INTEGER), 0) % 4 AS VARCHAR) AS domain,
  lang AS lang_out, source AS source_out, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS n FROM documents),
leaf AS (SELECT domain, lang, source, sum(n) AS tokens, CAST(sum(n) * {max_epochs} AS HUGEINT) AS cap FROM d GROUP BY 1, 2, 3),
total AS (SELECT CAST(floor(sum(tokens) * {fraction}::DOUBLE) AS HUGEINT) AS t FROM leaf),
one AS (SELECT domain, sum(cap) AS cap, CAST({weight('domain', mixing.DOMAIN_WEIGHTS)} AS HUGEINT) AS weight,
  least((SELECT sum(cap) FROM leaf), (SELECT t FROM total)) AS family_budget FROM leaf GROUP BY domain),
{_fill('top', 'one', '', 'domain')},
two AS (SELECT domain, lang, sum(leaf.cap) AS cap, CAST({weight('lang', mixing.LANG_WEIGHTS)} AS HUGEINT) AS weight, any_value(budget) AS family_budget
  FROM leaf JOIN top USING (domain) GROUP BY domain, lang),
{_fill('middle', 'two', 'domain', 'domain, lang')},
three AS (SELECT domain, lang, source, leaf.cap, CAST({mixing.DEFAULT_WEIGHT} AS HUGEINT) AS weight, budget AS family_budget
  FROM leaf JOIN middle USING (domain, lang)),
{_fill('low', 'three', 'domain, lang', 'domain, lang, source')},
plan AS (SELECT domain, lang, source, CAST(budget // tokens AS BIGINT) AS full_epochs, CAST(budget % tokens AS BIGINT) AS part
  FROM low JOIN leaf USING (domain, lang, source) WHERE budget > 0),
placed AS (SELECT d.*, full_epochs, part, CAST('0x' || substr(md5(concat_ws(':', '{seed}', CAST(full_epochs AS VARCHAR), id)), 1, 15) AS BIGINT) AS spot
  FROM d JOIN plan USING (domain, lang, source) WHERE n > 0),
begun AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY spot, id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM placed),
taken AS (SELECT *, CAST(greatest(least(n, part - first), 0) AS BIGINT) AS more FROM begun)
SELECT doc_id, domain, lang_out AS lang, source_out AS source, n AS n_tokens, full_epochs + CASE WHEN more > 0 THEN 1 ELSE 0 END AS epochs,
  full_epochs * n + more AS tokens_taken FROM taken WHERE full_epochs > 0 OR more > 0"""
