"""Query and SQL of the quality rules."""

from pyspark.sql import DataFrame, SparkSession

from strandspark.llm.quality import MARKS, LineRules, clean_lines
from strandspark.runtime import ship, table

NAME = "op2_quality_rules"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return clean_lines(table(spark, sf_dir, "documents")).drop("cleaned")


R = LineRules()
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = ", ".join(f"'{s}'" for s in R.separators)
BOILERPLATE = R.boilerplate.replace("'", "''")
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{WORD}') AS ws FROM d),
base AS (
  SELECT r, doc_id, ws, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM w),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
lw AS (SELECT r, line, pos, regexp_extract_all(line, '{WORD}') AS ws, len(regexp_extract_all(regexp_replace(line, '(?s)^.*[{MARKS}]', ''), '{WORD}')) AS left_open FROM lines),
t AS (SELECT row_number() OVER () AS x, text FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
tl AS (SELECT DISTINCT x, line, md5(line) AS h FROM (SELECT x, unnest(string_split(text, chr(10))) AS line FROM t) WHERE len(regexp_extract_all(line, '{WORD}')) > 0),
met AS (
  SELECT line, coalesce(CASE WHEN h = min(h) OVER w THEN nth_value(h, 2) OVER w ELSE min(h) OVER w END, '') AS company
  FROM tl WINDOW w AS (PARTITION BY x ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
common AS (
  SELECT line FROM met GROUP BY line
  HAVING count(*) >= {R.common_least} AND 100 * count(DISTINCT company) >= {R.company_percent} * count(*)),
ll AS (
  SELECT r, len(ws) AS n, row_number() OVER (PARTITION BY r, line ORDER BY pos) > 1 AS dup,
    100 * len(list_filter(ws, lambda x: x IN ({SEPARATORS}))) > {R.max_separator_percent} * len(ws)
    OR 100 * len(list_filter(ws, lambda x: regexp_matches(x, '[#*$%&<>]|!!|\?\?'))) > {R.max_noisy_percent} * len(ws)
    OR (len(ws) >= {R.open_line} AND (left_open = len(ws) OR left_open >= {R.long_line}))
    OR regexp_matches(line, '(?i){BOILERPLATE}') OR line IN (SELECT line FROM common) AS fails
  FROM lw WHERE len(ws) > 0),
per AS (
  SELECT r, count(*) FILTER (dup) AS n_dup_lines, count(*) FILTER (fails) AS n_lines_removed,
    coalesce(sum(n) FILTER (fails), 0) AS n_words_removed FROM ll GROUP BY r),
grams AS (SELECT r, unnest(range(1, len(ws) - 1)) AS p, ws FROM base WHERE len(ws) >= 3),
keyed AS (SELECT r, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS g FROM grams),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM keyed) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY r),
joined AS (
  SELECT doc_id, n_words, word_chars, n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines_removed, 0) AS BIGINT) AS n_lines_removed,
    CAST(coalesce(n_words_removed, 0) AS BIGINT) AS n_words_removed
  FROM base LEFT JOIN per USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {R.min_words} OR 100 * n_repeat_words > {R.max_repeat_percent} * n_words AS base_failed,
  NOT (n_words < {R.min_words} OR 100 * n_repeat_words > {R.max_repeat_percent} * n_words)
    AND 100 * n_words_removed <= {R.max_loss_percent} * n_words AS kept,
  n_lines_removed, n_words_removed
FROM joined
"""
