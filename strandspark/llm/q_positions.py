"""Query and SQL of benchmark decontamination."""

from pyspark.sql import DataFrame, SparkSession

from strandspark.llm.positions import WINDOW, contamination
from strandspark.runtime import ship, table

NAME = "op11_decontamination"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), WINDOW)


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Word sequences of the windows' sizes, compared as texts.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS.format("text")} AS w FROM benchmark),
iw AS (SELECT item, least(len(w), {WINDOW}) AS k, w, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS s FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[s : s + k - 1], ' ') AS g FROM iw),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT r, k, w, unnest(range(1, greatest(len(w) - k + 1, 0) + 1)) AS s FROM d CROSS JOIN ks),
g AS (SELECT r, k, s, array_to_string(w[s : s + k - 1], ' ') AS g FROM dw),
m AS (SELECT r, s, g.k, item FROM g JOIN win ON win.g = g.g AND win.k = g.k),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.r = d.r LEFT JOIN it ON it.r = d.r
"""
