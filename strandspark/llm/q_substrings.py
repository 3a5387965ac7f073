"""Query and SQL of substring deduplication."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.llm.substrings import WINDOW, repeat_digests
from strandspark.runtime import ship, table

NAME = "op7_substring_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    out = repeat_digests(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


def sql(docs: str) -> str:
    """``docs``: a relation with doc_id and text; gives a row number r and both kept forms."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM {docs}),
w AS (SELECT r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM d),
p AS (SELECT r, unnest(range(1, len(ws) - {WINDOW - 2})) AS p FROM w WHERE len(ws) >= {WINDOW}),
g AS (SELECT p.r, p, md5(array_to_string(ws[p : p + {WINDOW - 1}], ' ')) AS h FROM p JOIN w USING (r)),
hit AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY h) AS c FROM g) WHERE c > 1),
gone AS (SELECT DISTINCT r, q FROM (SELECT r, unnest(range(p, p + {WINDOW})) AS q FROM hit)),
at AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS q FROM w),
kept AS (
  SELECT a.r, string_agg(ws[a.q], ' ' ORDER BY a.q) FILTER (g.q IS NULL) AS words, count(g.q) AS n_removed
  FROM "at" a LEFT JOIN gone g ON a.r = g.r AND a.q = g.q GROUP BY a.r)
SELECT d.*, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(words, '') AS kept_words
FROM d JOIN w USING (r) LEFT JOIN kept USING (r)
"""


SQL = f"SELECT doc_id, n_words, n_removed, sha256(kept_words) AS kept_sha256 FROM ({sql('documents')})".replace("\nat AS (", '\n"at" AS (')
