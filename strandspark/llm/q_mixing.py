"""Query and SQL of the mix of sources."""

from pyspark.sql import DataFrame, SparkSession

from strandspark.llm.mixing import DIGITS, mix
from strandspark.runtime import ship, table

NAME = "op4_source_mix"
WEIGHTS, BUDGET, EPOCHS, SEED = (5, 2, 1), 1.5, 2.0, 20


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return mix(table(spark, sf_dir, "documents"), WEIGHTS, BUDGET, EPOCHS, SEED).drop("source", "copies")


def sql(docs: str) -> str:
    """``docs``: a relation with doc_id, text and source; gives source as well."""
    return rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS order_key FROM {docs}),
sl AS (SELECT source, order_key[1:{DIGITS}] AS slice, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY ALL),
s0 AS (SELECT source, CAST(sum(words) AS BIGINT) AS source_size FROM sl GROUP BY source),
s1 AS (
  SELECT source, source_size, list_value{WEIGHTS}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight,
    source_size * CAST({EPOCHS} AS DOUBLE) AS cap FROM s0),
s2 AS (
  SELECT *, (sum(source_size) OVER () * CAST({BUDGET} AS DOUBLE) - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM s1 WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS water FROM s2),
s4 AS (SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * weight) END AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM s4),
s6 AS (SELECT *, target - whole * source_size AS extra FROM s5),
cum AS (SELECT source, slice, words, coalesce(sum(words) OVER (PARTITION BY source ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sl),
cuts AS (SELECT cum.source, slice AS cut, before AS cut_before FROM cum JOIN s6 ON cum.source IS NOT DISTINCT FROM s6.source WHERE before < extra AND before + words >= extra),
k AS (SELECT s6.*, cut, cut_before FROM s6 LEFT JOIN cuts ON s6.source IS NOT DISTINCT FROM cuts.source),
o AS (
  SELECT d.*, source_size, target, whole, extra, cut, cut_before, order_key[1:{DIGITS}] AS slice,
    sum(size) OVER (PARTITION BY d.source, order_key[1:{DIGITS}] ORDER BY order_key, doc_id, size ROWS UNBOUNDED PRECEDING) AS within
  FROM d LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, source, size, source_size, target, CAST(size * (whole + CASE
  WHEN cut IS NULL THEN 0 WHEN slice < cut THEN CASE WHEN extra > 0 THEN 1 ELSE 0 END
  WHEN slice = cut AND cut_before + within - size / 2.0 <= extra THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
"""


SQL = f"SELECT doc_id, size, source_size, target, taken FROM ({sql('documents')})"
