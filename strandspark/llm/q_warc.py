"""Query and SQL of the archives."""

from pyspark.sql import DataFrame, SparkSession

from strandspark.llm.warc import capture_histories
from strandspark.runtime import ship, table

NAME = "op6_warc_index"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return capture_histories(table(spark, sf_dir, "pages")).drop("archive", "offset")


SQL = """
WITH p AS (SELECT page_id, coalesce(url, 'urn:page:' || page_id) AS url, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS response FROM p),
digit AS (
  SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> CAST(5 * (3 - j) AS INTEGER)) & 31) + 1, 1), '' ORDER BY i, j) AS digest
  FROM (SELECT page_id, i, ('0x' || substr(hex, i * 5 + 1, 5))::INTEGER AS v FROM g, range(8) t(i)), range(4) s(j) GROUP BY page_id),
h AS (SELECT *, split_part(url, '://', 2) AS rest, regexp_extract(split_part(url, '://', 2), '^[^/?#]*') AS host FROM g)
SELECT array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')' ||
    CASE WHEN split_part(substr(rest, length(host) + 1), '#', 1) = '' THEN '/' ELSE split_part(substr(rest, length(host) + 1), '#', 1) END AS urlkey,
  strftime(make_timestamp((1577836800 + page_id % 1000000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured,
  page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to
FROM h JOIN digit USING (page_id)
"""
