"""Query and SQL of the URL filter."""

from pyspark.sql import DataFrame, SparkSession

from strandspark.llm.urls import Rule, filter_urls, flagged_hosts
from strandspark.runtime import ship, table

NAME = "op1_url_filter"

#: The rules of the query.
RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]
#: Words of a host's labels that put the host and its subdomains on the list, by subject.
SUBJECTS = {
    "adult": ("adult", "escort", "porn", "sex", "xxx"),
    "gambling": ("bet", "bets", "betting", "casino", "gambling", "jackpot", "lottery", "poker", "roulette", "slots"),
    "drugs": ("cialis", "pill", "pills", "viagra"),
    "spam and malware": ("crack", "cracks", "keygen", "linkfarm", "malware", "phishing", "spam", "torrent", "warez"),
    "advertising": ("ads", "adserver", "adtech", "doubleclick", "popunder", "tracker", "tracking"),
}
TERMS = tuple(t for terms in SUBJECTS.values() for t in terms)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, RULES, flagged_hosts(pages, TERMS))


SQL = rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM p),
rules(action, rhost, rpath) AS (VALUES {", ".join(f"('{r.action}', '{r.host}', '{r.path}')" for r in RULES)}),
best AS (
  SELECT h.page_id, h.host, h.path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM h LEFT JOIN rules ON (h.host = rhost OR ends_with(h.host, '.' || rhost)) AND starts_with(h.path, rpath)
  GROUP BY h.page_id, h.host, h.path)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN action
  WHEN regexp_matches(host, '(^|[.-])({"|".join(TERMS)})(-[^.]*)?[.]') THEN 'block' ELSE 'allow' END AS verdict
FROM best
"""
