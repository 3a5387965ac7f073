"""Views of the driver's tables in the roles of reads, variants and features.

Each view is one SQL text that Spark and DuckDB both read (but for those in ``OWN``), so a query and
its SQL start from the same rows: an order is a read of one of two haplotypes, a supplier
(or part) a heterozygous site whose true phase is its key's parity, and rare
quantities are errors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandspark.runtime import table

_CLS = """CAST(CASE WHEN l_quantity = 50 THEN 2 ELSE ((l_orderkey % 2) + ({key} % 2) + CASE WHEN l_quantity = 1 THEN 1 ELSE 0 END) % 2 END AS INT)"""
_OBS = """SELECT CAST({contig} AS STRING) AS contig, l_orderkey AS read_id, CAST(l_linenumber % 3 AS INT) AS bam,
  CAST({key} AS STRING) AS variant_id, {key} AS pos, CAST(l_quantity AS INT) AS as_score, CAST(round(l_discount * 100) AS INT) AS mapq, {cls} AS cls
FROM {{lineitem}} JOIN {{{dim}}} ON {key} = {dim_key}"""
_BASE = "substring('ACGT', CAST({key} % 4 AS INT) + 1, 1)"
_ALT = "substring('CGTA', CAST({key} % 4 AS INT) + 1, 1)"
_VARIANTS = """SELECT CAST({contig} AS STRING) AS contig, CAST({dim_key} AS STRING) AS variant_id, {dim_key} AS pos,
  concat('rs', CAST({dim_key} AS STRING)) AS rsid, {ref} AS ref, {alt} AS alt,
  CAST(CASE {dim_key} % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS INT) AS phase0, CAST({dim_key} % 50 AS DOUBLE) / 100 AS maf, {dim_key} % 17 = 0 AS blacklisted
FROM {{{dim}}}"""


def _views(name: str, dim: str, dim_key: str, key: str, contig: str) -> dict[str, str]:
    x = {"dim": dim, "dim_key": dim_key, "key": key, "contig": contig}
    return {
        f"obs_{name}": _OBS.format(cls=_CLS.format(key=key), **x),
        f"var_{name}": _VARIANTS.format(ref=_BASE.format(key=dim_key), alt=_ALT.format(key=dim_key), **x),
    }


VIEWS = (
    _views("s", "supplier", "s_suppkey", "l_suppkey", "s_nationkey")
    | _views("t", "supplier", "s_suppkey", "l_suppkey", "CAST(floor(s_suppkey / 10) AS BIGINT)")
    | _views("p", "part", "p_partkey", "l_partkey", "concat(p_brand, ':', p_type)")
    | _views("b", "part", "p_partkey", "l_partkey", "p_brand")
)
#: A variant file of parts: genotypes, filters and annotations of every kind.
VIEWS["vcf"] = """SELECT concat('chr', CAST(p_partkey % 5 AS STRING)) AS contig, CAST(p_partkey AS INT) AS pos,
  CASE WHEN p_partkey % 6 = 0 THEN '.' ELSE concat('rs', CAST(p_partkey AS STRING)) END AS rsid,
  CASE WHEN p_size % 9 = 0 THEN 'AC' ELSE 'A' END AS ref, CASE WHEN p_size % 4 = 0 THEN 'C,T' WHEN p_size % 11 = 0 THEN 'G,CC' ELSE 'C' END AS alt,
  CASE WHEN p_partkey % 4 = 0 THEN 'q10' WHEN p_partkey % 7 = 0 THEN 'q10;PASS' WHEN p_partkey % 11 = 0 THEN '.' ELSE 'PASS' END AS filter,
  concat('DB;AF=', CAST(p_size AS STRING), 'e-2', CASE WHEN p_size % 4 = 0 OR p_size % 11 = 0 THEN ',0.2' ELSE '' END, ';DP=', CAST(p_partkey % 90 AS STRING), CASE WHEN p_size % 5 = 0 THEN ';DP=7=8' ELSE '' END) AS info,
  CASE WHEN p_partkey % 3 = 0 THEN 'DP:GT' WHEN p_partkey % 29 = 0 THEN 'DP' ELSE 'GT:DP' END AS format,
  CASE WHEN p_partkey % 3 = 0 THEN concat(CAST(p_size AS STRING), ':') WHEN p_partkey % 29 = 0 THEN '3' ELSE '' END AS head,
  CASE WHEN p_size % 13 = 0 THEN './.' WHEN p_size % 4 = 0 AND p_partkey % 2 = 0 THEN '1|2' WHEN p_partkey % 5 = 0 THEN '0|0' WHEN p_partkey % 5 = 1 THEN '1/0' WHEN p_partkey % 5 = 2 THEN '0|1' WHEN p_partkey % 5 = 3 THEN '1|0' ELSE '0/1' END AS gt
FROM {part}"""
#: Intervals over the key space of a contig.
VIEWS["features"] = """SELECT DISTINCT CAST(s_nationkey AS STRING) AS contig, k * 25 AS start, k * 25 + 40 AS stop, concat('g', CAST(s_nationkey AS STRING), '.', CAST(k AS STRING)) AS name
FROM {supplier} CROSS JOIN (SELECT DISTINCT CAST(floor(s_suppkey / 25) AS INT) AS k FROM {supplier}) f"""
VIEWS["spans"] = "SELECT user_id AS span_id, event_type AS contig, CAST(min(event_id) AS BIGINT) AS start, CAST(max(event_id) AS BIGINT) AS stop FROM {events} GROUP BY user_id, event_type"
VIEWS["points"] = "SELECT event_id, event_type AS contig, event_id AS spot, event_id + 1 AS next_spot FROM {events}"
#: Banned stretches of sites: every second hundred.
VIEWS["bans"] = "SELECT DISTINCT CAST(s_nationkey AS STRING) AS contig, k * 20 AS start, k * 20 + 7 AS stop FROM {supplier} CROSS JOIN (SELECT DISTINCT CAST(floor(s_suppkey / 20) AS INT) AS k FROM {supplier}) f"
VIEWS["bams"] = "SELECT CAST(c_custkey AS INT) AS bam, concat('/data/', CAST(c_custkey % 3 AS STRING), '/', c_mktsegment, CAST(c_custkey % 40 AS STRING), '.bam') AS path FROM {customer}"
#: A cohort: customers are individuals, suppliers variants of their nation's gene; who bought of a supplier has a genotype there.
VIEWS["cohort_counts"] = """SELECT concat('g', CAST(s_nationkey AS STRING), '.1') AS gene, concat('S', CAST(o_custkey AS STRING)) AS sample, CAST(sum(l_quantity) AS BIGINT) AS a, CAST(sum(l_linenumber * 7) AS BIGINT) AS b
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY s_nationkey, o_custkey"""
VIEWS["cohort_gt"] = """SELECT DISTINCT CAST(s_nationkey AS STRING) AS contig, s_suppkey * 100 AS pos, concat('v', CAST(s_suppkey AS STRING)) AS id, 'A' AS ref, 'C' AS alt, concat('I', CAST(o_custkey AS STRING)) AS vcf_sample,
  CASE (o_custkey * 7 + s_suppkey) % 6 WHEN 0 THEN '0|1' WHEN 1 THEN '1|0' WHEN 2 THEN '0|0' WHEN 3 THEN '1|1' WHEN 4 THEN '0/1' ELSE '0|1' END AS gt
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey"""
VIEWS["cohort_map"] = "SELECT concat('I', CAST(c_custkey AS STRING)) AS vcf_sample, concat('S', CAST(c_custkey AS STRING)) AS bed_sample FROM {customer}"
VIEWS["cohort_pairs"] = "SELECT CAST(s_suppkey AS BIGINT) AS xindex, concat('g', CAST(s_nationkey AS STRING), '.1') AS gene_id, concat('v', CAST(s_suppkey AS STRING)) AS var_id, CAST(s_nationkey AS STRING) AS var_contig, s_suppkey * 100 AS var_pos, 'A' AS var_ref, 'C' AS var_alt FROM {supplier}"
#: Genotyped coding variants of one sample, with genes and effects.
VIEWS["coding"] = """SELECT p_brand AS gene, concat('n', p_brand) AS name, CAST(p_partkey AS STRING) AS variant_id, concat('rs', CAST(p_partkey AS STRING)) AS rsid, p_type AS effect, CAST(p_size AS DOUBLE) AS phred,
  CAST(p_partkey % 2 AS INT) AS a0, CAST(floor(p_partkey / 2) % 2 AS INT) AS a1, CASE WHEN p_partkey % 3 = 0 THEN CAST(floor(p_partkey / 40) AS INT) END AS block, CAST(p_partkey % 100 AS DOUBLE) / 100 AS af
FROM {part}"""

#: Aligned reads of lines of orders, by templates of every operation, with bases of low quality; and the sites under them.
VIEWS["reads"] = """SELECT concat('r', CAST(l_orderkey AS STRING)) AS qname, concat('chr', CAST(l_partkey % 5 AS STRING)) AS rname, CAST(l_partkey AS BIGINT) AS pos, CAST(l_linenumber % 3 AS INT) AS bam, CAST(l_quantity AS INT) AS as_score,
  CASE CAST(l_orderkey % 7 AS INT) WHEN 0 THEN '40M' WHEN 1 THEN '10M5I25M' WHEN 2 THEN '12M8D28M' WHEN 3 THEN '3S17M30N20M' WHEN 4 THEN '5M2I5M10N10M3D13M5S' WHEN 5 THEN '7=1X20M2D2I10M' ELSE '2H20M1I19M' END AS cigar,
  substring(repeat(CASE CAST(l_suppkey % 3 AS INT) WHEN 0 THEN 'ACGTTGCA' WHEN 1 THEN 'CCATGAAC' ELSE 'GATTACAN' END, 5), 1, 40) AS seq, substring(repeat(CASE CAST(l_linenumber % 4 AS INT) WHEN 0 THEN 'III#IIII' ELSE 'IIIIIIII+' END, 5), 1, 40) AS qual
FROM {lineitem}"""
VIEWS["read_sites"] = """SELECT concat('chr', CAST(p_partkey % 5 AS STRING)) AS contig, concat('s', CAST(p_partkey AS STRING)) AS variant_id, CAST(p_partkey AS BIGINT) AS pos, CASE WHEN p_size % 9 = 0 THEN 3 WHEN p_size % 4 = 0 THEN 2 ELSE 1 END AS ref_len,
  CASE WHEN p_size % 9 = 0 THEN 'ACG,A' WHEN p_size % 4 = 0 THEN 'AC,A' WHEN p_size % 2 = 0 THEN 'A,C' ELSE 'G,T' END AS two FROM {part}"""
#: Texts for Spark alone, of the same rows: here nations and stretches are made distinct before they are paired, as
#: suppliers times stretches are rows that grow with the square of the table.
OWN = {
    name: f"SELECT CAST(s_nationkey AS STRING) AS contig, {columns} FROM (SELECT DISTINCT s_nationkey FROM {{supplier}}) n CROSS JOIN (SELECT DISTINCT CAST(floor(s_suppkey / {width}) AS INT) AS k FROM {{supplier}}) f"
    for name, width, columns in (
        ("features", 25, "k * 25 AS start, k * 25 + 40 AS stop, concat('g', CAST(s_nationkey AS STRING), '.', CAST(k AS STRING)) AS name"),
        ("bans", 20, "k * 20 AS start, k * 20 + 7 AS stop"),
    )
}
TABLES = ("supplier", "lineitem", "part", "events", "customer", "nation", "orders")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = OWN.get(name, VIEWS[name])
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    df = spark.sql(text, **used)
    if name.startswith("var_"):
        from pyspark.sql import functions as F

        df = df.withColumn("alleles", F.array("ref", "alt"))
    return df


def duck(name: str) -> str:
    """The view's SQL for DuckDB."""
    return VIEWS[name].format(**{t: t for t in TABLES})
