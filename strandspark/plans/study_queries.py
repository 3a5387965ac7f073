"""Queries of genotype fields, gene expression, cohort effects and compound pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.config import CisConfig, GeneConfig, PhaseConfig
from strandspark.functions import fields, stats
from strandspark.operators import cis_effect, compound, gene_expression, observe, vcf_annotate
from strandspark.operators import haplotypes as H
from strandspark.plans.adapters import duck, view
from strandspark.plans.core_queries import R, Case, _HC, chain, gw_sql
from strandspark.runtime import ship, table, written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- genotype fields ---------------------------------------------------------------

_VCF = f"WITH v AS ({duck('vcf')}) "


def _sample(v: DataFrame) -> DataFrame:
    """The sample column: the genotype in its place of the format."""
    gt, dp = F.col("gt"), F.col("head")
    sample = F.when(F.col("format") == "GT:DP", F.concat(gt, F.lit(":3"))).when(F.col("format") == "DP:GT", F.concat(dp, gt)).otherwise(dp)
    return v.withColumn("sample", sample)


_HET = "format <> 'DP' AND gt NOT LIKE '%.%' AND substr(gt, 1, 1) <> substr(gt, 3, 1)"


@query("het_filter", _VCF + f"SELECT contig, pos, gt FROM v WHERE {_HET}")
def het_filter(spark, sf_dir):
    v = _sample(view(spark, sf_dir, "vcf")).withColumn("gt", fields.sample_field(F.col("format"), F.col("sample"), "GT"))
    return v.where(fields.is_het(F.col("gt"))).select("contig", "pos", "gt")


@query("pass_filter", _VCF + "SELECT contig, pos, filter FROM v WHERE list_contains(string_split(filter, ';'), 'PASS')")
def pass_filter(spark, sf_dir):
    return view(spark, sf_dir, "vcf").where(fields.passes(F.col("filter"))).select("contig", "pos", "filter")


@query("indel_filter", _VCF + "SELECT contig, pos, ref, alt FROM v WHERE length(ref) = 1 AND list_max(list_transform(string_split(alt, ','), lambda x: length(x))) = 1")
def indel_filter(spark, sf_dir):
    return view(spark, sf_dir, "vcf").where(~fields.is_indel(F.col("ref"), F.col("alt"))).select("contig", "pos", "ref", "alt")


@query("vcf_counters", _VCF + f"""SELECT contig, count(*) FILTER ({_HET}) AS hets, count(*) FILTER ({_HET} AND NOT list_contains(string_split(filter, ';'), 'PASS')) AS filtered,
  count(*) FILTER ({_HET} AND list_contains(string_split(filter, ';'), 'PASS') AND (length(ref) > 1 OR alt LIKE '%CC%')) AS indels, count(*) FILTER ({_HET} AND gt LIKE '%/%') AS unphased FROM v GROUP BY contig""")
def vcf_counters(spark, sf_dir):
    v = _sample(view(spark, sf_dir, "vcf")).withColumn("gt", fields.sample_field(F.col("format"), F.col("sample"), "GT"))
    het, ok = fields.is_het(F.col("gt")), fields.passes(F.col("filter"))
    return v.groupBy("contig").agg(F.count_if(het).alias("hets"), F.count_if(het & ~ok).alias("filtered"), F.count_if(het & ok & fields.is_indel(F.col("ref"), F.col("alt"))).alias("indels"), F.count_if(het & F.contains("gt", F.lit("/"))).alias("unphased"))


@query("info_map", _VCF + """, kv AS (SELECT contig, pos, split_part(x, '=', 1) AS key, split_part(x, '=', 2) AS value, i FROM (SELECT contig, pos, unnest(string_split(info, ';')) AS x, generate_subscripts(string_split(info, ';'), 1) AS i FROM v) WHERE contains(x, '='))
SELECT contig, pos, key, arg_max(value, i) AS value FROM kv GROUP BY ALL""")
def info_map(spark, sf_dir):
    v = view(spark, sf_dir, "vcf").select("contig", "pos", F.explode(fields.info_map(F.col("info"))).alias("key", "value"))
    return v


@query("fold_af", _VCF + f"""SELECT contig, pos, gt, round(coalesce(list_min(list_transform(list_filter(list_zip(string_split(regexp_extract(info, 'AF=([^;]*)', 1), ','), range(1, 3)), lambda z: z[1] IS NOT NULL AND contains(gt, CAST(z[2] AS VARCHAR))), lambda z: least(CAST(z[1] AS DOUBLE), 1 - CAST(z[1] AS DOUBLE)))), 0), 9) AS maf FROM v WHERE {_HET}""")
def fold_af(spark, sf_dir):
    v = view(spark, sf_dir, "vcf").where("format <> 'DP'").where(fields.is_het(F.col("gt")))
    return v.select("contig", "pos", "gt", F.round(fields.folded_af(fields.info_map(F.col("info"))["AF"], F.col("gt")), 9).alias("maf"))


@query("vcf_fields", _VCF + """SELECT contig || '_' || pos || '_' || ref || '_' || replace(alt, ',', '_') AS variant_id, CASE WHEN rsid = '.' THEN contig || '_' || pos || '_' || ref || '_' || replace(alt, ',', '_') ELSE rsid END AS rsid,
  array_to_string(list_filter(list_transform(range(0, 3), lambda i: CASE WHEN contains(gt, CAST(i AS VARCHAR)) THEN (list_concat([ref], string_split(alt, ',')))[i + 1] END), lambda x: x IS NOT NULL), ',') AS alleles,
  CASE WHEN contains(gt, '|') THEN (list_concat([ref], string_split(alt, ',')))[CAST(substr(gt, 1, 1) AS INT) + 1] END AS hap0 FROM v WHERE gt NOT LIKE '%.%'""")
def vcf_fields(spark, sf_dir):
    v = view(spark, sf_dir, "vcf").where(~F.contains("gt", F.lit(".")))
    uid = fields.unique_id(F.col("contig"), F.col("pos"), F.col("ref"), F.col("alt"))
    return v.select(uid.alias("variant_id"), fields.rsid_or_id(F.col("rsid"), uid).alias("rsid"), F.array_join(fields.carried(F.col("ref"), F.col("alt"), F.col("gt")), ",").alias("alleles"), F.get(fields.prior_phase(F.col("ref"), F.col("alt"), F.col("gt")), F.lit(0)).alias("hap0"))


# --- genes -------------------------------------------------------------------------

_RAW_POSITION = lambda v: v.cast("long")  # noqa: E731  the views' variant ids are positions
_GENES = R + chain("s") + _HC + f""",
feat AS (SELECT *, row_number() OVER (ORDER BY contig, start) - 1 AS feature FROM ({duck("features")})),
sr AS (SELECT DISTINCT obs.contig, obs.variant_id, bam, read_id, CASE WHEN cls = 0 THEN 'a' ELSE 'b' END AS hap FROM obs JOIN var ON var.contig = obs.contig AND var.variant_id = obs.variant_id WHERE cls < 2 AND NOT blacklisted AND (obs.contig, obs.variant_id) NOT IN (SELECT (contig, variant_id) FROM ph)),
allr AS (SELECT contig, 'b' || block AS bid, variant_id, bam, hap, read_id FROM used UNION ALL SELECT contig, 's' || variant_id, variant_id, bam, hap, read_id FROM sr),
rows0 AS (SELECT t.contig, 'b' || t.block AS bid, bam, start, stop, variants, "blockGWPhase" AS gwp, gw_confidence AS stat, max_maf FROM t JOIN cnt ON cnt.contig = t.contig AND cnt.block = t.block WHERE "aCount" + "bCount" > 0
  UNION ALL SELECT DISTINCT var.contig, 's' || var.variant_id, bam, pos, pos, var.variant_id, CASE phase0 WHEN 0 THEN '0|1' WHEN 1 THEN '1|0' ELSE '0/1' END, 1.0, maf FROM var JOIN sr ON sr.contig = var.contig AND sr.variant_id = var.variant_id),
ov AS (SELECT r.*, f.feature, f.start AS fs, f.stop AS fe FROM rows0 r JOIN feat f ON f.contig = r.contig AND r.start - 1 < f.stop AND f.start < r.stop),
mem AS (SELECT feature, bam, bid, ov.contig, unnest(string_split(variants, ',')) AS v, generate_subscripts(string_split(variants, ','), 1) AS i, fs, fe FROM ov),
ins AS (SELECT * FROM mem WHERE v <> '' AND CAST(v AS BIGINT) - 1 >= fs AND CAST(v AS BIGINT) - 1 <= fe),
vl AS (SELECT feature, bam, bid, string_agg(v, ',' ORDER BY i) AS used, count(*) AS nv FROM ins GROUP BY ALL),
rc AS (SELECT ins.feature, ins.bam, ins.bid, count(DISTINCT read_id) FILTER (hap = 'a') AS a, count(DISTINCT read_id) FILTER (hap = 'b') AS b FROM ins JOIN allr ON allr.contig = ins.contig AND allr.bid = ins.bid AND allr.variant_id = ins.v AND allr.bam = ins.bam GROUP BY ALL),
px AS (SELECT ov.*, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(used, '') AS used, coalesce(nv, 0) AS nv, gwp <> '0/1' AND stat >= 0.9 AS phased FROM ov LEFT JOIN rc ON rc.feature = ov.feature AND rc.bam = ov.bam AND rc.bid = ov.bid LEFT JOIN vl ON vl.feature = ov.feature AND vl.bam = ov.bam AND vl.bid = ov.bid),
p1 AS (SELECT feature, bam, sum(CASE WHEN gwp = '1|0' THEN b ELSE a END) AS pa, sum(CASE WHEN gwp = '1|0' THEN a ELSE b END) AS pb, coalesce(string_agg(used, ',' ORDER BY start, variants) FILTER (used <> ''), '') AS pv, sum(nv) AS pn FROM px WHERE phased GROUP BY ALL),
u1 AS (SELECT feature, bam, a AS ua, b AS ub, used AS uv, nv AS un FROM (SELECT *, row_number() OVER (PARTITION BY feature, bam ORDER BY a + b DESC, start, variants) AS rn FROM px WHERE NOT phased AND a + b > 0) WHERE rn = 1),
grid2 AS (SELECT feat.*, b.bam FROM feat CROSS JOIN (SELECT DISTINCT bam FROM rows0) b),
gx AS (SELECT grid2.*, coalesce(pa, 0) AS pa, coalesce(pb, 0) AS pb, coalesce(pv, '') AS pv, coalesce(pn, 0) AS pn, coalesce(ua, 0) AS ua, coalesce(ub, 0) AS ub, coalesce(uv, '') AS uv, coalesce(un, 0) AS un FROM grid2 LEFT JOIN p1 ON p1.feature = grid2.feature AND p1.bam = grid2.bam LEFT JOIN u1 ON u1.feature = grid2.feature AND u1.bam = grid2.bam),
ga AS (SELECT contig, start, stop, name, CAST(CASE WHEN pa + pb >= ua + ub THEN pa ELSE ua END AS BIGINT) AS a, CAST(CASE WHEN pa + pb >= ua + ub THEN pb ELSE ub END AS BIGINT) AS b, CAST(CASE WHEN pa + pb >= ua + ub THEN pn ELSE un END AS INT) AS n_variants, CASE WHEN pa + pb >= ua + ub THEN pv ELSE uv END AS variants, CAST(pa + pb >= ua + ub AS INT) AS gw_phased, bam FROM gx)"""


def hap_rows(spark, sf_dir) -> DataFrame:
    case = Case(spark, sf_dir, "s")
    phased = case.phased(case.edges())
    both = H.haplotypic_counts(phased, case.variants, case.obs, H.genome_phase(phased, case.variants, 0)).unionByName(H.singleton_counts(case.variants, phased, case.obs))
    return written(gene_expression.with_order(both, "ord", "start", "variants"), "haplotypic-counts")


def features(spark, sf_dir) -> DataFrame:
    return gene_expression.with_order(view(spark, sf_dir, "features"), "feature", "contig", "start")


def genes(spark, sf_dir) -> DataFrame:
    return gene_expression.gene_counts(hap_rows(spark, sf_dir), features(spark, sf_dir), GeneConfig(), _RAW_POSITION, 50)


@query("gene_ae_final", _GENES + """ SELECT contig, start, stop, name, a AS "aCount", b AS "bCount", a + b AS "totalCount", CASE WHEN b = 0 THEN CAST('inf' AS DOUBLE) WHEN a = 0 THEN CAST('-inf' AS DOUBLE) ELSE round(log2(CAST(a AS DOUBLE) / b), 9) END AS "log2_aFC", n_variants, variants, gw_phased, bam FROM ga""")
def gene_ae_final(spark, sf_dir):
    return genes(spark, sf_dir).withColumn("log2_aFC", F.when(F.abs("log2_aFC") == stats.INF, F.col("log2_aFC")).otherwise(F.round("log2_aFC", 9)))


@query("gene_ae_phased", _GENES + """ SELECT contig, name, bam, a AS "aCount", b AS "bCount" FROM ga WHERE gw_phased = 1 AND a + b > 0""")
def gene_ae_phased(spark, sf_dir):
    return genes(spark, sf_dir).where("gw_phased = 1 AND totalCount > 0").select("contig", "name", "bam", "aCount", "bCount")


@query("gene_ae_best_unphased", _GENES + """ SELECT contig, name, bam, a AS "aCount", b AS "bCount", variants FROM ga WHERE gw_phased = 0""")
def gene_ae_best_unphased(spark, sf_dir):
    return genes(spark, sf_dir).where("gw_phased = 0").select("contig", "name", "bam", "aCount", "bCount", "variants")


def _matrix(phased_only: bool):
    def run(spark, sf_dir):
        g = written(genes(spark, sf_dir), "genes")
        out = gene_expression.matrix(g, features(spark, sf_dir), [0, 1, 2], phased_only)
        return out.toDF(*out.columns[:4], "bam0", "bam1", "bam2")

    return run


_CELL = "CASE WHEN {ok} THEN CAST(a AS VARCHAR) || '|' || CAST(b AS VARCHAR) ELSE '0|0' END"
for _name, _ok in (("expr_matrix", "true"), ("gw_matrix", "gw_phased = 1")):
    _cells = ", ".join(f"max({_CELL.format(ok=_ok)}) FILTER (bam = {i}) AS bam{i}" for i in range(3))
    query(_name, _GENES + f" SELECT contig, start, stop, name, {_cells} FROM ga GROUP BY contig, start, stop, name")(_matrix(_name == "gw_matrix"))


# --- reads and annotated rows --------------------------------------------------------

_READS = f"""WITH r AS (SELECT row_number() OVER () AS id, * FROM ({duck("reads")})), v AS ({duck("read_sites")}),
c AS (SELECT DISTINCT cigar FROM r),
o AS (SELECT cigar, i, CAST(x[: -2] AS INT) AS n, x[-1] AS op FROM (SELECT cigar, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHPX=]')) AS x, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[MIDNSHPX=]'), 1) AS i FROM c)),
w AS (SELECT *, CAST(coalesce(sum(CASE WHEN op IN ('M', '=', 'X', 'D', 'N') THEN n ELSE 0 END) OVER (PARTITION BY cigar ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS g,
  CAST(coalesce(sum(CASE WHEN op IN ('M', '=', 'X', 'I', 'S') THEN n ELSE 0 END) OVER (PARTITION BY cigar ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS q, count(*) FILTER (op = 'N') OVER (PARTITION BY cigar ORDER BY i) AS seg FROM o),
cell AS (
  SELECT cigar, seg, g + k AS spot, CASE WHEN op = 'D' THEN NULL ELSE q + k + 1 END AS first, 1 AS n FROM w, unnest(range(n)) AS u(k) WHERE op IN ('M', '=', 'X', 'D')),
ins AS (SELECT cigar, seg, g - 1 AS spot, q + 1 AS first, n FROM w WHERE op = 'I'),
base AS (SELECT cell.cigar, cell.seg, cell.spot, cell.first, ins.first AS i_first, ins.n AS i_n FROM cell LEFT JOIN ins ON ins.cigar = cell.cigar AND ins.seg = cell.seg AND ins.spot = cell.spot),
p AS (SELECT r.id, r.rname, r.cigar, r.pos AS read_pos, seq, qual, qname, r.bam, variant_id, v.pos, ref_len, two FROM r JOIN v ON v.contig = r.rname AND v.pos BETWEEN r.pos AND r.pos + 120),
b AS (SELECT p.*, base.seg, base.spot, concat(CASE WHEN base.first IS NULL THEN '' WHEN ascii(qual[base.first]) - 33 >= 10 THEN seq[base.first] ELSE 'N' END,
    coalesce(array_to_string(list_transform(range(i_first, i_first + i_n), lambda j: CASE WHEN ascii(qual[j]) - 33 >= 10 THEN seq[j] ELSE 'N' END), ''), '')) AS x
  FROM p JOIN base ON base.cigar = p.cigar AND base.spot BETWEEN p.pos - read_pos AND p.pos - read_pos + ref_len - 1),
a AS (SELECT id, qname, bam, rname AS contig, variant_id, pos, two, replace(string_agg(x, '' ORDER BY spot), 'D', '') AS allele FROM b GROUP BY id, qname, bam, rname, variant_id, pos, two, ref_len, seg HAVING count(*) = ref_len)"""


@query("read_alleles", _READS + """ SELECT contig, variant_id, pos, bam, allele, CAST(coalesce(list_position(string_split(two, ','), allele) - 1, 2) AS INT) AS cls, count(*) AS seen, count(DISTINCT qname) AS reads FROM a WHERE allele NOT IN ('', 'N') GROUP BY ALL""")
def read_alleles(spark, sf_dir):
    """Alleles of all sites in aligned reads with every kind of operation."""
    sites = view(spark, sf_dir, "read_sites").withColumn("alleles", F.split("two", ","))
    return observe.allele_reads(view(spark, sf_dir, "reads"), sites, width=50)


#: A variant file of the sites of view ``var_s``, and their places in it.
_FILE = """SELECT contig, variant_id, contig || '_' || CAST(pos AS STRING) || '_' || ref || '_' || alt AS uid, pos, rsid, ref, alt, '.' AS qual, 'PASS' AS filter, 'NS=1' AS info, CASE WHEN pos % 3 = 0 THEN 'GT' ELSE 'GT:DP' END AS format,
  (CASE phase0 WHEN 0 THEN '0|1' WHEN 1 THEN '1|0' ELSE '1/0' END) || (CASE WHEN pos % 3 = 0 THEN '' ELSE ':7' END) AS sample, CASE phase0 WHEN 0 THEN '0|1' WHEN 1 THEN '1|0' ELSE '1/0' END AS gt FROM {v}"""


@query("annotated_vcf", R + chain("s") + ", " + gw_sql(0) + f""", file AS ({_FILE.format(v="var").replace("STRING", "VARCHAR")}),
nb AS (SELECT contig, block, row_number() OVER (ORDER BY contig, min(pos), block) AS bi, string_agg(replace(rsid, ':', '_'), ',' ORDER BY idx) AS ids FROM pv GROUP BY contig, block),
x AS (SELECT file.*, pv.hap_a, bi, ids, gw.gw_confidence AS conf, gw.max_maf AS top, coalesce(gw.gw, pv.f) AS g FROM file LEFT JOIN pv ON pv.contig = file.contig AND pv.variant_id = file.variant_id LEFT JOIN nb ON nb.contig = pv.contig AND nb.block = pv.block LEFT JOIN gw ON gw.contig = pv.contig AND gw.block = pv.block),
y AS (SELECT *, CASE WHEN hap_a IS NULL THEN '0/1' WHEN hap_a = 0 THEN '0|1' ELSE '1|0' END AS pg, CASE WHEN hap_a IS NULL OR g IS NULL THEN gt WHEN xor(hap_a, g) = 0 THEN '0|1' ELSE '1|0' END AS pw, hap_a IS NOT NULL AND conf >= 0.9 AS sure FROM x),
z AS (SELECT *, hap_a IS NOT NULL AND NOT sure AS open, CASE WHEN sure AND g IS NOT NULL THEN pw WHEN hap_a IS NOT NULL AND NOT sure THEN pg ELSE gt END AS new FROM y)
SELECT contig, pos, concat_ws(chr(9), contig, pos, rsid, ref, alt, qual, filter, info, format || ':PG:PB:PI:PW:PC:PM' || CASE WHEN open THEN ':PS' ELSE '' END,
  new || CASE WHEN format = 'GT' THEN '' ELSE ':7' END || ':' || pg || ':' || coalesce(ids, '.') || ':' || coalesce(CAST(bi AS VARCHAR), '.') || ':' || pw || ':' || coalesce(CAST(conf AS VARCHAR), '.') || ':' || coalesce(CAST(top AS VARCHAR), '.') || CASE WHEN open THEN ':' || bi ELSE '' END) AS value FROM z""")
def annotated_vcf(spark, sf_dir):
    """Lines of the variant file with their phase, blocks numbered over all contigs, open blocks as phase sets."""
    case = Case(spark, sf_dir, "s")
    phased = case.phased(case.edges())
    file = spark.sql(_FILE.format(v="{v}"), v=case.variants)
    own = vcf_annotate.phase_fields(phased, case.variants, H.genome_phase(phased, case.variants, 0))
    own = own.join(file.select("contig", "variant_id", "uid"), ["contig", "variant_id"]).drop("variant_id").withColumnRenamed("uid", "variant_id")
    return vcf_annotate.annotate_rows(file.drop("uid", "variant_id", "gt"), own, PhaseConfig(gw_phase_vcf=2))


# --- cohort ------------------------------------------------------------------------

_COHORT = f"""WITH cc AS ({duck("cohort_counts")}), gt AS ({duck("cohort_gt")}), mp AS ({duck("cohort_map")}), pr AS ({duck("cohort_pairs")}),
ind AS (SELECT xindex, gene_id, var_id, gt.vcf_sample, CASE WHEN contains(gt, '0') AND contains(gt, '1') THEN 'het' ELSE 'hom' END AS kind, a, b, gt FROM pr JOIN gt ON contig = var_contig AND pos = var_pos AND ((ref = var_ref AND alt = var_alt) OR id = var_id)
  JOIN mp ON mp.vcf_sample = gt.vcf_sample JOIN cc ON cc.gene = gene_id AND cc.sample = bed_sample WHERE contains(gt, '|') AND a + b >= 8),
af AS (SELECT xindex, gene_id, var_id, vcf_sample, kind, CASE WHEN gt = '0|1' THEN -1 ELSE 1 END * log2((a + 1.0) / (b + 1.0)) AS afc, CASE WHEN gt = '1|0' THEN b ELSE a END AS ref_count, CASE WHEN gt = '1|0' THEN a ELSE b END AS alt_count FROM ind)"""


def cohort(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    ship(spark)
    pairs = view(spark, sf_dir, "cohort_pairs")
    return cis_effect.individuals(pairs, view(spark, sf_dir, "cohort_counts"), view(spark, sf_dir, "cohort_gt"), view(spark, sf_dir, "cohort_map")), pairs


@query("cis_var_afc", _COHORT + " SELECT xindex, var_id, vcf_sample, kind, round(afc, 9) + 0 AS afc, ref_count, alt_count FROM af")
def cis_var_afc(spark, sf_dir):
    return cohort(spark, sf_dir)[0].select("xindex", "var_id", "vcf_sample", "kind", F.round("afc", 9).alias("afc"), "ref_count", "alt_count")


def cohort_effects(spark, sf_dir) -> DataFrame:
    """The effects table of the cohort, without what is resampled; values to nine digits, so that equal ones are ties everywhere."""
    rows, pairs = cohort(spark, sf_dir)
    return cis_effect.effects(rows.withColumn("afc", F.round("afc", 9)), pairs, CisConfig(bs=0), lists=False)


@query("cis_var_median", _COHORT + """, m AS (SELECT xindex, gene_id AS gene, var_id, kind, count(*) AS n, median(round(afc, 9)) AS mid, median(abs(round(afc, 9))) AS mid_abs FROM af GROUP BY ALL)
SELECT gene, var_id, coalesce(max(n) FILTER (kind = 'het'), 0) AS het_n, coalesce(max(n) FILTER (kind = 'hom'), 0) AS hom_n, round(max(mid) FILTER (kind = 'het'), 6) + 0 AS het_median, round(max(mid_abs) FILTER (kind = 'het'), 6) AS het_abs_median,
  round(max(mid) FILTER (kind = 'hom'), 6) + 0 AS hom_median, round(max(mid_abs) FILTER (kind = 'hom'), 6) AS hom_abs_median FROM m GROUP BY xindex, gene, var_id""")
def cis_var_median(spark, sf_dir):
    mids = [F.when(~F.isnan(c), F.round(c, 6) + 0).alias(c) for c in ("het_median", "het_abs_median", "hom_median", "hom_abs_median")]
    return cohort_effects(spark, sf_dir).select("gene", "var_id", F.col("var_het_n").alias("het_n"), F.col("var_hom_n").alias("hom_n"), *mids)


@query("cis_var_ranksum", _COHORT + """, r AS (SELECT var_id, kind, rank() OVER (PARTITION BY var_id ORDER BY x) + (count(*) OVER (PARTITION BY var_id, x) - 1) / 2.0 AS rk FROM (SELECT var_id, kind, abs(round(afc, 9)) AS x FROM af)),
s AS (SELECT var_id, count(*) FILTER (kind = 'het') AS n1, count(*) FILTER (kind = 'hom') AS n2, sum(rk) FILTER (kind = 'het') AS r1 FROM r GROUP BY var_id),
z AS (SELECT var_id, abs((r1 - n1 * (n1 + n2 + 1) / 2.0) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0)) / sqrt(2.0) AS x FROM s WHERE n1 > 0 AND n2 > 0)
SELECT var_id, round(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda i: (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * (CASE WHEN x = 0 THEN 0 ELSE exp((2 * i + 1) * ln(x) - lgamma(i + 1)) END) / (2 * i + 1))), 6) + 0 AS p FROM z""")
def cis_var_ranksum(spark, sf_dir):
    """Two-sided p of the rank sums; the SQL sums the series of the error function."""
    return cohort_effects(spark, sf_dir).where(~F.isnan("het_hom_pvalue")).select("var_id", (F.round("het_hom_pvalue", 6) + 0).alias("p"))


@query("cis_var_effects")
def cis_var_effects(spark, sf_dir):
    """Full table with bootstrapped intervals: resampling, so without SQL."""
    rows, pairs = cohort(spark, sf_dir)
    return cis_effect.effects(rows, pairs, CisConfig())


# --- compound pairs ----------------------------------------------------------------

_CODING = f"""WITH c AS ({duck("coding")}),
g AS (SELECT gene, variant_id, a0, a1 FROM c WHERE NOT (a0 = 0 AND a1 = 0)),
p AS (SELECT gene, variant_id, CASE WHEN CAST(variant_id AS BIGINT) % 7 = 0 THEN a1 ELSE a0 END AS a0, CASE WHEN CAST(variant_id AS BIGINT) % 7 = 0 THEN a0 ELSE a1 END AS a1, block FROM c WHERE block IS NOT NULL AND NOT (a0 = 0 AND a1 = 0)),
gi AS (SELECT gene, va, vb, list_filter([{{'a': a0, 'b': b0, 'c': 'cis'}}, {{'a': a0, 'b': b1, 'c': 'trans'}}, {{'a': a1, 'b': b0, 'c': 'trans'}}, {{'a': a1, 'b': b1, 'c': 'cis'}}], lambda s: s.a <> 0 AND s.b <> 0) AS x FROM (SELECT a.gene, a.variant_id AS va, b.variant_id AS vb, a.a0, a.a1, b.a0 AS b0, b.a1 AS b1 FROM g a JOIN g b ON a.gene = b.gene AND a.variant_id <> b.variant_id)),
pi AS (SELECT gene, va, vb, CASE WHEN same THEN list_filter([{{'a': a0, 'b': b0, 'c': 'cis'}}, {{'a': a0, 'b': b1, 'c': 'trans'}}, {{'a': a1, 'b': b0, 'c': 'trans'}}, {{'a': a1, 'b': b1, 'c': 'cis'}}], lambda s: s.a <> 0 AND s.b <> 0) ELSE [] END AS x FROM (SELECT a.gene, a.variant_id AS va, b.variant_id AS vb, a.a0, a.a1, b.a0 AS b0, b.a1 AS b1, a.block = b.block AS same FROM p a JOIN p b ON a.gene = b.gene AND a.variant_id <> b.variant_id)),
j AS (SELECT gi.gene, gi.va, gi.vb, gi.x AS gx, coalesce(pi.x, []) AS px FROM gi LEFT JOIN pi ON pi.gene = gi.gene AND pi.va = gi.va AND pi.vb = gi.vb),
k AS (SELECT *, CASE WHEN len(px) = 0 THEN '0' WHEN len(gx) = len(px) AND gx = px THEN '1' WHEN len(gx) = len(px) THEN '-1' ELSE '0' END AS rb FROM j),
rows_ AS (SELECT gene, va, vb, unnest(gx) AS s, rb FROM k UNION ALL SELECT gene, va, vb, unnest(px), '1' FROM k WHERE rb = '-1')"""


def coding(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = view(spark, sf_dir, "coding").where("NOT (a0 = 0 AND a1 = 0)")
    gw = c.select("gene", "variant_id", F.array("a0", "a1").alias("alleles"))
    swap = F.col("variant_id").cast("long") % 7 == 0
    pg = c.where("block is not null").select("gene", "variant_id", F.when(swap, F.array("a1", "a0")).otherwise(F.array("a0", "a1")).alias("alleles"), "block")
    effects = c.select("gene", "variant_id", F.lit(1).alias("allele"), "name", "rsid", "phred", "effect", "af")
    return gw, pg, effects


@query("annotate_pairs", _CODING + """ SELECT rows_.gene AS ensg, ca.name, va AS variant_a, ca.rsid AS rsid_a, s.a AS allele_a, ca.af AS af_a, ca.phred AS cadd_phred_a, ca.effect AS cadd_effect_a,
  vb AS variant_b, cb.rsid AS rsid_b, s.b AS allele_b, cb.af AS af_b, cb.phred AS cadd_phred_b, cb.effect AS cadd_effect_b, s.c AS configuration, rb AS read_backed
  FROM rows_ JOIN c ca ON ca.gene = rows_.gene AND ca.variant_id = va JOIN c cb ON cb.gene = rows_.gene AND cb.variant_id = vb""")
def annotate_pairs(spark, sf_dir):
    gw, pg, effects = coding(spark, sf_dir)
    return compound.annotate(gw, pg, effects)


@query("read_backed_codes", _CODING + " SELECT rb AS read_backed, count(*) AS n FROM rows_ GROUP BY rb")
def read_backed_codes(spark, sf_dir):
    gw, pg, _ = coding(spark, sf_dir)
    return compound.code_counts(gw, pg)


@query("af_lookup", """SELECT p_partkey AS pos, 'C' AS alt, round(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE CAST(p_size AS DOUBLE) / 100 END, 9) AS af FROM part""")
def af_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    alleles = part.select(F.lit("1").alias("contig"), F.col("p_partkey").alias("pos"), F.lit("C").alias("alt"))
    freq = part.where("p_partkey % 3 <> 0").select(F.lit("1").alias("contig"), F.col("p_partkey").alias("pos"), F.array(F.lit("G"), F.lit("C")).alias("alts"), F.array(F.lit(0.5), F.col("p_size") / 100).alias("afs"), F.lit(0).alias("ord"))
    return compound.with_frequency(alleles, freq).select("pos", "alt", F.round("af", 9).alias("af"))


@query("cadd_lookup", """SELECT p_brand AS gene, CAST(p_partkey AS VARCHAR) AS variant_id, 2 AS allele, p_type AS effect, CAST(p_size AS DOUBLE) AS phred FROM part WHERE p_partkey % 2 = 0""")
def cadd_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    variants = part.select(F.lit("1").alias("contig"), F.col("p_partkey").alias("pos"), F.col("p_partkey").cast("string").alias("variant_id"), F.lit("rs").alias("rsid"), F.lit("A,C").alias("alt"))
    cadd = part.where("p_partkey % 2 = 0").select(F.lit("1").alias("contig"), F.col("p_partkey").alias("pos"), F.explode(F.array(F.lit("C"), F.lit("G"))).alias("alt"), F.col("p_brand").alias("gene"), F.lit("n").alias("name"), F.col("p_type").alias("effect"), F.col("p_size").cast("double").alias("phred"), F.lit(0).alias("ord"))
    return compound.with_cadd(variants, cadd).select("gene", "variant_id", "allele", "effect", "phred")
