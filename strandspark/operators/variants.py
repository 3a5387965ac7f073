"""Variant rows of one sample to heterozygous sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.config import PhaseConfig
from strandspark.functions import fields
from strandspark.operators import intervals


def het_sites(vcf: DataFrame, config: PhaseConfig, blacklist: DataFrame | None = None, count_blacklist: DataFrame | None = None) -> DataFrame:
    """contig, variant_id, pos, rsid, ref, ref_len, alleles (two carried), gt, phase0 (the
    haplotype of the first carried allele), maf, blacklisted.

    Sites are heterozygous, pass the filters, are no indels unless wanted, and lie
    outside ``blacklist``; ``count_blacklist`` only marks.
    """
    v = vcf.withColumn("gt", fields.sample_field(F.col("format"), F.col("sample"), "GT")).where(fields.is_het(F.col("gt")))
    if config.pass_only:
        v = v.where(fields.passes(F.col("filter")))
    if not config.include_indels:
        v = v.where(~fields.is_indel(F.col("ref"), F.col("alt")))
    uid = fields.unique_id(F.col("contig"), F.col("pos"), F.col("ref"), F.col("alt"), config.id_separator)
    own = fields.carried(F.col("ref"), F.col("alt"), F.col("gt"))
    v = v.withColumns({"variant_id": uid, "alleles": own, "ref_len": F.length("ref"), "site": F.col("pos") - 1, "site_end": F.col("pos") - 1 + F.length("ref"), "prior": fields.prior_phase(F.col("ref"), F.col("alt"), F.col("gt"))})
    v = v.withColumns({"rsid": uid if config.unique_ids else fields.rsid_or_id(F.col("rsid"), uid), "phase0": fields.allele_phase(F.get("alleles", F.lit(0)), F.col("prior")), "maf": fields.folded_af(fields.info_map(F.col("info"))[config.gw_af_field], F.col("gt"))})
    keep = ["contig", "variant_id"]
    if blacklist is not None:
        v = intervals.not_overlapping(v, blacklist, keep, ["contig"], "site", "site_end", "start", "stop")
    if count_blacklist is None:
        v = v.withColumn("blacklisted", F.lit(False))
    else:
        hit = intervals.overlapping(v, count_blacklist, keep, ["contig"], "site", "site_end", "start", "stop").select(*keep, F.lit(True).alias("blacklisted"))
        v = v.join(hit, keep, "left").withColumn("blacklisted", F.coalesce("blacklisted", F.lit(False)))
    return v.select("contig", "variant_id", "pos", "rsid", "ref", "ref_len", "alleles", "gt", "phase0", "maf", "blacklisted")


def site_counters(vcf: DataFrame) -> DataFrame:
    """Numbers of heterozygous rows, and of those filtered, indels and unphased."""
    v = vcf.withColumn("gt", fields.sample_field(F.col("format"), F.col("sample"), "GT")).where(fields.is_het(F.col("gt")))
    ok = fields.passes(F.col("filter"))
    return v.agg(F.count(F.lit(1)).alias("hets"), F.count_if(~ok).alias("filtered"), F.count_if(ok & fields.is_indel(F.col("ref"), F.col("alt"))).alias("indels"), F.count_if(F.contains("gt", F.lit("/"))).alias("unphased"))
