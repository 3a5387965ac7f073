"""Phase annotations of variant rows, as columns; no row leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.config import PhaseConfig
from strandspark.functions import fields
from strandspark.operators.haplotypes import BLOCK, corrected, joined
from strandspark.operators.scans import numbered

TAGS = ("PG", "PB", "PI", "PW", "PC", "PM")
#: Header lines of the tags.
HEADERS = {
    "PG": '##FORMAT=<ID=PG,Number=1,Type=String,Description="Read-backed genotype">',
    "PB": '##FORMAT=<ID=PB,Number=1,Type=String,Description="Variants of the read-backed block">',
    "PI": '##FORMAT=<ID=PI,Number=1,Type=String,Description="Index of the read-backed block">',
    "PM": '##FORMAT=<ID=PM,Number=1,Type=String,Description="Largest allele frequency of the block">',
    "PW": '##FORMAT=<ID=PW,Number=1,Type=String,Description="Genome-wide genotype">',
    "PC": '##FORMAT=<ID=PC,Number=1,Type=String,Description="Confidence of the genome-wide genotype">',
    "PS": '##FORMAT=<ID=PS,Number=1,Type=String,Description="Phase set">',
}


def header_lines(comments: list[str], columns: list[str], sample: str, config: PhaseConfig) -> list[str]:
    """Comment lines with those of missing tags, then the column line of one sample."""
    wanted = [*TAGS, *(["PS"] if config.gw_phase_vcf == 2 else [])]
    new = [HEADERS[t] for t in wanted if not any(c.startswith(f"##FORMAT=<ID={t},") for c in comments)]
    return [*comments, *new, "\t".join([*columns[:9], sample])]


def block_index(phased: DataFrame) -> DataFrame:
    """(contig, part, block_index): blocks numbered from 1 over all contigs."""
    first = phased.groupBy(*BLOCK).agg(F.min("pos").alias("pos"))
    return numbered(first, "block_index", "contig", "pos", "part", start=1).select(*BLOCK, F.col("block_index").cast("int").alias("block_index"))


def phase_fields(phased: DataFrame, variants: DataFrame, gw: DataFrame) -> DataFrame:
    """(contig, variant_id) with on_a and on_b (alleles of haplotypes A and B), gw_ph, confidence,
    max_maf, block_index and block_ids of every phased variant."""
    own = corrected(phased, variants, gw).join(block_index(phased), BLOCK)
    ids = own.groupBy(*BLOCK).agg(joined(fields.safe_rsid(F.col("rsid"))).alias("block_ids"))
    own = own.join(ids, BLOCK)
    allele = lambda h: F.get("alleles", h)
    return own.select("contig", "variant_id", allele(F.col("hap_a")).alias("on_a"), allele(1 - F.col("hap_a")).alias("on_b"), "gw_ph", "gw_confidence", "max_maf", "block_index", "block_ids")


def _set(formats: Column, values: Column, tag: str, value: Column) -> Column:
    """Values with the tag's one replaced."""
    return F.transform(values, lambda v, i: F.when(F.get(formats, i) == tag, value).otherwise(v))


def annotate_rows(vcf: DataFrame, phase: DataFrame, config: PhaseConfig) -> DataFrame:
    """(contig, pos, value) lines of all rows of one sample's file, with their phase tags.

    Phased rows get the read-backed genotype, block, index, frequency, genome-wide
    genotype and confidence; others their own genotype. Where a genome-wide phase stays
    open the input genotype stands. GT is replaced as ``gw_phase_vcf`` says.
    """
    uid = fields.unique_id(F.col("contig"), F.col("pos"), F.col("ref"), F.col("alt"), config.id_separator)
    x = vcf.withColumn("variant_id", uid).join(phase, ["contig", "variant_id"], "left")
    alleles = fields.alleles(F.col("ref"), F.col("alt"))
    place = lambda a: (F.array_position(alleles, a) - 1).cast("string")
    gt = F.coalesce(fields.sample_field(F.col("format"), F.col("sample"), "GT"), F.lit("."))
    is_phased = F.col("on_a").isNotNull()
    pg = F.concat(place(F.col("on_a")), F.lit("|"), place(F.col("on_b")))
    pw = F.when(F.col("gw_ph") == 0, pg).when(F.col("gw_ph") == 1, F.concat(place(F.col("on_b")), F.lit("|"), place(F.col("on_a")))).otherwise(gt)
    own = F.array_join(F.array_sort(F.filter(F.split(gt, "[|/]"), lambda c: c != "")), "/")
    values = {
        "PG": F.when(is_phased, pg).otherwise(own), "PB": F.when(is_phased, F.col("block_ids")).otherwise("."), "PI": F.when(is_phased, F.col("block_index").cast("string")).otherwise("."),
        "PW": F.when(is_phased, pw).otherwise(gt), "PC": F.when(is_phased, F.col("gw_confidence").cast("string")).otherwise("."), "PM": F.when(is_phased, F.col("max_maf").cast("string")).otherwise("."),
    }
    sure = is_phased & (F.col("gw_confidence") >= config.gw_phase_vcf_min_confidence)
    replace_sure = sure & F.col("gw_ph").isNotNull() if config.gw_phase_vcf in (1, 2) else F.lit(False)
    replace_open = is_phased & ~sure if config.gw_phase_vcf == 2 else F.lit(False)
    new_gt = F.when(replace_sure, values["PW"]).when(replace_open, values["PG"]).otherwise(gt)
    fmt = F.split("format", ":")
    x = x.withColumn("_fmt", F.concat(fmt, F.filter(F.array(*[F.lit(t) for t in TAGS]), lambda t: ~F.array_contains(fmt, t))))
    if config.gw_phase_vcf == 2:
        x = x.withColumn("_fmt", F.when(replace_open & ~F.array_contains("_fmt", "PS"), F.concat("_fmt", F.array(F.lit("PS")))).otherwise(F.col("_fmt")))
        values["PS"] = F.when(replace_open, F.col("block_index").cast("string")).otherwise(".")
    cells = F.split("sample", ":")
    out = F.transform("_fmt", lambda t, i: F.coalesce(F.get(cells, i), F.lit("")))
    for tag, value in {**values, "GT": new_gt}.items():
        out = _set(F.col("_fmt"), out, tag, F.coalesce(value, F.lit(".")))
    line = F.concat_ws("\t", "contig", F.col("pos").cast("string"), "rsid", "ref", "alt", "qual", "filter", "info", F.array_join("_fmt", ":"), F.array_join(out, ":"))
    return x.select("contig", "pos", line.alias("value"))


def phase_changes(vcf: DataFrame, phase: DataFrame, config: PhaseConfig) -> DataFrame:
    """One row: unphased genotypes that got a sure phase, and phased ones that it turns."""
    uid = fields.unique_id(F.col("contig"), F.col("pos"), F.col("ref"), F.col("alt"), config.id_separator)
    x = vcf.withColumn("variant_id", uid).join(phase, ["contig", "variant_id"]).where(F.col("gw_confidence") >= config.gw_phase_vcf_min_confidence).where("gw_ph is not null")
    gt = fields.sample_field(F.col("format"), F.col("sample"), "GT")
    prior = fields.prior_phase(F.col("ref"), F.col("alt"), gt)
    first = F.when(F.col("gw_ph") == 0, F.col("on_a")).otherwise(F.col("on_b"))
    return x.agg(F.count_if(F.contains(gt, F.lit("/"))).alias("unphased_phased"), F.count_if(F.contains(gt, F.lit("|")) & (F.get(prior, F.lit(0)) != first)).alias("phase_corrections"))
