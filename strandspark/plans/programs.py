"""The five programs over files: each reads its inputs and returns its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.config import AnnotateConfig, CisConfig, GeneConfig, PhaseConfig, per_bam
from strandspark.functions import fields
from strandspark.operators import cis_effect, compound, edges, gene_expression, haplotypes, observe, phasing, variants, vcf_annotate
from strandspark.runtime import ship, written
from strandspark.sources import readers, writers
from strandspark.sources.bam import index_of, read_bam
from strandspark.sources.bgzf import windows_of


def read_alignments(spark: SparkSession, paths: list[str], sites: DataFrame | None = None) -> DataFrame:
    """Reads of SAM text and BAM files, numbered by their place in ``paths``: one scan of each
    kind. ``sites``: reads that reach none of them need not be read."""
    binary = [i for i, p in enumerate(paths) if p.endswith(".bam")]
    out = []
    for kind in (binary, [i for i in range(len(paths)) if i not in set(binary)]):
        if kind:
            own = [paths[i] for i in kind]
            regions = windows_of(sites) if kind is binary and sites is not None and any(index_of(p) for p in own) else None
            one = read_bam(spark, own, regions=regions) if kind is binary else readers.read_sam(spark, own)
            out.append(one.withColumn("bam", F.element_at(F.array(*[F.lit(i) for i in kind]), F.col("bam") + 1)) if kind != list(range(len(kind))) else one)
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def filtered(reads: DataFrame, config: PhaseConfig, n: int) -> DataFrame:
    """Reads of ``n`` files that pass each file's filters."""
    limits = list(zip(range(n), per_bam(config.mapq, n, "mapq"), [bool(x) for x in per_bam(config.paired_end, n, "paired_end")], per_bam(config.isize, n, "isize")))
    reads = reads.join(F.broadcast(reads.sparkSession.createDataFrame(limits, "bam int, least_mapq int, paired boolean, most_isize int")), "bam")  # one row a file
    flag, mapq = F.col("flag"), F.col("mapq")
    ok = F.when(F.col("paired"), observe.read_filter(flag, mapq, F.col("least_mapq"), True, config.remove_dups)).otherwise(observe.read_filter(flag, mapq, F.col("least_mapq"), False, config.remove_dups))
    ok = ok & ((F.col("most_isize") == 0) | (F.abs("tlen") <= F.col("most_isize")))
    return reads.where(ok).drop("least_mapq", "paired", "most_isize")


def observations(spark: SparkSession, sams: list[str], sites: DataFrame, config: PhaseConfig) -> DataFrame:
    """Allele observations of all files, after the read filters and score cutoffs."""
    reads = read_alignments(spark, sams, sites)
    obs = observe.observe(filtered(reads, config, len(sams)), sites, config.baseq, rebase=not config.compat, width=observe.bin_width(sites))
    by = ["bam", "contig"] if config.by_contig else ["bam"]
    return written(edges.keep_scores(obs, config.as_q_cutoff, by), "observations")


def phase_reads(spark: SparkSession, vcf_path: str, sams: list[str], config: PhaseConfig, blacklist: str | None = None, count_blacklist: str | None = None) -> dict[str, DataFrame]:
    """Read-backed phasing: all tables of the core program by name."""
    ship(spark)
    vcf = readers.check_contigs(readers.read_vcf(spark, vcf_path, config.sample, config.chr_prefix, config.chrom, config.compat), config.id_separator)
    bed = lambda p: readers.read_bed(spark, p) if p else None
    sites = written(variants.het_sites(vcf, config, bed(blacklist), bed(count_blacklist)), "sites")
    obs = observations(spark, sams, sites, config)
    by = ["contig"] if config.by_contig else []
    tests = written(edges.pair_tests(obs, sites, by=by), "tests")
    alive = written(edges.surviving(tests, config.cc_threshold), "edges")
    if not config.unphased_vars:
        used = alive.select("contig", F.explode(F.array("variant_a", "variant_b")).alias("variant_id")).distinct()
        sites = sites.join(used, ["contig", "variant_id"], "left_semi")
    phased = written(phasing.phase(alive, written(phasing.blocks_of(alive), "blocks"), config.max_block_size, config.compat), "phased")
    gw = written(haplotypes.genome_phase(phased, sites, config.gw_phase_method), "genome-phase")
    names = edges.bam_names(spark.createDataFrame([(i, p.replace(".sam", ".bam")) for i, p in enumerate(sams)], "bam int, path string"))
    excluded = tuple(i - 1 for i in config.haplo_count_bam_exclude)
    counts = haplotypes.haplotypic_counts(phased, sites, obs, gw, excluded, config.output_read_ids).unionByName(haplotypes.singleton_counts(sites, phased, obs, excluded, config.output_read_ids))
    out = {
        "variant_connections": tests.select("variant_a", "variant_b", "supporting_connections", "total_connections", F.col("p").alias("conflicting_configuration_p"), "phase_concordant"),
        "allelic_counts": edges.allelic_counts(obs).join(sites.select("contig", "variant_id", "alleles"), ["contig", "variant_id"]).select(
            "contig", F.col("pos").alias("position"), F.col("variant_id").alias("variantID"), F.get("alleles", F.lit(0)).alias("refAllele"), F.get("alleles", F.lit(1)).alias("altAllele"),
            F.col("ref_count").alias("refCount"), F.col("alt_count").alias("altCount"), F.col("total_count").alias("totalCount")),
        "haplotypes": haplotypes.haplotypes(phased, sites, obs, alive, gw).unionByName(haplotypes.singleton_haplotypes(sites, phased, obs)),
        "haplotypic_counts": counts.join(F.broadcast(names), "bam").drop("bam").withColumnRenamed("name", "bam").select(*counts.columns),
        "allele_config": haplotypes.allele_config(phased, sites),
    }
    fields_of = written(vcf_annotate.phase_fields(phased, sites, gw), "phase-fields")
    out["vcf"] = vcf_annotate.annotate_rows(vcf, fields_of, config)
    out["metrics"] = run_metrics(vcf, sites, obs, phased).crossJoin(vcf_annotate.phase_changes(vcf, fields_of, config))
    if config.output_network:
        out["network_links"] = haplotypes.network_links(edges.pair_cells(obs), phased, config.output_network)
        out["network_nodes"] = haplotypes.network_nodes(out["network_links"], phased)
    return out


def run_metrics(vcf: DataFrame, sites: DataFrame, obs: DataFrame, phased: DataFrame) -> DataFrame:
    """One row of the run's numbers; each part is one aggregated row."""
    parts = [
        variants.site_counters(vcf),
        sites.agg(F.count(F.lit(1)).alias("sites")),
        obs.agg(F.count(F.lit(1)).alias("observations"), F.count_distinct("read_id").alias("reads")),
        phased.agg(F.count(F.lit(1)).alias("phased"), F.count_if(F.col("idx") == 0).alias("blocks")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out.withColumn("phased_fraction", F.when(F.col("sites") > 0, F.col("phased") / F.col("sites")).otherwise(0.0))


def write_phasing(spark: SparkSession, tables: dict[str, DataFrame], vcf_path: str, out: str, config: PhaseConfig) -> None:
    for name, df in tables.items():
        if name == "vcf" and config.write_vcf:
            head = vcf_annotate.header_lines(readers.vcf_comments(spark, vcf_path), readers.vcf_header(spark, vcf_path), config.sample, config)
            writers.write_lines(df, head, f"{out}.vcf")
        elif name != "vcf":
            writers.write_tsv(df, f"{out}.{name}.txt")


def gene_program(spark: SparkSession, counts_path: str, features_path: str, config: GeneConfig = GeneConfig()) -> DataFrame:
    return gene_expression.gene_counts(readers.read_counts(spark, counts_path), readers.read_features(spark, features_path), config)


def matrix_program(spark: SparkSession, folder: str, features_path: str) -> tuple[gene_expression.Matrix, gene_expression.Matrix]:
    """(all counts, genome-wide phased counts) as gene by sample matrices."""
    genes, feats = written(readers.read_gene_folder(spark, folder), "genes"), readers.read_features(spark, features_path)
    return gene_expression.matrix_cells(genes, feats), gene_expression.matrix_cells(genes, feats, phased_only=True)


def cis_program(spark: SparkSession, matrix_path: str, vcf_path: str, pairs_path: str, map_path: str, config: CisConfig = CisConfig(), lists: bool = True) -> DataFrame:
    ship(spark)
    pairs = readers.read_pairs(spark, pairs_path)
    cells = readers.read_matrix(spark, matrix_path, None if config.ignore_v else pairs, config.chrom)
    counts = cells.select(F.col("name").alias("gene"), "sample", "a", "b")
    rows = cis_effect.individuals(pairs, counts, readers.read_genotypes(spark, vcf_path, readers.regions_for(vcf_path, pairs, "var_contig", "var_pos"), phased_only=True), readers.read_samples(spark, map_path), config)
    return cis_effect.effects(rows, pairs, config, lists)


def compound_program(spark: SparkSession, vcf_path: str, cadd_path: str, config: AnnotateConfig, af_path: str | None = None) -> DataFrame:
    """Pairs of coding variants of a phased sample by gene, with effects and frequencies."""
    vcf = readers.read_vcf(spark, vcf_path, config.sample)
    uid = F.concat_ws(config.id_separator, "contig", F.col("pos").cast("string"), "ref", "alt")
    field = lambda k: fields.sample_field(F.col("format"), F.col("sample"), k)
    whole = F.size(F.split("format", ":")) == F.size(F.split("sample", ":"))
    v = vcf.where(whole).withColumns({"variant_id": uid, "g": compound.genotype_alleles(field("GT")), "p": compound.phased_alleles(field("PG")), "block": field("PI").try_cast("double")})
    v = v.where("g is not null or p is not null")
    alleles = written(compound.with_cadd(v, readers.read_cadd(spark, cadd_path, readers.regions_for(cadd_path, v))), "annotations")
    if af_path:
        alleles = compound.with_frequency(alleles, readers.read_frequencies(spark, af_path, config.af_field, readers.regions_for(af_path, v)))
    else:
        info = fields.info_map(F.col("info"))[config.af_field]
        own = v.select("variant_id", F.posexplode(F.split(info, ",")).alias("i", "f")).select("variant_id", (F.col("i") + 1).alias("allele"), F.col("f").try_cast("double").alias("af"))
        alleles = alleles.join(own, ["variant_id", "allele"], "left")
    genes = alleles.select("gene", "variant_id").distinct()
    gw = v.where("g is not null").select("variant_id", F.col("g").alias("alleles")).join(genes, "variant_id")
    pg = v.where("p is not null and block is not null").select("variant_id", F.col("p").alias("alleles"), "block").join(genes, "variant_id")
    return compound.annotate(gw, pg, alleles)
