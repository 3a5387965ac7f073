"""Tables of phased blocks: connections, reads, genome-wide phase, configurations.

``phased`` rows: contig, part, variant_id, pos, idx, hap_a (see phasing.phase);
``variants`` rows: contig, variant_id, pos, rsid, ref, alleles (two), phase0 (the
haplotype of allele 0 in the prior phase, null if unknown), maf, blacklisted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandspark.runtime import written

BLOCK = ["contig", "part"]


def ordered(value: Column | str, order: Column | str = "idx") -> Column:
    """Array of a group's values in the order of ``idx``."""
    own = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o") if isinstance(order, str) else order.alias("o"), (F.col(value) if isinstance(value, str) else value).alias("v"))))
    return F.transform(own, lambda s: s["v"])


def joined(value: Column | str, sep: str = ",") -> Column:
    return F.array_join(ordered(value), sep, UNKNOWN)


UNKNOWN = "-"


def block_edges(phased: DataFrame, edges: DataFrame) -> DataFrame:
    """(contig, part, edges_supporting, edges_total) of decided connections in a block."""
    p = phased.select(*BLOCK, "variant_id", "hap_a")
    e = edges.where("config >= 0").join(p.toDF("contig", "part", "variant_a", "ha"), ["contig", "variant_a"])
    e = e.join(p.toDF("contig", "part", "variant_b", "hb"), ["contig", "part", "variant_b"])
    found = e.groupBy(*BLOCK).agg(F.count_if(F.col("ha").bitwiseXOR(F.col("hb")) == F.col("config")).cast("double").alias("edges_supporting"), F.count(F.lit(1)).cast("double").alias("edges_total"))
    all_blocks = phased.select(*BLOCK).distinct()
    return all_blocks.join(found, BLOCK, "left").na.fill(0.0, ["edges_supporting", "edges_total"])


def haplotype_reads(phased: DataFrame, obs: DataFrame) -> DataFrame:
    """(contig, part, variant_id, idx, bam, read_id, hap): allele-matching reads by haplotype, a row
    an observation. What is made of them counts distinct reads, so mates are not merged here."""
    own = obs.where("cls < 2").select("contig", "variant_id", "bam", "read_id", "cls")
    hap = F.when(F.col("cls") == F.col("hap_a"), "a").otherwise("b")
    return phased.select(*BLOCK, "variant_id", "idx", "hap_a").join(own, ["contig", "variant_id"]).withColumn("hap", hap).drop("cls", "hap_a")


def reads_per_haplotype(reads: DataFrame, by: list[str] = BLOCK, names: tuple[str, str] = ("reads_hap_a", "reads_hap_b")) -> DataFrame:
    """Distinct reads of haplotypes A and B."""
    count = lambda h: F.count_if((F.col("hap") == h) & F.col("read_id").isNotNull())
    return reads.select(*by, "hap", "read_id").distinct().groupBy(*by).agg(count("a").alias(names[0]), count("b").alias(names[1]))


def genome_phase(phased: DataFrame, variants: DataFrame, method: int = 0) -> DataFrame:
    """Anchor blocks to the prior phase.

    Per block: gw_confidence; ``gw``, the corrected haplotype of A at every variant (0, 1
    or null for each variant's prior); phase_concordant; max_maf. Method 0 takes the
    majority of the known phases, method 1 weighs them by allele frequency.
    """
    own = phased.join(variants.select("contig", "variant_id", "phase0", "maf"), ["contig", "variant_id"])
    own = own.withColumn("ph", F.when(F.col("hap_a") == 0, F.col("phase0")).otherwise(1 - F.col("phase0")))
    maf = F.coalesce("maf", F.lit(0.0))
    b = own.groupBy(*BLOCK).agg(
        F.count("ph").alias("known"), F.count(F.lit(1)).alias("n"), F.count_distinct("ph").alias("kinds"), F.avg("ph").alias("mean"),
        F.coalesce(F.sum(F.when(F.col("ph") == 0, maf)), F.lit(0.0)).alias("m0"), F.coalesce(F.sum(F.when(F.col("ph") == 1, maf)), F.lit(0.0)).alias("m1"), F.max(maf).alias("max_maf"),
    )
    majority = F.greatest("mean", 1 - F.col("mean"))
    to = F.when(F.col("mean") < 0.5, 0).when(F.col("mean") > 0.5, 1)
    if method == 1:
        weighed = F.col("m0") + F.col("m1") > 0
        to = F.when(weighed, F.when(F.col("m0") > F.col("m1"), 0).when(F.col("m1") > F.col("m0"), 1)).otherwise(to)
        majority = F.when(weighed, F.try_divide(F.greatest("m0", "m1"), F.col("m0") + F.col("m1"))).otherwise(majority)
    same = (F.col("known") == F.col("n")) & (F.col("kinds") == 1)
    confidence = F.when(F.col("known") == 0, 0.5).when(same, 1.0).otherwise(majority)
    return b.select(*BLOCK, confidence.alias("gw_confidence"), F.when((F.col("known") > 0) & ~same, to).cast("int").alias("gw"), (F.col("kinds") <= 1).cast("int").alias("phase_concordant"), "max_maf")


def corrected(phased: DataFrame, variants: DataFrame, gw: DataFrame) -> DataFrame:
    """Phased variants with ``ph`` (prior haplotype of A's allele) and ``gw_ph`` (corrected)."""
    own = phased.join(variants.select("contig", "variant_id", "rsid", "alleles", "phase0", "maf", "blacklisted"), ["contig", "variant_id"])
    own = own.withColumn("ph", F.when(F.col("hap_a") == 0, F.col("phase0")).otherwise(1 - F.col("phase0")))
    return own.join(gw, BLOCK).withColumn("gw_ph", F.coalesce("gw", "ph"))


def _both(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit("|"), b)


def _phase_strings(column: str) -> Column:
    text = lambda c: joined(F.coalesce(c.cast("string"), F.lit(UNKNOWN)), "")
    return _both(text(F.col(column)), text(1 - F.col(column)))


def haplotypes(phased: DataFrame, variants: DataFrame, obs: DataFrame, edges: DataFrame, gw: DataFrame) -> DataFrame:
    """One row per block, in the columns of the haplotype table."""
    own = corrected(phased, variants, gw)
    allele = lambda h: F.get("alleles", h)
    rows = own.groupBy(*BLOCK).agg(
        F.min("pos").alias("start"), F.max("pos").alias("stop"), F.count(F.lit(1)).alias("variants"), joined("rsid").alias("variant_ids"),
        _both(joined(allele(F.col("hap_a"))), joined(allele(1 - F.col("hap_a")))).alias("variant_alleles"),
        _phase_strings("ph").alias("annotated_phase"), _phase_strings("gw_ph").alias("gw_phase"), F.first("phase_concordant").alias("phase_concordant"), F.first("gw_confidence").alias("gw_confidence"),
    )
    rows = rows.join(block_edges(phased, edges), BLOCK).join(reads_per_haplotype(haplotype_reads(phased, obs)), BLOCK, "left").na.fill(0, ["reads_hap_a", "reads_hap_b"])
    return rows.select(
        "contig", "start", "stop", (F.col("stop") - F.col("start")).alias("length"), "variants", "variant_ids", "variant_alleles", "reads_hap_a", "reads_hap_b",
        (F.col("reads_hap_a") + F.col("reads_hap_b")).alias("reads_total"), "edges_supporting", "edges_total", "annotated_phase", "phase_concordant", "gw_phase", "gw_confidence",
    )


def haplotypic_counts(phased: DataFrame, variants: DataFrame, obs: DataFrame, gw: DataFrame, excluded: tuple[int, ...] = (), read_ids: bool = False) -> DataFrame:
    """Reads per block, file and haplotype over variants that are not blacklisted."""
    own = corrected(phased, variants, gw)
    used = own.where(~F.col("blacklisted"))
    reads = written(haplotype_reads(used, obs).where(~F.col("bam").isin(list(excluded)) if excluded else F.lit(True)), "haplotype-reads")
    counts = reads_per_haplotype(reads, [*BLOCK, "bam"], ("aCount", "bCount"))
    rank = F.dense_rank().over(Window.partitionBy(*BLOCK, "bam", "hap").orderBy("read_id")) - 1
    at = reads.withColumn("rank", rank).groupBy(*BLOCK, "bam", "variant_id", "idx").agg(*[F.array_join(F.array_sort(F.collect_set(F.when(F.col("hap") == h, F.col("rank")))), ",").alias(h) for h in "ab"])
    # Variants without a read in a file still have their place in that file's lists.
    grid = used.select(*BLOCK, "variant_id", "idx").join(reads.select(*BLOCK, "bam").distinct(), BLOCK)
    at = grid.join(at, [*BLOCK, "bam", "variant_id", "idx"], "left").na.fill("", ["a", "b"])
    lists = at.groupBy(*BLOCK, "bam").agg(joined("a", ";").alias("aReads"), joined("b", ";").alias("bReads"))
    allele = lambda h: F.get("alleles", h)
    only = lambda v, black: F.array_join(F.filter(ordered(F.when(F.col("blacklisted") == black, v)), lambda x: x.isNotNull()), ",")
    first = F.min_by("gw_ph", "idx")
    rows = own.groupBy(*BLOCK).agg(
        F.min("pos").alias("start"), F.max("pos").alias("stop"), only(F.col("variant_id"), False).alias("variants"), F.count_if(~F.col("blacklisted")).alias("variantCount"),
        only(F.col("variant_id"), True).alias("variantsBlacklisted"), F.count_if("blacklisted").alias("variantCountBlacklisted"),
        only(allele(F.col("hap_a")), False).alias("haplotypeA"), only(allele(1 - F.col("hap_a")), False).alias("haplotypeB"),
        F.when(first == 0, "0|1").when(first == 1, "1|0").otherwise("0/1").alias("blockGWPhase"), F.first("gw_confidence").alias("gwStat"), F.first("max_maf").alias("max_haplo_maf"),
    )
    out = rows.join(counts, BLOCK).join(lists, [*BLOCK, "bam"]).withColumn("totalCount", F.col("aCount") + F.col("bCount")).where("totalCount > 0")
    extra = []
    if read_ids:
        ids = reads.groupBy(*BLOCK, "bam").agg(*[F.array_join(F.array_sort(F.collect_set(F.when(F.col("hap") == h, F.col("read_id").cast("string")))), ",").alias(f"read_ids_{h}") for h in "ab"])
        out, extra = out.join(ids, [*BLOCK, "bam"]), ["read_ids_a", "read_ids_b"]
    return out.select("contig", "start", "stop", "variants", "variantCount", "variantsBlacklisted", "variantCountBlacklisted", "haplotypeA", "haplotypeB", "aCount", "bCount", "totalCount", "blockGWPhase", "gwStat", "max_haplo_maf", "bam", "aReads", "bReads", *extra)


def _unphased(variants: DataFrame, phased: DataFrame) -> DataFrame:
    return variants.join(phased.select("contig", "variant_id"), ["contig", "variant_id"], "left_anti")


def _own_phase(column: str) -> Column:
    return F.coalesce(_both(F.col(column).cast("string"), (1 - F.col(column)).cast("string")), F.lit("-|-"))


def singleton_haplotypes(variants: DataFrame, phased: DataFrame, obs: DataFrame) -> DataFrame:
    """Covered variants outside blocks, in the columns of the haplotype table."""
    from strandspark.operators.edges import allelic_counts

    own = _unphased(variants, phased).join(allelic_counts(obs).drop("pos"), ["contig", "variant_id"])
    nan = F.lit(float("nan"))
    return own.select(
        "contig", (F.col("pos") - 1).alias("start"), F.col("pos").alias("stop"), F.lit(1).cast("long").alias("length"), F.lit(1).cast("long").alias("variants"), F.col("rsid").alias("variant_ids"),
        _both(F.get("alleles", F.lit(0)), F.get("alleles", F.lit(1))).alias("variant_alleles"), F.col("ref_count").alias("reads_hap_a"), F.col("alt_count").alias("reads_hap_b"), F.col("total_count").alias("reads_total"),
        F.lit(0.0).alias("edges_supporting"), F.lit(0.0).alias("edges_total"), _own_phase("phase0").alias("annotated_phase"), F.lit(None).cast("int").alias("phase_concordant"), _own_phase("phase0").alias("gw_phase"), nan.alias("gw_confidence"),
    )


def singleton_counts(variants: DataFrame, phased: DataFrame, obs: DataFrame, excluded: tuple[int, ...] = (), read_ids: bool = False) -> DataFrame:
    """Variants outside blocks per file, in the columns of the count table."""
    own = written(_unphased(variants, phased).where(~F.col("blacklisted")), "unphased")
    if excluded:
        obs = obs.where(~F.col("bam").isin(list(excluded)))
    # observations of these variants only, each read of a class once
    obs = obs.where("cls < 2").join(own.select("contig", "variant_id"), ["contig", "variant_id"], "left_semi").select("contig", "variant_id", "bam", "cls", "read_id").distinct()
    reads = lambda c: F.count_if((F.col("cls") == c) & F.col("read_id").isNotNull())
    per = obs.groupBy("contig", "variant_id", "bam").agg(reads(0).alias("aCount"), reads(1).alias("bCount"))
    own = own.join(per, ["contig", "variant_id"])
    phase = F.when(F.col("phase0") == 0, "0|1").when(F.col("phase0") == 1, "1|0").otherwise("0/1")
    extra = [F.lit("").alias("read_ids_a"), F.lit("").alias("read_ids_b")] if read_ids else []
    return own.select(
        "contig", F.col("pos").alias("start"), F.col("pos").alias("stop"), F.col("variant_id").cast("string").alias("variants"), F.lit(1).cast("long").alias("variantCount"), F.lit("").alias("variantsBlacklisted"), F.lit(0).cast("long").alias("variantCountBlacklisted"),
        F.get("alleles", F.lit(0)).alias("haplotypeA"), F.get("alleles", F.lit(1)).alias("haplotypeB"), "aCount", "bCount", (F.col("aCount") + F.col("bCount")).alias("totalCount"), phase.alias("blockGWPhase"), F.lit(1.0).alias("gwStat"), F.coalesce("maf", F.lit(0.0)).alias("max_haplo_maf"), "bam", F.lit("").alias("aReads"), F.lit("").alias("bReads"), *extra,
    )


def allele_config(phased: DataFrame, variants: DataFrame) -> DataFrame:
    """cis or trans of every ordered pair of variants of a block."""
    own = phased.join(variants.select("contig", "variant_id", "rsid", "alleles", "ref"), ["contig", "variant_id"])
    on_a = F.get("alleles", F.col("hap_a")) == F.col("ref")
    on_b = F.get("alleles", 1 - F.col("hap_a")) == F.col("ref")
    a = own.select(*BLOCK, F.col("variant_id").alias("variant_a"), F.col("rsid").alias("rsid_a"), on_a.alias("ra"))
    b = own.select(*BLOCK, F.col("variant_id").alias("variant_b"), F.col("rsid").alias("rsid_b"), on_b.alias("rb"))
    pairs = a.join(b, BLOCK).where("variant_a <> variant_b")
    return pairs.select("variant_a", "rsid_a", "variant_b", "rsid_b", F.when(F.col("ra") == F.col("rb"), "trans").otherwise("cis").alias("configuration"))


def network_links(cells: DataFrame, phased: DataFrame, variant: str | None = None) -> DataFrame:
    """Allele-to-allele connections inside blocks (of one variant's block, if named): as
    read (inferred 0) and mirrored to the complementary alleles (inferred 1)."""
    p = phased.select(*BLOCK, "variant_id")
    if variant is not None:
        p = p.join(p.where(F.col("variant_id") == variant).select(*BLOCK), BLOCK, "left_semi")
    own = cells.join(p.toDF("contig", "part", "variant_a"), ["contig", "variant_a"]).join(p.toDF("contig", "part", "variant_b"), ["contig", "part", "variant_b"])
    rows = [F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.col(f"c{i if not m else 1 - i}{j if not m else 1 - j}").alias("n"), F.lit(m).alias("inferred")) for m in (0, 1) for i in (0, 1) for j in (0, 1)]
    own = own.select("variant_a", "variant_b", F.explode(F.array(*rows)).alias("x")).where("x.n > 0")
    allele = lambda v, a: F.concat_ws(":", F.col(v), F.col(a).cast("string"))
    return own.select(allele("variant_a", "x.a").alias("variantA"), allele("variant_b", "x.b").alias("variantB"), F.col("x.n").alias("connections"), F.col("x.inferred").cast("int").alias("inferred"))


def network_nodes(links: DataFrame, phased: DataFrame) -> DataFrame:
    """Alleles of the links with their place in the block and haplotype."""
    ids = links.select(F.explode(F.array("variantA", "variantB")).alias("id")).distinct()
    own = ids.withColumn("variant_id", F.expr("substring_index(id, ':', 1)")).withColumn("allele", F.expr("cast(substring_index(id, ':', -1) as int)"))
    own = own.join(phased.select(F.col("variant_id").cast("string").alias("variant_id"), "idx", "hap_a"), "variant_id")
    return own.select("id", F.col("idx").alias("index"), F.when(F.col("allele") == F.col("hap_a"), "A").otherwise("B").alias("assigned_hap"))
