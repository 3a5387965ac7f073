"""Effect of regulatory variants on the allelic expression of genes in a cohort."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.config import CisConfig
from strandspark.functions.fields import strip_version
from strandspark.functions.stats import afc, bootstrap_median, rank_sum
from strandspark.runtime import written

EFFECTS = ["het", "het_abs", "hom", "hom_abs"]
LISTS = ["het_afcs", "hom_afcs", "het_ref_counts", "het_alt_counts", "hom_0_counts", "hom_1_counts", "het_samples", "hom_samples"]


def individuals(pairs: DataFrame, counts: DataFrame, genotypes: DataFrame, samples: DataFrame, config: CisConfig = CisConfig()) -> DataFrame:
    """One row per pair, matching variant record and usable individual.

    ``pairs``: xindex, gene_id, var_id, var_contig, var_pos, var_ref, var_alt;
    ``counts``: gene, sample, a, b; ``genotypes``: contig, pos, id, ref, alt,
    vcf_sample, gt; ``samples``: vcf_sample, bed_sample. Equi-joins throughout: the
    point lookups of all pairs are one join on (contig, pos).
    """
    if config.chrom:
        pairs = pairs.where(F.col("var_contig") == config.chrom)
    if config.ignore_v:
        pairs, counts = pairs.withColumn("gene_id", strip_version(F.col("gene_id"))), counts.withColumn("gene", strip_version(F.col("gene")))
    used = counts.join(pairs.select(F.col("gene_id").alias("gene")).distinct(), "gene", "left_semi")
    x = pairs.join(genotypes.where(F.contains("gt", F.lit("|"))), (F.col("var_contig") == F.col("contig")) & (F.col("var_pos") == F.col("pos")))
    same = (F.col("var_ref") != "") & (F.col("var_alt") != "") & (F.col("ref") == F.col("var_ref")) & (F.col("alt") == F.col("var_alt"))
    x = x.where(same | (F.col("id") == F.col("var_id"))).join(samples, "vcf_sample")
    x = x.join(used, (F.col("gene") == F.col("gene_id")) & (F.col("sample") == F.col("bed_sample"))).where(F.col("a") + F.col("b") >= config.min_cov)
    left, right = F.get(F.split("gt", "[|]"), F.lit(0)), F.get(F.split("gt", "[|]"), F.lit(1))
    het = F.contains("gt", F.lit("0")) & F.contains("gt", F.lit("1"))
    hom = ((left == "0") & (right == "0")) | ((left == "1") & (right == "1"))
    alt_1 = het & (right == "1") & (left != "1")
    return x.where(het | hom).select(
        "xindex", "gene_id", "var_id", "var_contig", "var_pos", F.col("id").alias("record"), "vcf_sample", F.when(het, "het").otherwise("hom").alias("kind"), afc(F.col("a"), F.col("b"), config.pc, alt_1).alias("afc"),
        F.when(het & ~alt_1, F.col("b")).otherwise(F.col("a")).alias("ref_count"), F.when(het & ~alt_1, F.col("a")).otherwise(F.col("b")).alias("alt_count"),
    )


def effects(rows: DataFrame, pairs: DataFrame, config: CisConfig = CisConfig(), lists: bool = True) -> DataFrame:
    """One row per pair and record: numbers, rank-sum p, bootstrapped medians, and with ``lists`` the value lists.

    The statistics of one pair need its individuals together -- one per sample of the
    cohort, so groups are small. Seeds come from the pair: reruns agree. ``config.bs`` of 0
    gives no resampled numbers (NaN). The table is written before it is put in order, as
    ranges are found by reading it.
    """
    schema = "xindex long, gene string, var_id string, var_chr string, var_pos long, var_het_n long, var_hom_n long, het_hom_pvalue double, "
    schema += ", ".join(f"{e}_low double, {e}_median double, {e}_high double" + (", het_p double" if e == "het" else "") for e in EFFECTS)
    schema += "".join(f", {k} string" for k in LISTS) if lists else ""
    times, seed = config.bs, config.seed

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        if lists:
            t = t.take(pc.sort_indices(t["vcf_sample"]))
        het = t["kind"].to_numpy(zero_copy_only=False) == "het"
        at = {"het": np.flatnonzero(het), "hom": np.flatnonzero(~het)}
        values = t["afc"].to_numpy()
        v = {k: values[i] for k, i in at.items()}
        _, p = rank_sum(np.abs(v["het"]), np.abs(v["hom"]))
        x = t["xindex"][0].as_py()
        out = [x, *(t[c][0].as_py() for c in ("gene_id", "var_id", "var_contig", "var_pos")), len(v["het"]), len(v["hom"]), p]
        for i, (k, absolute) in enumerate((("het", False), ("het", True), ("hom", False), ("hom", True))):
            low, mid, high, zero = bootstrap_median(np.abs(v[k]) if absolute else v[k], times, seed * 1_000_003 + x * 4 + i)
            out += [low, mid, high] + ([zero] if i == 0 else [])
        if lists:
            text = lambda c, k: ",".join(map(str, t[c].take(pa.array(at[k])).to_pylist()))
            out += [text("afc", "het"), text("afc", "hom"), text("ref_count", "het"), text("alt_count", "het"), text("ref_count", "hom"), text("alt_count", "hom"), text("vcf_sample", "het"), text("vcf_sample", "hom")]
        kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
        columns = [f.split() for f in schema.split(", ")]
        return pa.table({n: pa.array([y], kinds[kind]) for (n, kind), y in zip(columns, out)})

    used = ["xindex", "record", "gene_id", "var_id", "var_contig", "var_pos", "kind", "afc", *(("vcf_sample", "ref_count", "alt_count") if lists else ())]
    own = rows.select(*used).withColumns({c: F.col(c).cast("long") for c in ("xindex", "var_pos")}).withColumn("afc", F.col("afc").cast("double"))
    return written(own.groupBy("xindex", "record").applyInArrow(run, schema), "effects").orderBy("xindex").drop("xindex")
