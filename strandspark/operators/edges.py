"""Observations to tested variant connections.

``obs`` rows: contig, read_id, bam, variant_id, pos, as_score, cls -- the allele class
is 0 or 1 for the individual's alleles and 2 for any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandspark.functions.stats import conflict_p

MAX_MISMATCH = 0.05


def score_cutoff(obs: DataFrame, quantile: float, by: list[str] = ["bam"]) -> DataFrame:
    """Per file, the score at ``quantile`` over observation rows, linearly interpolated."""
    return obs.where(F.col("as_score").isNotNull()).groupBy(*by).agg(F.percentile("as_score", F.lit(float(quantile))).alias("cutoff"))


def keep_scores(obs: DataFrame, quantile: float, by: list[str] = ["bam"]) -> DataFrame:
    """Rows at or over their file's cutoff. Where a file has scores, rows without one go."""
    if quantile <= 0:
        return obs
    cut = F.broadcast(score_cutoff(obs, quantile, by))  # one row per file
    return obs.join(cut, by, "left").where(F.col("cutoff").isNull() | (F.col("as_score") >= F.col("cutoff"))).drop("cutoff")


def variant_matches(obs: DataFrame) -> DataFrame:
    """Matching and other observation rows (mates count each) of every variant."""
    return obs.groupBy("contig", "variant_id").agg(F.count_if(F.col("cls") < 2).alias("matches"), F.count_if(F.col("cls") == 2).alias("mismatches"))


def noise_rate(obs: DataFrame, by: list[str] = []) -> DataFrame:
    """Share of other bases over variants with few of them, halved: one row, or one per ``by``."""
    m = variant_matches(obs).where((F.col("matches") > 0) & (F.col("mismatches") < MAX_MISMATCH * (F.col("matches") + F.col("mismatches"))))
    return m.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum("mismatches").cast("double"), F.lit(2.0) * F.sum(F.col("matches") + F.col("mismatches"))), F.lit(0.0)).alias("noise"))


def read_classes(obs: DataFrame) -> DataFrame:
    """Distinct (contig, read, variant, class): mates and files that agree count once."""
    return obs.select("contig", "read_id", "variant_id", "pos", "cls").distinct()


def pair_cells(obs: DataFrame) -> DataFrame:
    """Reads per pair of variants and pair of classes, as columns c00 .. c22; only pairs
    that some read joins by two of the individual's alleles.

    Rows are dealt by a hash of the read once, a number that is also what they are sorted by. Reads
    of a single row, most of all, go right there; what is left of a read stays where it is, one
    sorted array, and its pairs are exploded from this, in order, without a join. Reads that share
    a hash are grouped apart. Counts are combined before their shuffle.
    """
    own = obs.select("contig", "read_id", "variant_id", "pos", "cls").where("contig is not null and read_id is not null")
    dealt = own.withColumn("_read", F.xxhash64("contig", "read_id")).repartition("_read")
    many = dealt.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy("_read"))).where("_rows > 1").drop("_rows")
    one = F.struct(F.col("pos"), F.col("variant_id").alias("v"), F.col("cls").alias("c"))
    reads = many.groupBy("_read", "contig", "read_id").agg(F.array_sort(F.collect_set(one)).alias("own")).where(F.size("own") > 1)
    firsts = reads.select("contig", "own", F.posexplode("own").alias("i", "a"))
    pairs = firsts.select("contig", "a", F.explode(F.slice("own", F.col("i") + 2, F.size("own"))).alias("b"))
    pairs = pairs.select("contig", F.col("a.v").alias("variant_a"), F.col("a.pos").alias("pos_a"), F.col("b.v").alias("variant_b"), F.col("b.pos").alias("pos_b"), F.col("a.c").alias("ca"), F.col("b.c").alias("cb"))
    pairs = pairs.where("variant_a <> variant_b or pos_a <> pos_b")  # classes of one variant are no pair
    cells = [F.count_if((F.col("ca") == i) & (F.col("cb") == j)).alias(f"c{i}{j}") for i in range(3) for j in range(3)]
    return pairs.groupBy("contig", "variant_a", "pos_a", "variant_b", "pos_b").agg(*cells).where("c00 + c01 + c10 + c11 > 0")


def connections(cells: DataFrame) -> DataFrame:
    """Supporting and total connections, and the configuration that the majority shows:
    0 (same alleles together), 1 (crossed) or -1 (a tie)."""
    same, crossed = F.col("c00") + F.col("c11"), F.col("c01") + F.col("c10")
    other = F.col("c02") + F.col("c12") + F.col("c20") + F.col("c21") + F.col("c22")
    config = F.when(same > crossed, 0).when(crossed > same, 1).otherwise(-1).cast("int")
    return cells.select("contig", "variant_a", "pos_a", "variant_b", "pos_b", F.greatest(same, crossed).alias("supporting_connections"), (same + crossed + other).alias("total_connections"), config.alias("config"))


def concordance(config: Column, phase_a0: Column, phase_b0: Column) -> Column:
    """'1' or '0': the configuration agrees with the prior phases of the first alleles or
    not; '.' where a phase is unknown or the configuration a tie."""
    agrees = F.when(config == 0, phase_a0 == phase_b0).otherwise(phase_a0 != phase_b0)
    return F.when((config < 0) | phase_a0.isNull() | phase_b0.isNull(), ".").when(agrees, "1").otherwise("0")


def pair_tests(obs: DataFrame, variants: DataFrame | None = None, noise: DataFrame | None = None, by: list[str] = []) -> DataFrame:
    """All tested pairs with their conflict probability; ``variants`` (variant_id, phase0)
    adds the concordance with the prior phase."""
    noise = noise_rate(obs, by) if noise is None else noise
    tests = connections(pair_cells(obs))
    tests = tests.join(F.broadcast(noise), by) if by else tests.crossJoin(F.broadcast(noise))  # one row of noise
    tests = tests.withColumn("p", conflict_p(F.col("supporting_connections"), F.col("total_connections"), F.col("noise"))).drop("noise")
    if variants is None:
        return tests
    p = variants.select("contig", "variant_id", "phase0")
    a, b = p.toDF("contig", "variant_a", "phase_a"), p.toDF("contig", "variant_b", "phase_b")
    tests = tests.join(a, ["contig", "variant_a"], "left").join(b, ["contig", "variant_b"], "left")
    return tests.withColumn("phase_concordant", concordance(F.col("config"), F.col("phase_a"), F.col("phase_b"))).drop("phase_a", "phase_b")


def surviving(tests: DataFrame, threshold: float) -> DataFrame:
    """Connections whose conflicts noise can explain."""
    return tests.where(F.col("p") >= threshold)


def allelic_counts(obs: DataFrame) -> DataFrame:
    """Distinct reads of each of the two alleles per variant; only covered variants."""
    own = obs.where("cls < 2").select("contig", "pos", "variant_id", "cls", "read_id").distinct()
    reads = lambda c: F.count_if((F.col("cls") == c) & F.col("read_id").isNotNull())
    out = own.groupBy("contig", "pos", "variant_id").agg(reads(0).alias("ref_count"), reads(1).alias("alt_count"))
    return out.withColumn("total_count", F.col("ref_count") + F.col("alt_count"))


def bam_names(files: DataFrame) -> DataFrame:
    """(bam, name): base names, numbered .1, .2 in input order where they repeat."""
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.bam$", "")
    named = files.withColumn("base", base)
    by = Window.partitionBy("base")
    again = F.concat("base", F.lit("."), F.row_number().over(by.orderBy("bam")).cast("string"))
    return named.withColumn("name", F.when(F.count(F.lit(1)).over(by) > 1, again).otherwise(F.col("base"))).select("bam", "name")
