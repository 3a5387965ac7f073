"""Hand-derived cases of FIXTURES.md."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandspark.functions import fields, stats
from strandspark.functions.cigar import allele_at, segments
from strandspark.operators import cis_effect, compound, edges, gene_expression, haplotypes, intervals, phasing
from strandspark.config import GeneConfig, per_bam
from tests.walks import allele, walk


def alleles(spark, cigar, seq, sites, qual=None, rebase=True, pos=100):
    """Alleles of (position, length) sites in one read."""
    df = spark.createDataFrame([(cigar, seq, qual or "I" * len(seq))], "cigar string, seq string, qual string")
    seg = df.select(F.explode(segments(F.col("cigar"), F.col("seq"), F.col("qual"), 10, rebase)).alias("s"))
    out = {}
    for p, n in sites:
        first = F.lit(p) - (F.lit(pos) + F.col("s.off_start"))
        got = [r[0] for r in seg.select(allele_at(F.col("s.pseudo"), F.col("s.ins"), first.cast("int"), F.lit(n))).collect() if r[0] is not None]
        out[p, n] = got[0] if got else None
    return out


def test_spliced_read(spark):
    assert [(s["off_start"], s["off_end"], s["pseudo"]) for s in walk("4M10N4M", "ACGTTGCA", "I" * 8, 10)] == [(0, 4, "ACGT"), (14, 18, "TGCA")]
    assert alleles(spark, "4M10N4M", "ACGTTGCA", [(102, 1), (115, 1), (108, 1)]) == {(102, 1): "G", (115, 1): "G", (108, 1): None}


def test_deletion(spark):
    assert walk("2M1D2M", "ACGT", "IIII", 10)[0]["pseudo"] == "ACDGT"
    assert alleles(spark, "2M1D2M", "ACGT", [(102, 1), (101, 2)]) == {(102, 1): None, (101, 2): "C"}


def test_insertion(spark):
    assert walk("2M2I2M", "ACTTGA", "I" * 6, 10)[0]["ins"] == {1: "TT"}
    assert alleles(spark, "2M2I2M", "ACTTGA", [(101, 1), (102, 1)]) == {(101, 1): "CTT", (102, 1): "G"}


def test_base_quality(spark):
    assert alleles(spark, "4M", "ACGT", [(102, 1), (101, 2)], "II#I") == {(102, 1): None, (101, 2): "CN"}


def test_insertion_after_splice(spark):
    args = "2M10N2M2I2M", "ACGTAACC", [(113, 1)]
    assert alleles(spark, *args)[113, 1] == "TAA" and alleles(spark, *args, rebase=False)[113, 1] == "T"


def test_reads_as_a_plain_walk(spark):
    """Random alignments of every operation: the alleles of all places, both ways of looking insertions up."""
    import random

    r = random.Random(7)
    reads = []
    for i in range(120):
        ops = [(r.randint(1, 5), r.choice("MMMMIDNSHPX=")) for _ in range(r.randint(1, 9))]
        n = sum(k for k, o in ops if o in "MISX=")
        reads.append((i, "".join(f"{k}{o}" for k, o in ops), "".join(r.choices("ACGTDN", k=n)), "".join(r.choices("#I", [1, 4], k=n))))
    reads.append((900, "*", "ACG", "III"))
    reads += [(901, "9M", "ACG", "III"), (902, "3M", "ACGT", "I")]
    df = spark.createDataFrame(reads, "i int, cigar string, seq string, qual string")
    for rebase in (True, False):
        seg = df.select("i", F.explode(segments(F.col("cigar"), F.col("seq"), F.col("qual"), 10, rebase)).alias("s")).where("length(s.pseudo) > 0")
        seg = seg.withColumn("k", F.explode(F.sequence(F.lit(0), F.length("s.pseudo") - 1))).withColumn("n", F.explode(F.array(*map(F.lit, (1, 2, 3))))).where("k + n <= length(s.pseudo)")
        got = {(x["i"], x["at"], x["n"]): x["a"] for x in seg.select("i", (F.col("s.off_start") + F.col("k")).alias("at"), "n", allele_at(F.col("s.pseudo"), F.col("s.ins"), F.col("k"), F.col("n")).alias("a")).collect()}
        want = {}
        for i, cigar, seq, qual in reads:
            for part in walk(cigar, seq, qual, 10, rebase):
                for k in range(len(part["pseudo"])):
                    want |= {(i, part["off_start"] + k, n): allele(part, k, n) for n in (1, 2, 3) if k + n <= len(part["pseudo"])}
        assert got == want


def test_reads_away_from_sites_are_not_walked(spark):
    from strandspark.operators import observe

    sites = spark.createDataFrame([("1", "v", 40_000, 1, ["A", "C"]), ("1", "w", 900_000, 1, ["A", "C"]), ("2", "u", 5, 1, ["A", "C"])], "contig string, variant_id string, pos long, ref_len int, alleles array<string>")
    places = [("1", 1), ("1", 39_998), ("1", 32_766), ("1", 50_000), ("1", 899_000), ("1", 10_000_000), ("2", 1), ("2", 99_000), ("3", 5), (None, 5)]
    reads = spark.createDataFrame([(f"r{k}", c, p, "4M", "ACGT", "IIII", 1, 0) for k, (c, p) in enumerate(places)] + [("long", "1", 1, "2M60000N2M", "ACGT", "IIII", 1, 0), ("jump", "1", 100_000, "2M799998N2M", "ACGT", "IIII", 1, 0)], "qname string, rname string, pos long, cigar string, seq string, qual string, as_score int, bam int")
    near = {x["qname"] for x in reads.where(observe.occupied(sites)).collect()}
    assert near == {"r1", "r2", "r4", "r6", "long", "jump"}
    spoilt = reads.withColumn("seq", F.when(F.col("qname").isin(list(near)), F.col("seq")).otherwise((F.lit(1) / (F.col("pos") * 0)).cast("string")))
    assert {(x["read_id"], x["variant_id"]) for x in observe.observe(spoilt, sites).collect()} == {("r1", "v"), ("jump", "w")}
    assert reads.where(observe.occupied(sites.limit(0))).count() == 0


def test_soft_clip(spark):
    assert alleles(spark, "2S3M", "NNACG", [(100, 1)])[100, 1] == "A"


def test_score_quantile(spark):
    obs = spark.createDataFrame([(0, x) for x in (1, 2, 3, 10)], "bam int, as_score int")
    assert edges.score_cutoff(obs, 0.05).first()["cutoff"] == pytest.approx(1.15)
    assert sorted(r["as_score"] for r in edges.keep_scores(obs, 0.05).collect()) == [2, 3, 10]


def test_noise(spark):
    rows = [("c", "v1", 0)] * 99 + [("c", "v1", 2)] + [("c", "v2", 1)] * 50 + [("c", "v2", 2)] * 5
    obs = spark.createDataFrame(rows, "contig string, variant_id string, cls int")
    assert edges.noise_rate(obs).first()["noise"] == pytest.approx(0.005)
    assert edges.noise_rate(obs.limit(0)).first()["noise"] == 0


def test_pair_probability(spark):
    df = spark.createDataFrame([(9, 10), (8, 12), (1, 2), (3, 3), (0, 4), (3800, 4500)], "s long, n long")
    p = [r[0] for r in df.select(stats.conflict_p(F.col("s"), F.col("n"), F.lit(0.01))).collect()]
    assert p[:5] == [pytest.approx(0.4670874810), pytest.approx(0.0046074586, rel=1e-6), pytest.approx(0.118279, abs=1e-6), 1.0, 0.0]
    exact = sum(math.exp(math.lgamma(4501) - math.lgamma(i + 1) - math.lgamma(4501 - i) + i * math.log(0.939) + (4500 - i) * math.log(0.061)) for i in range(3801))
    assert p[5] == pytest.approx(exact, rel=1e-6, abs=1e-300)


def block(spark, phases, mafs=None, config="0000"):
    n = len(phases)
    phased = spark.createDataFrame([("c", "v0", f"v{i}", 10 * i, i, int(config[i])) for i in range(n)], "contig string, part string, variant_id string, pos long, idx int, hap_a int")
    rows = [("c", f"v{i}", 10 * i, f"rs{i}", "A", ["A", "C"], p, (mafs or [0.0] * n)[i], False) for i, p in enumerate(phases)]
    variants = spark.createDataFrame(rows, "contig string, variant_id string, pos long, rsid string, ref string, alleles array<string>, phase0 int, maf double, blacklisted boolean")
    return phased, variants


@pytest.mark.parametrize("phases, mafs, method, want", [
    ([0, 0, 1, None], None, 0, (2 / 3, 0, 0, "0000|1111")),
    ([0, None], None, 0, (1.0, 0, 1, "00|11")),
    ([0, 1], None, 0, (0.5, None, 0, "01|10")),
    ([0, 1], [0.1, 0.3], 1, (0.75, 1, 0, "11|00")),
    ([None, None], None, 0, (0.5, None, 1, "--|--")),
    ([1, 1], None, 0, (1.0, None, 1, "11|00")),
])
def test_genome_phase(spark, phases, mafs, method, want):
    phased, variants = block(spark, phases, mafs)
    gw = haplotypes.genome_phase(phased, variants, method)
    r = gw.first()
    obs = spark.createDataFrame([("c", 1, 0, "v0", 0, 0)], "contig string, read_id long, bam int, variant_id string, pos long, cls int")
    none = spark.createDataFrame([], "contig string, variant_a string, pos_a long, variant_b string, pos_b long, config int")
    row = haplotypes.haplotypes(phased, variants, obs, none, gw).first()
    assert (r["gw_confidence"], r["gw"], r["phase_concordant"], row["gw_phase"]) == (pytest.approx(want[0]), *want[1:])
    assert (row["reads_hap_a"], row["reads_hap_b"], row["start"], row["stop"]) == (1, 0, 0, 10 * (len(phases) - 1))


def test_block_edges_and_cis(spark):
    phased, variants = block(spark, [None] * 3, config="001")
    e = spark.createDataFrame([("c", "v0", 0, "v1", 10, 0), ("c", "v1", 10, "v2", 20, 1), ("c", "v0", 0, "v2", 20, -1)], "contig string, variant_a string, pos_a long, variant_b string, pos_b long, config int")
    assert tuple(haplotypes.block_edges(phased, e).first())[2:] == (2.0, 2.0)
    got = {(r["variant_a"], r["variant_b"]): r["configuration"] for r in haplotypes.allele_config(phased, variants).collect()}
    assert got["v0", "v1"] == "cis" and got["v0", "v2"] == "trans" and len(got) == 6


def test_folded_frequency(spark):
    df = spark.createDataFrame([("0.7,0.2", "1|2"), (None, "0|1"), ("0.7,0.2", "0/2")], "af string, gt string")
    assert [r[0] for r in df.select(fields.folded_af(F.col("af"), F.col("gt"))).collect()] == [pytest.approx(0.2), 0.0, pytest.approx(0.2)]


def gene_inputs(spark, rows, stops=((10, 20),)):
    counts = spark.createDataFrame(rows, "contig string, start long, stop long, variants string, aCount long, bCount long, totalCount long, blockGWPhase string, gwStat double, max_haplo_maf double, bam string, aReads string, bReads string, ord long")
    feats = spark.createDataFrame([("1", s, e, f"g{i}", i) for i, (s, e) in enumerate(stops)], "contig string, start long, stop long, name string, feature long")
    return counts, feats


def test_gene_swap_and_empty(spark):
    rows = [("1", 15, 15, "1_15_A_C", 3, 12, 15, "1|0", 1.0, 0.1, "b", "", "", 0)]
    got = gene_expression.gene_counts(*gene_inputs(spark, rows, ((10, 20), (50, 60)))).orderBy("start").collect()
    assert tuple(got[0])[4:] == (12, 3, 15, 2.0, 1, "1_15_A_C", 1, "b")
    assert tuple(got[1])[4:] == (0, 0, 0, math.inf, 0, "", 1, "b")
    assert gene_expression.gene_counts(*gene_inputs(spark, rows), GeneConfig(min_cov=16)).count() == 0
    with pytest.raises(ValueError):
        GeneConfig(min_haplo_maf=0.6)


def test_gene_unphased_wins(spark):
    rows = [("1", 12, 12, "1_12_A_C", 2, 2, 4, "0|1", 1.0, 0.1, "b", "", "", 0), ("1", 13, 13, "1_13_A_C", 4, 1, 5, "0/1", 1.0, 0.1, "b", "", "", 1), ("1", 14, 14, "1_14_A_C", 1, 4, 5, "0|1", 0.5, 0.1, "b", "", "", 2)]
    r = gene_expression.gene_counts(*gene_inputs(spark, rows)).first()
    assert (r["aCount"], r["bCount"], r["variants"], r["gw_phased"]) == (4, 1, "1_13_A_C", 0)
    r = gene_expression.gene_counts(*gene_inputs(spark, rows[:1]), GeneConfig(min_haplo_maf=0.2)).first()
    assert (r["gw_phased"], r["totalCount"]) == (0, 4)


def test_gene_end(spark):
    single = ("1", 21, 21, "1_21_A_C", 5, 5, 10, "0|1", 1.0, 0.1, "b", "", "", 0)
    pair = ("1", 15, 21, "1_15_A_C,1_21_A_C", 3, 2, 5, "0|1", 1.0, 0.1, "b", "0,1;1,2", "0;1", 1)
    r = gene_expression.gene_counts(*gene_inputs(spark, [single])).first()
    assert r["totalCount"] == 0
    r = gene_expression.gene_counts(*gene_inputs(spark, [pair])).first()
    assert (r["aCount"], r["bCount"], r["n_variants"]) == (3, 2, 2)


def test_cis_effect(spark):
    pairs = spark.createDataFrame([(0, "g", "v", "1", 5, "A", "C")], "xindex int, gene_id string, var_id string, var_contig string, var_pos long, var_ref string, var_alt string")
    counts = spark.createDataFrame([("g", "S1", 10, 4), ("g", "S2", 3, 3)], "gene string, sample string, a long, b long")
    gt = spark.createDataFrame([("1", 5, "v", "A", "C", "I1", "0|1"), ("1", 5, "v", "A", "C", "I2", "0|1"), ("1", 5, "v", "A", "C", "I3", "0/1")], "contig string, pos long, id string, ref string, alt string, vcf_sample string, gt string")
    samples = spark.createDataFrame([("I1", "S1"), ("I2", "S2"), ("I3", "S1")], "vcf_sample string, bed_sample string")
    rows = cis_effect.individuals(pairs, counts, gt, samples).collect()
    assert len(rows) == 1 and rows[0]["afc"] == pytest.approx(-1.1375035237) and (rows[0]["ref_count"], rows[0]["alt_count"]) == (10, 4)
    z, p = stats.rank_sum(np.array([1.0, 2.0, 3.0]), np.array([2.0, 4.0]))
    assert (z, p) == (pytest.approx(-0.8660254038), pytest.approx(0.3864762312))
    a, b = (stats.bootstrap_median(np.array([1.0, 2.0, 5.0]), 500, 3) for _ in range(2))
    assert a == b and a[1] == 2 and all(map(math.isnan, stats.bootstrap_median(np.zeros(0), 9, 1)))


def test_matrix(spark):
    genes = spark.createDataFrame([("1", 0, 9, "g", 3, 4, 7, 0.0, 1, "v", 0, "s"), ("1", 0, 9, "g", 1, 4, 5, 0.0, 1, "v", 1, "t"), ("1", 0, 9, "other", 1, 4, 5, 0.0, 1, "v", 1, "u")], "contig string, start long, stop long, name string, aCount long, bCount long, totalCount long, log2_aFC double, n_variants int, variants string, gw_phased int, bam string")
    feats = spark.createDataFrame([("1", 0, 9, "g", 0)], "contig string, start long, stop long, name string, feature long")
    every, phased = gene_expression.matrix(genes, feats), gene_expression.matrix(genes, feats, phased_only=True)
    assert every.columns == ["contig", "start", "stop", "name", "s", "t"]
    assert tuple(every.first())[4:] == ("3|4", "1|4") and tuple(phased.first())[4:] == ("0|0", "1|4")
    own = gene_expression.matrix_cells(genes, feats)
    assert sorted(tuple(r)[4:] for r in gene_expression.cell_counts(own.rows, own.names).collect()) == [("s", 3, 4), ("t", 1, 4)]


def test_bam_names(spark):
    files = spark.createDataFrame([(0, "a/x.bam"), (1, "b/x.bam"), (2, "y.bam")], "bam int, path string")
    assert dict(edges.bam_names(files).collect()) == {0: "x.1", 1: "x.2", 2: "y"}
    assert per_bam("3", 2, "mapq") == [3, 3] and per_bam("3,4", 2, "mapq") == [3, 4]
    with pytest.raises(ValueError):
        per_bam("1,2", 3, "mapq")


def test_compound(spark):
    gw = spark.createDataFrame([("g", "v1", [0, 1]), ("g", "v2", [1, 0]), ("NA", "v1", [0, 1]), ("NA", "v2", [1, 0])], "gene string, variant_id string, alleles array<int>")
    pg = gw.withColumn("block", F.lit(1.0))
    got = compound.gene_pairs(gw, pg).collect()
    assert {(r["variant_a"], r["variant_b"], r["allele_a"], r["allele_b"], r["configuration"], r["read_backed"]) for r in got} == {("v1", "v2", 1, 1, "trans", "1"), ("v2", "v1", 1, 1, "trans", "1")}
    turned = pg.withColumn("alleles", F.when(F.col("variant_id") == "v1", F.reverse("alleles")).otherwise(F.col("alleles"))).where("gene = 'g'")
    got = [(r["variant_a"], r["configuration"], r["read_backed"]) for r in compound.gene_pairs(gw, turned).collect()]
    assert sorted(got) == [("v1", "cis", "1"), ("v1", "trans", "-1"), ("v2", "cis", "1"), ("v2", "trans", "-1")]
    apart = pg.withColumn("block", F.col("variant_id"))
    assert {r["read_backed"] for r in compound.gene_pairs(gw, apart).collect()} == {"0"}
    gts = spark.createDataFrame([("0|1",), ("1/1",), ("0/1",), ("0|0",), (".|1",), ("1|2",)], "gt string")
    assert [r[0] for r in gts.select(compound.genotype_alleles(F.col("gt"))).collect()] == [[0, 1], [1, 1], None, None, None, [1, 2]]


def test_singleton_coordinates(spark):
    _, variants = block(spark, [None])
    variants = variants.withColumn("pos", F.lit(500).cast("long"))
    phased = spark.createDataFrame([], "contig string, part string, variant_id string, pos long, idx int, hap_a int")
    obs = spark.createDataFrame([("c", 1, 0, "v0", 500, 0), ("c", 1, 0, "v0", 500, 0), ("c", 2, 0, "v0", 500, 2)], "contig string, read_id long, bam int, variant_id string, pos long, cls int")
    h, c = haplotypes.singleton_haplotypes(variants, phased, obs).first(), haplotypes.singleton_counts(variants, phased, obs).first()
    assert (h["start"], h["stop"], h["length"], h["reads_total"]) == (499, 500, 1, 1) and math.isnan(h["gw_confidence"])
    assert (c["start"], c["stop"], c["blockGWPhase"], c["gwStat"], c["totalCount"]) == (500, 500, "0/1", 1.0, 1)


def test_intervals_against_nested_loop(spark):
    import random

    r = random.Random(1)
    rows = [(i, r.choice("ab"), s := r.randint(-50, 300), s + r.choice([0, 1, 5, 120])) for i in range(150)]
    a = spark.createDataFrame(rows, "i long, contig string, s long, e long")
    b = spark.createDataFrame([(i, c, s, e) for i, c, s, e in rows[::2]], "j long, contig string, s2 long, e2 long")
    want = {(x[0], y[0]) for x in rows for y in rows[::2] if x[1] == y[1] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]}
    got = [(r["i"], r["j"]) for r in intervals.overlaps(a, b, ["contig"], "s", "e", "s2", "e2", 16).collect()]
    assert len(got) == len(want) and set(got) == want
    semi = {r["i"] for r in intervals.overlapping(a, b, ["i"], ["contig"], "s", "e", "s2", "e2", 16).collect()}
    anti = {r["i"] for r in intervals.not_overlapping(a, b, ["i"], ["contig"], "s", "e", "s2", "e2", 16).collect()}
    assert semi == {i for i, _ in want} and anti == {x[0] for x in rows} - semi


def test_info(spark):
    df = spark.createDataFrame([("DB;AF=0.1;X=1=2;AF=0.3",), (None,), ("",)], "i string")
    assert [r[0] for r in df.select(fields.info_map(F.col("i"))).collect()] == [{"AF": "0.3", "X": "1"}, None, {}]
    assert df.select(fields.info_map_strict(F.col("i"))).first()[0] == {"AF": "0.3"}


def test_weak_points():
    assert phasing.split_points(6, [(i, i + 1, 0) for i in range(5)], 15) == [2, 4]
    assert phasing.phase_block(3, [(0, 1, 0), (1, 2, 1)]) == [(0, "001")]
    assert phasing.phase_block(3, [(0, 1, 0), (1, 2, 0), (0, 2, 1)]) == []
