"""Files in, tables out: simulated diploid reads through all five programs."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandspark.config import AnnotateConfig, CisConfig, GeneConfig, PhaseConfig
from strandspark.operators import gene_expression
from strandspark.plans import programs
from strandspark.sources import readers, writers

HEAD = '##fileformat=VCFv4.2\n##FORMAT=<ID=GT,Number=1,Type=String,Description="G">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS0\tS1\n'


def simulate(folder, seed=3):
    """Sites every 30 bases on two contigs, reads of 100 bases from two haplotypes."""
    r = random.Random(seed)
    vcf, sam, truth = [HEAD], ["@SQ\tSN:1\tLN:9999\n@SQ\tSN:2\tLN:9999\n"], {}
    for contig in "12":
        sites = {}
        for i in range(12):
            pos = 1000 + 30 * i
            ref, alt = r.sample("ACGT", 2)
            hap = r.randint(0, 1)
            sites[pos] = (ref, alt, hap)
            gt = f"{hap}|{1 - hap}" if i % 3 else "0/1"
            vcf.append(f"{contig}\t{pos}\trs{contig}{i}\t{ref}\t{alt}\t.\tPASS\tAF=0.{i + 10}\tGT:DP\t0|0:1\t{gt}:9\n")
            truth[f"{contig}_{pos}_{ref}_{alt}"] = hap
        vcf.append(f"{contig}\t5000\t.\tA\tC\t.\tq10\t.\tGT\t0|1\t0|1\n{contig}\t5001\t.\tA\tC,G\t.\tPASS\t.\tGT\t0|1\t0|0\n{contig}\t5100\t.\tA\tC\t.\tPASS\tAF=0.4\tGT\t0|1\t0|1\n")
        for n in range(400):
            start, hap = r.randint(950, 1330), r.randint(0, 1)
            seq = []
            for p in range(start, start + 100):
                if p in sites:
                    ref, alt, h = sites[p]
                    base = ref if h == hap else alt
                    seq.append(r.choice("ACGT") if r.random() < 0.005 else base)
                else:
                    seq.append("A")
            sam.append(f"r{contig}{n}\t{99 if n % 50 else 1024 + 99}\t{contig}\t{start}\t255\t100M\t=\t{start}\t150\t{''.join(seq)}\t{'I' * 100}\tNH:i:1\tAS:i:{98 if n % 20 else 10}\n")
    (folder / "in.vcf").write_text("".join(vcf))
    with gzip.open(folder / "in.vcf.gz", "wt") as f:
        f.write("".join(vcf))
    (folder / "a.sam").write_text("".join(sam))
    (folder / "features.bed").write_text("#c\n1\t990\t1200\tg1.1\n1\t1150\t1400\tg2\n2\t0\t5000\tg3\n3\t0\t10\tg4\n")
    (folder / "ban.bed").write_text("1\t999\t1000\n")
    return truth


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sim")
    truth = simulate(folder)
    config = PhaseConfig(sample="S1", gw_phase_vcf=2, output_network="1_1030_" + next(k for k in truth if k.startswith("1_1030_"))[7:])
    tables = programs.phase_reads(spark, str(folder / "in.vcf.gz"), [str(folder / "a.sam")], config, count_blacklist=str(folder / "ban.bed"))
    return folder, truth, config, tables


def test_phase_is_recovered(run, spark):
    _, truth, _, t = run
    rows = [r for r in t["haplotypes"].collect() if r["variants"] > 1]
    assert sorted((r["contig"], r["variants"]) for r in rows) == [("1", 12), ("2", 12)]
    for r in rows:
        ids = sorted((k for k in truth if k.startswith(r["contig"])), key=lambda k: int(k.split("_")[1]))
        a, b = (x.split(",") for x in r["variant_alleles"].split("|"))
        on_a = [int(k.split("_")[3 - truth[k]] == x) for k, x in zip(ids, a)]
        assert len(set(on_a)) == 1 and all(x != y for x, y in zip(a, b))
        assert r["edges_supporting"] == r["edges_total"] > 12 and r["gw_confidence"] == 1
    m = t["metrics"].first()
    assert m["blocks"] == 2 and m["phased"] == 24 and m["sites"] == 26 and m["filtered"] == 2 and m["unphased_phased"] == 8 and m["phase_corrections"] == 0


def test_tables_of_the_core(run):
    _, truth, _, t = run
    counts = [r for r in t["haplotypic_counts"].collect() if r["variantCount"] > 1]
    assert {r["bam"] for r in counts} == {"a"} and {r["variantCountBlacklisted"] for r in counts} == {0, 1}
    for r in counts:
        lists = r["aReads"].split(";")
        assert len(lists) == r["variantCount"] and len({x for y in lists for x in y.split(",") if x}) == r["aCount"]
    assert t["allelic_counts"].count() == 24
    assert t["variant_connections"].where("conflicting_configuration_p < 0.01").count() == 0
    assert t["allele_config"].count() == 2 * 12 * 11
    links = t["network_links"].collect()
    assert links and {r["inferred"] for r in links} == {0, 1} and all(r["variantA"].startswith("1_") for r in links)
    assert t["network_nodes"].count() == len({x for r in links for x in (r["variantA"], r["variantB"])})


def test_annotated_file(run, spark):
    folder, truth, config, t = run
    programs.write_phasing(spark, {"vcf": t["vcf"]}, str(folder / "in.vcf"), str(folder / "out"), config)
    lines = [x for p in sorted((folder / "out.vcf").glob("part*")) for x in p.read_text().splitlines()]
    head, rows = [x for x in lines if x[0] == "#"], [x.split("\t") for x in lines if x[0] != "#"]
    assert head[-1].split("\t")[-1] == "S1" and sum("ID=P" in x for x in head) == 7
    for c in rows:
        got = dict(zip(c[8].split(":"), c[9].split(":")))
        key = "_".join([c[0], c[1], c[3], c[4]])
        assert len(c[8].split(":")) == len(c[9].split(":"))
        if key in truth:
            assert got["GT"] == got["PW"] == f"{truth[key]}|{1 - truth[key]}" and got["PI"] in ("1", "2") and len(got["PB"].split(",")) == 12
        else:
            assert got["PB"] == "." and "|" not in got["PG"]


def test_order_of_reads_does_not_matter(run, spark, tmp_path):
    folder, _, config, t = run
    lines = (folder / "a.sam").read_text().splitlines(keepends=True)
    head, body = lines[:2], lines[2:]
    random.Random(1).shuffle(body)
    (tmp_path / "x.sam").write_text("".join(head + body[:300]))
    (tmp_path / "y.sam").write_text("".join(head + body[300:]))
    two = programs.phase_reads(spark, str(folder / "in.vcf"), [str(tmp_path / "x.sam"), str(tmp_path / "y.sam")], PhaseConfig(sample="S1"))
    keep = ["contig", "variant_ids", "variant_alleles", "gw_phase"]
    assert sorted(two["haplotypes"].where("variants > 1").select(*keep).collect()) == sorted(t["haplotypes"].where("variants > 1").select(*keep).collect())


def test_genes_matrix_and_cohort(run, spark, tmp_path):
    folder, _, _, t = run
    writers.write_tsv(t["haplotypic_counts"], f"{tmp_path}/counts.txt")
    genes = programs.gene_program(spark, f"{tmp_path}/counts.txt", str(folder / "features.bed"), GeneConfig())
    got = {r["name"]: r for r in genes.collect()}
    assert set(got) == {"g1.1", "g2", "g3", "g4"} and got["g4"]["totalCount"] == 0 and got["g3"]["gw_phased"] == 1
    assert got["g3"]["totalCount"] > got["g1.1"]["totalCount"] > 100
    (tmp_path / "genes").mkdir()
    for s, df in (("s1", genes), ("s2", genes.withColumn("aCount", F.col("aCount") + 1)), ("bad", genes.limit(1))):
        writers.write_tsv(df.withColumn("bam", F.lit(s)), f"{tmp_path}/genes/{s}.txt", single=True)
    (tmp_path / "genes" / "no.txt").write_text("a\tb\n1\t2\n")
    every, phased = programs.matrix_program(spark, f"{tmp_path}/genes", str(folder / "features.bed"))
    assert every.names == ["s1", "s2"] and [r["name"] for r in every.wide().collect()] == ["g1.1", "g2", "g3", "g4"]
    assert every.wide().columns[4:] == ["s1", "s2"]
    writers.write_matrix(every, f"{tmp_path}/m.bed")
    (tmp_path / "pairs.tsv").write_text("gene_id\tvar_id\tvar_contig\tvar_pos\tvar_ref\tvar_alt\ng3\tx\t2\t5100\tA\tC\ng1\ty\t1\t5100\tA\tC\n")
    (tmp_path / "map.tsv").write_text("vcf_sample\tbed_sample\nS1\ts2\nS0\tzz\nS0\ts1\n")
    args = f"{tmp_path}/m.bed", str(folder / "in.vcf"), f"{tmp_path}/pairs.tsv", f"{tmp_path}/map.tsv"
    out = programs.cis_program(spark, *args, CisConfig(bs=50)).collect()
    assert [(r["gene"], r["var_het_n"]) for r in out] == [("g3", 2)] and out[0]["het_samples"] == "S0,S1"
    out = programs.cis_program(spark, *args, CisConfig(bs=50, ignore_v=True)).collect()
    assert [r["gene"] for r in out] == ["g3", "g1"]
    assert phased.rows.count() == 4


def test_a_matrix_of_twenty_thousand_samples(spark, tmp_path):
    """Written and read back without a column for each sample."""
    n = 20_000
    features = spark.createDataFrame([("1", 0, 10, "g1", 0), ("1", 20, 30, "g0", 1)], "contig string, start long, stop long, name string, feature long")
    cells = spark.range(n).select(F.format_string("s%05d", F.col("id")).alias("bam"), F.col("id").alias("k"))
    genes = features.crossJoin(cells).select("contig", "start", "stop", "name", F.col("k").alias("aCount"), (F.col("k") * 2 + F.col("start")).alias("bCount"), (F.col("k") % 2).cast("int").alias("gw_phased"), "bam")
    genes = genes.where("not (name = 'g0' and k = 7)")  # an incomplete sample
    every, phased = gene_expression.matrix_cells(genes, features), gene_expression.matrix_cells(genes, features, phased_only=True)
    assert len(every.names) == n - 1 and "s00007" not in every.names
    row = phased.rows.where("name = 'g0'").first()
    assert row["cells"][:3] == ["0|0", "1|22", "0|0"] and len(row["cells"]) == n - 1
    writers.write_matrix(every, f"{tmp_path}/m")
    back = readers.read_matrix(spark, f"{tmp_path}/m")
    assert back.count() == 2 * (n - 1)
    assert tuple(back.where("name = 'g1' and sample = 's19999'").select("a", "b").first()) == (19_999, 39_998)
    assert [x.split("\t")[3] for x in (tmp_path / "m" / next(p.name for p in (tmp_path / "m").glob("part*"))).read_text().splitlines()] == ["name", "g1", "g0"]


def test_lines_with_their_header_are_one_text(spark, tmp_path):
    df = spark.createDataFrame([("2", 5, "c"), ("1", 9, "b"), ("1", 8, "a")], "contig string, pos long, value string").repartition(3)
    for single in (True, False):
        writers.write_lines(df, ["##z", "##a", "#C"], f"{tmp_path}/{single}", single)
        parts = sorted((tmp_path / str(single)).glob("part*"))
        assert "".join(p.read_text() for p in parts).split() == ["##z", "##a", "#C", "a", "b", "c"]
        assert not single or len(parts) == 1


def test_compound_program(spark, tmp_path):
    rows = [("1", 10, "rs1", "A", "C", "AF=0.1", "GT:PG:PI", "0|1:0|1:3"), ("1", 20, "rs2", "A", "C", "AF=0.2", "GT:PG:PI", "1|0:1|0:3"), ("1", 30, ".", "A", "C", "", "GT", "0/1"), ("1", 40, "rs4", "A", "C", "AF=0.4", "GT", "1/1")]
    (tmp_path / "v.vcf").write_text(HEAD.replace("\tS0\tS1", "\tS1") + "".join(f"{c}\t{p}\t{i}\t{r}\t{a}\t.\tPASS\t{x}\t{f}\t{s}\n" for c, p, i, r, a, x, f, s in rows))
    cadd = []
    for p in (10, 20, 30, 40):
        cells = ["."] * 100
        cells[0], cells[1], cells[4], cells[10], cells[92], cells[95], cells[-1] = "1", str(p), "C", f"effect{p}", "G1" if p != 40 else "NA", "name", str(p / 10)
        cadd.append("\t".join(cells))
    (tmp_path / "cadd.tsv").write_text("#x\n" + "\n".join(cadd) + "\n")
    out = programs.compound_program(spark, f"{tmp_path}/v.vcf", f"{tmp_path}/cadd.tsv", AnnotateConfig(sample="S1")).collect()
    assert {(r["variant_a"], r["variant_b"], r["configuration"], r["read_backed"], r["af_a"], r["cadd_phred_b"]) for r in out} == {("1_10_A_C", "1_20_A_C", "trans", "1", 0.1, 2.0), ("1_20_A_C", "1_10_A_C", "trans", "1", 0.2, 1.0)}
    assert len(out[0]) == 16
    (tmp_path / "af.vcf").write_text(HEAD + "1\t10\t.\tA\tG,C\t.\t.\tAF=0.5,0.25\tGT\t.\t.\n")
    out = programs.compound_program(spark, f"{tmp_path}/v.vcf", f"{tmp_path}/cadd.tsv", AnnotateConfig(sample="S1"), f"{tmp_path}/af.vcf").collect()
    assert {(r["variant_a"], r["af_a"], r["af_b"]) for r in out} == {("1_10_A_C", 0.25, 0.0), ("1_20_A_C", 0.0, 0.25)}


def test_readers(run, spark):
    folder, _, _, _ = run
    assert readers.sam_contigs(spark, str(folder / "a.sam")) == ["1", "2"]
    v = readers.read_vcf(spark, str(folder / "in.vcf"), "S1", prefix="chr", chrom="2")
    assert {r["contig"] for r in readers.known_contigs(v).collect()} == {"chr2"}
    with pytest.raises(ValueError):
        readers.read_vcf(spark, str(folder / "in.vcf"), "nobody")
    with pytest.raises(Exception, match="separator"):
        readers.check_contigs(v.withColumn("contig", F.lit("a_b")), "_").collect()
    assert readers.read_vcf(spark, str(folder / "in.vcf"), "S1", compat=True).count() < readers.read_vcf(spark, str(folder / "in.vcf"), "S1").count()


def test_stream(run, spark, tmp_path):
    from strandspark.operators import variants
    from strandspark.streaming import observations as S

    folder, _, config, t = run
    (tmp_path / "in").mkdir()
    lines = (folder / "a.sam").read_text().splitlines(keepends=True)
    for i in range(2):
        (tmp_path / "in" / f"{i}.sam").write_text("".join(lines[2 + i :: 2]))
    sites = variants.het_sites(readers.read_vcf(spark, str(folder / "in.vcf"), "S1"), config)
    reads = S.read_stream(spark, f"{tmp_path}/in", 1)
    q = S.allele_counts(reads, sites).writeStream.format("memory").queryName("allele_stream").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c0").trigger(availableNow=True).start()
    q.awaitTermination(120)
    from strandspark.operators.observe import observe

    batch = observe(readers.read_sam(spark, [str(folder / "a.sam")]), sites).where("cls < 2")
    want = {(r["variant_id"], r["cls"]): r["n"] for r in batch.groupBy("variant_id", "cls").agg(F.count_distinct("read_id").alias("n")).collect()}
    assert {(r["variant_id"], r["cls"]): r["reads"] for r in spark.table("allele_stream").collect()} == want
    seen = []
    S.collect_observations(reads, sites, f"{tmp_path}/obs", f"{tmp_path}/c1", lambda df: seen.append(df.count())).awaitTermination(120)
    assert len(seen) == 2 and seen[-1] == observe(readers.read_sam(spark, [str(folder / "a.sam")]), sites).count()


def _stream_files(folder, lines, parts, seed):
    """Reads in files of ``parts`` stretches of the coordinate order (shuffled, with a seed)."""
    head = [x for x in lines if x[0] == "@"]
    body = sorted((x for x in lines if x[0] != "@"), key=lambda x: (x.split("\t")[2], int(x.split("\t")[3])))
    step = -(-len(body) // parts)
    files = ["".join(head + body[k : k + step]) for k in range(0, len(body), step)]
    if seed:
        random.Random(seed).shuffle(files)
    folder.mkdir()
    return files


@pytest.mark.parametrize("seed", [0, 4])
def test_incremental_stream_equals_batch(run, spark, tmp_path, seed):
    """Sorted files: final counts and contigs come as the reads move on, with bounded state.
    Shuffled ones: with a wait that covers them, the same at the end."""
    import os

    from strandspark.operators import variants
    from strandspark.operators.observe import observe
    from strandspark.streaming import observations as S

    folder, _, config, t = run
    lines = (folder / "a.sam").read_text().splitlines(keepends=True)
    sites = variants.het_sites(readers.read_vcf(spark, str(folder / "in.vcf"), "S1"), config).cache()
    files = _stream_files(tmp_path / "in", lines, 4, seed)
    for i, text in enumerate(files):
        (tmp_path / "in" / f"{i}.sam").write_text(text)
        os.utime(tmp_path / "in" / f"{i}.sam", (1_000_000 + i, 1_000_000 + i))
    S.write_end(spark, f"{tmp_path}/in")
    reads = S.read_stream(spark, f"{tmp_path}/in", 1)
    whole = observe(readers.read_sam(spark, [str(folder / "a.sam")]), sites)

    if not seed:
        q = S.final_counts(reads, sites, ["1", "2"], 1000).writeStream.format("memory").queryName("final").outputMode("append").option("checkpointLocation", f"{tmp_path}/c0").trigger(availableNow=True).start()
        q.awaitTermination(180)
        got = [tuple(r) for r in spark.table("final").select("variant_id", "cls", "reads").collect()]
        want = sorted((r["variant_id"], r["cls"], r["n"]) for r in whole.where("cls < 2").groupBy("variant_id", "cls").agg(F.count_distinct("read_id").alias("n")).collect())
        assert sorted(got) == want
        rows = [p["stateOperators"][-1]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        assert rows and max(rows) < sum(n for *_, n in want) and rows[-1] <= 2  # what lies behind is dropped

    out = f"{tmp_path}/phase"
    S.phase_as_contigs_close(reads, sites, ["1", "2"], out, f"{tmp_path}/c1", PhaseConfig(sample="S1"), wait=0 if not seed else 9).awaitTermination(300)
    cols = ["contig", "part", "variant_id", "idx", "hap_a"]
    phased = spark.read.parquet(f"{out}/phased").withColumn("contig", F.col("contig").cast("string"))
    assert sorted(map(tuple, phased.select(*cols).collect())) == sorted(map(tuple, S.phase_observations(whole, sites, PhaseConfig(sample="S1")).select(*cols).collect()))
    assert not (tmp_path / "phase" / "late").exists() and not list((tmp_path / "phase" / "open").glob("batch=*/contig=[12]"))
