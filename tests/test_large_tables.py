"""What only large tables showed: counts without pairs, tasks by output, whole blocks, long rows."""

import random
from collections import Counter

from pyspark.sql import functions as F

from strandspark.operators import compound
from tests.test_pairs_and_bins import brute_pairs


def test_codes_are_counted_without_pairs(spark):
    r = random.Random(8)
    allele = lambda: [r.choice([0, 0, 1, 2]), r.choice([0, 1, 1, 2])]
    gw, pg = {}, {}
    for gene, n in (("hot", 60), ("g", 9), ("one", 1), ("NA", 5)):
        for v in range(n):
            if r.random() < 0.85:
                gw[(gene, f"v{v}")] = allele()
            if r.random() < 0.7:
                own = gw.get((gene, f"v{v}"), allele())
                pg[(gene, f"v{v}")] = (r.choice([own, own[::-1], allele()]), r.randint(1, 4))
    g = spark.createDataFrame([(*k, a) for k, a in gw.items()], "gene string, variant_id string, alleles array<int>")
    p = spark.createDataFrame([(*k, a, b) for k, (a, b) in pg.items()], "gene string, variant_id string, alleles array<int>, block int")
    want = Counter(x[-1] for x in brute_pairs(gw, pg))
    assert {x["read_backed"]: x["n"] for x in compound.code_counts(g, p).collect()} == want and len(want) == 3


def test_pairing_has_tasks_by_cells(spark):
    """A few KB of variants make many pairs; they are not left to one or two tasks."""
    v = spark.range(600).select(F.concat(F.lit("g"), F.col("id") % 10).alias("gene"), F.col("id").cast("string").alias("variant"))
    at = compound._pairs(v, ["gene"], 30).select(F.spark_partition_id().alias("i")).groupBy("i").count().collect()
    assert len(at) >= 12 and sum(r["count"] for r in at) == 10 * 60 * 59 // 2


def test_pairs_are_made_as_they_are_returned(spark):
    """Both orders of a pair come from the join; nothing is copied or turned after it, and pairs of different blocks carry no genotypes."""
    g = spark.createDataFrame([("g", f"v{i}", [i % 2, 1]) for i in range(20)], "gene string, variant_id string, alleles array<int>")
    p = spark.createDataFrame([("g", f"v{i}", [1, i % 2], i // 4) for i in range(0, 20, 2)], "gene string, variant_id string, alleles array<int>, block int")
    top = _plan(compound.gene_pairs(g, p, per_cell=7)).split("Exchange")[0]
    assert "Generate" not in top and "Join" in top and "g0_a" not in top


def test_stretches_of_an_open_block_are_no_concordant_block(spark, monkeypatch):
    """Two triangles, one of which no assignment satisfies, joined by one edge: cut at the edge, one stretch has all its edges."""
    from strandspark.plans import core_queries

    e = [(0, 1, 0), (1, 2, 0), (0, 2, 0), (2, 3, 0), (3, 4, 0), (4, 5, 0), (3, 5, 1), (10, 11, 1)]
    rows = [("c", f"{a:02d}", a, f"{b:02d}", b, x) for a, b, x in e]
    edges = spark.createDataFrame(rows, "contig string, variant_a string, pos_a long, variant_b string, pos_b long, config int")
    monkeypatch.setattr(core_queries.Case, "edges", lambda self: edges)
    got = core_queries.concordant_blocks(spark, "/root/testdata/sf0.001").collect()
    assert [(r["contig"], r["block"], r["hap_a"], r["hap_b"]) for r in got] == [("c", "10", "01", "10")]


def test_effects_without_resampling_are_the_same(spark):
    from strandspark.config import CisConfig
    from strandspark.plans.study_queries import cohort
    from strandspark.operators import cis_effect

    rows, pairs = cohort(spark, "/root/testdata/sf0.001")
    full = cis_effect.effects(rows, pairs).toPandas()
    slim = cis_effect.effects(rows, pairs, CisConfig(bs=0), lists=False).toPandas()
    same = ["gene", "var_id", "var_het_n", "var_hom_n", "het_hom_pvalue", "het_median", "het_abs_median", "hom_median", "hom_abs_median"]
    assert len(full) and full[same].equals(slim[same]) and slim["het_low"].isna().all() and not full["het_low"].isna().all()
    assert "het_afcs" in full and "het_afcs" not in slim


def test_cells_in_places(spark):
    """Cells of a wide row are laid out in one pass over those that are there."""
    from strandspark.plans.file_queries import in_places

    r = random.Random(1)
    for n in (1, 2, 50):
        own = {i: f"c{i}" for i in r.sample(range(n), (n + 1) // 2)}
        df = spark.createDataFrame([(sorted(own.items()),)], "m array<struct<place:int,cell:string>>")
        assert df.select(in_places("m", "./.", n)).first()[0] == "\t".join(own.get(i, "./.") for i in range(n))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_reads_need_no_join(spark):
    """Rows are dealt by read once; counts are what is shuffled after that."""
    from strandspark.operators import edges

    rows = [("c", 1, "a", 1, 0), ("c", 1, "b", 2, 1), ("c", 1, "b", 2, 2), ("c", 2, "a", 1, 0), ("c", None, "a", 1, 0), ("c", None, "b", 2, 0), ("d", 3, "x", 5, 1), ("d", 3, "y", 5, 1)]
    got = edges.pair_cells(spark.createDataFrame(rows, "contig string, read_id long, variant_id string, pos long, cls int"))
    assert "Join" not in _plan(got) and _plan(got).count("Exchange hashpartitioning") == 2
    cells = {(r["variant_a"], r["variant_b"]): {k: n for k, n in r.asDict().items() if k[0] == "c" and k != "contig" and n} for r in got.collect()}
    assert cells == {("a", "b"): {"c01": 1, "c02": 1}, ("x", "y"): {"c11": 1}}


def test_numbering_takes_its_rows_once(spark):
    from strandspark.operators.scans import numbered

    seen = spark.sparkContext.accumulator(0)

    def look(it):
        for pdf in it:
            seen.add(len(pdf))
            yield pdf

    got = numbered(spark.range(500).mapInPandas(look, "id long"), "n", "id").collect()
    assert all(r["n"] == r["id"] for r in got) and seen.value == 500


def test_observations_are_not_shuffled(spark):
    from strandspark.operators import observe

    reads = spark.createDataFrame([(q, "c", 10 * (i % 7) + 1, i % 2, "20M", "ACGTT" * 4, "I" * 20) for i in range(60) for q in (f"r{i // 2}",)], "qname string, rname string, pos long, bam int, cigar string, seq string, qual string")
    sites = spark.createDataFrame([("c", f"s{p}", p, 1, ["A", "C"]) for p in range(3, 90, 4)], "contig string, variant_id string, pos long, ref_len int, alleles array<string>")
    got = observe.allele_reads(reads, sites, 16)
    assert _plan(got).count("Exchange hashpartitioning") + _plan(got).count("REPARTITION_BY_NUM") <= 4 and "Exchange hashpartitioning(read_id" not in _plan(got) and "variant_id#" not in "".join(x for x in _plan(got).split("\n") if "Exchange" in x)
    obs = observe.observe(reads.withColumn("as_score", F.lit(1)), sites, width=16)
    by = ["contig", "variant_id", "pos", "bam", "allele", "cls"]
    want = obs.groupBy(*by).agg(F.count(F.lit(1)).alias("seen"), F.count_distinct("read_id").alias("reads"))
    assert got.count() and sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_near_components_need_no_rounds(spark, monkeypatch):
    """Chains of 40 nodes, each within its contig: their edges are stars when they are first written."""
    from strandspark.operators import graph

    rows = [(f"c{c}", f"c{c}:{i + 1:02d}", f"c{c}:{i:02d}") for c in range(30) for i in range(39)]
    random.Random(3).shuffle(rows)
    made = []
    monkeypatch.setattr(graph, "written", lambda df, name, write=graph.written: made.append(name) or write(df, name))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 20)
    try:  # batches end where a contig does
        got = graph.components(spark.createDataFrame(rows, "contig string, u string, v string").repartition(4), near=["contig"], batch=50).collect()
    finally:
        spark.conf.set(key, before)
    assert sorted((x["node"], x["root"]) for x in got) == sorted((f"c{c}:{i:02d}", f"c{c}:00") for c in range(30) for i in range(40))
    assert made == ["edges"]


def test_components_over_small_batches(spark):
    """What batches and contigs leave apart is joined by the rounds, with the same roots."""
    from strandspark.operators import graph

    r = random.Random(5)
    rows = [(f"c{r.randint(0, 2)}", f"é{a:03d}", f"é{b:03d}") for a, b in ((r.randint(0, 299), r.randint(0, 299)) for _ in range(260))]
    least = {x: x for _, u, v in rows if u != v for x in (u, v)}
    for _ in range(300):
        for _, u, v in rows:
            if u != v:
                least[u] = least[v] = min(least[u], least[v])
    df = spark.createDataFrame(rows, "contig string, u string, v string")
    for batch in (1, 7, 1000):
        got = graph.components(df, ["contig"], batch).collect()
        assert len(got) == len(least) and {x["node"]: x["root"] for x in got} == least, batch


def test_large_blocks_are_phased_in_few_steps(spark, monkeypatch):
    """Many concordant blocks, none as one row: tables written do not grow with the longest block, and open steps are left out."""
    from strandspark.operators import graph, phasing, splitting

    rows = [("c", f"v{100 * b + i:05d}", 100 * b + i, f"v{100 * b + i + 1:05d}", 100 * b + i + 1, (b + i) % 2) for b in range(5) for i in range(40)]
    edges = spark.createDataFrame(rows, "contig string, variant_a string, pos_a long, variant_b string, pos_b long, config int").cache()
    made = []
    for m in (graph, phasing, splitting):
        monkeypatch.setattr(m, "written", lambda df, name, write=m.written: made.append(name) or write(df, name))
    out = phasing.phase(edges, phasing.blocks_of(edges).cache(), large=0)
    assert len(made) <= 8, made
    got = {(x["part"], x["idx"]): x["hap_a"] for x in out.collect()}
    want = {}
    for b in range(5):
        hap = 0
        for i in range(41):
            want[(f"v{100 * b:05d}", i)] = hap
            hap ^= (b + i) % 2
    assert got == want


def test_cohort_files_grow_with_the_genotypes(spark, tmp_path, monkeypatch):
    """Samples with no genotype near a site have no cell there; every file is whole, and its cells go by its own header."""
    from strandspark.plans import file_queries
    from strandspark.sources import readers

    rows = [("1", 100 * i, f"v{i}", "A", "C", f"I{n}", ("0|1", "1|0", "0/1")[(i + n) % 3]) for i in range(60) for n in range(5 * i, 5 * i + 8)]
    gt = spark.createDataFrame(rows, "contig string, pos long, id string, ref string, alt string, vcf_sample string, gt string")
    monkeypatch.setattr(file_queries, "PER_FILE", 4)
    entries = F.array_sort(F.collect_list(F.struct("place", F.col("gt").alias("cell")))).alias("m")
    pattern = file_queries._cohort_vcf(gt, entries, f"{tmp_path}/vcf")
    lines = spark.read.text(pattern).select("value", F.col("_metadata.file_path").alias("f")).collect()
    cells = sum(x["value"].count("\t") - 8 for x in lines if x["value"][0] != "#")
    assert len({x["f"] for x in lines}) == 15 and cells == 60 * 23  # 18,480 in one file of all sites
    for f in {x["f"] for x in lines}:
        own = [x["value"] for x in lines if x["f"] == f]
        assert own[0].startswith("##") and own[1].startswith("#CHROM") and len(own) == 6
    for phased in (False, True):
        got = sorted(map(tuple, readers.read_genotypes(spark, pattern, phased_only=phased).where("gt <> './.'").collect()))
        assert got == sorted(x for x in rows if not phased or "|" in x[-1])


def test_stretches_are_distinct_before_they_are_paired(spark):
    """Features and bans have the rows of their SQL, without a row for each supplier and stretch."""
    import duckdb

    from strandspark.plans.adapters import duck, view

    c, sf = duckdb.connect(), "/root/testdata/sf0.01"
    c.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{sf}/supplier.parquet')")
    for name in ("features", "bans"):
        df = view(spark, sf, name)
        want = c.execute(duck(name))
        assert [x[0] for x in want.description] == df.columns and sorted(map(tuple, df.collect())) == sorted(want.fetchall())
        assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_reads_meet_few_sites_where_these_are_dense(spark, tmp_path, monkeypatch):
    """Bins are narrow where sites are dense, with the same observations."""
    from strandspark.config import PhaseConfig
    from strandspark.operators import observe
    from strandspark.plans import programs

    far = spark.createDataFrame([("c", f"s{i}", 5000 * i) for i in range(40)], "contig string, variant_id string, pos long")
    assert observe.bin_width(far) == observe.intervals.BIN and observe.bin_width(far.limit(0)) == observe.intervals.BIN
    sites = spark.createDataFrame([("c", f"s{p}", p, 1, ["A", "C"]) for p in range(3, 8000, 20)], "contig string, variant_id string, pos long, ref_len int, alleles array<string>")
    lines = ["\t".join([f"r{i}", "99", "c", str(37 * i % 7900 + 1), "60", "300M", "=", "1", "9", "ACGTT" * 60, "I" * 300, "AS:i:9"]) for i in range(200)]
    (tmp_path / "a.sam").write_text("\n".join(lines) + "\n")
    config, widths, own = PhaseConfig(mapq="0", as_q_cutoff=0.0), [], observe.observe
    monkeypatch.setattr(observe, "observe", lambda *a, width=observe.intervals.BIN, **b: widths.append(width) or own(*a, width=width, **b))
    got = programs.observations(spark, [f"{tmp_path}/a.sam"], sites, config)
    assert widths and widths[0] <= 512
    monkeypatch.setattr(observe, "bin_width", lambda sites: observe.intervals.BIN, raising=False)
    want = programs.observations(spark, [f"{tmp_path}/a.sam"], sites, config)
    assert got.count() > 1000 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
