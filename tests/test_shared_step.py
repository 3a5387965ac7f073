"""The step that all phasing queries share: reads dealt and blocks phased once, kernels by matrices."""

import random

import pytest
from pyspark.sql import functions as F

from strandspark.operators import compound, edges, haplotypes, phasing


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def observations(spark, seed):
    r = random.Random(seed)
    rows = [("c" if k % 2 else "d", k % 30, r.randrange(2), str(v), v, r.choice([0, 0, 1, 1, 2])) for k in range(60) for v in r.sample(range(9), r.choice([1, 1, 2, 4])) for _ in range(r.choice([1, 2]))]
    return spark.createDataFrame(rows, "contig string, read_id long, bam int, variant_id string, pos long, cls int")


def test_reads_are_sorted_by_a_number_and_kept_apart(spark, monkeypatch):
    """Reads are dealt and sorted by one long; reads that share it make no pair."""
    obs = observations(spark, 3)
    cells = edges.pair_cells(obs)
    assert "Window [count(1)" in plan(cells) and "hashpartitioning(_read" in plan(cells)
    want = sorted(map(tuple, cells.collect()))
    monkeypatch.setattr(edges.F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    assert sorted(map(tuple, edges.pair_cells(obs).collect())) == want and len(want) > 20


def test_blocks_are_phased_once(spark):
    e = [("c", str(10 + a), 10 + a, str(10 + b), 10 + b, x) for a, b, x in [(0, 1, 0), (1, 2, 1), (3, 4, 1)]]
    rows = spark.createDataFrame(e, "contig string, variant_a string, pos_a long, variant_b string, pos_b long, config int")
    out = phasing.phase(rows, phasing.blocks_of(rows))
    assert "MapInPandas" not in plan(out)
    assert sorted((r["variant_id"], r["hap_a"]) for r in out.collect()) == [("10", 0), ("11", 0), ("12", 1), ("13", 0), ("14", 1)]


def test_mates_are_merged_where_they_are_counted(spark):
    obs = observations(spark, 4)
    phased = spark.createDataFrame([(c, "0", str(v), v, v, v % 2) for c in "cd" for v in range(5)], "contig string, part string, variant_id string, pos long, idx int, hap_a int")
    reads = haplotypes.haplotype_reads(phased, obs)
    assert "Aggregate" not in plan(reads)
    want = {}
    for x in obs.collect():
        if x["cls"] < 2 and x["pos"] < 5:
            want.setdefault((x["contig"], "a" if x["cls"] == x["pos"] % 2 else "b"), set()).add(x["read_id"])
    got = {r["contig"]: (r["reads_hap_a"], r["reads_hap_b"]) for r in haplotypes.reads_per_haplotype(reads).collect()}
    assert got == {c: (len(want[c, "a"]), len(want[c, "b"])) for c in "cd"}


@pytest.mark.parametrize("codes", [4, 1 << 16])
def test_assignments_are_scored_by_a_product(monkeypatch, codes):
    monkeypatch.setattr(phasing, "CODES", codes)
    phasing._first_signs.cache_clear()
    monkeypatch.setattr(phasing, "support", None)  # edges are not gone through one by one
    r = random.Random(codes)
    for n in (2, 5, 9):
        for _ in range(20):
            e = [(*sorted(r.sample(range(n), 2)), r.choice([0, 1, 1, -1])) for _ in range(2 * n)]
            ways = [format(k, f"0{n}b") for k in range(1 << (n - 1))]
            got = [sum(c >= 0 and int(w[a]) ^ int(w[b]) == c for a, b, c in e) for w in ways]
            best = [w for w, s in zip(ways, got) if s == max(got)]
            assert phasing.exhaustive(n, e) == (best[0] if len(best) == 1 else "-" * n)
    phasing._first_signs.cache_clear()


def test_cuts_skip_levels_without_points():
    """Heavy blocks cross every point many times; cuts are those of the level by level search."""
    r = random.Random(5)
    for _ in range(200):
        n, most = r.randrange(2, 40), r.choice([2, 5, 15])
        e = [(*sorted(r.sample(range(n), 2)), 0) for _ in range(r.randrange(1, 5 * n))]
        count, chosen, level, longest = phasing.crossing(n, e), set(), 1, n
        while level == 1 or longest > most and level <= int(count.max(initial=0)):
            for p in range(2, n - 1):
                if count[p] == level and p - 1 not in chosen and p + 1 not in chosen:
                    chosen.add(p)
            cuts = [0, *sorted(chosen), n]
            longest = max(b - a for a, b in zip(cuts, cuts[1:]))
            level += 1
        assert phasing.split_points(n, e, most) == sorted(chosen)


def test_copies_of_a_variant_do_not_grow_with_its_gene(spark):
    """A gene of many buckets' size: a bounded number of copies on both sides, and still all pairs."""
    v = spark.range(400).select(F.lit("g").alias("gene"), F.col("id").cast("string").alias("variant"))
    left, right = compound._cells(v, 4)
    assert left.count() + right.count() <= 400 * (compound.MOST_BUCKETS + 1)
    assert compound._pairs(v, ["gene"], 4).count() == 400 * 399 // 2
