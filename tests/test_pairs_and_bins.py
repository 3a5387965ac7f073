"""Pairs of large genes in cells, and intervals of any length in nested bins, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from strandspark.operators import compound, intervals


def items(a, b, together=True):
    return [(x, y, "cis" if i == j else "trans") for i, x in enumerate(a) for j, y in enumerate(b) if together and x and y]


def brute_pairs(gw, pg):
    out = []
    names = sorted({k for k in gw} | {k for k in pg})
    for gene, a in names:
        for other, b in names:
            if gene != other or a == b or gene == "NA":
                continue
            ka, kb = (gene, a), (gene, b)
            rb = items(pg[ka][0], pg[kb][0], pg[ka][1] == pg[kb][1]) if ka in pg and kb in pg else []
            if ka in gw and kb in gw:
                g = items(gw[ka], gw[kb])
                mark = "0" if not rb or len(g) != len(rb) else "1" if g == rb else "-1"
                out += [(gene, a, b, *x, mark) for x in g]
                out += [(gene, a, b, *x, "1") for x in rb] if mark == "-1" else []
            else:
                out += [(gene, a, b, *x, "1") for x in rb]
    return sorted(out)


@pytest.mark.parametrize("per_cell", [3, 1000])
def test_gene_pairs(spark, per_cell):
    r = random.Random(6)
    allele = lambda: [r.choice([0, 0, 1, 1, 2]), r.choice([0, 1, 1, 2])]
    gw, pg = {}, {}
    for gene, n in (("hot", 40), ("g", 7), ("one", 1), ("NA", 5)):
        for v in range(n):
            if r.random() < 0.85:
                gw[(gene, f"v{v}")] = allele()
            if r.random() < 0.7:
                own = gw.get((gene, f"v{v}"), allele())
                pg[(gene, f"v{v}")] = (r.choice([own, own[::-1], allele()]), r.randint(1, 4))
    g = spark.createDataFrame([(*k, a) for k, a in gw.items()], "gene string, variant_id string, alleles array<int>")
    p = spark.createDataFrame([(*k, a, b) for k, (a, b) in pg.items()], "gene string, variant_id string, alleles array<int>, block int")
    got = compound.gene_pairs(g, p, per_cell=per_cell)
    want = brute_pairs(gw, pg)
    cols = ["gene", "variant_a", "variant_b", "allele_a", "allele_b", "configuration", "read_backed"]
    assert sorted(map(tuple, got.select(*cols).collect())) == want
    effects = spark.createDataFrame([(gene, f"v{v}", a, f"n{gene}", f"rs{v}", float(a), f"e{v}", v / 100) for gene, n in (("hot", 40), ("g", 7)) for v in range(n) for a in (1, 2) if (v + a) % 5], "gene string, variant_id string, allele int, name string, rsid string, phred double, effect string, af double")
    out = sorted((x["ensg"], x["variant_a"], x["variant_b"], x["allele_a"], x["allele_b"], x["configuration"], x["read_backed"]) for x in compound.annotate(g, p, effects, per_cell).collect())
    has = lambda v, a: (int(v[1:]) + a) % 5 > 0
    assert out == [x for x in want if x[0] in ("hot", "g") and has(x[1], x[3]) and has(x[2], x[4])]
    one = compound.annotate(g, p, effects, per_cell).first()
    assert one["rsid_b"] == "rs" + one["variant_b"][1:] and one["cadd_phred_a"] == one["allele_a"] and one["af_b"] == int(one["variant_b"][1:]) / 100 and one["name"] == "n" + one["ensg"]


def test_no_task_pairs_a_whole_gene(spark):
    v = spark.range(3000).select(F.lit("g").alias("gene"), F.col("id").cast("string").alias("variant"))
    left, right = compound._cells(v, 500)
    cells = left.groupBy("_row", "_column").count().collect()
    assert len(cells) == 21 and max(r["count"] for r in cells) < 650 and right.count() + left.count() == 3000 * 7


def spans(r, n, longest):
    out = []
    for i in range(n):
        a = r.randint(0, 100_000)
        out.append((r.choice("xy"), i, a, a + r.choice([0, 1, 1, r.randint(1, 60), r.randint(1, longest)])))
    return out


def test_nested_overlaps(spark):
    r = random.Random(3)
    left, right = spans(r, 150, 90_000), spans(r, 150, 90_000) + [("x", 999, 0, 10_000_000_000), ("y", 998, 5, 5)]
    a = spark.createDataFrame(left, "c string, i int, s long, e long")
    b = spark.createDataFrame(right, "c string, j int, s2 long, e2 long")
    want = sorted((i, j) for c, i, s, e in left for d, j, s2, e2 in right if c == d and s < e2 and s2 < e and s < e and s2 < e2)
    for width in (10, 10_000):
        got = intervals.nested_overlaps(a, b, ["c"], "s", "e", "s2", "e2", width)
        assert sorted((x["i"], x["j"]) for x in got.collect()) == want
        back = intervals.nested_overlaps(b, a, ["c"], "s2", "e2", "s", "e", width)
        assert sorted((x["i"], x["j"]) for x in back.collect()) == want
    lengths = a.withColumn("_level", intervals._level("s", "e", 10)).where("e > s")
    rows = intervals._in_bins(lengths.withColumn("_at", F.col("_level")), "s", "e", 10).groupBy("i").count()
    assert rows.agg(F.max("count")).first()[0] <= 2


def test_point_sums(spark):
    r = random.Random(9)
    own = spans(r, 200, 100_000) + [("x", 500, 0, 1 << 40), ("z", 501, 0, 100)]
    points = [(r.choice("xy"), r.randint(0, 120_000), r.randint(1, 9)) for _ in range(3000)]
    a = spark.createDataFrame(own, "c string, i int, s long, e long")
    p = spark.createDataFrame(points, "c string, at long, v int")
    want = {}
    for c, i, s, e in own:
        inside = [v for d, at, v in points if c == d and s <= at < e]
        if inside:
            want[i] = (len(inside), sum(inside))
    for width in (1, 7, 64, 5000):
        got = intervals.point_sums(a, p, ["c", "i"], ["c"], "s", "e", "at", {"n": F.lit(1), "total": F.col("v")}, width)
        assert {x["i"]: (x["n"], x["total"]) for x in got.collect()} == want
