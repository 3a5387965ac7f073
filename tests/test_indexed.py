"""Block-gzipped text and alignments: split into tasks, and read by index."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from strandspark.config import AnnotateConfig
from strandspark.plans import programs
from strandspark.sources import bam, bgzf, readers
from tests.indexes import Blocks, block, index_body, write_indexed
from tests.test_bam import encode


def table(seed=1, n=3000, contigs=("1", "2", "X")):
    r = random.Random(seed)
    lines = ["##a", "#c\tp"]
    for c in contigs:
        for p in sorted(r.randint(1, 40_000_000) for _ in range(n)):
            lines.append(f"{c}\t{p}\t" + "".join(r.choices("ACGTé", k=r.randint(0, 30))))
    return "\n".join(lines) + "\n"


def tasks(df):
    return df.rdd.getNumPartitions()


@pytest.mark.parametrize("size", [97, 2000, 60_000])
@pytest.mark.parametrize("text", ["", "one", "a\nb\n", "\n\n\nx\n", table(n=300), "long" * 20_000 + "\nx\n" + "y" * 5000, "a\r\nb\r\n" * 900])
def test_lines_are_those_of_the_text(spark, tmp_path, text, size):
    path = f"{tmp_path}/x.gz"
    with open(path, "wb") as f:
        f.write(Blocks(text.encode(), size).file)
    whole = text.replace("\r\n", "\n").split("\n")
    want = sorted(whole[:-1] if whole[-1] == "" else whole)
    for split in (150, 900, 1 << 20):
        reader = bgzf.LinesReader({"path": path, "split": str(split)})
        got = [x.decode() for p in reader.partitions() for lines in p.batches() for x in lines]
        assert sorted(got) == want


def test_whole_file_in_several_tasks(spark, tmp_path):
    text = table()
    write_indexed(f"{tmp_path}/t.gz", text, 900)
    df = bgzf.read_lines(spark, f"{tmp_path}/t.gz", split=8000)
    assert tasks(df) >= 10
    assert [r["value"] for r in df.collect()] == text.splitlines()
    plain = tmp_path / "t.txt"
    plain.write_text(text)
    assert bgzf.read_lines(spark, str(plain)).count() == len(text.splitlines())


def test_sites_thin_what_is_read(spark, tmp_path):
    text = table(n=4000)
    path = f"{tmp_path}/t.gz"
    write_indexed(path, text, 900)
    r = random.Random(5)
    rows = [x.split("\t") for x in text.splitlines() if x[0] != "#"]
    picked = [(c, int(p)) for c, p, _ in r.sample(rows, 12)] + [("2", 39_999_999), ("nowhere", 5), ("1", 1)]
    regions = bgzf.windows_of(spark.createDataFrame(picked, "contig string, pos long"))
    df = bgzf.read_lines(spark, path, regions, split=3000)
    got = [x["value"] for x in df.collect()]
    assert len(got) == len(set(got)) < 0.05 * len(rows)
    near = {(c, p - 1 >> 14) for c, p in picked}
    assert {x for x in text.splitlines() if x[0] != "#" and (x.split("\t")[0], int(x.split("\t")[1]) - 1 >> 14) in near} <= set(got)
    ranges = bgzf.Index.read(f"{path}.tbi").ranges(regions)
    touched = {at for a, b in ranges for at in range(a >> 16, (b >> 16) + 1)}
    file = bgzf.File(path)
    starts, at = [], 0
    while at < file.size:
        starts.append(at)
        at = file.block(at)[1]
    assert len(touched & set(starts)) < 0.1 * len(starts)
    everything = bgzf.read_lines(spark, path, bgzf.whole_contigs("1,2,X"), split=3000)
    assert tasks(everything) > 20 and sorted(x["value"] for x in everything.collect()) == sorted(x for x in text.splitlines() if x[0] != "#")
    assert bgzf.read_lines(spark, path, []).count() == 0


def test_plain_gzip_and_comments(spark, tmp_path):
    import gzip

    with gzip.open(f"{tmp_path}/a.gz", "wt") as f:
        f.write("##h\n#CHROM\tx\n1\t2\n")
    assert not bgzf.is_blocked(f"{tmp_path}/a.gz") and readers.vcf_comments(spark, f"{tmp_path}/a.gz") == ["##h"]
    write_indexed(f"{tmp_path}/b.gz", "##h\n#CHROM\tx\n1\t2\t##no\n", 7)
    assert readers.vcf_comments(spark, f"{tmp_path}/b.gz") == ["##h"] and readers.vcf_header(spark, f"{tmp_path}/b.gz") == ["#CHROM", "x"]


def test_compound_program_by_index(spark, tmp_path):
    """The same pairs from indexed files as from plain ones."""
    r = random.Random(3)
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n"
    sites = sorted((c, r.randint(1, 3_000_000)) for c in "12" for _ in range(30))
    vcf = head + "".join(f"{c}\t{p}\trs{p}\tA\tC\t.\tPASS\tAF=0.1\tGT:PG:PI\t{r.choice(['0|1', '1|0', '1|1'])}:{r.choice(['0|1', '1|0'])}:{r.randint(1, 3)}\n" for c, p in sites)
    spots = sorted(set(sites) | {(c, r.randint(1, 3_000_000)) for c in "12" for _ in range(4000)})
    cadd = "#h\n" + "".join("\t".join([c, str(p), "A", "SNV", "C", *["."] * 5, "missense", *["."] * 81, f"g{p % 3}", ".", ".", f"n{p % 3}", str(p % 40)]) + "\n" for c, p in spots)
    freq = head + "".join(f"{c}\t{p}\t.\tA\tG,C\t.\tPASS\tAF=0.5,0.{p % 9 + 1}\tGT\t0|1\n" for c, p in spots)
    for name, text in (("v.vcf", vcf), ("c.tsv", cadd), ("f.vcf", freq)):
        (tmp_path / name).write_text(text)
        write_indexed(f"{tmp_path}/{name}.gz", text, 3000)
    run = lambda end: sorted(map(tuple, programs.compound_program(spark, f"{tmp_path}/v.vcf{end}", f"{tmp_path}/c.tsv{end}", AnnotateConfig(sample="S"), f"{tmp_path}/f.vcf{end}").collect()), key=str)
    assert run("") == run(".gz") != []
    regions = readers.regions_for(f"{tmp_path}/c.tsv.gz", readers.read_vcf(spark, f"{tmp_path}/v.vcf", "S"))
    assert readers.read_cadd(spark, f"{tmp_path}/c.tsv.gz", regions).count() < len(spots) / 2


# --- alignments --------------------------------------------------------------------


def alignments(seed, n=4000, names=("1", "2", "3")):
    r = random.Random(seed)
    rows = sorted((r.randrange(len(names)), r.randint(1, 5_000_000)) for _ in range(n))
    out = []
    for i, (c, p) in enumerate(rows):
        k = r.randint(1, 60)
        out.append(f"read{i}\t99\t{names[c]}\t{p}\t{r.randint(0, 255)}\t{k}M100N2M\t=\t5\t0\t{''.join(r.choices('ACGTN', k=k + 2))}\t{''.join(chr(33 + r.randint(0, 60)) for _ in range(k + 2))}\tAS:i:{i}")
    return out + [f"lost{i}\t4\t*\t0\t0\t*\t*\t0\t0\tACG\tIII" for i in range(50)]


def write_bam(path, lines, names=("1", "2", "3"), size=3000, indexed=True):
    raw = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", len(names))
    for n in names:
        raw += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 6_000_000)
    spans = []
    for x in lines:
        one = encode(x, list(names))
        spans.append((x.split("\t"), len(raw), len(raw) + len(one)))
        raw += one
    made = Blocks(raw, size)
    with open(path, "wb") as f:
        f.write(made.file)
    if indexed:
        records = [(names.index(c[2]), int(c[3]) - 1, int(c[3]) - 1 + len(c[9]) + 100, made.place(a), made.place(b)) for c, a, b in spans if c[2] in names]
        with open(f"{path}.bai", "wb") as f:
            f.write(b"BAI\1" + struct.pack("<i", len(names)) + index_body(records, len(names)))


@pytest.mark.parametrize("size", [700, 3000, 65_000])
@pytest.mark.parametrize("indexed", [True, False])
def test_no_read_is_lost_or_doubled_at_a_cut(spark, tmp_path, size, indexed):
    lines = alignments(2)
    path = f"{tmp_path}/x.bam"
    write_bam(path, lines, size=size, indexed=indexed)
    for split in (2000, 20_000):
        df = bam.read_bam(spark, [path, path], split=split)
        assert tasks(df) >= 4
        got = df.groupBy("qname", "bam").count().collect()
        assert len(got) == 2 * len(lines) and all(r["count"] == 1 for r in got)


def test_regions_and_filters_reach_the_index(spark, tmp_path):
    lines = alignments(3)
    path = f"{tmp_path}/x.bam"
    write_bam(path, lines)
    rows = [x.split("\t") for x in lines]
    reader = lambda **o: bam.BamReader({"paths": path, "split": "5000", **o})
    size = lambda parts: sum((b >> 16) - (a >> 16) + 1 for p in parts for a, b in p.ranges)
    whole = size(reader().partitions())
    picked = bam.read_bam(spark, [path]).where("rname = '2' and pos >= 1000000 and pos < 1200000")
    assert sorted(r["qname"] for r in picked.collect()) == sorted(c[0] for c in rows if c[2] == "2" and 1_000_000 <= int(c[3]) < 1_200_000)
    own = reader()
    left = own.pushFilters([bam.EqualTo(("rname",), "2"), bam.GreaterThanOrEqual(("pos",), 1_000_000), bam.LessThan(("pos",), 1_200_000)])
    assert len(list(left)) == 3 and 0 < size(own.partitions()) < 0.1 * whole
    sites = spark.createDataFrame([("1", 2_000_000), ("3", 100_000), ("9", 5)], "contig string, pos long")
    regions = bgzf.windows_of(sites)
    assert 0 < size(reader(regions=bgzf.encoded(regions)).partitions()) < 0.1 * whole
    got = {r["qname"] for r in bam.read_bam(spark, [path], regions=regions).collect()}
    assert {c[0] for c in rows if (c[2], (int(c[3]) - 1) >> 14) in {("1", 1_999_999 >> 14), ("3", 99_999 >> 14)}} <= got < {c[0] for c in rows}
    assert bam.read_bam(spark, [path], chrom="1,3").count() == sum(c[2] in ("1", "3") for c in rows)
    assert bam.read_bam(spark, [path], chrom="nowhere").count() == 0


def test_empty_alignments(spark, tmp_path):
    for indexed in (True, False):
        path = f"{tmp_path}/{indexed}.bam"
        write_bam(path, [], indexed=indexed)
        assert bam.read_bam(spark, [path]).count() == 0


def test_first_block_skips_lookalikes():
    """The magic bytes inside a block's data are not taken for a block."""
    import os
    import tempfile

    raw = (bgzf.MAGIC + b"\0" * 5 + b"\xff\6\0BC\2\0\x20\0") * 400 + os.urandom(3000)
    stored = b"".join(block(raw[k : k + 500]) for k in range(0, len(raw), 500)) + block(b"")
    with tempfile.NamedTemporaryFile(suffix=".gz") as f:
        f.write(stored)
        f.flush()
        file, starts, at = bgzf.File(f.name), [], 0
        while at < file.size:
            starts.append(at)
            at = file.block(at)[1]
        for at in range(1, file.size, 37):
            assert file.first_block(at) == min([s for s in starts if s >= at], default=file.size)


def test_two_thousand_files_are_one_scan(spark, tmp_path):
    line = "r{0}\t99\t1\t{0}\t60\t4M\t=\t5\t0\tACGT\tIIII\tAS:i:{0}\n"
    paths = []
    for i in range(2000):
        paths.append(f"{tmp_path}/f{i}.sam")
        with open(paths[-1], "w") as f:
            f.write("@SQ\tSN:1\tLN:99\n" + line.format(i))
    df = readers.read_sam(spark, [*paths, paths[7]])
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    got = df.where(F.col("pos") != 7).select("pos", "bam").collect()
    assert len(got) == 1999 and all(r["pos"] == r["bam"] for r in got)
    assert sorted(r["bam"] for r in df.where(F.col("pos") == 7).collect()) == [7, 2000]


def test_gene_files_with_headers_of_their_own(spark, tmp_path):
    names = [x.split()[0] for x in readers.GENES.split(", ")]
    rows = {n: str(i) for i, n in enumerate(names)}
    for k in range(30):
        order = names if k % 2 else names[::-1]
        (tmp_path / f"g {k}.txt").write_text("\t".join(order) + "\n" + "".join("\t".join({**rows, "bam": f"s{k}"}[n] for n in order) + "\n" for _ in range(2)))
    (tmp_path / "other.txt").write_text("a\tb\n1\t2\n")
    got = readers.read_gene_folder(spark, str(tmp_path)).collect()
    assert len(got) == 60 and {r["bam"] for r in got} == {f"s{k}" for k in range(30)}
    assert {(r["contig"], r["start"], r["gw_phased"]) for r in got} == {("0", 1, 10)}
    assert readers.read_gene_folder(spark, f"{tmp_path}/none").collect() == []


def test_pairs_of_several_splits(spark, tmp_path):
    path = f"{tmp_path}/pairs.txt"
    with open(path, "w") as f:
        f.write("\t".join(x.split()[0] for x in readers.PAIRS.split(", ")) + "\n")
        for i in range(20_000):
            f.write(f"g{i}\tv{i}\t1\t{i}\tA\tC\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = readers.read_pairs(spark, path)
        assert tasks(df) > 3
        got = sorted((r["xindex"], r["var_pos"]) for r in df.collect())
        assert [p for _, p in got] == list(range(20_000)) and len({x for x, _ in got}) == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
