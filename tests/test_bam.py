import random
import struct

from strandspark.__main__ import main, parser
from strandspark.sources import bam, readers
from tests.indexes import block


def encode(line: str, names: list[str]) -> bytes:
    c = line.split("\t")
    ops = [(int(n) << 4) | bam.OPERATIONS.index(o) for n, o in __import__("re").findall(r"(\d+)([MIDNSHPX=])", c[5])]
    seq = [bam.BASES.index(x) for x in c[9]]
    packed = bytes((seq[i] << 4) | (seq[i + 1] if i + 1 < len(seq) else 0) for i in range(0, len(seq), 2))
    tags = b""
    for t in c[11:]:
        name, kind, v = t.split(":", 2)
        tags += name.encode() + (b"i" + struct.pack("<i", int(v)) if kind == "i" else b"Z" + v.encode() + b"\0")
    tags = b"XBBs" + struct.pack("<i", 2) + struct.pack("<hh", 1, 2) + b"XAAq" + tags
    body = struct.pack("<iiBBHHHiiii", names.index(c[2]) if c[2] in names else -1, int(c[3]) - 1, len(c[0]) + 1, int(c[4]), 0, len(ops), int(c[1]), len(seq), -1, -1, int(c[8]))
    body += c[0].encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + bytes(ord(q) - 33 for q in c[10]) + tags
    return struct.pack("<i", len(body)) + body


def to_bam(sam: str, names: list[str]) -> bytes:
    text = b"@HD\n"
    raw = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(names))
    for n in names:
        raw += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 9999)
    raw += b"".join(encode(x, names) for x in sam.splitlines() if x[0] != "@")
    return b"".join(block(raw[k : k + 3000]) for k in range(0, len(raw), 3000)) + block(b"")


def test_same_reads_as_text(spark, tmp_path):
    r = random.Random(2)
    lines = ["@SQ\tSN:1\tLN:9999"]
    for i in range(6000):
        n = r.randint(1, 80)
        tags = "\tRG:Z:x y\tAS:i:%d" % r.randint(-5, 300) if i % 7 else "\tNM:i:2"
        lines.append(f"read{i}\t{r.choice([99, 1123])}\t{r.choice(['1', 'chr2'])}\t{r.randint(1, 900)}\t{r.randint(0, 255)}\t{n}M3N2S\t=\t5\t-{r.randint(0, 500)}\t{''.join(r.choices('ACGTN', k=n + 2))}\t{''.join(chr(33 + r.randint(0, 60)) for _ in range(n + 2))}{tags}")
    (tmp_path / "x.sam").write_text("\n".join(lines) + "\n")
    (tmp_path / "x.bam").write_bytes(to_bam("\n".join(lines), ["1", "chr2"]))
    text, binary = readers.read_sam(spark, [f"{tmp_path}/x.sam"]), bam.read_bam(spark, [f"{tmp_path}/x.bam"])
    assert sorted(map(tuple, binary.select(*text.columns).collect()), key=str) == sorted(map(tuple, text.collect()), key=str)
    assert bam.read_bam(spark, [f"{tmp_path}/x.bam"], chrom="1").count() == text.where("rname = '1'").count()


def test_command_line(spark, tmp_path):
    from tests.test_programs import simulate

    simulate(tmp_path)
    (tmp_path / "a.bam").write_bytes(to_bam((tmp_path / "a.sam").read_text(), ["1", "2"]))
    main(["phase", "--vcf", f"{tmp_path}/in.vcf", "--bam", f"{tmp_path}/a.bam", "--sample", "S1", "--o", f"{tmp_path}/out"])
    got = readers.read_counts(spark, f"{tmp_path}/out.haplotypic_counts.txt")
    assert got.where("variantCount = 12").count() == 2 and {r["bam"] for r in got.collect()} == {"a"}
    main(["gene_ae", "--haplotypic_counts", f"{tmp_path}/out.haplotypic_counts.txt", "--features", f"{tmp_path}/features.bed", "--o", f"{tmp_path}/genes.txt"])
    assert readers.read_table(spark, f"{tmp_path}/genes.txt", readers.GENES).count() == 4
    args = parser().parse_args(["cis_var", "--bed", "b", "--vcf", "v", "--pairs", "p", "--map", "m", "--o", "o", "--chr", "1", "--ignore_v", "1"])
    assert args.chrom == "1" and args.ignore_v is True and args.bs == 10_000
