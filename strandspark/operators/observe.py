"""Reads to allele observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.functions.cigar import allele_at, reference_span, segments
from strandspark.operators import intervals
from strandspark.sources.bgzf import WINDOW_BITS, windows_of

DUPLICATE, PROPER_PAIR = 0x400, 2


def read_filter(flag: Column, mapq_col: Column, mapq: int, paired: bool, remove_dups: bool) -> Column:
    """Mapping quality, duplicate flag and proper pairs; secondary reads stay."""
    ok = mapq_col >= mapq
    if remove_dups:
        ok = ok & (flag.bitwiseAND(DUPLICATE) == 0)
    if paired:
        ok = ok & (flag.bitwiseAND(PROPER_PAIR) == PROPER_PAIR)
    return ok


def insert_filter(tlen: Column, isize: int) -> Column:
    return F.lit(True) if not isize else F.abs(tlen) <= isize


def occupied(sites: DataFrame) -> Column:
    """Condition on reads (rname, pos, cigar): the stretch from the first to the last aligned base
    touches a window of 16 KB that holds a site.

    The windows are one byte each in a constant (a genome has as many as its length allows,
    whatever the number of sites), so the test neither joins nor walks an alignment.
    Reads over more than two windows are kept without a look at those between.
    """
    flags, offsets = bytearray(), {}
    for contig, low, high in windows_of(sites):
        at = offsets.setdefault(contig, len(flags))
        flags.extend(bytes(at + low - len(flags)) + bytes([1]) * (high - low + 1))
    if not offsets:
        return F.lit(False)
    start = F.element_at(F.create_map(*[F.lit(x) for c, at in offsets.items() for x in (c, at)]), F.col("rname"))
    bounds = F.create_map(*[F.lit(x) for (c, at), end in zip(offsets.items(), [*list(offsets.values())[1:], len(flags)]) for x in (c, end - at)])
    bits = F.lit(bytes(flags))
    window = lambda pos: F.shiftright(F.greatest(pos - 1, F.lit(0)).cast("long"), WINDOW_BITS).cast("int")
    first, last = window(F.col("pos")), window(F.col("pos") + F.greatest(reference_span(F.col("cigar")), F.lit(1)) - 1)
    size = F.element_at(bounds, F.col("rname"))
    hit = lambda w: (w < size) & (F.substring(bits, start + w + 1, F.lit(1)) == F.lit(b"\x01"))
    return F.coalesce(start.isNotNull() & ((last - first > 1) | hit(first) | hit(last)), F.lit(False))


def observe(reads: DataFrame, variants: DataFrame, baseq: int = 10, rebase: bool = True, width: int = intervals.BIN, tasks: int | None = None) -> DataFrame:
    """Alleles of variants in reads: contig, read_id, bam, variant_id, pos, allele, as_score, cls.

    ``reads``: qname, rname, pos, cigar, seq, qual, as_score, bam; ``variants``: contig,
    variant_id, pos, ref_len, alleles. A variant is seen where an alignment segment
    contains all of its reference bases; the join is an equi-join on bins of the
    variant's first base. Reads away from all sites go before anything of them is walked.
    """
    near = reads.where(occupied(variants))
    seg = near.select("bam", F.col("qname").alias("read_id"), F.col("rname").alias("contig"), F.col("pos").alias("read_pos"), "as_score", F.explode(segments(F.col("cigar"), F.col("seq"), F.col("qual"), baseq, rebase)).alias("s"))
    seg = seg.select("bam", "read_id", "contig", "as_score", (F.col("read_pos") + F.col("s.off_start")).alias("seg_start"), F.col("s.pseudo").alias("pseudo"), F.col("s.ins").alias("ins"))
    seg = seg.withColumn("seg_end", F.col("seg_start") + F.length("pseudo"))
    sites = variants.select("contig", "variant_id", "pos", "ref_len", "alleles", (F.col("pos") + 1).alias("after"))
    pairs = intervals.overlaps(seg, sites, ["contig"], "seg_start", "seg_end", "pos", "after", width, F.col("pos") + F.col("ref_len") <= F.col("seg_end"), tasks)
    allele = allele_at(F.col("pseudo"), F.col("ins"), (F.col("pos") - F.col("seg_start")).cast("int"), F.col("ref_len").cast("int"))
    out = pairs.withColumn("allele", allele).where(F.col("allele").isNotNull())
    at = F.array_position("alleles", F.col("allele"))
    cls = F.when(at > 0, (at - 1).cast("int")).otherwise(2)
    return out.select("contig", "read_id", "bam", "variant_id", "pos", "allele", "as_score", cls.alias("cls"), *(["_bin"] if tasks else []))


#: Sites of a bin that a read is held against, and the narrowest bins made for that.
PER_BIN, NARROW = 8, 256


def bin_width(sites: DataFrame) -> int:
    """Width of bins that hold about ``PER_BIN`` sites where these are dense: a read is held against all
    sites of its bins, so with bins of one width work would grow with their density."""
    n = F.col("count").cast("double")
    met = sites.groupBy("contig", F.floor(F.col("pos") / intervals.BIN)).count().agg(F.sum(n * n) / F.sum(n)).first()[0] or 1
    return max(NARROW, min(intervals.BIN, int(intervals.BIN * PER_BIN / met)))


#: Reads of one task where alleles are counted.
READS_PER_TASK = 200_000


def allele_reads(reads: DataFrame, variants: DataFrame, width: int = intervals.BIN) -> DataFrame:
    """(contig, variant_id, pos, bam, allele, cls, seen, reads): observations and distinct reads of
    every allele of a variant in a file.

    All observations of a variant are in the task of its bin, so they are counted where they are
    made; what is shuffled are reads and sites, not observations.
    """
    fewest = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    obs = observe(reads.withColumn("as_score", F.lit(None).cast("int")), variants, width=width, tasks=max(fewest, reads.count() // READS_PER_TASK))
    allele = ["contig", "variant_id", "pos", "bam", "allele", "cls"]
    per_read = obs.groupBy("_bin", *allele, "read_id").agg(F.count(F.lit(1)).alias("n"))
    return per_read.groupBy("_bin", *allele).agg(F.sum("n").alias("seen"), F.count("read_id").alias("reads")).drop("_bin")
