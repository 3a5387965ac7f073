"""Alignments as column expressions: reads to gap-free segments, and alleles out of segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENT = "struct<off_start:int,off_end:int,pseudo:string,ins:array<struct<at:int,bases:string>>>"


def reference_span(cigar: Column) -> Column:
    """Reference bases from a read's first to its last one."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0), lambda n, x: n + x.cast("int"))


def masked(seq: Column, qual: Column, baseq: int) -> Column:
    """The read's bases, N where the quality is under ``baseq``, as far as both texts go."""
    low = f"[!-\\x{32 + min(baseq, 94):02x}]" if baseq > 0 else ""
    each = F.zip_with(F.split(seq, ""), F.split(qual, ""), lambda b, q: F.when(F.ascii(q) - 33 >= baseq, b).otherwise("N"))
    sure = F.length(seq) == F.length(qual)
    if low:
        sure = sure & ~qual.rlike(low)
    n = F.least(F.length(seq), F.length(qual))
    return F.when(sure, seq).otherwise(F.substring(F.array_join(each, ""), F.lit(1), n))


def segments(cigar: Column, seq: Column, qual: Column, baseq: int, rebase: bool = True) -> Column:
    """Segments of a read between its skips, offsets relative to the read's position.

    Bases under ``baseq`` become N; a deletion is D per base; inserted bases are kept
    under the position that they follow, counted from the segment (``rebase``) or
    from the read.
    """
    parts = F.regexp_extract_all(cigar, F.lit(r"\d+[MIDNSHPX=]"), F.lit(0))
    ops = F.transform(parts, lambda p: F.struct(F.substring(p, F.lit(1), F.length(p) - 1).cast("int").alias("n"), F.right(p, F.lit(1)).alias("op")))
    none = F.array().cast("array<struct<at:int,bases:string>>")
    bases = masked(seq, qual, baseq)
    start = F.struct(F.array().cast(f"array<{SEGMENT}>").alias("done"), F.lit(0).alias("start"), F.lit("").alias("pseudo"), none.alias("ins"), F.lit(0).alias("genome"), F.lit(0).alias("read"), bases.alias("bases"))

    def closed(s: Column) -> Column:
        return F.concat(s["done"], F.array(F.struct(s["start"].alias("off_start"), s["genome"].alias("off_end"), s["pseudo"].alias("pseudo"), s["ins"].alias("ins"))))

    def step(s: Column, o: Column) -> Column:
        n, op = o["n"], o["op"]
        own = F.substring(s["bases"], s["read"] + 1, n)
        key = s["genome"] - 1 - s["start"] if rebase else s["genome"] - 1
        state = lambda **new: F.struct(*[new.get(c, s[c]).alias(c) for c in ("done", "start", "pseudo", "ins", "genome", "read", "bases")])
        return (
            F.when(op.isin("M", "=", "X"), state(pseudo=F.concat(s["pseudo"], own), genome=s["genome"] + n, read=s["read"] + n))
            .when(op == "I", state(ins=F.concat(s["ins"], F.array(F.struct(key.alias("at"), own.alias("bases")))), read=s["read"] + n))
            .when(op == "D", state(pseudo=F.concat(s["pseudo"], F.repeat(F.lit("D"), n)), genome=s["genome"] + n))
            .when(op == "N", state(done=closed(s), start=s["genome"] + n, pseudo=F.lit(""), ins=none, genome=s["genome"] + n))
            .when(op == "S", state(read=s["read"] + n))
            .otherwise(s)
        )

    whole = F.aggregate(ops, start, step, closed)
    return F.when(seq.isNotNull() & qual.isNotNull() & cigar.isNotNull(), whole)


def allele_at(pseudo: Column, ins: Column, first: Column, length: Column) -> Column:
    """Allele of ``length`` reference bases from index ``first`` (0-based) of a segment:
    insertions spliced in, deletions taken out; null where nothing or a lone N is left."""
    inserted = lambda i: F.coalesce(F.try_element_at(F.filter(ins, lambda x: x["at"] == i), F.lit(-1))["bases"], F.lit(""))
    spliced = F.array_join(F.transform(F.sequence(first, first + length - 1), lambda i: F.concat(F.substring(pseudo, i + 1, F.lit(1)), inserted(i))), "")
    bases = F.when(F.size(ins) == 0, F.substring(pseudo, first + 1, length)).otherwise(spliced)
    inside = (first >= 0) & (length > 0) & (first + length <= F.length(pseudo))
    allele = F.replace(bases, F.lit("D"), F.lit(""))
    return F.when(inside, F.when(~allele.isin("", "N"), allele))
