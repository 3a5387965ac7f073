"""Column expressions over genotype fields, identifiers and allele lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def info_map(info: Column) -> Column:
    """``k=v;flag;...`` as a map: items with ``=`` only, the piece after the first ``=``,
    the last of equal keys."""
    items = F.filter(F.split(info, ";"), lambda x: F.contains(x, F.lit("=")))
    key = lambda x: F.split(x, "=")[0]
    # The last item of a key wins: earlier ones are those that a later item repeats.
    last = F.filter(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), F.split(x, "=")[1].alias("v"), i.alias("i"))), lambda s: s["i"] == F.array_max(F.transform(F.filter(F.transform(items, lambda y, j: F.struct(key(y).alias("k"), j.alias("j"))), lambda t: t["k"] == s["k"]), lambda t: t["j"])))
    return F.map_from_entries(F.transform(last, lambda s: F.struct(s["k"], s["v"])))


def info_map_strict(info: Column) -> Column:
    """As :func:`info_map`, of items with exactly one ``=``."""
    parts = F.array_join(F.filter(F.split(info, ";"), lambda x: F.size(F.split(x, "=")) == 2), ";")
    return info_map(parts)


def sample_field(fmt: Column, sample: Column, key: str) -> Column:
    """Value of ``key`` in a FORMAT/sample pair; null where there is none."""
    at = F.array_position(F.split(fmt, ":"), key)
    return F.when(at > 0, F.get(F.split(sample, ":"), at.cast("int") - 1))


def unique_id(contig: Column, pos: Column, ref: Column, alt: Column, separator: str = "_") -> Column:
    """contig, position, reference and every alternative, joined."""
    return F.concat_ws(separator, contig, pos.cast("string"), ref, F.replace(alt, F.lit(","), F.lit(separator)))


def rsid_or_id(rsid: Column, uid: Column) -> Column:
    return F.when(rsid.isNull() | rsid.isin("", "."), uid).otherwise(rsid)


def genotype_digits(gt: Column) -> Column:
    """Characters of a genotype without one ``|`` and one ``/``."""
    plain = F.regexp_replace(F.regexp_replace(gt, r"^([^|]*)[|]", "$1"), r"^([^/]*)/", "$1")
    return F.filter(F.split(plain, ""), lambda c: c != "")


def is_het(gt: Column) -> Column:
    """No missing allele, and more than one distinct character."""
    return F.coalesce(~F.contains(gt, F.lit(".")) & (F.size(F.array_distinct(genotype_digits(gt))) > 1), F.lit(False))


def passes(filters: Column) -> Column:
    return F.array_contains(F.split(filters, ";"), "PASS")


def alleles(ref: Column, alt: Column) -> Column:
    return F.concat(F.array(ref), F.split(alt, ","))


def is_indel(ref: Column, alt: Column) -> Column:
    return F.array_max(F.transform(alleles(ref, alt), F.length)) > 1


def carried(ref: Column, alt: Column, gt: Column) -> Column:
    """The individual's alleles in allele index order."""
    return F.filter(F.transform(alleles(ref, alt), lambda a, i: F.when(F.array_contains(genotype_digits(gt), i.cast("string")), a)), lambda a: a.isNotNull())


def prior_phase(ref: Column, alt: Column, gt: Column) -> Column:
    """[allele on haplotype 0, allele on haplotype 1] of a phased genotype, else null."""
    parts = F.split(gt, "[|]")
    of = lambda i: F.get(alleles(ref, alt), parts[i].cast("int"))
    return F.when(F.contains(gt, F.lit("|")), F.array(of(0), of(1)))


def allele_phase(allele: Column, phase: Column) -> Column:
    """Haplotype of an allele in a prior phase; null where unknown."""
    at = F.array_position(phase, allele)
    return F.when(at > 0, (at - 1).cast("int"))


def folded_af(af: Column, gt: Column) -> Column:
    """Smallest min(af, 1 - af) over the carried alternatives of a CSV of frequencies."""
    freq = F.transform(F.split(af, ","), lambda x, i: F.when(F.array_contains(genotype_digits(gt), (i + 1).cast("string")), F.least(F.expr("1d") * x.cast("double"), F.lit(1.0) - x.cast("double"))))
    return F.coalesce(F.array_min(F.filter(freq, lambda x: x.isNotNull())), F.lit(0.0))


def complement(config: Column) -> Column:
    return F.translate(config, "01", "10")


def strip_version(gene: Column) -> Column:
    return F.substring_index(gene, ".", 1)


def safe_rsid(rsid: Column) -> Column:
    return F.replace(rsid, F.lit(":"), F.lit("_"))


def cis_or_trans(ref_a: Column, ref_b: Column) -> Column:
    """``ref_a``: haplotype A has the reference allele at the first variant; ``ref_b``:
    haplotype B has it at the second. Equal is trans."""
    return F.when(ref_a == ref_b, "trans").otherwise("cis")
