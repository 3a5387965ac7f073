"""Command line of the five programs: ``python -m strandspark PROGRAM --help``."""

from __future__ import annotations

import argparse
from dataclasses import MISSING, fields

from strandspark.config import AnnotateConfig, CisConfig, GeneConfig, PhaseConfig

PROGRAMS = {
    "phase": (PhaseConfig, ("vcf", "bam", "o"), ("blacklist", "haplo_count_blacklist")),
    "gene_ae": (GeneConfig, ("haplotypic_counts", "features", "o"), ()),
    "matrix": (None, ("gene_ae_dir", "features", "o"), ()),
    "cis_var": (CisConfig, ("bed", "vcf", "pairs", "map", "o"), ()),
    "annotate": (AnnotateConfig, ("geno_vcf", "cadd_file", "o"), ("af_vcf",)),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="strandspark")
    sub = out.add_subparsers(dest="program", required=True)
    for name, (config, needed, optional) in PROGRAMS.items():
        p = sub.add_parser(name)
        for x in needed:
            p.add_argument(f"--{x}", required=True)
        for x in optional:
            p.add_argument(f"--{x}")
        p.add_argument("--threads", type=int, default=0, help="cores of a session on this machine; a cluster has its own")
        p.add_argument("--temp_dir", default="", help="folder for tables between steps, shared by driver and executors")
        for f in fields(config) if config else ():
            default = f.default if f.default is not MISSING else f.default_factory()
            if isinstance(default, bool):
                kind = lambda v: v.lower() in ("1", "true", "yes")
            elif isinstance(default, tuple):
                kind = lambda v: tuple(int(x) for x in v.split(",") if x)
            else:
                kind = type(default) if default is not None else str
            p.add_argument(f"--{'chr' if f.name == 'chrom' else f.name}", dest=f.name, type=kind, default=default)
    return out


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from strandspark.plans import programs
    from strandspark.sources import writers

    args = parser().parse_args(argv)
    session = SparkSession.builder
    if args.threads:
        session = session.config("spark.master", f"local[{args.threads}]")
    if args.temp_dir:
        session = session.config("spark.checkpoint.dir", args.temp_dir)
    spark = session.getOrCreate()
    kind = PROGRAMS[args.program][0]
    config = kind(**{f.name: getattr(args, f.name) for f in fields(kind)}) if kind else None
    if args.program == "phase":
        tables = programs.phase_reads(spark, args.vcf, args.bam.split(","), config, args.blacklist, args.haplo_count_blacklist)
        programs.write_phasing(spark, tables, args.vcf, args.o, config)
    elif args.program == "gene_ae":
        writers.write_tsv(programs.gene_program(spark, args.haplotypic_counts, args.features, config), args.o)
    elif args.program == "matrix":
        every, phased = programs.matrix_program(spark, args.gene_ae_dir, args.features)
        writers.write_matrix(every, f"{args.o}.bed")
        writers.write_matrix(phased, f"{args.o}.gw_phased.bed")
    elif args.program == "cis_var":
        writers.write_tsv(programs.cis_program(spark, args.bed, args.vcf, args.pairs, args.map, config), args.o, single=True)
    else:
        writers.write_tsv(programs.compound_program(spark, args.geno_vcf, args.cadd_file, config, args.af_vcf), args.o)


if __name__ == "__main__":
    main()
