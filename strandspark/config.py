"""Parameters of the five programs."""

from __future__ import annotations

from dataclasses import dataclass, field


def per_bam(value, n: int, name: str) -> list[int]:
    """One value per aligned-read file: a single one (or CSV of one) serves all."""
    parts = [int(x) for x in str(value).split(",")] if not isinstance(value, (list, tuple)) else [int(x) for x in value]
    if len(parts) == 1:
        return parts * n
    if len(parts) != n:
        raise ValueError(f"{name}: {len(parts)} values for {n} files")
    return parts


@dataclass(frozen=True)
class PhaseConfig:
    sample: str = ""
    mapq: str = "255"
    baseq: int = 10
    paired_end: str = "1"
    isize: str = "0"
    as_q_cutoff: float = 0.05
    cc_threshold: float = 0.01
    include_indels: bool = False
    remove_dups: bool = True
    pass_only: bool = True
    unphased_vars: bool = True
    chr_prefix: str = ""
    chrom: str | None = None
    unique_ids: bool = False
    id_separator: str = "_"
    gw_phase_method: int = 0
    gw_af_field: str = "AF"
    gw_phase_vcf: int = 0
    gw_phase_vcf_min_confidence: float = 0.90
    max_block_size: int = 15
    output_read_ids: bool = False
    output_network: str | None = None
    haplo_count_bam_exclude: tuple[int, ...] = field(default_factory=tuple)
    #: Write the annotated variant file.
    write_vcf: bool = True
    #: Each contig by itself: noise rate and score cutoff are the contig's own.
    process_slow: bool = False
    #: 'global' or 'contig': rows over which the noise rate and the score cutoff are taken.
    noise_scope: str = "global"
    #: Bug-compatible block merging and insertion lookup.
    compat: bool = False

    @property
    def by_contig(self) -> bool:
        return self.process_slow or self.noise_scope == "contig"


@dataclass(frozen=True)
class GeneConfig:
    id_separator: str = "_"
    gw_cutoff: float = 0.9
    min_cov: int = 0
    min_haplo_maf: float = 0.0

    def __post_init__(self):
        if not 0 <= self.min_haplo_maf <= 0.5:
            raise ValueError("min_haplo_maf must be from 0 to 0.5")


@dataclass(frozen=True)
class CisConfig:
    pc: float = 1.0
    min_cov: int = 8
    chrom: str | None = None
    bs: int = 10_000
    ignore_v: bool = False
    seed: int = 1


@dataclass(frozen=True)
class AnnotateConfig:
    sample: str = ""
    af_field: str = "AF"
    id_separator: str = "_"
