"""Aligned reads of BAM files, as a Spark data source.

A file is read by several tasks, each from one virtual offset to another. With an
index (``.bai``) they are cut at places where it says that records begin; without one
each task finds the first record of its stretch of bytes, as a chain of records whose
fields agree with each other and with the header. A record belongs to the task in whose
range it begins, so none is lost or doubled at a cut.

Contigs and positions that are asked for (as arguments, or by filters on ``rname`` and
``pos`` that Spark hands down) thin what is read of an indexed file; the filters
stay in the plan. Files are opened through Arrow's file systems.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from strandspark.sources.bgzf import EVERYWHERE, SPLIT, WINDOW_BITS, File, Index, Regions, Stream, decoded, encoded, exists, grouped

SCHEMA = "qname string, flag int, rname string, pos long, mapq int, cigar string, tlen int, seq string, qual string, as_score int, bam int"
#: Fixed values of the format: base codes, alignment operations, sizes of tag values.
BASES = "=ACMGRSVTWYHKDBN"
OPERATIONS = "MIDNSHP=X"
TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
TAG_INTS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
ROWS = 5000
#: Records that have to follow each other before a place counts as the beginning of one,
#: and bytes that are looked at for them.
CHAIN, LOOK = 6, 1 << 20


def score(tags: bytes) -> int | None:
    """The last AS tag of a record."""
    at, found = 0, None
    while at + 3 <= len(tags):
        name, kind = tags[at : at + 2], chr(tags[at + 2])
        at += 3
        if kind in "ZH":
            at = tags.index(0, at) + 1
            continue
        if kind == "B":
            sub, n = chr(tags[at]), struct.unpack_from("<i", tags, at + 1)[0]
            at += 5 + n * TAG_SIZES[sub]
            continue
        if name == b"AS" and kind in TAG_INTS:
            found = struct.unpack_from(TAG_INTS[kind], tags, at)[0]
        at += TAG_SIZES[kind]
    return found


def number(source: Stream) -> int:
    return struct.unpack("<i", source.read(4))[0]


def contigs(source: Stream) -> list[tuple[str, int]]:
    """(name, length) of the header's contigs; leaves the source at the first record."""
    if source.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    source.read(number(source))
    out = []
    for _ in range(number(source)):
        name = source.read(number(source))[:-1].decode()
        out.append((name, number(source)))
    return out


def record(raw: bytes, names: list[str]) -> tuple:
    ref, pos, l_name, mapq, _, n_ops, flag, l_seq, _, _, tlen = struct.unpack_from("<iiBBHHHiiii", raw)
    at = 32
    qname = raw[at : at + l_name - 1].decode()
    at += l_name
    ops = struct.unpack_from(f"<{n_ops}I", raw, at)
    at += 4 * n_ops
    packed = raw[at : at + (l_seq + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq]
    at += len(packed)
    qual = "".join(chr(min(q, 93) + 33) for q in raw[at : at + l_seq])
    at += l_seq
    cigar = "".join(f"{o >> 4}{OPERATIONS[o & 15]}" for o in ops) or "*"
    return qname, flag, names[ref] if ref >= 0 else "*", pos + 1, mapq, cigar, tlen, seq, qual, score(raw[at:])


def record_size(data: bytes, at: int, lengths: list[int]) -> int | None:
    """Bytes of the record at ``at``, if what stands there can be one."""
    size, ref, pos, l_name, _, _, n_ops, _, l_seq, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (32 < size < 1 << 26 and l_name > 1 and l_seq >= 0 and size >= 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq):
        return None
    for r, p in ((ref, pos), (next_ref, next_pos)):
        if not (-1 <= r < len(lengths) and -1 <= p and (r < 0 or p < max(lengths[r], 1))):
            return None
    name = data[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] or not all(33 <= c <= 126 for c in name[:-1])):
        return None
    return 4 + size


def begins_chain(data: bytes, at: int, lengths: list[int], at_end: bool) -> bool:
    """Records follow each other from ``at`` on, up to the end of ``data`` (which the last one
    may run over, unless the file ends there) or for as many as convince."""
    for n in range(CHAIN):
        if at == len(data):
            return at_end or n > 0
        if at + 36 > len(data):
            return not at_end and n > 0
        size = record_size(data, at, lengths)
        if size is None:
            return False
        at += size
        if at > len(data):
            return not at_end
    return True


def first_record(file: File, at: int, lengths: list[int]) -> int:
    """Virtual offset of the first record that begins in a block at or after byte ``at``."""
    begin = file.first_block(at)
    while begin < file.size:
        data, after = file.block(begin)
        own, end = len(data), after
        parts = [data]
        seen = own
        while seen < LOOK and end < file.size:
            more, end = file.block(end)
            parts.append(more)
            seen += len(more)
        whole = b"".join(parts)
        for u in range(own):
            if u + 36 <= len(whole) and record_size(whole, u, lengths) is not None and begins_chain(whole, u, lengths, end >= file.size):
                return begin << 16 | u
        begin = after
    return file.size << 16


def records(source: Stream, names: list[str], end: int) -> Iterator[tuple]:
    """Records that begin before the virtual offset ``end``."""
    while source.place() < end and len(head := source.read(4)) == 4:
        yield record(source.read(struct.unpack("<i", head)[0]), names)


class BamPart(InputPartition):
    """Ranges of virtual offsets of a file, or a stretch of bytes that its task has to find records in."""

    def __init__(self, path: str, number: int, ranges: list[tuple[int, int]] | None = None, stretch: tuple[int, int] = (0, 0)):
        self.path, self.number, self.ranges, self.stretch = path, number, ranges, stretch


def index_of(path: str) -> str | None:
    return next((p for p in (f"{path}.bai", f"{path.removesuffix('.bam')}.bai") if exists(p)), None)


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.split = options["paths"].split("\n"), int(options["split"])
        self.regions = decoded(options.get("regions", ""))
        #: Contigs and 1-based positions that filters leave.
        self.contigs: set[str] | None = None
        self.low, self.high = 1, (EVERYWHERE[1] + 1) << WINDOW_BITS

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  the data source's method
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("rname",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.contigs = named if self.contigs is None else self.contigs & named
            elif getattr(f, "attribute", None) == ("pos",):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
        return filters  # ranges hold other records too

    def wanted(self, names: list[str]) -> Regions | None:
        """The windows to read; None for all records, those without a place included."""
        if self.contigs is None and self.regions is None and (self.low, self.high) == (1, (EVERYWHERE[1] + 1) << WINDOW_BITS):
            return None
        low, high = max(self.low - 1, 0) >> WINDOW_BITS, max(self.high - 1, 0) >> WINDOW_BITS
        asked = self.regions if self.regions is not None else [(n, *EVERYWHERE) for n in names]
        cut = [(c, max(a, low), min(b, high)) for c, a, b in asked if self.contigs is None or c in self.contigs]
        return [r for r in cut if r[1] <= r[2]]

    def partitions(self) -> list[BamPart]:
        out = []
        for i, path in enumerate(self.paths):
            file, index = File(path), index_of(path)
            if index is None:
                out += [BamPart(path, i, stretch=(at, min(file.size, at + self.split))) for at in range(0, file.size, self.split)]
                continue
            source = Stream(file)
            names = [n for n, _ in contigs(source)]
            first, end = source.place(), file.size << 16
            known = Index.read(index)
            regions = self.wanted(names)
            if regions is None:
                cuts = [first, *(p for p in known.places() if p > first), end]
                ranges = list(zip(cuts, cuts[1:]))
            else:
                ranges = known.ranges(regions, names)
            out += [BamPart(path, i, r) for r in grouped(ranges, self.split)]
        return out or [BamPart(self.paths[0], 0, [])]

    def read(self, partition: BamPart) -> Iterator[pa.RecordBatch]:
        fields = [x.split() for x in SCHEMA.split(", ")]
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

        file = File(partition.path)
        source = Stream(file)
        header = contigs(source)
        names, lengths = [n for n, _ in header], [n for _, n in header]
        ranges = partition.ranges
        if ranges is None:
            begin, end = partition.stretch
            first = source.place()
            ends = [max(first, first_record(file, at, lengths)) if at else first for at in (begin, end)]
            ranges = [(ends[0], ends[1])]
        for begin, end in ranges:
            if begin >= end:
                continue
            for r in records(Stream(file, begin), names, end):
                rows.append((*r, partition.number))
                if len(rows) == ROWS:
                    yield batch()
                    rows.clear()
        if rows:
            yield batch()


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strand_bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(dict(self.options))


def read_bam(spark: SparkSession, paths: list[str], chrom: str | None = None, regions: Regions | None = None, split: int = SPLIT) -> DataFrame:
    """Reads of BAM files in the columns of :func:`readers.read_sam`; ``bam`` is the place in
    ``paths``. ``chrom`` (comma-separated contigs) and ``regions`` (windows of 16 KB, see
    ``bgzf.windows_of``) leave unread what an index knows to lie elsewhere."""
    spark.dataSource.register(BamSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    source = spark.read.format("strand_bam").option("paths", "\n".join(paths)).option("split", str(split))
    if regions is not None:
        source = source.option("regions", encoded(regions))
    out = source.load()
    return out if chrom is None else out.where(F.col("rname").isin(chrom.split(",")))
