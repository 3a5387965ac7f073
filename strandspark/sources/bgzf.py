"""Block-gzipped files and their coordinate indexes, as splittable Spark sources.

A block-gzipped file is a chain of gzip members of at most 64 KB that carry their own
size, so reading may start at any of them. A place in such a file is a virtual offset:
the block's offset in the file, shifted by 16 bits, and the offset inside its data.

A whole file is cut into stretches of bytes; each task finds the first block of its
stretch and owns the lines that begin in it. With an index, and the stretches of
contigs that are asked for, only the ranges of virtual offsets that may hold
their records are read; these are cut into tasks at places where records begin.

Files are opened through Arrow's file systems, by any address those know (a bare path is
local); the index is read where the plan is made.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file that one task reads.
SPLIT = 32 << 20
#: Fixed values of the formats: the head of a block, its largest size, bits of an index
#: window, first bins of the six levels, and the bin that holds no records.
MAGIC = b"\x1f\x8b\x08\x04"
BLOCK = 1 << 16
WINDOW_BITS = 14
LEVELS = ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681))
META_BIN = 37450
#: Uncompressed bytes that are turned into an Arrow batch at once.
BATCH = 4 << 20
#: (contig, first window, last window): stretches of 16 KB windows that records are wanted from.
Regions = list[tuple[str, int, int]]


def _system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def exists(path: str) -> bool:
    system, name = _system(path)
    return system.get_file_info(name).type == arrow_fs.FileType.File


def block_size(head: bytes) -> int | None:
    """Size of the block that begins with these bytes; None if none does."""
    if len(head) < 18 or head[:4] != MAGIC:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        kind, n = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and n == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return None


class File:
    """Blocks of a file, read ahead by a few at a time."""

    def __init__(self, path: str):
        system, name = _system(path)
        self.path, self.source = path, system.open_input_file(name)
        self.size = self.source.size()
        self.ahead, self.ahead_at = b"", 0

    def bytes(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if not (self.ahead_at <= at and at + n <= self.ahead_at + len(self.ahead)):
            self.ahead, self.ahead_at = self.source.read_at(max(n, 8 * BLOCK), at), at
        return self.ahead[at - self.ahead_at : at - self.ahead_at + n]

    def is_blocked(self) -> bool:
        return block_size(self.bytes(0, 64)) is not None

    def block(self, at: int) -> tuple[bytes, int]:
        """Data of the block at ``at``, and where the next one begins."""
        raw = self.bytes(at, BLOCK)
        n = block_size(raw)
        if n is None or n > len(raw):
            raise ValueError(f"{self.path}: no whole block at {at}")
        return zlib.decompress(raw[:n], 31), at + n

    def first_block(self, at: int) -> int:
        """The first block that begins at or after ``at``; the file's size if none does."""
        if at <= 0 or at >= self.size:
            return max(0, min(at, self.size))
        found = at
        while found < self.size:
            window = self.bytes(found, BLOCK + 64)
            i = window.find(MAGIC)
            if i < 0:
                found += max(1, len(window) - 3)
                continue
            found += i
            n = block_size(self.bytes(found, 64))
            if n is not None and found + n <= self.size and (found + n == self.size or block_size(self.bytes(found + n, 64)) is not None) and self._inflates(found, n):
                return found
            found += 1
        return self.size

    def _inflates(self, at: int, n: int) -> bool:
        try:
            zlib.decompress(self.bytes(at, n), 31)
            return True
        except zlib.error:
            return False


class Stream:
    """Uncompressed bytes from a virtual offset on."""

    def __init__(self, file: File, place: int = 0):
        self.file, self.at, self.next = file, place >> 16, place >> 16
        self.data, self.within = b"", 0
        self._load()
        self.within = place & 0xFFFF

    def _load(self) -> bool:
        while self.next < self.file.size:
            self.at = self.next
            self.data, self.next = self.file.block(self.at)
            self.within = 0
            if self.data:
                return True
        self.at, self.data, self.within = self.file.size, b"", 0
        return False

    def place(self) -> int:
        """Virtual offset of the next byte; a block's end is the next one's beginning."""
        if self.within >= len(self.data):
            self._load()
        return self.at << 16 | self.within

    def read(self, n: int) -> bytes:
        out = []
        while n > 0:
            if self.within >= len(self.data) and not self._load():
                break
            part = self.data[self.within : self.within + n]
            self.within += len(part)
            n -= len(part)
            out.append(part)
        return out[0] if len(out) == 1 else b"".join(out)


def blocks(file: File, begin: int, end: int) -> Iterator[bytes]:
    """Data between two virtual offsets, block by block."""
    at = begin >> 16
    while at < file.size and (at < end >> 16 or at == end >> 16 and end & 0xFFFF):
        data, after = file.block(at)
        yield data[begin & 0xFFFF if at == begin >> 16 else 0 : end & 0xFFFF if at == end >> 16 else None]
        at = after


def _lines(data: bytes) -> list[bytes]:
    lines = data.split(b"\n")
    return [x[:-1] if x[-1:] == b"\r" else x for x in lines] if b"\r" in data else lines


def line_batches(parts: Iterator[bytes], skip_first: bool, tail: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Whole lines of ``parts`` and, at their end, what of ``tail`` belongs to the last one.

    ``skip_first``: the lines begin after the first line end; where there is none the
    stretch owns no line.
    """
    rest = b""
    for part in parts:
        if skip_first:
            cut = part.find(b"\n")
            if cut < 0:
                continue
            part, skip_first = part[cut + 1 :], False
        rest += part
        if len(rest) >= BATCH:
            cut = rest.rfind(b"\n")
            if cut >= 0:
                yield _lines(rest[:cut])
                rest = rest[cut + 1 :]
    if skip_first:
        return
    for part in tail:  # up to the end of the line that begins in, or right after, the stretch
        cut = part.find(b"\n")
        rest += part if cut < 0 else part[: cut + 1]
        if cut >= 0:
            break
    if rest:
        yield _lines(rest[:-1] if rest[-1:] == b"\n" else rest)


# --- indexes -----------------------------------------------------------------------


@dataclass
class ContigIndex:
    """Chunks of virtual offsets by bin, and the first record that reaches into each window."""

    bins: dict[int, np.ndarray]
    linear: np.ndarray

    def ranges(self, first: int, last: int) -> list[tuple[int, int]]:
        """Ranges that may hold records which reach into the windows ``first`` to ``last``."""
        out = []
        least = int(self.linear[first]) if first < len(self.linear) else int(self.linear[-1]) if len(self.linear) else 0
        wanted = [0]
        for bits, start in LEVELS:
            shift = bits - WINDOW_BITS
            low, high = start + (first >> shift), start + (last >> shift)
            wanted += range(low, high + 1) if high - low < len(self.bins) else [b for b in self.bins if low <= b <= high]
        for b in wanted:
            for begin, end in self.bins.get(b, ()):
                if end > least:
                    out.append((max(int(begin), least), int(end)))
        return out


@dataclass
class Index:
    """A coordinate index; ``names`` are empty where the file itself has them (alignments)."""

    names: list[str]
    contigs: list[ContigIndex] = field(default_factory=list)

    @staticmethod
    def read(path: str) -> Index:
        system, name = _system(path)
        with system.open_input_stream(name, compression=None) as f:
            raw = f.read()
        if raw[:2] == MAGIC[:2]:
            source, raw = raw, b""
            while source:
                one = zlib.decompressobj(31)
                raw += one.decompress(source)
                source = one.unused_data
        kind, n = raw[:4], struct.unpack_from("<i", raw, 4)[0]
        at, names = 8, []
        if kind == b"TBI\1":
            length = struct.unpack_from("<i", raw, 32)[0]
            names = raw[36 : 36 + length].decode().split("\0")[:n]
            at = 36 + length
        elif kind != b"BAI\1":
            raise ValueError(f"{path} is no coordinate index")
        out = Index(names)
        for _ in range(n):
            bins, n_bins = {}, struct.unpack_from("<i", raw, at)[0]
            at += 4
            for _ in range(n_bins):
                number, chunks = struct.unpack_from("<Ii", raw, at)
                at += 8
                if number < META_BIN:
                    bins[number] = np.frombuffer(raw, "<u8", 2 * chunks, at).reshape(-1, 2)
                at += 16 * chunks
            windows = struct.unpack_from("<i", raw, at)[0]
            linear = np.frombuffer(raw, "<u8", windows, at + 4)
            at += 4 + 8 * windows
            out.contigs.append(ContigIndex(bins, np.maximum.accumulate(linear) if windows else linear))
        return out

    def places(self) -> list[int]:
        """Virtual offsets at which records begin, in order."""
        return sorted({int(b) for c in self.contigs for chunks in c.bins.values() for b in chunks[:, 0]})

    def ranges(self, regions: Regions, names: list[str] | None = None) -> list[tuple[int, int]]:
        """The ranges of these regions without overlaps, each beginning and ending where a
        record does; ranges that meet stay apart, so that tasks can be cut between them."""
        at = {n: i for i, n in enumerate(names or self.names)}
        found = [r for contig, first, last in regions if contig in at for r in self.contigs[at[contig]].ranges(first, last)]
        starts = sorted({b for b, _ in found})
        out: list[tuple[int, int]] = []
        reach = 0
        for begin, end in sorted(found):
            begin = max(begin, reach)
            if begin < end:
                out.append((begin, end))
                reach = end
        cut = []
        for begin, end in out:
            inside = starts[bisect_left(starts, begin + 1) : bisect_left(starts, end)]
            cut += list(zip([begin, *inside], [*inside, end]))
        return cut


def grouped(ranges: list[tuple[int, int]], split: int) -> list[list[tuple[int, int]]]:
    """Ranges dealt to tasks of about ``split`` bytes, in order; ranges that meet become one."""
    out: list[list[tuple[int, int]]] = []
    size = split
    for begin, end in ranges:
        if size >= split:
            out.append([])
            size = 0
        if out[-1] and out[-1][-1][1] == begin:
            out[-1][-1] = (out[-1][-1][0], end)
        else:
            out[-1].append((begin, end))
        size += (end >> 16) - (begin >> 16) + 1
    return out


def windows_of(sites: DataFrame, contig: str = "contig", pos: str = "pos") -> Regions:
    """The 16 KB windows that 1-based positions fall into, joined where they meet. There are
    as many as a genome has at most, whatever the number of sites."""
    w = sites.select(F.col(contig).alias("c"), F.shiftright(F.greatest(F.col(pos) - 1, F.lit(0)).cast("long"), WINDOW_BITS).alias("w")).where("c is not null and w is not null").distinct()
    out: Regions = []
    for c, n in sorted((r["c"], r["w"]) for r in w.collect()):
        if out and out[-1][0] == c and out[-1][2] == n - 1:
            out[-1] = (c, out[-1][1], n)
        else:
            out.append((c, n, n))
    return out


#: Windows of a whole contig.
EVERYWHERE = (0, (1 << 15) - 1)


def encoded(regions: Regions) -> str:
    return "\n".join(["regions", *(f"{c}\t{a}\t{b}" for c, a, b in regions)])


def decoded(text: str) -> Regions | None:
    return [(c, int(a), int(b)) for c, a, b in (x.split("\t") for x in text.split("\n")[1:])] if text else None


def whole_contigs(names: str | None) -> Regions | None:
    """Regions of comma-separated contigs; None for all."""
    return [(c, *EVERYWHERE) for c in names.split(",")] if names else None


# --- lines as a source -------------------------------------------------------------


class Stretch(InputPartition):
    """Bytes ``begin`` to ``end`` of a file, or the ranges of virtual offsets in their place."""

    def __init__(self, path: str, begin: int = 0, end: int = 0, ranges: list[tuple[int, int]] | None = None):
        self.path, self.begin, self.end, self.ranges = path, begin, end, ranges

    def batches(self) -> Iterator[list[bytes]]:
        file = File(self.path)
        if self.ranges is not None:
            for begin, end in self.ranges:
                yield from line_batches(blocks(file, begin, end), False, iter(()))
            return
        first, last = file.first_block(self.begin), file.first_block(self.end)
        if first < last:
            yield from line_batches(blocks(file, first << 16, last << 16), self.begin > 0, blocks(file, last << 16, file.size << 16))


class LinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.regions, self.index = decoded(options.get("regions", "")), options.get("index", "")

    def partitions(self) -> list[Stretch]:
        if self.regions is not None:
            return [Stretch(self.path, ranges=r) for r in grouped(Index.read(self.index).ranges(self.regions), self.split)] or [Stretch(self.path, ranges=[])]
        size = File(self.path).size
        return [Stretch(self.path, at, min(size, at + self.split)) for at in range(0, size, self.split)] or [Stretch(self.path, ranges=[])]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        for lines in partition.batches():
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()).cast(pa.string())], names=["value"])


class LinesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strand_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> LinesReader:
        return LinesReader(dict(self.options))


def is_blocked(path: str) -> bool:
    """The file is block-gzipped, and can be opened without Spark."""
    try:
        return path.endswith((".gz", ".bgz")) and exists(path) and File(path).is_blocked()
    except (OSError, ValueError, NotImplementedError, pa.ArrowException):
        return False


def is_indexed(path: str) -> bool:
    return is_blocked(path) and exists(f"{path}.tbi")


def comment_lines(path: str) -> list[str]:
    """The lines at a block-gzipped file's beginning that begin with ``#``."""
    file, rest, out = File(path), b"", []
    for part in blocks(file, 0, file.size << 16):
        *lines, rest = (rest + part).split(b"\n")
        for line in lines:
            if line[:1] != b"#":
                return out
            out.append(line.rstrip(b"\r").decode())
    return out + ([rest.decode()] if rest[:1] == b"#" else [])


def read_lines(spark: SparkSession, path: str, regions: Regions | None = None, split: int = SPLIT) -> DataFrame:
    """Lines of a block-gzipped file, in several tasks; of all others as Spark reads text.

    ``regions``: only these are wanted. They thin what is read where the file has a ``.tbi``
    index beside it; the caller still filters, as neighbours come along.
    """
    if not is_blocked(path):
        return spark.read.text(path)
    spark.dataSource.register(LinesSource)
    source = spark.read.format("strand_lines").option("split", str(split)).option("index", f"{path}.tbi")
    if regions is not None and exists(f"{path}.tbi"):
        source = source.option("regions", encoded(regions))
    return source.load(path)
