"""Block gzip files and coordinate indexes for the tests."""

import struct
import zlib
from bisect import bisect_right


def block(data: bytes) -> bytes:
    """One block of block gzip."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    extra = b"BC" + struct.pack("<HH", 2, len(body) + 25)
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + extra + body + struct.pack("<II", zlib.crc32(data), len(data))


class Blocks:
    """A file of blocks of ``size`` bytes, and the virtual offset of each of its bytes."""

    def __init__(self, raw: bytes, size: int):
        self.starts, self.offsets, self.file = list(range(0, max(len(raw), 1), size)), [], b""
        for k in self.starts:
            self.offsets.append(len(self.file))
            self.file += block(raw[k : k + size])
        self.starts.append(len(raw))
        self.offsets.append(len(self.file))
        self.file += block(b"")

    def place(self, at: int) -> int:
        i = bisect_right(self.starts, at) - 1
        return self.offsets[i] << 16 | (at - self.starts[i])


def bin_of(begin: int, end: int) -> int:
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end >> shift:
            return first + (begin >> shift)
    return 0


def index_body(records, n_contigs: int) -> bytes:
    """``records``: (contig number, begin, end, virtual begin, virtual end), in order."""
    out = b""
    for c in range(n_contigs):
        bins, linear = {}, {}
        for contig, begin, end, first, last in records:
            if contig != c:
                continue
            chunks = bins.setdefault(bin_of(begin, end), [])
            if chunks and chunks[-1][1] == first:
                chunks[-1] = (chunks[-1][0], last)
            else:
                chunks.append((first, last))
            for w in range(begin >> 14, (end - 1 >> 14) + 1):
                linear.setdefault(w, first)
        out += struct.pack("<i", len(bins))
        for b, chunks in sorted(bins.items()):
            out += struct.pack("<Ii", b, len(chunks)) + b"".join(struct.pack("<QQ", *x) for x in chunks)
        n = max(linear, default=-1) + 1
        out += struct.pack("<i", n) + b"".join(struct.pack("<Q", linear.get(w, 0)) for w in range(n))
    return out


def write_indexed(path, text: str, size: int = 2000, columns: tuple[int, int] = (1, 2)) -> None:
    """Block-gzipped tab-separated text and its ``.tbi``."""
    raw = text.encode()
    made = Blocks(raw, size)
    names, records, at = [], [], 0
    for line in raw.splitlines(keepends=True):
        if line[:1] != b"#":
            cells = line.rstrip(b"\r\n").split(b"\t")
            name, pos = cells[columns[0] - 1].decode(), int(cells[columns[1] - 1])
            if name not in names:
                names.append(name)
            records.append((names.index(name), pos - 1, pos, made.place(at), made.place(at + len(line))))
        at += len(line)
    listed = b"".join(n.encode() + b"\0" for n in names)
    head = b"TBI\1" + struct.pack("<iiiiiii", len(names), 2, columns[0], columns[1], 0, ord("#"), 0) + struct.pack("<i", len(listed)) + listed
    with open(path, "wb") as f:
        f.write(made.file)
    with open(f"{path}.tbi", "wb") as f:
        f.write(b"".join(block(x) for x in [head + index_body(records, len(names)), b""]))
