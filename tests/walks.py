"""Alignment walk of one read in plain Python, for comparison."""

import re

OPERATION = re.compile(r"(\d+)([MIDNSHPX=])")


def walk(cigar: str, bases: str, quals: str, baseq: int, rebase: bool = True) -> list[dict]:
    """Segments of a read between its skips, offsets relative to the read's position.

    Bases under ``baseq`` become N; a deletion is D per base; inserted bases are kept
    under the position that they follow, counted from the segment (``rebase``) or
    from the read.
    """
    masked = "".join(b if ord(q) - 33 >= baseq else "N" for b, q in zip(bases, quals))
    out, pseudo, ins, start, genome, read = [], [], {}, 0, 0, 0

    def emit(end: int) -> None:
        out.append({"off_start": start, "off_end": end, "pseudo": "".join(pseudo), "ins": dict(ins)})

    for length, op in OPERATION.findall(cigar):
        n = int(length)
        if op in "M=X":
            pseudo.append(masked[read : read + n])
            genome, read = genome + n, read + n
        elif op == "N":
            emit(genome)
            genome += n
            start, pseudo, ins = genome, [], {}
        elif op == "D":
            pseudo.append("D" * n)
            genome += n
        elif op == "I":
            ins[genome - 1 - (start if rebase else 0)] = masked[read : read + n]
            read += n
        elif op == "S":
            read += n
    emit(genome)
    return out


def allele(segment: dict, first: int, length: int) -> str | None:
    """Allele of ``length`` reference bases from index ``first`` of a segment."""
    if first < 0 or length < 1 or first + length > len(segment["pseudo"]):
        return None
    out = "".join(segment["pseudo"][i] + segment["ins"].get(i, "") for i in range(first, first + length)).replace("D", "")
    return None if out in ("", "N") else out
