"""Blocks of connected variants and their phase.

Components come from the distributed graph operator; each block is then phased on
its own by the kernel below (numpy, no Spark), in a grouped map keyed by block.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandspark.operators.graph import components
from strandspark.runtime import written

UNKNOWN = "-"


def flipped(config: str) -> str:
    return config.translate(str.maketrans("01", "10"))


def concordant(n: int, edges: list[tuple[int, int, int]]) -> str | None:
    """The one assignment that satisfies all decided edges, 0 at the first variant;
    None if there is none, or if they don't reach every variant."""
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for a, b, c in edges:
        if c >= 0:
            near[a].append((b, c))
            near[b].append((a, c))
    at = [-1] * n
    at[0] = 0
    todo = [0]
    while todo:
        a = todo.pop()
        for b, c in near[a]:
            if at[b] < 0:
                at[b] = at[a] ^ c
                todo.append(b)
            elif at[b] != at[a] ^ c:
                return None
    return None if -1 in at else "".join(map(str, at))


def crossing(n: int, edges: list[tuple[int, int, int]]) -> np.ndarray:
    """Edges (ties too) that cross each point between variants i - 1 and i."""
    step = np.zeros(n + 1, np.int64)
    for a, b, _ in edges:
        step[min(a, b) + 1] += 1
        step[max(a, b) + 1] -= 1
    return np.cumsum(step)[:n]


def split_points(n: int, edges: list[tuple[int, int, int]], most: int) -> list[int]:
    """Where a block is cut: first at every point that one edge crosses, then at more and
    more crossed ones until no fragment is over ``most``; never beside another cut."""
    count = crossing(n, edges)[2 : n - 1]
    chosen: set[int] = set()
    for level in sorted({1, *count[count > 0].tolist()}):
        cuts = [0, *sorted(chosen), n]
        if level > 1 and max(b - a for a, b in zip(cuts, cuts[1:])) <= most:
            break
        for p in (np.flatnonzero(count == level) + 2).tolist():
            if p - 1 not in chosen and p + 1 not in chosen:
                chosen.add(p)
    return sorted(chosen)


def support(configs: np.ndarray, edges: list[tuple[int, int, int]]) -> np.ndarray:
    """Satisfied decided edges of each row of 0/1 assignments; -1 cells satisfy none."""
    out = np.zeros(len(configs), np.int64)
    for a, b, c in edges:
        if c >= 0:
            x, y = configs[:, a], configs[:, b]
            out += (x >= 0) & (y >= 0) & ((x ^ y) == c)
    return out


def inner(start: int, end: int, edges: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    return [(a - start, b - start, c) for a, b, c in edges if start <= a < end and start <= b < end]


#: Assignments scored at once.
CODES = 1 << 16


def _signs(n: int, base: int) -> np.ndarray:
    """Rows of 1 (allele 0) and -1 (allele 1) of the assignments from ``base``."""
    codes = np.arange(base, min(base + CODES, 1 << (n - 1)), dtype=np.int64)
    return (1 - 2 * ((codes[:, None] >> np.arange(n - 1, -1, -1)) & 1)).astype(np.float64)


_first_signs = functools.lru_cache(maxsize=17)(_signs)


def exhaustive(n: int, edges: list[tuple[int, int, int]]) -> str:
    """The assignment with the most satisfied edges, 0 at the first variant; unknown if not unique.

    With alleles as signs a decided edge adds 1 where it is satisfied and takes 1 where it is
    not, so all edges are one quadratic form: a product of matrices whatever their number
    (whole numbers, exact in doubles).
    """
    weights = np.zeros((n, n))
    for a, b, c in edges:
        if c >= 0:
            weights[a, b] += 1 - 2 * c
    best, found, ties = -np.inf, 0, 0
    for base in range(0, 1 << (n - 1), CODES):
        signs = _first_signs(n, 0) if base == 0 and n <= 16 else _signs(n, base)
        got = np.einsum("ij,ij->i", signs @ weights, signs)
        top = got.max()
        if top > best:
            best, ties, found = top, 0, base + int(got.argmax())
        if top == best:
            ties += int((got == best).sum())
    return format(found, f"0{n}b") if ties == 1 else UNKNOWN * n


def joined(first: str, second: str, edges: list[tuple[int, int, int]]) -> str:
    """Of the two ways to put two phased stretches together the one with more satisfied
    edges between them; unknown if equal, or if either is unknown."""
    if UNKNOWN in first or UNKNOWN in second:
        return UNKNOWN * (len(first) + len(second))
    ways = [first + second, first + flipped(second)]
    got = support(np.array([[int(x) for x in w] for w in ways], np.int8), edges)
    return UNKNOWN * len(ways[0]) if got[0] == got[1] else ways[int(got.argmax())]


def phase_block(n: int, edges: list[tuple[int, int, int]], max_block_size: int = 15, compat: bool = False) -> list[tuple[int, str]]:
    """(start, haplotype A) of the phased stretches of a block of ``n`` ordered variants;
    edges are (index, index, configuration). ``compat``: windows of later merges begin
    at the count of variants merged so far instead of at the stretch."""
    if n < 2:
        return []
    if (whole := concordant(n, edges)) is not None:
        return [(0, whole)]
    cuts = [0, *split_points(n, edges, max_block_size or n), n]
    parts = []
    for a, b in zip(cuts, cuts[1:]):
        own = inner(a, b, edges)
        got = concordant(b - a, own) if len(cuts) > 2 else None
        parts.append(got if got is not None else exhaustive(b - a, own))
    done: list[str] = []
    now, start = parts[0], 0
    for part in parts[1:]:
        size = len(now) + len(part)
        way = joined(now, part, inner(start, start + size, edges))
        if UNKNOWN in way:
            done.append(now)
            start = size if compat else start + len(now)
            now = part
        else:
            now = way
    out, at = [], 0
    for stretch in [*done, now]:
        if stretch[0] != UNKNOWN:
            out.append((at, stretch if stretch[0] == "0" else flipped(stretch)))
        at += len(stretch)
    return out


def blocks_of(edges: DataFrame) -> DataFrame:
    """(contig, block, variant_id, pos, idx): connected variants, ordered by position.

    A variant is one node whatever its contig, as ids are; ``block`` is the id of the
    component's first variant.
    """
    ends = edges.select("contig", F.explode(F.array(F.struct(F.col("variant_a").alias("variant_id"), F.col("pos_a").alias("pos")), F.struct(F.col("variant_b").alias("variant_id"), F.col("pos_b").alias("pos")))).alias("v"))
    nodes = ends.select("contig", "v.variant_id", "v.pos").distinct()
    node = lambda v: F.concat_ws("\t", "contig", v)
    root = components(edges.select("contig", node("variant_a").alias("u"), node("variant_b").alias("v")), near=["contig"])
    own = nodes.withColumn("node", node("variant_id")).join(root, "node")
    w = Window.partitionBy("contig", "root").orderBy("pos", "variant_id")
    own = own.withColumn("idx", (F.row_number().over(w) - 1).cast("int")).withColumn("block", F.first("variant_id").over(w))
    return own.select("contig", "block", "variant_id", "pos", "idx")


#: Variants, and connections, over which a block is phased in pieces instead of as one row.
LARGE, MANY = 2_000, 20_000


def phase(edges: DataFrame, blocks: DataFrame, max_block_size: int = 15, compat: bool = False, large: int = LARGE, many: int = MANY) -> DataFrame:
    """(contig, block, part, variant_id, pos, idx, hap_a): phased variants; ``part`` is the
    first variant of the stretch, ``idx`` the place in it, ``hap_a`` the allele (0 or 1)
    that haplotype A carries. Stretches whose phase stays open are left out.

    Blocks of up to ``large`` variants and ``many`` connections are one row each; larger ones
    are cut into fragments without ever being one (but for ``compat``, whose windows need the
    whole block). ``blocks`` are those of ``edges`` (see :func:`blocks_of`) and read several times: a written table.
    """
    v = blocks.select("contig", "variant_id", "block", "idx")
    e = edges.join(v.toDF("contig", "variant_a", "block", "ia"), ["contig", "variant_a"]).join(v.drop("block").toDF("contig", "variant_b", "ib"), ["contig", "variant_b"])
    e = written(e.select("contig", "block", "ia", "ib", "config"), "block-edges")
    last = (F.max(F.greatest("ia", "ib")) + 1).cast("int")  # every variant of a block is an end
    sizes = written(e.groupBy("contig", "block").agg(last.alias("n"), F.count(F.lit(1)).alias("edges")), "block-sizes")
    is_large = F.lit(False) if compat else (F.col("n") > large) | (F.col("edges") > many)
    whole, giants = sizes.agg(F.count_if(~is_large), F.count_if(is_large)).first()
    found = []
    if whole or not giants:
        stretches = _whole_blocks(sizes.where(~is_large).drop("edges"), e, max_block_size, compat)
        cells = stretches.select("contig", "block", "at", F.posexplode(F.split("config", "")).alias("i", "hap_a")).where("hap_a <> ''")
        cells = cells.select("contig", "block", (F.col("at") + F.col("i")).alias("idx"), "at", F.col("hap_a").cast("int"))
        found.append(written(cells, "phased-cells"))  # read twice below: blocks are phased once
    if giants:
        from strandspark.operators.splitting import phase_large

        nodes, own = blocks.select("contig", "block", "idx"), e
        if whole:
            large_ones = sizes.where(is_large).select("contig", "block")
            nodes, own = (written(x.join(large_ones, ["contig", "block"], "left_semi"), name) for x, name in ((nodes, "large-blocks"), (e, "large-edges")))
        found.append(phase_large(nodes, own, max_block_size).select("contig", "block", "idx", "at", "hap_a"))
    cells = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    out = blocks.join(cells, ["contig", "block", "idx"])
    # a stretch from a block's beginning is named as the block is; only later ones are looked up
    first = blocks.join(cells.where("idx = at and at > 0").select("contig", "block", "idx"), ["contig", "block", "idx"]).select("contig", "block", F.col("idx").alias("at"), F.col("variant_id").alias("part"))
    out = out.join(first, ["contig", "block", "at"], "left").withColumn("idx", (F.col("idx") - F.col("at")).cast("int"))
    return out.select("contig", "block", F.coalesce("part", "block").alias("part"), "variant_id", "pos", "idx", "hap_a")


def _whole_blocks(sizes: DataFrame, edges: DataFrame, max_block_size: int, compat: bool) -> DataFrame:
    """(contig, block, at, config) of the stretches of blocks that are one row each."""
    packed = edges.join(sizes.select("contig", "block"), ["contig", "block"], "left_semi").groupBy("contig", "block").agg(F.collect_list(F.struct("ia", "ib", "config")).alias("edges"))

    def run(it):
        for pdf in it:
            rows = []
            for contig, block, n, own in zip(pdf["contig"], pdf["block"], pdf["n"], pdf["edges"]):
                for at, config in phase_block(int(n), sorted((int(x["ia"]), int(x["ib"]), int(x["config"])) for x in own), max_block_size, compat):
                    rows.append((contig, block, at, config))
            yield pd.DataFrame(rows, columns=["contig", "block", "at", "config"])

    kinds = dict(sizes.dtypes)
    return sizes.join(packed, ["contig", "block"]).mapInPandas(run, f"contig {kinds['contig']}, block {kinds['block']}, at int, config string")
