"""Phase of blocks that are too large for one row: the steps of the block kernel
(``phasing.phase_block``) as joins and running values.

A block that one assignment satisfies is found through its double cover: every variant
is two nodes, one per haplotype, and a decided connection joins two pairs of them. The
block is concordant where the cover has two components, each with one node of every variant:
where what the first node reaches is as many nodes as variants, and not its own twin.

Else it is cut. The kernel cuts greedily, weakest points first, never beside another cut.
Among neighbours the weaker (of equal ones the first) is decided first, so a point's
decision follows from how far it is to the ends of the falling runs on both sides: it is
chosen where both distances are even. The level up to which chosen points are cuts is the
largest, over all stretches of the allowed length, of the weakest chosen point inside.

Connections inside a fragment are gathered and phased by the kernel, one row per
fragment. Connections between fragments become one weight per pair of fragments. Fragments
are then merged in order, by a pass over these weights that remembers one bit per
fragment of the stretch at hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandspark.operators import phasing
from strandspark.operators.graph import components
from strandspark.operators.scans import CHUNK, running
from strandspark.runtime import written

KEY = ["contig", "block"]


def concordant_blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(contig, block, idx, hap): variants of the blocks that one assignment satisfies, first 0."""
    node = lambda i, x: F.concat_ws("\t", "contig", "block", F.format_string("%012d", F.col(i)), x)
    own = edges.where("config >= 0").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("x"))
    cover = own.select(*KEY, node("ia", F.col("x").cast("string")).alias("u"), node("ib", F.col("x").bitwiseXOR(F.col("config")).cast("string")).alias("v"))
    # a block's first node is the smallest of its nodes, so it is the root of what it reaches
    mine = components(cover, near=KEY).where(F.col("root").endswith(f"\t{0:012d}\t0"))
    mine = mine.select(F.expr("substring(node, 1, length(node) - 15)").alias("own"), F.expr("int(substring(node, -14, 12))").alias("idx"), F.expr("int(right(node, 1))").alias("hap"))
    whole = nodes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).withColumn("own", F.concat_ws("\t", *KEY))
    ok = mine.groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.bool_or((F.col("idx") == 0) & (F.col("hap") == 1)).alias("twin")).where("not twin").join(whole, ["own", "n"])
    return mine.join(ok.select("own", *KEY), "own").select(*KEY, "idx", "hap")


def crossing_counts(nodes: DataFrame, edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(contig, block, at, crossing): connections, ties too, that cross the point before variant ``at`` (from 1)."""
    steps = edges.select(*KEY, F.explode(F.array(F.struct((F.least("ia", "ib") + 1).alias("at"), F.lit(1).alias("d")), F.struct((F.greatest("ia", "ib") + 1).alias("at"), F.lit(-1).alias("d")))).alias("s"))
    steps = steps.groupBy(*KEY, F.col("s.at").alias("at")).agg(F.sum("s.d").alias("d"))
    grid = nodes.select(*KEY, F.col("idx").alias("at")).join(steps, [*KEY, "at"], "left").na.fill(0, ["d"])
    return running(written(grid, "steps"), KEY, "at", "d", "sum", "crossing", chunk=chunk).where("at >= 1").select(*KEY, "at", "crossing")


def chosen_points(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The points (contig, block, at, crossing) that the greedy cutting chooses at some level."""
    near = points.select(*KEY, "at", "crossing")
    left = near.select(*KEY, (F.col("at") + 1).alias("at"), F.col("crossing").alias("before"))
    right = near.select(*KEY, (F.col("at") - 1).alias("at"), F.col("crossing").alias("after"))
    x = near.join(left, [*KEY, "at"], "left").join(right, [*KEY, "at"], "left")
    starts = F.when(F.col("before").isNull() | (F.col("before") > F.col("crossing")), F.col("at"))
    ends = F.when(F.col("after").isNull() | (F.col("after") >= F.col("crossing")), F.col("at"))
    x = written(x.withColumns({"run": starts, "run_end": ends}), "runs")
    x = written(running(x, KEY, "at", "run", "max", chunk=chunk), "runs")
    x = running(x, KEY, "at", "run_end", "min", backwards=True, chunk=chunk)
    return x.where((F.col("at") - F.col("run")) % 2 == 0).where((F.col("run_end") - F.col("at")) % 2 == 0).select(*KEY, "at", "crossing")


def cut_points(nodes: DataFrame, edges: DataFrame, most: int, chunk: int = CHUNK) -> DataFrame:
    """(contig, block, at): first variants of the fragments but the first one."""
    sizes = nodes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    counts = crossing_counts(nodes, edges, chunk).join(sizes, KEY)
    points = written(counts.where("at >= 2 and at <= n - 2 and crossing >= 1").select(*KEY, "at", "crossing"), "crossings")
    chosen = written(chosen_points(points, chunk), "chosen")
    if not most:
        return chosen.where("crossing = 1").select(*KEY, "at")
    # The weakest chosen point of every stretch of ``most`` points, from a block's chunk and the beginning of the next one.
    every = nodes.where("idx >= 1").select(*KEY, F.col("idx").alias("at")).join(chosen, [*KEY, "at"], "left").join(sizes, KEY)
    here = F.floor(F.col("at") / chunk)
    copies = F.when((F.col("at") % chunk < most) & (here > 0), F.sequence(F.greatest(here - 1 - F.floor(F.lit(most) / chunk), F.lit(0)), here)).otherwise(F.array(here))
    every = every.withColumn("_chunk", F.explode(copies))
    ahead = Window.partitionBy(*KEY, "_chunk").orderBy("at").rowsBetween(0, most - 1)
    stretch = every.withColumn("weakest", F.coalesce(F.min("crossing").over(ahead), F.lit((1 << 62)))).where((F.col("_chunk") == here) & (F.col("at") + most <= F.col("n")))
    level = stretch.groupBy(*KEY).agg(F.max("weakest").alias("level"))
    return chosen.join(level, KEY, "left").where(F.col("crossing") <= F.greatest(F.coalesce("level", F.lit(1)), F.lit(1))).select(*KEY, "at")


def _phase_fragments(most: int, fragments: DataFrame) -> DataFrame:
    """(contig, block, fragment, config) of rows with n, whole and the edges of one fragment."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for contig, block, fragment, n, whole, own in zip(*(pdf[c] for c in ("contig", "block", "fragment", "n", "whole", "edges"))):
                e = sorted((int(x["ia"]), int(x["ib"]), int(x["config"])) for x in (own if own is not None else ()))
                got = None if whole else phasing.concordant(int(n), e)
                rows.append((contig, block, fragment, got if got is not None else phasing.exhaustive(int(n), e)))
            yield pd.DataFrame(rows, columns=["contig", "block", "fragment", "config"])

    kinds = dict(fragments.dtypes)
    return fragments.mapInPandas(run, f"contig {kinds['contig']}, block {kinds['block']}, fragment int, config string")


def _merge(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Orientation and stretch of every fragment. Rows come by block and fragment, one for each
    earlier fragment that it is connected to (or one without)."""
    block, last, stretch, broken, bits, score, known = None, None, 0, True, {}, 0, True
    out: list[tuple] = []

    def close() -> None:
        """Decide the fragment whose rows have all been seen."""
        nonlocal stretch, broken
        if last is None:
            return
        joins = not broken and known and score != 0
        if not joins:
            stretch = last
            bits.clear()
        bits[last] = int(joins and score < 0)
        broken = not known
        out.append((*block, last, stretch, bits[last]))

    for pdf in it:
        for contig, b, fragment, other, weight, phased in zip(*(pdf[c] for c in ("contig", "block", "fragment", "other", "weight", "phased"))):
            if (contig, b) != block or fragment != last:
                close()
                if (contig, b) != block:
                    block, broken = (contig, b), True
                    bits.clear()
                last, score, known = int(fragment), 0, bool(phased)
            if other in bits:
                score += int(weight) * (-1 if bits[other] else 1)
        if len(out) >= 10_000:
            yield pd.DataFrame(out, columns=["contig", "block", "fragment", "stretch", "turned"])
            out.clear()
    close()
    yield pd.DataFrame(out, columns=["contig", "block", "fragment", "stretch", "turned"])


def phase_large(nodes: DataFrame, edges: DataFrame, most: int = 15, chunk: int = CHUNK) -> DataFrame:
    """(contig, block, at, idx, hap_a): phased variants of large blocks; ``at`` is the first
    variant of the stretch, ``idx`` the place in the block.

    ``nodes``: contig, block, idx; ``edges``: contig, block, ia, ib, config. Both are
    written tables.
    """
    whole = written(concordant_blocks(nodes, edges), "concordant")
    found = whole.select(*KEY, F.lit(0).alias("at"), "idx", F.col("hap").alias("hap_a"))
    settled = whole.where("idx = 0").select(*KEY)
    nodes = written(nodes.join(settled, KEY, "left_anti"), "open-blocks")
    if nodes.isEmpty():
        return found
    edges = written(edges.join(settled, KEY, "left_anti"), "open-edges")
    cuts = written(cut_points(nodes, edges, most, chunk), "cuts")
    marked = nodes.join(cuts.withColumn("fragment", F.col("at")), (nodes.contig == cuts.contig) & (nodes.block == cuts.block) & (nodes.idx == cuts.at), "left").select(nodes.contig, nodes.block, nodes.idx, F.when(nodes.idx == 0, 0).otherwise(F.col("fragment")).alias("fragment"))
    placed = written(running(written(marked, "marked"), KEY, "idx", "fragment", "max", chunk=chunk), "placed")
    at = lambda s: placed.select(*KEY, F.col("idx").alias(f"i{s}"), F.col("fragment").alias(f"f{s}"))
    routed = written(edges.join(at("a"), [*KEY, "ia"]).join(at("b"), [*KEY, "ib"]), "routed")
    inner = routed.where("fa = fb").groupBy(*KEY, F.col("fa").alias("fragment")).agg(F.collect_list(F.struct((F.col("ia") - F.col("fa")).alias("ia"), (F.col("ib") - F.col("fa")).alias("ib"), "config")).alias("edges"))
    sizes = placed.groupBy(*KEY, "fragment").agg(F.count(F.lit(1)).cast("int").alias("n"))
    uncut = sizes.groupBy(*KEY).agg((F.count(F.lit(1)) == 1).alias("whole"))
    parts = written(_phase_fragments(most, sizes.join(uncut, KEY).join(inner, [*KEY, "fragment"], "left")), "fragments")
    phased = F.col("config").substr(1, 1) != phasing.UNKNOWN
    cells = parts.where(phased).select(*KEY, "fragment", F.posexplode(F.split("config", "")).alias("i", "x")).where("x <> ''").select(*KEY, (F.col("fragment") + F.col("i")).alias("idx"), "fragment", F.col("x").cast("int").alias("x"))
    cells = written(cells, "cells")
    end = lambda s: cells.select(*KEY, F.col("idx").alias(f"i{s}"), F.col("x").alias(f"x{s}"))
    between = routed.where("fa <> fb and config >= 0").join(end("a"), [*KEY, "ia"]).join(end("b"), [*KEY, "ib"])
    agrees = F.when(F.col("xa").bitwiseXOR(F.col("xb")) == F.col("config"), 1).otherwise(-1)
    weights = between.groupBy(*KEY, F.greatest("fa", "fb").alias("fragment"), F.least("fa", "fb").alias("other")).agg(F.sum(agrees).alias("weight"))
    order = parts.select(*KEY, "fragment", phased.alias("phased")).join(weights, [*KEY, "fragment"], "left").na.fill(-1, ["other"]).na.fill(0, ["weight"])
    kinds = dict(order.dtypes)
    turned = written(order.repartition(*KEY).sortWithinPartitions(*KEY, "fragment").mapInPandas(_merge, f"contig {kinds['contig']}, block {kinds['block']}, fragment int, stretch int, turned int"), "turned")
    merged = cells.join(turned, [*KEY, "fragment"]).select(*KEY, F.col("stretch").alias("at"), "idx", F.col("x").bitwiseXOR(F.col("turned")).alias("hap_a"))
    return found.unionByName(merged)
