"""Connected components of an edge table, by alternating large and small stars.

Each round hangs every node on a smaller neighbour; rounds are logarithmic in the
size of a component, and each is a few aggregations whose result is written to
the shared folder. No component is ever in one task: minima are combined before
the shuffle, and a node with very many edges is split by the join.

Where a caller says which rows are near each other, edges are dealt by that and every
batch of a task is contracted first: small components are stars before any round, and
of large ones only what joins the batches is left to the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.runtime import fewer, forget, written


#: Edges that a task contracts at once.
BATCH = 250_000


def least_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of 0 .. n - 1 that each of them reaches over the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return root


def _stars(batch: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v), ordered by ``near``, as stars: every node on the smallest that it reaches by the ``batch`` or more
    rows (up to four times that) that are contracted at once, which end where ``near`` changes if it does."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        both = pa.chunked_array(t["u"].chunks + t["v"].chunks).combine_chunks().dictionary_encode()
        order = pc.sort_indices(both.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        codes = rank[both.indices.to_numpy()]
        root = least_reachable(codes[: len(t)], codes[len(t) :], len(order))
        hung, ids = np.flatnonzero(root != np.arange(len(root))), both.dictionary.take(order)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(hung)), ids.take(pa.array(root[hung]))], ["u", "v"])

    held, rows = [], 0
    for b in it:
        held.append(b)
        rows += b.num_rows
        if b.num_rows and rows >= batch:
            last = pc.index(b["near"], b["near"][b.num_rows - 1]).as_py()
            if not last and rows < 4 * batch:
                continue
            if last:
                held[-1] = b.slice(0, last)
            yield stars(held)
            held, rows = ([b.slice(last)], b.num_rows - last) if last else ([], 0)
    if rows:
        yield stars(held)


def _contracted(edges: DataFrame, near: list[str], batch: int) -> DataFrame:
    """Edges with the same components, dealt by ``near``; much of one ``near`` is split over tasks."""
    dealt = edges.hint("rebalance", *(F.col(c) for c in near)).select("u", "v", F.concat_ws("\t", *near).alias("near"))
    return dealt.sortWithinPartitions("near").mapInArrow(lambda it: _stars(batch, it), dealt.select("u", "v").schema)


def _least(edges: DataFrame, n: int) -> DataFrame:
    """Rows (u, m): the smallest of a node and its neighbours ``v``. A table of its own,
    so that both sides of the join with it are plain shuffles, which Spark can split
    where a node has very many edges."""
    return written(fewer(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), n), "least")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both, n), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down, n)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _open(edges: DataFrame) -> bool:
    """Some node still hangs on two others, or on one that hangs itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    nodes = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))  # repeated edges count as open: a round drops them
    return not nodes.where("up > 1 or up > 0 and down > 0").isEmpty()


def components(edges: DataFrame, near: list[str] | None = None, batch: int = BATCH) -> DataFrame:
    """(node, root) of every node of rows (u, v): root is the smallest id reachable.

    Self-loops and repeated edges do no harm; no edges give an empty table. ``near``:
    columns of ``edges`` that nodes of a component mostly share.
    """
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), *(near or [])).where("u <> v")
    now = written(_contracted(down, near, batch) if near else down, "edges")
    n = None
    while _open(now):
        n = n or now.count()  # rounds never add edges
        after = written(fewer(_small_star(_large_star(now, n), n), n), "edges")
        forget(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
