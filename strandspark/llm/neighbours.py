"""Approximate nearest neighbours with balanced posting lists.

The index has two levels, so that the number of lists grows with the table while what
is held in one place grows with its square root only. A bounded sample of the vectors
gives the centroids of about ``sqrt(lists)`` cells, by k-means with a penalty for large
clusters, and a bounded sample of each cell's vectors, in a task of its own, those of
the cell's lists. Every vector is put into its nearest cell and there into the list of
its nearest centroid; boundary vectors also go into those cells, and those lists, whose
distance is within ``closure`` times of that.

Centroids are searched by neighbour graphs held in memory, one of the cells and one in
each cell: from several entries, the nearest node not yet expanded is expanded while
its distance is within ``ratio`` times the nearest one's. Of the lists so found those
are read whose distance is within ``ratio`` times the nearest one's over all cells (and
further ones while these hold too few vectors).

Every list is cut into parts of bounded length, and only where more queries than fit
into a block read a list are its parts met by several blocks; so no task holds more
than one part and one block. Each pair gives its k best by exact double distances, and
the best of these are the result. The cells' graph is the only broadcast.

Defined results: vectors that are null, all zero, of another length than most, or
that hold null or non-finite components take no part, nor do rows without an id;
rows with a query's own id are not its candidates; repeated rows count once; with
fewer than ``k`` candidates all are returned; an empty table gives an empty result;
other columns are not looked at. Any number of equal vectors may share a list.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandspark.runtime import forget, written


@dataclass(frozen=True)
class IndexConfig:
    per_list: int = 512
    #: Lists of one cell.
    max_lists: int = 2048
    #: Rows of the samples that centroids are fitted on: per centroid, and over all of one fit.
    sample_per_list: int = 48
    max_sample: int = 50_000
    closure: float = 1.02
    replicas: int = 4
    ratio: float = 1.25
    degree: int = 16
    #: Vectors of a part, and queries of a block; vectors that are put into a cell's lists at once.
    part: int = 4096
    cell_part: int = 32_768
    rounds: int = 12
    seed: int = 5


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows, by a matrix product (for ranking only)."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def balanced_centroids(x: np.ndarray, k: int, config: IndexConfig) -> np.ndarray:
    """k-means whose assignment makes full clusters dearer."""
    rng = np.random.default_rng(config.seed)
    c = x[rng.choice(len(x), k, replace=False)].astype(np.float64)
    size = np.full(k, len(x) / k)
    for _ in range(config.rounds):
        at = np.empty(len(x), np.int64)
        for s in range(0, len(x), 8192):
            d = distances(x[s : s + 8192].astype(np.float64), c)
            at[s : s + 8192] = (d * (1 + 0.02 * np.clip(size / (len(x) / k) - 1, -1, 5))).argmin(1)
        size = np.bincount(at, minlength=k).astype(float)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.choice(len(x), k)])
    return c


@dataclass
class CentroidGraph:
    """Centroids, their neighbours, entries of the search, and how many vectors each has."""

    centroids: np.ndarray
    near: list[np.ndarray]
    entries: np.ndarray
    #: Half the distance of each centroid to the next one: a query may be as near as that to any list's edge.
    edge: np.ndarray
    config: IndexConfig
    sizes: np.ndarray

    @staticmethod
    def build(c: np.ndarray, config: IndexConfig, sizes: np.ndarray | None = None) -> CentroidGraph:
        k = len(c)
        links: list[set[int]] = [set() for _ in range(k)]
        edge = np.zeros(k)
        for s in range(0, k, 1024):
            d = distances(c[s : s + 1024], c)
            order = np.argsort(d, 1)[:, : config.degree + 1]
            if k > 1:
                edge[s : s + 1024] = np.partition(d, 1, 1)[:, 1] / 2
            for i, row in enumerate(order, s):
                for j in map(int, row):
                    if i != j:
                        links[i].add(j)
                        links[j].add(i)
        for i in range(k):  # a ring, so that every node can be reached
            links[i].add((i + 1) % k)
            links[(i + 1) % k].add(i)
        near = [np.array(sorted(x - {i}), np.int64) for i, x in enumerate(links)]
        sizes = np.zeros(k, np.int64) if sizes is None else sizes
        return CentroidGraph(c, near, np.unique(np.linspace(0, k - 1, min(k, 8)).astype(np.int64)), edge, config, sizes)

    def search(self, q: np.ndarray, least: int) -> tuple[list[tuple[float, int]], float]:
        """(distance, centroid) of a query, nearest first, and the distance that counts as the
        nearest one's; the centroids hold ``least`` vectors if the graph does."""
        seen = np.zeros(len(self.centroids), bool)
        todo: list[tuple[float, int]] = []
        best, first = np.inf, np.inf

        def visit(nodes: np.ndarray) -> None:
            nonlocal best, first
            nodes = nodes[~seen[nodes]]
            if len(nodes):
                seen[nodes] = True
                d = np.sqrt(((self.centroids[nodes] - q) ** 2).sum(1))
                if (m := int(d.argmin())) >= 0 and d[m] < first:
                    first = float(d[m])
                    best = max(first, float(self.edge[nodes[m]]))
                for x in zip(d.tolist(), nodes.tolist()):
                    heapq.heappush(todo, x)

        size = self.sizes
        visit(self.entries)
        found: list[tuple[float, int]] = []
        held = 0
        while todo and (todo[0][0] <= self.config.ratio * best or held < least):
            d, i = heapq.heappop(todo)
            found.append((d, i))
            held += int(size[i])
            visit(self.near[i])
        found.sort()
        out, held = [], 0
        for d, i in found:
            if d > self.config.ratio * best and held >= least:
                break
            out.append((d, i))
            held += int(size[i])
        return out, best


def assign(v: np.ndarray, c: np.ndarray, config: IndexConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, centroid, nearest?) of vectors: each row's nearest centroid and those about as near."""
    reach = min(config.replicas, len(c))
    rows, places, first = [], [], []
    for s in range(0, len(v), 8192):
        d = distances(v[s : s + 8192], c)
        order = np.argpartition(d, reach - 1, 1)[:, :reach] if reach < len(c) else np.tile(np.arange(len(c)), (len(d), 1))
        dd = np.take_along_axis(d, order, 1)
        by = np.lexsort((order, dd), axis=1)
        order, dd = np.take_along_axis(order, by, 1), np.take_along_axis(dd, by, 1)
        row, col = np.nonzero(dd <= config.closure * dd[:, :1])
        rows.append(row + s)
        places.append(order[row, col])
        first.append(col == 0)
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((rows, np.int64), (places, np.int64), (first, bool)))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if len(column) else np.zeros((0, dim))


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part; v as doubles."""
    v = F.col("v")
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size("v") > 0)
    ok = ok & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return own.where(F.coalesce(ok, F.lit(False)))


def _drawn(id_col: str, seed: int, share: Column) -> Column:
    """A seeded share of the ids."""
    return F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 30)) < (share * F.lit(1 << 30)).cast("long") + 1


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", config: IndexConfig = IndexConfig()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row where
    ``is_query`` (a condition on ``vec_id``) holds; score is the Euclidean distance."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    own = valid_vectors(vectors, id_col, vec_col)
    lengths = own.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"))
    most = lengths.orderBy(F.desc("n"), "dim").first()
    if most is None:
        return spark.createDataFrame([], schema)
    dim, n, n_queries = most["dim"], most["n"], most["q"]
    own = own.where(F.size("v") == dim)

    n_lists = max(1, n // config.per_list)
    n_cells = max(1, round(n_lists**0.5))
    share = min(1.0, min(config.max_sample, config.sample_per_list * n_cells + 256) / n)
    picked = own.where(_drawn("vec_id", config.seed, F.lit(share)))
    x = _matrix(picked.orderBy("vec_id", F.xxhash64("v")).select(F.col("v").cast("array<float>")).toArrow()["v"], dim)
    if not len(x):
        x = _matrix(own.limit(1).select("v").toArrow()["v"], dim)
    x = np.unique(x, axis=0)
    graph = CentroidGraph.build(balanced_centroids(x, min(n_cells, len(x)), config), config)
    shared = spark.sparkContext.broadcast(graph)

    def to_cells(it):
        for b in it:
            row, cell, first = assign(_matrix(b.column(1), dim), shared.value.centroids, config)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(first), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row))], names=["cell", "first", "vec_id", "v"])

    cells = written(own.mapInArrow(to_cells, "cell int, first boolean, vec_id long, v array<double>"), "cells")
    counted = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("first").alias("own")).collect()  # a row per cell
    plan = []
    for r in counted:
        graph.sizes[r["cell"]] = r["own"]
        own_lists = int(min(config.max_lists, max(1, round(r["own"] / config.per_list))))
        plan.append((r["cell"], own_lists, min(1.0, min(config.max_sample, config.sample_per_list * own_lists + 256) / max(1, r["own"])), int(-(-r["n"] // config.cell_part))))
    plan = F.broadcast(spark.createDataFrame(plan, "cell int, own_lists int, share double, parts int"))  # a row per cell

    def fit(group: pa.Table) -> pa.Table:
        x = np.unique(_matrix(group["v"], dim).astype(np.float32), axis=0)
        c = balanced_centroids(x, min(group["own_lists"][0].as_py(), len(x)), config)
        return pa.table({"cell": pa.array([group["cell"][0].as_py()] * len(c), pa.int32()), "list": pa.array(range(len(c)), pa.int32()), "c": pa.array(list(c), pa.list_(pa.float64()))})

    sample = cells.where("first").join(plan, "cell").where(_drawn("vec_id", config.seed + 1, F.col("share")))
    lists = written(sample.select("cell", "own_lists", "v").orderBy("cell", "v").groupBy("cell").applyInArrow(fit, "cell int, list int, c array<double>"), "list-centroids")
    have = {r["cell"] for r in lists.select("cell").distinct().collect()}
    if rest := [(r["cell"], 0, graph.centroids[r["cell"]].tolist()) for r in counted if r["cell"] not in have]:  # nothing drawn
        lists = written(lists.unionByName(spark.createDataFrame(rest, lists.schema)), "list-centroids")

    def to_lists(vectors: pa.Table, centroids: pa.Table) -> pa.Table:
        v = _matrix(vectors["v"], dim)
        ids = centroids["list"].to_numpy()
        row, at, first = assign(v, _matrix(centroids["c"], dim), config) if len(v) and len(ids) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        own = first & vectors["first"].to_numpy()[row].astype(bool)
        cell = np.full(len(row), vectors["cell"][0].as_py() if len(row) else 0, np.int32)
        return pa.table({"cell": cell, "list": ids[at].astype(np.int32), "own": own, "vec_id": vectors["vec_id"].take(pa.array(row)), "v": vectors["v"].take(pa.array(row))})

    parted = cells.join(plan, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).select("cell", "part", "first", "vec_id", "v")
    repeated = lists.join(plan, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "part", "list", "c")
    postings = parted.groupBy("cell", "part").cogroup(repeated.groupBy("cell", "part")).applyInArrow(to_lists, "cell int, list int, own boolean, vec_id long, v array<double>")
    postings = written(postings, "postings")
    forget(cells)
    sizes = written(postings.groupBy("cell", "list").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("own")), "list-sizes")
    sized = spark.sparkContext.broadcast(graph)
    least = 2 * (k + 1)

    def to_query_cells(it):
        for b in it:
            rows, found = [], []
            for i, q in enumerate(_matrix(b.column(1), dim)):
                near, _ = sized.value.search(q, least)
                rows.extend([i] * len(near))
                found.extend(c for _, c in near)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), b.column(0).take(pa.array(rows, pa.int64())), b.column(1).take(pa.array(rows, pa.int64()))], names=["cell", "query_id", "q"])

    queries = own.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = written(queries.mapInArrow(to_query_cells, "cell int, query_id long, q array<double>"), "query-cells")
    blocks = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / config.part).cast("int").alias("blocks"))
    blocks = F.broadcast(blocks)  # a row per cell

    def to_query_lists(queries: pa.Table, centroids: pa.Table) -> pa.Table:
        rows, found, far, best = [], [], [], []
        if len(queries) and len(centroids):
            ids = centroids["list"].to_numpy()
            g = CentroidGraph.build(_matrix(centroids["c"], dim), config, centroids["own"].to_numpy())
            for i, q in enumerate(_matrix(queries["q"], dim)):
                near, first = g.search(q, least)
                rows.extend([i] * len(near))
                best.extend([first] * len(near))
                far.extend(d for d, _ in near)
                found.extend(int(ids[j]) for _, j in near)
        at = pa.array(rows, pa.int64())
        return pa.table({"cell": queries["cell"].take(at), "list": pa.array(found, pa.int32()), "far": pa.array(far, pa.float64()), "best": pa.array(best, pa.float64()), "query_id": queries["query_id"].take(at), "q": queries["q"].take(at)})

    blocked = asked.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).select("cell", "block", "query_id", "q")
    known = lists.join(sizes.select("cell", "list", "own"), ["cell", "list"])
    repeated = known.join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "block", "list", "c", "own")
    probes = blocked.groupBy("cell", "block").cogroup(repeated.groupBy("cell", "block")).applyInArrow(to_query_lists, "cell int, list int, far double, best double, query_id long, q array<double>")
    before = Window.partitionBy("query_id").orderBy("far", "cell", "list").rowsBetween(Window.unboundedPreceding, -1)
    probes = probes.join(sizes.select("cell", "list", "own"), ["cell", "list"])
    probes = probes.withColumns({"best": F.min("best").over(Window.partitionBy("query_id")), "held": F.coalesce(F.sum("own").over(before), F.lit(0))})
    probes = written(probes.where((F.col("far") <= F.lit(config.ratio) * F.col("best")) | (F.col("held") < least)).select("cell", "list", "query_id", "q"), "query-lists")
    read = probes.groupBy("cell", "list").agg(F.ceil(F.count(F.lit(1)) / config.part).cast("int").alias("blocks"))
    read = written(read.join(sizes.select("cell", "list", F.ceil(F.col("n") / config.part).cast("int").alias("parts")), ["cell", "list"]), "lists-read")

    def search(queries: pa.Table, part: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        q, v = _matrix(queries["q"], dim), _matrix(part["v"], dim)
        qid, vid = queries["query_id"].to_numpy(), part["vec_id"].to_numpy()
        if len(q) and len(v):
            repeats = int(np.unique(vid, return_counts=True)[1].max())
            for s in range(0, len(q), 256):
                near = distances(q[s : s + 256], v)
                # The product's rounding may swap close neighbours, so some more are measured exactly.
                top = min(len(v), (k + 1) * repeats)
                edge = np.partition(near, top - 1, 1)[:, top - 1]
                for i, d in enumerate(near, s):
                    at = np.flatnonzero(d <= edge[i - s] * (1 + 1e-6) + 1e-9)
                    at = at[vid[at] != qid[i]]
                    exact = np.sqrt(((v[at] - q[i]) ** 2).sum(1))
                    best = np.lexsort((vid[at], exact))
                    at, exact = at[best], exact[best]
                    _, one = np.unique(vid[at], return_index=True)
                    one = np.sort(one)[:k]
                    for col, x in zip(out, (np.full(len(one), qid[i]), vid[at][one], exact[one])):
                        col.append(x)
        cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2].astype(np.float64))})

    key = ["cell", "list", "part", "block"]
    left = probes.join(read, ["cell", "list"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*key, "query_id", "q")
    right = postings.join(read, ["cell", "list"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*key, "vec_id", "v")
    pairs = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
