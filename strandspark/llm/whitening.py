"""Embedding whitening by hierarchical SVD merging.

Every partition of the fit list (each different vector once) is reduced to a summary:
its number of vectors, their exact sums, and all singular values and right singular
vectors of the centred block. Two summaries merge without loss: the singular vectors of
both, scaled by their singular values, are stacked with one more row that corrects for
the two means, sqrt(n m / (n + m)) times their difference, and decomposed again. No
dimension is cut off on the way, so the last summary has the singular values of the
whole centred fit list, whatever the order of merging.

Summaries meet in groups of ``FAN``, level by level, until one is left; a summary has as
many numbers as the square of the dimensions, and no task holds more than a group of
them. Only the last one reaches the driver and the tasks that project vectors.

Defined results: rows whose vector is null or holds null or non-finite entries are
dropped, as are vectors of another length than most; scaled entries are cut to
2**28; repeated rows and equal vectors count once in the fit, and each has its rows in
the result; ids may be null; a component without variance (to double precision) has a
null ``whitened``, and so has every row where all vectors are equal; vectors of fewer
dimensions than components have as many components as dimensions; a deviation beyond
64 bits is null; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.llm.vectors import integer_vectors, lists, matrix
from strandspark.runtime import forget, written

SCALE, COMPONENTS = 256, 4
#: Summaries that one task merges.
FAN = 8
SUMMARY = "slot long, n long, total array<long>, values array<double>, vectors array<double>"


@dataclass
class Summary:
    n: int
    #: Exact sums of the vectors.
    total: np.ndarray
    #: Singular values of the centred vectors, falling, and their right singular vectors as rows.
    values: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.total / self.n

    @staticmethod
    def of(x: np.ndarray) -> Summary:
        """Of the rows of an integer matrix, of which there is at least one."""
        total = x.sum(0)
        values, vectors = _decomposed(x - total / len(x))
        return Summary(len(x), total, values, vectors)

    def merge(self, other: Summary) -> Summary:
        shift = np.sqrt(self.n * other.n / (self.n + other.n)) * (self.mean - other.mean)
        values, vectors = _decomposed(np.concatenate([self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, shift[None]]))
        return Summary(self.n + other.n, self.total + other.total, values, vectors)

    def row(self, slot: int) -> tuple:
        return slot, self.n, self.total.tolist(), self.values.tolist(), self.vectors.ravel().tolist()

    @staticmethod
    def from_row(n: int, total, values, vectors) -> Summary:
        total = np.asarray(total, np.int64)
        return Summary(int(n), total, np.asarray(values, float), np.asarray(vectors, float).reshape(-1, len(total)))


def _decomposed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, values, vectors = np.linalg.svd(x, full_matrices=False)
    return values, vectors


def _summaries(width: int, it):
    """One summary of a partition, merged batch by batch."""
    whole: Summary | None = None
    for b in it:
        if b.num_rows:
            own = Summary.of(matrix(b.column(0), width))
            whole = own if whole is None else whole.merge(own)
    if whole is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(("slot", "n", "total", "values", "vectors"), whole.row(TaskContext.get().partitionId())))], schema=_schema())


def _schema() -> pa.Schema:
    return pa.schema([("slot", pa.int64()), ("n", pa.int64()), ("total", pa.list_(pa.int64())), ("values", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))])


def _merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    own = [Summary.from_row(*r) for r in pdf.sort_values("slot")[["n", "total", "values", "vectors"]].itertuples(index=False)]
    while len(own) > 1:
        own = [a[0].merge(a[1]) if len(a) > 1 else a[0] for a in (own[i : i + 2] for i in range(0, len(own), 2))]
    return pd.DataFrame([own[0].row(int(key[0]))], columns=["slot", "n", "total", "values", "vectors"])


def fit(x: DataFrame, width: int) -> Summary | None:
    """Summary of the different vectors of the column ``x``; None where there are none."""
    level = written(x.mapInArrow(lambda it: _summaries(width, it), SUMMARY), "svd-summaries")
    most = level.agg(F.max("slot")).first()[0]
    if most is None:
        return None
    while most > 0:
        after = written(level.groupBy(F.floor(F.col("slot") / FAN).alias("slot")).applyInPandas(_merged, SUMMARY), "svd-summaries")
        forget(level)
        level, most = after, most // FAN
    return Summary.from_row(*level.select("n", "total", "values", "vectors").first())


@dataclass
class Whitening:
    summary: Summary
    components: int = COMPONENTS

    @property
    def variances(self) -> np.ndarray:
        """Eigenvalues of the covariance (divisor n), falling; as many as there are dimensions."""
        out = np.zeros(len(self.summary.total))
        out[: len(self.summary.values)] = self.summary.values**2 / self.summary.n
        return out

    @property
    def directions(self) -> np.ndarray:
        """Unit eigenvectors of the first components, as rows."""
        have, width = self.summary.vectors, len(self.summary.total)
        k = min(self.components, width)
        if len(have) < k:  # fewer vectors than dimensions: any directions at right angles to theirs
            have = np.concatenate([have, np.linalg.svd(have, full_matrices=True)[2][len(have) :]])
        return have[:k]

    def spread(self) -> np.ndarray:
        """Standard deviation of each component; nan where the vectors have none."""
        k = min(self.components, len(self.summary.total))
        e = self.variances
        least = max(self.summary.n, len(e)) * np.finfo(float).eps * np.sqrt(e[0])
        s = np.sqrt(e[:k])
        return np.where(s > least, s, np.nan)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of integer vectors."""
        return (x - self.summary.mean) @ self.directions.T / self.spread()

    def explained(self) -> list[float | None]:
        e = self.variances
        return [float(v / e.sum()) if e.sum() > 0 else None for v in e[: len(self.spread())]]

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over dimensions of (n x - total) squared."""
        n, total = self.summary.n, self.summary.total
        far = float(np.abs(x).max(initial=0)) * n + float(np.abs(total).max(initial=0))
        if far < 2.0**62 and far * far * x.shape[1] < 2.0**62:
            return ((n * x - total) ** 2).sum(1).tolist()
        whole = [sum((n * c - t) ** 2 for c, t in zip(row, total.tolist())) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in whole]


def identity_error(x: DataFrame, width: int, w: Whitening) -> float | None:
    """Largest entry of the whitened fit list's covariance less the identity, over components with variance."""
    live = np.flatnonzero(~np.isnan(w.spread()))
    if not len(live):
        return None

    def run(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([lists(w.project(matrix(b.column(0), width))[:, live], pa.float64())], names=["w"])

    pairs = [(i, j) for i in range(len(live)) for j in range(i, len(live))]
    got = x.mapInArrow(run, "w array<double>").agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of each row's first components."""
    own, width = integer_vectors(vectors, scale, vec_col, {"vec_id": id_col})
    schema = f"vec_id {dict(own.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not width:
        return own.sparkSession.createDataFrame([], schema)
    own = written(own, "whitening-vectors")
    different = written(own.select("x").distinct(), "whitening-fit")
    w = Whitening(fit(different, width), components)
    error, explained = identity_error(different, width, w), w.explained()
    forget(different)
    k = len(explained)

    def run(it):
        for b in it:
            x = matrix(b.column("x"), width)
            each = np.repeat(np.arange(b.num_rows), k)
            columns = [b.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(len(each), w.summary.n)), pa.array(w.deviation(x), pa.int64()).take(pa.array(each)), pa.array(w.project(x).ravel(), pa.float64(), from_pandas=True), pa.array(explained * b.num_rows, pa.float64()), pa.array([error] * len(each), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return own.mapInArrow(run, schema)
